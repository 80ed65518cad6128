"""DuckDB SQL with the result each query must have."""

from __future__ import annotations

from lexivec.functions.place_draws import RANGE, STEPS
from operator_queries import (
    CAP, DIGITS, EPOCH, MAX_LENGTH, MIN_COUNT, NEGATIVE, OBJECTIVES, SAMPLE, SEED, SHORT_LENGTH, SLOW,
    SMALL_BUFFER, TOP, TRAINING, WINDOW,
)

WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"

LEARNERS = TRAINING.num_partitions


def hashed(place: str) -> str:
    """The hash behind starting vectors and the trainer's draws, of an integer expression."""
    out = f"({place}) % {RANGE}"
    for factor, shift in STEPS:
        out = f"({out}) * {factor} % {RANGE}"
        out = f"list_transform([{out}], lambda x: xor(x, x >> {shift}))[1]"
    return out


def unit(number: str) -> str:
    """The draw of that number for a row with ``key``, in [0, 1)."""
    both = f"list_transform([{hashed(f'key + {number}')}], lambda h: (h << 21) + ({hashed('h + 1')} >> 10))[1]"
    return f"({both} / {float(1 << 52)})"


def placed_draw(purpose: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', '0', sentence, '{purpose}')), 1, 13))::bigint"


def windows(epoch: int) -> str:
    """The trainer's centers of an epoch with their radius, if they are kept."""
    key = hashed(f"({hashed(f'({hashed(f'sentence + {SEED}')}) + {epoch}')}) + pos")
    return f"""
        select * from (
          select k.*, {WINDOW} - floor({unit('0')} * {WINDOW})::bigint as r, {unit('1')} as u
          from (select p.doc_id, p.chunk, p.sentence, p.learner, s.pos, s.center, {key} as key,
                       greatest(1 - {float(LEARNERS)} * (p.words_before + s.pos) / (2 * t + 1), 1e-4) as rate
                from spots s join placed p using (doc_id, chunk) cross join total) k) w
        join keep on keep.word_id = w.center where w.u <= keep.keep"""


def window_pairs(name: str) -> str:
    return f"""
        select c.learner, c.sentence, c.pos, c.center, c.key, c.rate, c.r, x.pos - c.pos as off, x.center as context
        from {name} c join spots x on x.doc_id = c.doc_id and x.chunk = c.chunk and x.pos <> c.pos
         and x.pos between c.pos - c.r and c.pos + c.r"""


# Building blocks: each name is a table expression, listed with what it builds on.
PARTS = {
    "tok": ((), f"""
        select doc_id, list_filter(regexp_split_to_array(lower(text), '{WORD_BREAK}'),
                                   lambda x: x <> '') as tokens from documents"""),
    "words": (("tok",), """
        select doc_id, unnest(tokens) as word,
               (generate_subscripts(tokens, 1) - 1)::integer as pos from tok"""),
    "counts": (("words",), "select word, count(*) as cnt from words group by word"),
    "vocab": (("counts",), f"""
        select word, cnt, (row_number() over (order by cnt desc, word) - 1)::integer as word_id
        from counts where cnt >= {MIN_COUNT}"""),
    "total": (("vocab",), "select sum(cnt)::double as t, sum(pow(cnt, 0.75)) as z from vocab"),
    "keep": (("vocab", "total"), f"""
        select word_id, sqrt({SAMPLE} * t / cnt) + {SAMPLE} * t / cnt as keep
        from vocab cross join total"""),
    "dist": (("vocab", "total"), """
        select word_id, p, coalesce(lag(hi) over (order by word_id), 0.0) as lo, hi
        from (select word_id, pow(cnt, 0.75) / z as p,
                     sum(pow(cnt, 0.75)) over (order by word_id) / z as hi
              from vocab cross join total)"""),
    "cells": (("dist",), """
        select word_id, lo, hi, unnest(range(floor(lo * 16384)::bigint,
                                             floor(hi * 16384)::bigint + 1)) as cell from dist"""),
    "enc": (("words", "vocab"), """
        select doc_id, row_number() over (partition by doc_id order by pos) - 1 as rn, word_id
        from words join vocab using (word)"""),
    "spots": (("enc",), f"""
        select doc_id, (rn // {MAX_LENGTH})::integer as chunk, (rn % {MAX_LENGTH})::integer as pos,
               word_id as center,
               {WINDOW} - (('0x' || substr(md5(concat_ws('|', '{SEED}', '{EPOCH}', doc_id,
                 rn // {MAX_LENGTH}, rn % {MAX_LENGTH}, 'win')), 1, 13))::bigint % {WINDOW}) as r
        from enc"""),
    "kept": (("spots", "keep"), f"""
        select s.* from spots s join keep k on k.word_id = s.center
        where ('0x' || substr(md5(concat_ws('|', '{SEED}', '{EPOCH}', doc_id, chunk, pos, 'sub')),
                              1, 13))::bigint / 4503599627370496.0 <= k.keep"""),
    "pairs": (("kept", "spots"), """
        select c.doc_id, c.chunk, c.pos, c.r, c.center, x.pos - c.pos as off, x.center as context
        from kept c join spots x on x.doc_id = c.doc_id and x.chunk = c.chunk and x.pos <> c.pos
         and x.pos between c.pos - c.r and c.pos + c.r"""),
    "allpairs": (("spots",), """
        select c.doc_id, c.chunk, c.pos, c.center, x.pos - c.pos as off, x.center as context
        from spots c join spots x on x.doc_id = c.doc_id and x.chunk = c.chunk and x.pos <> c.pos
         and x.pos between c.pos - c.r and c.pos + c.r"""),
    "examples": (("pairs",), """
        select doc_id, chunk, pos, center, r as radius,
               string_agg(context, ' ' order by off) as ctx
        from pairs group by all"""),
    "sents": (("enc",), f"""
        select doc_id, chunk, n, first, row_number() over (order by md5(ids), ids) - 1 as sentence
        from (select doc_id, (rn // {MAX_LENGTH})::integer as chunk, count(*) as n,
                     string_agg(word_id, ' ' order by rn) as ids, arg_min(word_id, rn) as first
              from enc group by doc_id, rn // {MAX_LENGTH})"""),
    "placed": (("sents",), f"""
        select *, (sum(n) over (partition by learner order by turn, sentence) - n)::bigint as words_before
        from (select *, ({placed_draw('learner')} % {LEARNERS})::integer as learner, {placed_draw('turn')} as turn
              from sents)"""),
    "windows": (("spots", "placed", "total", "keep"), windows(1)),
    "windows2": (("spots", "placed", "total", "keep"), windows(2)),
    "wpairs": (("windows", "spots"), window_pairs("windows")),
    "wpairs2": (("windows2", "spots"), window_pairs("windows2")),
    # Huffman: runs of equal counts are merged, see lexivec/operators/huffman.py.
    "hist": (("vocab",), """
        select list(cnt order by cnt desc) as w, list(n order by cnt desc) as s, list(past order by cnt desc) as past,
               max(past) as v
        from (select cnt, count(*) as n, max(word_id) + 1 as past from vocab group by cnt)"""),
    "merged": (("hist",), """
        with recursive step(lft, queue, turn, unpaired, inner_first, leaf, size, began) as (
          select len(w)::bigint, []::struct(w bigint, f bigint, n bigint)[], 0::bigint, 0::bigint, -1::bigint, -1::bigint,
                 0::bigint, 0::bigint from hist
          union all
          select case when inner_ then lft else lft - 1 end,
                 rest || (case when turn % 2 = 1 then [{'w': unpaired + rw, 'f': turn // 2, 'n': 1::bigint}] else [] end)
                   || (case when rn - turn % 2 > 1
                       then [{'w': 2 * rw, 'f': (turn + turn % 2) // 2, 'n': (rn - turn % 2) // 2}] else [] end),
                 turn + rn, rw, case when inner_ then q.f else -1 end, case when inner_ then -1 else lft end, rn, turn
          from (select lft, turn, unpaired, inner_, queue[1] as q, case when inner_ then queue[2:] else queue end as rest,
                       case when inner_ then queue[1].w else hist.w[lft] end as rw,
                       case when inner_ then queue[1].n else hist.s[lft] end as rn
                from (select step.*, len(queue) > 0 and (lft = 0 or queue[1].w <= hist.w[greatest(lft, 1)]) as inner_
                      from step cross join hist where turn < 2 * hist.v - 2) cross join hist))
        select inner_first, leaf, size, began from step where size > 0"""),
    "paths": (("merged", "hist", "vocab"), """
        with recursive climb(word_id, node, bit) as (
          select word_id, turn // 2, turn % 2
          from (select v.word_id, m.began + hist.past[m.leaf] - 1 - v.word_id as turn
                from vocab v cross join hist join merged m on m.leaf > 0 and hist.w[greatest(m.leaf, 1)] = v.cnt)
          union all
          select word_id, turn // 2, turn % 2
          from (select c.word_id, m.began + c.node - m.inner_first as turn
                from climb c join merged m on m.inner_first >= 0 and c.node between m.inner_first and m.inner_first + m.size - 1))
        select * from climb"""),
    "model": (("vocab",), """
        select word, word_id, cnt as count, embedding::double[] as vector,
               sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm
        from vocab join embeddings on vec_id = word_id"""),
    "asked": (("model",), "select word as q, vector as qv from model where word_id = 0"),
    "scores": (("model", "asked"), """
        select word, q, list_cosine_similarity(vector, qv) as s from model cross join asked"""),
    "docmean": (("tok", "words", "model"), """
        select t.doc_id, d.dim, coalesce(s.total, 0.0) / greatest(len(t.tokens), 1) as value
        from tok t
        cross join (select unnest(range((select max(len(vector)) from model)))::integer as dim) d
        left join (select doc_id, dim, sum(v) as total
                   from words join (select word, unnest(vector) as v,
                                           generate_subscripts(vector, 1) - 1 as dim from model)
                   using (word) group by doc_id, dim) s
          on s.doc_id = t.doc_id and s.dim = d.dim"""),
}


def r6(x: str) -> str:
    return f"case when abs({x}) < 5e-7 then 0.0 else round({x}, 6) end"


def sql(body: str, *parts: str) -> str:
    """``body`` with the parts it names, and those they build on, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in parts:
        add(name)
    ctes = ",\n".join(f"{name} as materialized ({PARTS[name][1]})" for name in order)
    return f"with {ctes}\n{body}" if ctes else body


def draw(*parts: str) -> str:
    text = ", ".join((f"'{SEED}'", f"'{EPOCH}'", *parts))
    return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::bigint / 4503599627370496.0"


def elements(columns: str, source: str, vector: str = "vector") -> str:
    value = f"unnest({vector})::double"
    return (f"select {columns}, dim, {r6('v')} as value from (select *, {value} as v, "
            f"(generate_subscripts({vector}, 1) - 1)::integer as dim from {source})")


def negative_draws(rows: str, keys: str, extra: str = "") -> str:
    """Draws for ``rows``; u skips the interval of the center."""
    return f"""
        select e.* exclude (u), iv.word_id as target
        from (select *, case when u0 >= clo then u0 + cp else u0 end as u
              from (select r.*, k.draw, c.p as cp, c.lo as clo,
                           {draw(keys, "'neg'", "k.draw")} * (1 - c.p) as u0
                    from {rows} r join dist c on c.word_id = r.center
                    cross join (select unnest(range(1, {NEGATIVE + 1})) as draw) k)) e
        join cells iv on iv.cell = floor(e.u * 16384)::bigint and e.u >= iv.lo and e.u < iv.hi"""


TRAINED = """
    select word, word_id, cnt as count, {size}::integer as n, true as sound{more} from vocab"""


INIT_HASH = hashed("p")


def added(cbow: int = 0, hs: bool = False, negative: int = NEGATIVE, vector_size: int = SLOW.vector_size) -> str:
    """What the first epoch adds to the output weights at a vanishing rate: every target's label less one half, times the
    hidden vector made of starting vectors; the mean of the learners that met the target."""
    center = "learner, sentence, pos, center, key, rate"
    examples = f"(select distinct {center}, 2 as first from wpairs)" if cbow else (
        f"(select {center}, off, context, 2 + (off + {WINDOW}) * {NEGATIVE} as first from wpairs)")
    targets = []
    if hs:
        targets.append(f"""select x.*, 'hs' as kind, p.node as target, 0.5 - p.bit as g
                           from {examples} x join paths p on p.word_id = x.center""")
    if negative:
        targets.append(f"select x.*, 'neg' as kind, x.center as target, 0.5 as g from {examples} x")
        targets.append(f"""
            select e.* exclude (u), 'neg' as kind, iv.word_id as target, -0.5 as g
            from (select * exclude (u0, p, lo), case when u0 >= lo then u0 + p else u0 end as u
                  from (select x.*, c.p, c.lo, {unit('first + d')} * (1 - c.p) as u0
                        from {examples} x join dist c on c.word_id = x.center
                        cross join (select unnest(range({NEGATIVE})) as d) k)) e
            join cells iv on iv.cell = floor(e.u * 16384)::bigint and e.u >= iv.lo and e.u < iv.hi""")
    every = " union all ".join(targets)
    slot, share = "0", "1"
    if cbow:
        every = f"""select t.*, w.off, w.context, w.r, count(*) over (partition by t.sentence, t.pos, t.kind, t.target, t.copy) as n
                    from (select *, row_number() over (partition by sentence, pos, kind, target) as copy from ({every})) t
                    join wpairs w using (sentence, pos)"""
        slot, share = ("off + r", "1") if cbow == 2 else ("0", "n")
    width = vector_size * (2 * WINDOW + 1 if cbow == 2 else 1)
    start = f"""(select word_id, dim, ({hashed("p")} / {float(RANGE)} - 0.5) / {vector_size} as x
                 from (select word_id, dim, word_id::bigint * {vector_size} + dim + {SEED} as p
                       from vocab cross join (select unnest(range({vector_size})) as dim)))"""
    value = f"case when abs(value) < {0.5 * 10**-DIGITS} then 0.0 else round(value, {DIGITS}) end"
    return f"""
        select kind, row_id, dim, {value} as value from (
          select m.kind, m.target::bigint as row_id, d.dim::integer as dim, coalesce(f.total, 0.0) / m.learners as value
          from (select kind, target, count(distinct learner) as learners from sums group by kind, target) m
          cross join (select unnest(range({width})) as dim) d
          left join (select kind, target, slot * {vector_size} + dim as dim, sum(g * x) as total
                     from sums join {start} v on v.word_id = sums.context
                     group by kind, target, slot * {vector_size} + dim) f
            on f.kind = m.kind and f.target = m.target and f.dim = d.dim)""", f"""
        select kind, learner, target, {slot} as slot, context, sum(g * rate / {share}) as g
        from ({every}) group by all"""


def added_sql(**objective) -> str:
    body, sums = added(**objective)
    needed = ["wpairs", "vocab"] + ["paths"] * bool(objective.get("hs")) + ["cells"] * (objective.get("negative", NEGATIVE) > 0)
    with_parts = sql("", *needed)
    return f"{with_parts.rstrip()},\nsums as materialized ({sums})\n{body}"


ORACLE = {
    "corpus_tokens": sql(
        "select doc_id, len(tokens) as n, array_to_string(tokens, ' ') as tokens from tok", "tok"),
    "dictionary_source": sql(f"""
        select word, count(*) as cnt from (
          select word from words union all
          select unnest(list_filter(regexp_split_to_array(lower(text), '{WORD_BREAK}'),
                                    lambda x: x <> '')) from conversations)
        group by word having count(*) >= {MIN_COUNT}""", "words"),
    "model_save": sql(elements("word, word_id, count", "model"), "model"),
    "model_load": sql(elements(f"word, word_id, count, {r6('norm')} as norm", "model"), "model"),
    "model_metadata": sql("""
        select 'lexivec.WordVectorsModel' as class, '1.0' as version,
               max(len(vector))::integer as "vectorSize", count(*) as "numWords" from model""",
        "model"),
    "write_partition_plan": sql(f"""
        select count(*) as num_words, max(len(vector))::integer as vector_size,
               (4 * max(len(vector)) + 15) * count(*) // {SMALL_BUFFER} + 1 as num_partitions
        from model""", "model"),
    "explode_tokens": sql("select doc_id, pos, word from words", "words"),
    "min_count_filter": sql(f"select word, cnt from counts where cnt >= {MIN_COUNT}", "counts"),
    "oov_filter_encode": sql(
        "select doc_id, string_agg(word_id, ' ' order by rn) as ids from enc group by doc_id", "enc"),
    "sentence_chunks": sql(f"""
        select doc_id, (rn // {SHORT_LENGTH})::integer as chunk, count(*)::integer as n,
               string_agg(word_id, ' ' order by rn) as ids
        from enc group by doc_id, rn // {SHORT_LENGTH}""", "enc"),
    "append_output_column": sql(f"""
        select d.doc_id, d.lang, d.source, d.n_chars, len(t.tokens)::integer as n_tokens,
               (select max(len(vector)) from model)::integer as n_features,
               {r6("m.value")} as first_feature
        from documents d join tok t using (doc_id) join docmean m using (doc_id)
        where m.dim = 0""", "docmean"),
    "validate_input_schema": sql(
        "select doc_id, len(tokens)::integer as n_tokens from tok", "tok"),
    "word_lookup": sql(elements("word", "(select * from model where word_id = 0)"), "model"),
    "word_count": sql("select word, cnt from counts", "counts"),
    "train_word_total": sql("select sum(cnt)::bigint as total from vocab", "vocab"),
    "unigram_distribution": sql(
        f"select word_id, {r6('p')} as p, {r6('lo')} as lo, {r6('hi')} as hi from dist", "dist"),
    "parameter_average": f"""
        select label, dim, {r6("avg(v)::float::double")} as value
        from (select label, unnest(embedding)::double as v,
                     (generate_subscripts(embedding, 1) - 1)::integer as dim from embeddings)
        group by label, dim""",
    "doc_mean_vector": sql(f"select doc_id, dim, {r6('value')} as value from docmean", "docmean"),
    "vector_norms": sql(f"select word, {r6('norm')} as norm from model", "model"),
    "vocab_rank": sql("select word, cnt, word_id from vocab", "vocab"),
    "vocab_cap": sql(f"""
        select word, cnt, word_id from vocab
        where (select count(*) from vocab) <= {CAP}
           or cnt > (select greatest({MIN_COUNT + 1}, max(cnt)) from vocab where word_id = {CAP})""",
        "vocab"),
    "topk_bounded": sql(
        f"select word, {r6('s')} as similarity from scores order by s desc, word limit {2 * TOP}",
        "scores"),
    "join_vectors_counts": sql(
        f"select word, count, {r6('vector[1]')} as first from model", "model"),
    "token_id_join": sql(
        "select doc_id, pos, word_id from words join vocab using (word)", "words", "vocab"),
    "token_vector_join": sql(f"""
        select doc_id, count(vector) as known, count(*) as n,
               {r6("sum(coalesce(vector[1], 0.0))")} as first_sum
        from words left join model using (word) group by doc_id""", "words", "model"),
    "context_pairs": sql("""
        select doc_id, chunk, count(*) as pairs, sum(center::bigint * context)::bigint as products,
               sum(off * context)::bigint as weighted
        from allpairs group by doc_id, chunk""", "allpairs"),
    "negative_interval_join": sql(f"""
        select iv.word_id as target, count(*) as draws, sum(pos)::bigint as positions
        from (select pos, {draw("doc_id", "chunk", "pos", "'u'")} as u from spots) s
        join cells iv on iv.cell = floor(s.u * 16384)::bigint and s.u >= iv.lo and s.u < iv.hi
        group by iv.word_id""", "spots", "cells"),
    "cosine_scores": sql(f"select word, {r6('s')} as similarity from scores", "scores"),
    "keep_probability": sql(f"select word_id, {r6('keep')} as keep from keep", "keep"),
    "subsample_centers": sql("select doc_id, chunk, pos, center from kept", "kept"),
    "dynamic_radius": sql("select doc_id, chunk, pos, r::integer as radius from spots", "spots"),
    "negative_samples": sql(f"""
        select target, count(*) as draws, sum(center)::bigint as centers,
               sum(draw)::bigint as numbers
        from ({negative_draws("(select distinct doc_id, chunk, pos, center from pairs)",
                              "doc_id, chunk, pos")}) group by target""", "pairs", "cells"),
    "training_examples_cbow": sql(
        "select doc_id, chunk, pos, center, radius::integer as radius, ctx from examples", "examples"),
    "training_examples_concat": sql("""
        select doc_id, chunk, (off + r)::integer as slot, count(*) as n,
               sum(context)::bigint as contexts, sum(center::bigint * pos)::bigint as spots
        from pairs group by doc_id, chunk, off + r""", "pairs"),
    "hs_training_rows": sql("""
        select node, label, sum(n)::bigint as n, sum(contexts)::bigint as contexts
        from (select p.node::integer as node, (1 - p.bit)::integer as label, n, contexts
              from (select center, count(*) as n, sum(context) as contexts from pairs group by center) c
              join paths p on p.word_id = c.center)
        group by node, label""", "pairs", "paths"),
    "neg_training_rows": sql(f"""
        select target, label, count(*) as n, sum(context)::bigint as contexts,
               sum(center)::bigint as centers
        from (select center as target, 1 as label, context, center from pairs
              union all
              select target, 0, context, center
              from ({negative_draws("pairs", "doc_id, chunk, pos, off")}))
        group by target, label""", "pairs", "cells"),
    "learning_rate_schedule": sql(f"""
        select learner, sentence, words_before,
               round(greatest({TRAINING.step_size} * (1 - ({float(LEARNERS)} * words_before + t) / (2 * t + 1)),
                              {TRAINING.step_size} * 1e-4), 9) as alpha
        from placed cross join total""", "placed", "total"),
    "modified_rows": sql(f"""
        select distinct 'in' as kind, context::bigint as row_id from wpairs
        union all
        select distinct 'neg', target::bigint from (
          select center as target from wpairs
          union all
          select iv.word_id
          from (select case when u0 >= lo then u0 + p else u0 end as u
                from (select c.p, c.lo, {unit('2 + d')} * (1 - c.p) as u0
                      from (select distinct center, key, sentence, pos from wpairs) x join dist c on c.word_id = x.center
                      cross join (select unnest(range({NEGATIVE})) as d) k)) e
          join cells iv on iv.cell = floor(e.u * 16384)::bigint and e.u >= iv.lo and e.u < iv.hi)""", "wpairs", "cells"),
    "init_vectors": sql(f"""
        select word_id, count(*)::integer as n, round(max(v)::float::double, 8) as high,
               round(min(v)::float::double, 8) as low
        from (select word_id, ({INIT_HASH} / {float(RANGE)} - 0.5) / {TRAINING.vector_size} as v
              from (select word_id, word_id::bigint * {TRAINING.vector_size} + dim + {SEED} as p from vocab
                    cross join (select unnest(range({TRAINING.vector_size})) as dim) d))
        group by word_id""", "vocab"),
    "shuffle_sentences": sql(
        "select sentence, learner, turn, n::integer as n, first::integer as first from placed", "placed"),
    "training_metrics": sql(f"""
        select e.epoch::integer as epoch, learner, e.epoch / 2.0::double as progress, sum(n)::bigint as words,
               any_value(case e.epoch when 1 then x1 else x2 end)::bigint as examples, sum(n)::bigint as noted,
               round(greatest({TRAINING.step_size} * (1 - ({float(LEARNERS)} * sum(n) + (e.epoch - 1) * any_value(t)) / (2 * any_value(t) + 1)),
                              {TRAINING.step_size} * 1e-4), 9) as alpha, true as sound
        from placed join (select learner, count(distinct (sentence, pos)) as x1 from wpairs group by learner) a using (learner)
        join (select learner, count(distinct (sentence, pos)) as x2 from wpairs2 group by learner) b using (learner)
        cross join total cross join (values (1), (2)) e(epoch)
        group by e.epoch, learner""", "placed", "wpairs", "wpairs2", "total"),
    "fit_epochs": sql(TRAINED.format(size=TRAINING.vector_size, more=", true as learned"), "vocab"),
    "flagship_fit": sql(f"""
        select word as query, least({TOP}, n - 1)::bigint as found, least({TOP}, n - 1)::integer as last,
               true as sound, 0::integer as itself
        from vocab cross join (select count(*) as n from vocab)""", "vocab"),
    **{f"train_{name}": added_sql(**objective) for name, objective in OBJECTIVES.items()},
    "get_vectors": sql(elements("word", "model"), "model"),
    "get_vocab": sql("select word, count from model", "model"),
    "find_synonyms_word": sql(f"""
        select word, {r6('s')} as similarity from scores where word <> q
        order by s desc, word limit {TOP}""", "scores"),
    "find_synonyms_vector": sql(
        f"select word, {r6('s')} as similarity from scores order by s desc, word limit {TOP}",
        "scores"),
    "find_synonyms_batch": sql(f"""
        select query, word, {r6('s')} as similarity, rank::integer as rank
        from (select query, word, s,
                     row_number() over (partition by query order by s desc, word) as rank
              from (select q.word as query, m.word,
                           list_cosine_similarity(q.vector, m.vector) as s
                    from model q join model m on q.word <> m.word))
        where rank <= {TOP}""", "model"),
    "transform_documents": sql(
        f"select doc_id, dim, {r6('value')} as value from docmean", "docmean"),
    "stream_transform_documents": sql(
        f"select doc_id, dim, {r6('value')} as value from docmean", "docmean"),
    "model_from_table": f"""
        select word, (row_number() over (order by count desc, word) - 1)::integer as word_id, count,
               {r6("norm")} as norm
        from (select vec_id::varchar as word, sqrt(list_sum(list_transform(
                       embedding::double[], lambda x: x * x))) as norm from embeddings)
        join (select (doc_id % 1000)::varchar as word, count(*) as count from documents group by 1)
        using (word)""",
}

"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import ascii_lower, small

PREFIX_HEX = 8  # 32 bits of the digest are joined on
BROADCAST_RULES = 1 << 18
SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its digest; ``block`` wins over ``allow`` for the same pair.
    Rules with a null or an empty host fit nothing."""
    given = rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), "action")
    one = given.dropna().filter("h != ''").groupBy("h", "p").agg(F.max("action").alias("action"))
    full = digest(F.col("h"), F.col("p"))
    return one.select(
        F.substring(full, 1, PREFIX_HEX).alias("rule_prefix"), full.alias("rule_digest"),
        F.concat("h", "p").alias("rule_text"), F.length("h").alias("rule_host"), "action",
        F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("path_chars"))


def judge_urls(rows: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``rows`` plus host, path, rule and verdict (allow or block).

    ``rules`` has host, path and action. A rule fits its host and all subdomains when the path
    starts with the rule's path; of several the longest rule wins, then the one with the longer
    host. Without any the rule is null and the verdict ``default``. Repeated rows come out as
    often as they came in; input columns called host, path, rule or verdict are replaced; columns
    that cannot be grouped (maps) are refused by Spark.

    Each row is expanded into (host suffix, path prefix) expressions for the label counts and
    path lengths that rules have, so their number is bounded by the rules and the URL. They meet
    the rules on a short hash prefix; the digest decides. Equal rows are counted first, and the
    choice among rules groups by the same columns, so that there is one shuffle. A rule table
    beyond ``broadcast_rules`` is copied once per salt and joined in a shuffle.
    """
    made = ("host", "path", "rule", "verdict")
    keep = [c for c in rows.columns if c.lower() not in made]
    known = prepared_rules(rules)
    shapes = known.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("path_chars"))).first()
    keys = [f"k{i}" for i in range(len(keep))]
    base = (rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, keys)])
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    host, path = url_parts(F.col(keys[keep.index(url)]))
    base = base.withColumns({"u_host": host, "u_path": path})

    def ints(values):
        return F.lit([int(v) for v in values]).cast("array<int>")

    suffixes = F.filter(ints(shapes[0]), lambda k: k <= F.size(F.split("u_host", r"\.")))
    prefixes = F.filter(ints(shapes[1]), lambda n: n <= F.length("u_path"))
    pairs = F.flatten(F.transform(suffixes, lambda k: F.transform(prefixes, lambda n: F.struct(
        F.call_function("substring_index", F.col("u_host"), F.lit("."), -k).alias("h"),
        F.substr(F.col("u_path"), F.lit(1), n).alias("p")))))
    expanded = base.withColumn("e", F.explode_outer(pairs))
    expanded = expanded.withColumn("full", digest(F.col("e.h"), F.col("e.p"))).drop("e")
    expanded = expanded.withColumn("short", F.substring("full", 1, PREFIX_HEX))
    known = known.drop("labels", "path_chars")
    meets = (F.col("short") == F.col("rule_prefix")) & (F.col("full") == F.col("rule_digest"))
    if small(known, broadcast_rules, "rule_text"):
        joined = expanded.join(F.broadcast(known), meets, "left")
    else:
        known = known.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expanded = expanded.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
        joined = expanded.join(known, meets & (F.col("salt") == F.col("rule_salt")), "left")
    rank = F.when(F.col("rule_text").isNotNull(),
                  F.struct(F.length("rule_text"), F.col("rule_host")))
    best = joined.groupBy(*keys, "copies", "u_host", "u_path").agg(
        F.max_by(F.struct("rule_text", "action"), rank).alias("best"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, keep)], F.col("u_host").alias("host"),
        F.col("u_path").alias("path"), F.col("best.rule_text").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))

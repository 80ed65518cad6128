"""The update rules one example at a time, in plain Python: what training must come to."""

import bisect
import collections
import hashlib
import math

import numpy as np
from test_huffman import merged_word_by_word

RANGE = 1 << 31


def mixed(x):
    x %= RANGE
    for factor, shift in ((1103515245, 15), (69069, 13), (1664525, 16)):
        x = x * factor % RANGE
        x ^= x >> shift
    return x


def place_key(seed, epoch, sentence, pos):
    key = mixed(sentence % RANGE + seed % RANGE)
    key = mixed(key + sentence // RANGE + epoch)
    return mixed(key + pos)


def unit(key, number):
    high = mixed(key + number)
    return ((high << 21) + (mixed(high + 1) >> 10)) / 2**52


def md5_draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def place(texts, ids, settings):
    """Per learner its sentences in order: (number, word ids)."""
    chunks = []
    for text in texts:
        known = [ids[w] for w in text if w in ids]
        chunks += [known[a:a + settings.max_sentence_length] for a in range(0, len(known), settings.max_sentence_length)]
    chunks.sort(key=lambda c: (hashlib.md5(" ".join(map(str, c)).encode()).hexdigest(), c))
    learners = collections.defaultdict(list)
    for number, chunk in enumerate(chunks):
        learner = md5_draw(settings.seed, 0, number, "learner") % settings.num_partitions
        learners[learner].append((md5_draw(settings.seed, 0, number, "turn"), number, chunk))
    return {k: [(n, c) for _, n, c in sorted(rows)] for k, rows in learners.items()}


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def fit(texts, settings):
    counts = collections.Counter(w for t in texts for w in t)
    words = sorted((w for w in counts if counts[w] >= settings.min_count), key=lambda w: (-counts[w], w))
    ids, cnt = {w: i for i, w in enumerate(words)}, [counts[w] for w in words]
    total, size, window, k = sum(cnt), settings.vector_size, settings.window_size, settings.negative
    mass = [c ** 0.75 for c in cnt]
    high = np.cumsum(mass) / sum(mass)
    paths = merged_word_by_word(cnt)
    weights = {("in", i): np.array([(mixed(i * size + d + settings.seed) / RANGE - 0.5) / size for d in range(size)])
               for i in range(len(words))}

    def negatives(center, key, first):
        low, own = (high[center - 1] if center else 0.0), mass[center] / sum(mass)
        for d in range(k):
            u = unit(key, first + d) * (1 - own)
            yield bisect.bisect_right(high, u + own if u >= low else u)

    def example(own, touched, hidden, center, key, first, rate):
        """Adds to the output rows in turn; returns the error of the hidden vector."""
        error = np.zeros(len(hidden))
        targets = []
        if settings.hs:
            targets += [("hs", point, 1 - code) for code, point in zip(*paths[center])]
        if k:
            targets += [("neg", center, 1)] + [("neg", t, 0) for t in negatives(center, key, first)]
        for kind, row, label in targets:
            out = own.setdefault((kind, row), np.zeros(len(hidden)))
            gain = (label - sigmoid(float(hidden @ out))) * rate
            error += gain * out
            own[kind, row] = out + gain * hidden
            touched.add((kind, row))
        return error

    def epoch_of(rows, start, epoch):
        own, touched, seen = dict(start), set(), 0
        for sentence, chunk in rows:
            for pos, center in enumerate(chunk):
                done = settings.num_partitions * seen + (epoch - 1) * total
                rate = max(settings.step_size * (1 - done / (settings.max_iter * total + 1)), settings.step_size * 1e-4)
                seen += 1
                key = place_key(settings.seed, epoch, sentence, pos)
                if settings.sample > 0:
                    ratio = settings.sample * total / cnt[center]
                    if unit(key, 1) > math.sqrt(ratio) + ratio:
                        continue
                radius = window - int(unit(key, 0) * window)
                around = [(o, chunk[pos + o]) for o in range(-radius, radius + 1) if o and 0 <= pos + o < len(chunk)]
                if not around:
                    continue
                if settings.cbow == 0:
                    for o, word in around:
                        error = example(own, touched, own["in", word], center, key, 2 + (o + window) * k, rate)
                        own["in", word] = own["in", word] + error
                elif settings.cbow == 1:
                    hidden = sum(own["in", word] for _, word in around) / len(around)
                    error = example(own, touched, hidden, center, key, 2, rate)
                    for _, word in around:
                        own["in", word] = own["in", word] + error
                else:
                    hidden = np.zeros((2 * window + 1, size))
                    for o, word in around:
                        hidden[o + radius] = own["in", word]
                    error = example(own, touched, hidden.ravel(), center, key, 2, rate).reshape(-1, size)
                    for o, word in around:
                        own["in", word] = own["in", word] + error[o + radius]
                touched |= {("in", word) for _, word in around}
        return {row: own[row] for row in touched}

    placed = place(texts, ids, settings)
    for epoch in range(1, settings.max_iter + 1):
        changed = [epoch_of(rows, weights, epoch) for rows in placed.values()]
        for row in set().union(*changed):
            weights[row] = sum(c[row] for c in changed if row in c) / sum(row in c for c in changed)
    return {w: weights["in", i] for i, w in enumerate(words)}

"""The quality classifier against plain Python: features by loops over characters, training by loops over numbers."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import quality

MASK = (1 << 64) - 1


def plain_bucket(h: int, salt: int) -> int:
    h = ((h ^ salt) * 0xFF51AFD7ED558CCD) & MASK
    h ^= h >> 33
    h = (h * 0xC4CEB9FE1A85EC53) & MASK
    return h >> (64 - quality.BITS)


def plain_features(text):
    """Every word, every run of 3 to 5 characters of it with its borders, and the end of the text."""
    out = []
    blank = lambda c: c == " " or "\t" <= c <= "\r"
    for word in "".join(" " if blank(c) else c for c in text or "").split(" "):
        if not word:
            continue
        out.append(plain_bucket(sum(ord(c) * pow(0xD1B54A32D192ED03, k & 63, 1 << 64) for k, c in enumerate(word)) & MASK, 77))
        run = [1, *map(ord, word), 1]
        for n in (3, 4, 5):
            for i in range(len(run) - n + 1):
                out.append(plain_bucket(sum(run[i + k] * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)) & MASK, n))
    return sorted([*out, 0])


@pytest.mark.parametrize("text", ["", None, " \n\t", "a", "ab", "The quick  brown\nfox.", "ünï cödé \U0001f600 x", "w" * 200 + " end", "a b c d e"])
def test_features_equal_plain_ones(text):
    assert sorted(quality.features(text).tolist()) == plain_features(text)


def plain_train(rows, seed=3):
    """The same steps in the same order, one number at a time."""
    rng = np.random.default_rng(seed)
    start = rng.uniform(-1 / quality.DIMS, 1 / quality.DIMS, (1 << quality.BITS, quality.DIMS)).astype(np.float32)
    used = sorted({int(i) for ids, _, _ in rows for i in ids})
    vectors = {i: [float(x) for x in start[i]] for i in used}
    out = [[0.0] * quality.DIMS for _ in range(2)]
    total, done = quality.EPOCHS * len(rows), 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share, y = rows[k]
            rate = quality.RATE * (1 - done / total)
            done += 1
            mean = [sum(float(s) * vectors[int(i)][d] for i, s in zip(ids, share)) for d in range(quality.DIMS)]
            z = [sum(o * m for o, m in zip(side, mean)) for side in out]
            e = [math.exp(v - max(z)) for v in z]
            p = [v / sum(e) for v in e]
            p[y] -= 1
            back = [p[0] * out[0][d] + p[1] * out[1][d] for d in range(quality.DIMS)]
            for side in range(2):
                out[side] = [o - rate * p[side] * m for o, m in zip(out[side], mean)]
            for i, s in zip(ids, share):
                vectors[int(i)] = [v - rate * float(s) * b for v, b in zip(vectors[int(i)], back)]
    return {i: sum(v * (b - a) for v, a, b in zip(vectors[i], *out)) for i in used}


def test_training_and_scores_equal_plain_ones():
    rng = random.Random(1)
    good, bad = "calm river light over stone".split(), "BUY now!!! $$$ click win".split()
    texts = [(" ".join(rng.choices(good if y else bad, k=rng.randrange(1, 8))), y) for y in (0, 1) * 20]
    rows = []
    for text, y in texts:
        ids, n = np.unique(quality.features(text), return_counts=True)
        rows.append((ids.astype(np.uint32), (n / n.sum()).astype(np.float32), y))
    model, plain = quality.train(rows), plain_train(rows)
    assert max(abs(model.weights[i] - w) for i, w in plain.items()) < 1e-4
    for text, y in texts:
        held = plain_features(text)
        z = sum(plain[i] for i in held) / len(held)
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-4 and (model.score(text) >= 0.5) == bool(y)

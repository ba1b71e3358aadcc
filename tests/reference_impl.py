"""Brute-force numpy versions of the byte statistics, written from the
feature definitions, used as test oracles for the Spark operators."""
import numpy as np


def entropy8(a):
    if len(a) == 0:
        return 0.0
    p = np.bincount(a, minlength=256) / len(a)
    p = p[p > 0]
    return float(-np.sum(p * np.log2(p)) / 8.0)


def window_stats(a):
    a = np.asarray(a, dtype=np.uint8)
    n = len(a)
    out = []
    if n:
        out += [a.mean(), a.std(), a.min(), a.max(), np.median(a), np.percentile(a, 25), np.percentile(a, 75)]
    else:
        out += [0.0] * 7
    out += [np.sum(a == 0), np.sum(a == 255), np.sum(a == 0x90), np.sum((a >= 32) & (a <= 126)), entropy8(a)]
    segs = [a[: n // 3], a[n // 3: 2 * (n // 3)], a[2 * (n // 3):]] if n >= 3 else [a, a, a]
    for s in segs:
        out += [s.mean() if len(s) else 0.0, s.std() if len(s) else 0.0, entropy8(s)]
    cs = max(1, n // 10)
    chunks = [a[i * cs: (i * cs + cs if i < 9 else n)] for i in range(10)]
    means = [c.mean() if len(c) else 0.0 for c in chunks]
    stds = [c.std() if len(c) else 0.0 for c in chunks]
    out += means + stds
    for v in (np.array(means, np.float32), np.array(stds, np.float32)):
        d = np.diff(v).astype(np.float64)
        out += [np.mean(np.abs(d)), np.std(d), d.max(), d.min()]
    return [float(x) for x in out]


def block_entropies(sample, block=2048):
    m = len(sample)
    if m == 0:
        return []
    k = min(10, max(1, m // block))
    if k == 1:
        return [entropy8(sample)]
    bs = m // k
    return [entropy8(sample[i * bs: (i * bs + bs if i < k - 1 else m)]) for i in range(k)]

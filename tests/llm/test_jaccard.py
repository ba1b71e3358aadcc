import random

import numpy as np

from hexlens.llm import jaccard


def brute(rows):
    """(class_id, n_links) of each row by all pairs of n-gram sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((min(ids) if ids else None, len(links[i])))
    return out


def changed(text, r, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def check(docs_of, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in jaccard.join(docs_of(rows)).collect())
    want = sorted((i if i is not None else -1, c if c is not None else -1, n) for (i, _), (c, n) in zip(rows, brute(rows)))
    assert got == want


def test_near_copies_against_all_pairs(spark, docs_of, prose):
    r = random.Random(4)
    rows = []
    for k in range(25):
        base = prose(k, r.randrange(60, 300))
        rows += [(len(rows) + j, changed(base, r, j)) for j in range(r.randrange(1, 5))]
    rows += [(900, None), (901, ""), (902, "  "), (903, "a b"), (904, "a b"), (905, "a b c"), (906, "a\tb"), (907, "b a")]
    check(docs_of, rows)


def test_crowded_bucket_is_cut_into_blocks(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(5)
    base = prose(77, 120)
    check(docs_of, [(k, changed(base, r, 1 + k % 2)) for k in range(60)] + [(100 + k, base) for k in range(20)])


def test_chain_of_links_is_one_class(spark, docs_of, prose):
    w = prose(3, 400, 10**6).split()
    check(docs_of, [(k, " ".join(w[8 * k:8 * k + 200])) for k in range(20)])


def test_repeated_and_null_ids_and_an_empty_table(spark, docs_of, prose):
    a, b = prose(1, 50), prose(2, 50)
    check(docs_of, [(5, a), (5, a), (None, a), (7, b), (None, prose(3, 50)), (None, prose(4, 40)), (None, prose(4, 40))])
    assert jaccard.join(docs_of([])).count() == 0
    d = docs_of([(1, a), (2, a)]).selectExpr("*", "1 as node", "2 as label", "3 as bands")
    assert sorted(tuple(x) for x in jaccard.join(d).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_first_of_class_keeps_one_row_of_each(spark, docs_of, prose):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 60)
    rows = [(9, a), (4, a), (4, a), (7, b), (None, a), (None, c), (None, c), (11, None), (12, ""), (11, None)]
    kept = jaccard.first_of_class(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r.doc_id or -1), r.text or "") for r in kept.collect())
    assert got == sorted([(4, a), (7, b), (-1, c), (11, ""), (12, ""), (11, "")])


def test_set_matrix_counts_like_pairs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 500, 200)).astype(np.uint64) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert jaccard.intersections(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_meeting_probability():
    p = lambda s: 1 - (1 - s**jaccard.ROWS) ** jaccard.BANDS
    assert p(0.8) > 0.999 and p(0.3) < 0.05

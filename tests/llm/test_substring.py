import hashlib
import random
from collections import Counter

import numpy as np

from hexlens.llm import hashing, substring

SPACES = " \t\n\x0b\x0c\r"


def brute(texts):
    """(n_words, kept words) of each text, by a table of all windows."""
    words = [[w for w in (t or "").encode().split()] for t in texts]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def check(spark, docs_of, texts, **kw):
    got = {r.doc_id: r for r in substring.dedup(docs_of(list(enumerate(texts))), **kw).collect()}
    assert len(got) == len(texts)
    for k, (n, kept) in enumerate(brute(texts)):
        r = got[k]
        assert (r.ss_n_words, r.ss_n_removed) == (n, n - len(kept))
        assert r.ss_kept.encode() == b" ".join(kept)
        cut = set()
        for s in r.ss_removed:
            cut.update(range(s.start, s.end))
        assert len(cut) == n - len(kept)
        assert hashlib.sha256(r.ss_kept.encode()).hexdigest()
    return got


def test_planted_repeats_against_all_windows(spark, docs_of, prose):
    r = random.Random(1)
    texts = [prose(k, r.randrange(0, 260)) for k in range(60)]
    for n in (34, 35, 36, 52, 53, 120):  # at every offset to the blocks
        shared = prose(1000 + n, n)
        for k in r.sample(range(60), 4):
            w = texts[k].split()
            at = r.randrange(len(w) + 1)
            texts[k] = " ".join(w[:at] + shared.split() + w[at:])
    texts += [None, "", " \t\n ", "one", prose(5, 35), prose(5, 35), prose(6, 34), prose(6, 34)]
    check(spark, docs_of, texts)


def test_repeats_inside_one_document_and_runs(spark, docs_of, prose):
    p = prose(9, 40)
    check(spark, docs_of, [p + " x " + p, "to " * 90, "to " * 35, "to " * 34, "to " * 36, "é " * 50 + prose(3, 60), prose(3, 60)])


def test_white_space_is_ascii_only(spark, docs_of, prose):
    w = prose(2, 50).split()
    texts = [" ".join(w), "\n".join(w), "\t \r\n".join(w), " ".join(w), " ".join(w[:40]), "\x0b".join(w)]
    check(spark, docs_of, texts)


def test_many_copies_and_a_long_text(spark, docs_of, prose):
    texts = [prose(1, 50)] * 300 + [prose(7, 60_000, 10**7)] + [prose(8, 40)]
    got = check(spark, docs_of, texts)
    assert got[300].ss_n_removed == 0 and got[0].ss_n_removed == 50


def test_empty_table_and_carried_columns(spark, docs_of, prose):
    assert substring.dedup(docs_of([])).count() == 0
    d = docs_of([(1, prose(1, 40)), (1, prose(1, 40)), (None, prose(2, 40))]).selectExpr("*", "1 as home", "2 as bucket", "3 as payload")
    rows = substring.dedup(d, carry=("lang", "home", "bucket", "payload")).collect()
    assert len(rows) == 3 and {(r.carried.home, r.carried.bucket, r.carried.payload) for r in rows} == {(1, 2, 3)}
    assert sorted((r.doc_id or 0, r.ss_n_removed) for r in rows) == [(0, 0), (1, 40), (1, 40)]


def test_hashes_of_windows_equal_exactly_where_words_do(prose):
    text = (prose(1, 400, 3) + " ").encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, 500, len(text)])
    starts, ends, first = hashing.spans(buf, off, hashing.space_table())
    words = [text[a:z] for a, z in zip(starts, ends)]
    assert words == text[:500].split() + text[500:].split()
    for k in (1, 5, 18):
        h = hashing.window_hashes(hashing.word_hashes(buf, starts, ends), k)
        by = {}
        for i, x in enumerate(h.tolist()):
            by.setdefault(tuple(words[i:i + k]), set()).add(x)
        assert all(len(v) == 1 for v in by.values()) and len(set(h.tolist())) == len(by)
        ok = hashing.window_valid(first, k)
        assert ok.tolist() == [i + k <= first[1] or i >= first[1] for i in range(len(h))]


def test_packing_of_sorted_hashes():
    a = np.sort(hashing.mix(np.arange(1, 1000, dtype=np.uint64)))
    assert np.array_equal(substring.unpack(substring.pack_sorted(a), True), a)
    assert np.array_equal(substring.unpack(substring.pack_plain(a[::-1].copy()), False), a[::-1])
    parts = list(substring.bucket_bounds(a, 7))
    assert parts[0][1] == 0 and parts[-1][2] == len(a) and len(parts) == 7

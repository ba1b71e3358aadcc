import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hexlens.llm import bpe, queries

MIXED = ["a", "b", " ", "e", "s", "'", "\n", "1", "é", "東", "😀", "՘", "ß", " ", "\t", "ab", "the", "  ", "'re", "'l", "\x1c", "́",
         "࢏", "\U00011de0", "<|endoftext|>", "\r\n"]


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.default_path())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_ids_are_the_librarys(own, library):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    r = random.Random(1)
    texts = ["".join(r.choice(MIXED) for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(128, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(800)]
    texts += ["a" * 20000, "ab" * 9999, "\n" * 5000 + "x", "東京" * 3000, " " * 4000, ""]
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(text):
    v = bpe.vocabulary(bpe.default_path())
    assert v.encode(text) == tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={}).encode_ordinary(text)


def merged(raw, ranks):
    """Byte pair merging by its definition: the lowest rank first, of equal ones the leftmost."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_every_prefix_has_its_encoding(own):
    r = random.Random(2)
    for _ in range(40):
        raw = bytes(r.choice(b"aaabcdethes \xc3\xa9") for _ in range(r.randrange(1, 50)))
        table = bpe.Prefixes(own)
        for c in raw:  # byte by byte
            table.append(bytes([c]))
        assert table.last == bpe.Prefixes(own, raw).last
        for n in range(len(raw) + 1):
            assert table.ids(n) == merged(raw[:n], own.ranks)


def test_tables_after_edits(own):
    r = random.Random(3)
    for _ in range(100):
        raw = bytes(r.choice(b"aaabcdethes") for _ in range(r.choice([0, 20, 600])))
        table = bpe.Prefixes(own, raw)
        for _ in range(5):
            at, gone, more = r.randrange(-2, len(raw) + 3), r.choice([0, 1, 50]), bytes(r.choice(b"abth") for _ in range(r.choice([0, 1, 40])))
            table.edit(at, gone, more)
            at = min(max(at, 0), len(raw))
            raw = raw[:at] + more + raw[at + gone :]
            assert table.raw == raw and table.last == bpe.Prefixes(own, raw).last


def test_an_edit_leaves_far_entries_alone(own, monkeypatch):
    table = bpe.Prefixes(own, b"abcde" * 20000)
    seen, iterate = [0], own.matches.iter
    monkeypatch.setattr(own, "matches", type("Counted", (), {"iter": lambda self, s: (seen.__setitem__(0, seen[0] + 1) or m for m in iterate(s))})())
    table.edit(50000, 3, b"zz")
    assert 0 < seen[0] < 2000


def test_edited_texts(own, library):
    r = random.Random(4)
    for _ in range(150):
        t = "".join(r.choice(MIXED if r.random() < 0.3 else "abcdeth") for _ in range(r.choice([0, 5, 50, 400, 1500])))
        doc = bpe.Text(own, t)
        for _ in range(5):
            at, gone, more = r.randrange(-2, len(t) + 4), r.choice([0, 0, 1, 3, 40]), "".join(r.choice(MIXED) for _ in range(r.choice([0, 1, 2, 5, 30])))
            doc.edit(at, gone, more)
            at = min(max(at, 0), len(t))
            t = t[:at] + more + t[at + gone :]
            assert doc.text() == t and doc.ids() == library.encode_ordinary(t)


def test_the_query_on_the_given_table(spark, library):
    got = {r.doc_id: r for r in queries.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_empty_long_and_repeated_rows(spark, docs_of, library):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "x"), (4, "long é " * 30000), (5, "<|endoftext|>")]
    d = docs_of(rows).selectExpr("*", "1 as ids", "2 as decoded")
    got = bpe.decode(bpe.encode(d)).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in got) == sorted(
        (i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.decode(bpe.encode(docs_of([]))).count() == 0
    odd = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text, null as edits")
    assert bpe.encode(odd).first().ids == library.encode_ordinary("a�b")
    null_ids = spark.sql("select 1L as doc_id, cast(null as array<int>) as ids")
    assert bytes(bpe.decode(null_ids).first().decoded) == b""


def test_revised_rows(spark, library):
    d = spark.sql("""select * from values (1L, 'one two three', array(struct(4, 3, 'four'), struct(0, 0, 'and '), null, struct(900, 1, '!'))),
                     (2L, null, array(struct(0, 0, 'new'))), (3L, 'same', null) as t(doc_id, text, edits)""")
    got = {r.doc_id: r for r in bpe.revise(d).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "and one four three!", 2: "new", 3: "same"}
    assert all(r.ids == library.encode_ordinary(r.text) for r in got.values())

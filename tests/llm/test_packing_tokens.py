import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hexlens.llm import packing, token_counts, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world, it's 12 o'clock.\n\n  Done\t!", "naïve café — 東京 😀 <|endoftext|> x", "a" * 3000, "ſ K   x", "ǆ" * 40,
         "\n\n\n", " ", "l'été d'où", "word " * 4000, "Ünïcödé ẞ ñ"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)  # as it comes: the string of an added token is that token


def test_ids_equal_those_of_the_library(spark, reference):
    enc = tokenizer.encoder(PATH)
    assert enc.fast is not None
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    for text in TEXTS + [r.text for r in docs]:
        assert enc.ids(text) == reference.encode(text, add_special_tokens=False).ids
    for lo in range(0, 0x250, 16):  # every character of the fast path, alone and among others
        text = " ".join(f"a{chr(c)}{chr(c)}b {chr(c)}1" for c in range(lo, lo + 16))
        assert enc.ids(text) == reference.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, reference, size=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        ids = reference.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= size and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq)


def test_pieces_are_whole_and_sequences_gapless(spark, docs_of, reference, prose):
    r = random.Random(3)
    texts = dict(enumerate(TEXTS + [None] + [prose(k, r.randrange(1, 700)) for k in range(80)]))
    rows = packing.pack(docs_of(list(texts.items()))).collect()
    n = check_packed(rows, texts, reference)
    assert n * 1024 < 1.03 * sum(x.length for x in rows) + 1024  # little padding


def test_repeated_rows_null_ids_and_an_empty_table(spark, docs_of, prose):
    d = docs_of([(1, "a b"), (1, "a b"), (None, "a b"), (2, prose(1, 3000))]).selectExpr("*", "1 as shard", "2 as start")
    rows = packing.pack(d).collect()
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs_of([])).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = random.Random(7)
    for _ in range(50):
        lengths = np.array([r.randrange(1, 33) for _ in range(r.randrange(0, 60))], np.int64)
        window, offset = packing.best_fit_decreasing(lengths, 32)
        room, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):  # by looking at every window
            fits = [w for w, x in enumerate(room) if x >= lengths[k]]
            if fits:
                least = min(room[w] for w in fits)
                want[k] = least
                w = next(w for w in fits if room[w] == least)
            else:
                want[k], w = 32, len(room)
                room.append(32)
            room[w] -= lengths[k]
        assert all(32 - offset[k] == want[k] for k in want)
        assert len(set(window)) == len(room)


def brute_sections(text, cuts, reference, rule):
    """Tokens of each section from the library's offsets, character by character."""
    bounds = [0, *cuts, len(text)]
    of = [max(k for k in range(len(bounds) - 1) if bounds[k] <= c) for c in range(len(text))]
    n, cross = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1)
    for a, z in reference.encode(text, add_special_tokens=False).offsets:
        chars = [of[c] for c in range(a, z)]
        to = {"first": chars[0], "last": chars[-1], "most": max(sorted(set(chars)), key=chars.count)}[rule]
        n[to] += 1
        cross[to] += chars[0] != chars[-1]
    return n, cross


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_the_library_offsets(spark, docs_of, reference, rule):
    texts = ["ab\ncd  \n\n  ef", "one\n\n\ntwo three\n", "x", "\n", "plain words only", "a\n\n\n\n\nb\n\n"]
    rows = token_counts.count_tokens(docs_of(list(enumerate(texts))), rule=rule).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        cuts = [i + 1 for i, c in enumerate(t[:-1]) if c == "\n"]
        assert [r.start_char for r in own] == [0, *cuts] and own[-1].end_char == len(t)
        n, cross = brute_sections(t, cuts, reference, rule)
        assert [r.n_tokens for r in own] == n and [r.n_crossing for r in own] == cross


def test_given_sections_with_wide_characters(spark, docs_of, reference):
    texts = {1: "éà東京😀 abc déf", 2: "plain ascii here", 3: None, 4: ""}
    d = docs_of(list(texts.items())).selectExpr("*", "array(3L, 6L, 3L, null, -1L, 900L) as cut", "5 as section")
    rows = token_counts.count_tokens(d, sections_col="cut").collect()
    for k in (1, 2):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert [(r.start_char, r.end_char) for r in own] == [(0, 3), (3, 6), (6, len(texts[k]))]
        assert [r.n_tokens for r in own] == brute_sections(texts[k], [3, 6], reference, "first")[0]
    assert [(r.section, r.start_char, r.end_char, r.n_tokens) for r in rows if r.doc_id in (3, 4)] == [(0, 0, 0, 0)] * 2


def test_counts_add_up_and_odd_tables(spark, docs_of, reference, prose):
    texts = {k: t for k, t in enumerate(TEXTS + [prose(1, 5000)])}
    rows = token_counts.count_tokens(docs_of(list(texts.items()) + [(99, None), (99, "x"), (None, "x\ny")])).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.n_tokens
    for k, t in texts.items():
        assert total[k] == len(reference.encode(t, add_special_tokens=False).ids)
    assert total[99] == 1 and total[None] == 3
    assert token_counts.count_tokens(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs_of([]), rule="none")


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "line\nna\u00efve <|endoftext|>\n\n\u6771\u4eac <|endoftext|>\nend\n", "<|endoftext| >", "<|end\noftext|>"]


def test_added_tokens_are_the_librarys(spark, docs_of):
    library = Tokenizer.from_file(PATH)  # as it comes, without any flag
    enc = tokenizer.encoder(PATH)
    assert enc.ids(MARKED[0]) == [64, 220, 50256, 275]
    for text in MARKED:
        assert enc.ids(text) == library.encode(text, add_special_tokens=False).ids
        assert enc.ends(text)[-1] == len(text.encode())
    docs = docs_of(list(enumerate(MARKED)))
    check_packed(packing.pack(docs).collect(), dict(enumerate(MARKED)), library)
    rows = token_counts.count_tokens(docs).collect()
    for k, t in enumerate(MARKED):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(library.encode(t, add_special_tokens=False).ids)
        if t.isascii():
            n, cross = brute_sections(t, [i + 1 for i, c in enumerate(t[:-1]) if c == "\n"], library, "first")
            assert [r.n_tokens for r in own] == n and [r.n_crossing for r in own] == cross


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"lstrip": True, "rstrip": True}])
def test_added_tokens_that_take_white_space(tmp_path, flags):
    import json
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0] |= flags
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "[\u00e9]", "special": False})
    (tmp_path / "own.json").write_text(json.dumps(spec), encoding="utf-8")
    enc, library = tokenizer.Encoder(str(tmp_path / "own.json")), Tokenizer.from_file(str(tmp_path / "own.json"))
    for text in ("a  <|endoftext|>  b", "x [\u00e9] y\n[\u00e9]", " <|endoftext|> "):
        got = library.encode(text, add_special_tokens=False)
        assert enc.ids(text) == got.ids
        assert enc.ends(text).tolist() == [len(text[:z].encode()) for _, z in got.offsets]

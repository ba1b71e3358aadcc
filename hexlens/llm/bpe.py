"""Op 12: byte-level BPE by dynamic programming over the prefixes of each piece.

A text is cut into pieces by the vocabulary's pattern; each piece is encoded on
its own.  Of all tokens that end at a prefix, exactly one can be the last token
of that prefix's encoding: the one that may stand beside the last token of the
prefix before it.  Two tokens may stand side by side if no merge would have
crossed their border before both were whole.  The table of last tokens holds
the encoding of every prefix, so bytes are appended without a look at the rest,
and after an edit the table is filled again from the edit only until it agrees
with the old one over the length of the longest token.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same with classes filled in.  Only marks can begin as a contraction does, so letters may be tried first.
FILLED = r" ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: A match of the pattern depends on fewer characters than this beyond its end.
AHEAD = 3
#: Pieces of more bytes keep their table for later edits; shorter ones are encoded anew.
LONG_PIECE = 256
#: Entries of a cache of a worker process.  Of pieces there are two such caches: what is used moves
#: from the old one to the new one, and when that is full, it becomes the old one.
CACHED = 1 << 18
ENCODED = "doc_id long, ids array<int>"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranges(points: list[int], limit: int) -> str:
    """A character class body for ascending code points up to a limit."""
    out: list[list[int]] = []
    for p in points:
        if p > limit:
            break
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)


class Splitter:
    """Pieces of a text as the library cuts them, by its own Unicode tables, for which it is asked once."""

    def __init__(self):
        self._by_limit: dict[int, re.Pattern] = {}
        self._classes: dict[str, list[int]] | None = None
        self._astral = re.compile("[\U00010000-\U0010ffff]")

    def _points(self) -> dict[str, list[int]]:
        import tiktoken
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        bytewise, out = {bytes([b]): b for b in range(256)}, {}
        for key, name in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
            asked = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=bytewise, special_tokens={})
            out[key] = sorted(set(map(ord, bytes(asked.encode_ordinary(every)).decode())))
        return out

    def matcher(self, text: str) -> re.Pattern:
        """The pattern for a text; classes reach no farther than its characters, which makes them faster."""
        limit = 0x7F if text.isascii() else 0x10FFFF if self._astral.search(text) else 0xFFFF
        if limit not in self._by_limit:
            self._classes = self._classes or self._points()
            body = FILLED
            for key, points in self._classes.items():
                body = body.replace("{" + key + "}", ranges(points, limit))
            self._by_limit[limit] = re.compile(body)
        return self._by_limit[limit]


class Vocabulary:
    """Tokens by rank, which tokens may follow each other, and encodings of pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        if len(self.tokens) != len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every byte, and one rank a token")
        self.longest = max(map(len, self.ranks))
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.matches = ahocorasick.Automaton()  # all longer tokens in a piece, by their ends
        for t, r in self.ranks.items():
            if len(t) > 1:
                self.matches.add_word(t.decode("latin-1"), (len(t), r))
        self.matches.make_automaton()
        self.split = Splitter()
        self._parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._before: dict[str, tuple[int, ...]] = {}

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``."""
        found = self._parts.get(token)
        if found is None:
            t = self.tokens[token]
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k], token), self.ranks.get(t[k:], token)
                if a < token and b < token and self._apart(a, b, token):
                    found = self._parts[token] = (a, b)
                    break
            else:
                raise ValueError(f"no merge of lower tokens makes token {token}")
        return found

    def _apart(self, a: int, b: int, below: int) -> bool:
        """Whether no merge of a rank under ``below`` crosses the border of ``a`` and ``b``.

        Merges are undone on both sides of the border, the latest first.  In
        each state, a merge across it would have been made if its rank is under
        that of the merge that ended the state; of equal ranks the left is first.
        """
        until = below  # ranks under this are made while both neighbours are as they are
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < until:
                return False
            one, two = len(self.tokens[a]) == 1, len(self.tokens[b]) == 1
            if one and two:
                return True
            if two or (not one and a > b):
                a, until = self.parts(a)[1], min(until, a)
            else:
                b, until = self.parts(b)[0], min(until, b + 1)

    def beside(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a`` in an encoding; remembered in ``pairs`` under ``a << 32 | b``."""
        if len(self.pairs) >= 4 * CACHED:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self._apart(a, b, 1 << 62)
        return ok

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece) or self._before.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            found = (whole,) if whole is not None else tuple(Prefixes(self, raw).ids())
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= CACHED:
                self._before, self.known = self.known, {}
            self.known[piece] = found
        return found

    def encode(self, text: str, out: list[int] | None = None) -> list[int]:
        """The ids of a text, added to ``out`` if given."""
        out = [] if out is None else out
        slow, more = self.piece, out.extend
        for p in self.split.matcher(text).findall(text):
            more(self.known.get(p) or slow(p))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of the encoding of every prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def _fill(self, start: int, stop: int) -> None:
        """Set the last tokens of the prefixes longer than ``start``, up to ``stop`` bytes."""
        last, v = self.last, self.vocabulary
        known, beside, single = v.pairs.get, v.beside, v.single
        last += [single[c] for c in self.raw[start:stop]]  # right unless a longer token may be last
        first = max(0, start - v.longest + 1)  # no token that starts before this ends after start
        found = start
        for at, (size, t) in v.matches.iter(self.raw[first:stop].decode("latin-1")):
            end = first + at + 1
            if end <= found:
                continue
            before = last[end - size]
            if before >= 0:
                ok = known(before << 32 | t)
                if not (beside(before, t) if ok is None else ok):
                    continue
            last[end] = t
            found = end

    def append(self, more: bytes) -> None:
        start = len(self.raw)
        self.raw += more
        self._fill(start, len(self.raw))

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replace ``removed`` bytes from ``at``.

        Entries up to the edit stay.  Those after it are set anew until the last
        ``longest`` ones, all behind the edit, are the old ones: so is the rest.
        """
        at = min(max(at, 0), len(self.raw))
        removed = min(max(removed, 0), len(self.raw) - at)
        old, self.last = self.last, self.last[: at + 1]
        self.raw = self.raw[:at] + inserted + self.raw[at + removed :]
        shift, longest, behind, end = len(inserted) - removed, self.vocabulary.longest, at + len(inserted), at
        while end < len(self.raw):
            begin, end = end, min(end + 2 * longest, len(self.raw))
            self._fill(begin, end)
            if end - longest >= behind and self.last[end - longest :] == old[end - longest - shift : end + 1 - shift]:
                self.last += old[end + 1 - shift :]
                return

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (default: all)."""
        at, out = len(self.raw) if end is None else end, []
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.vocabulary.tokens[t])
        return out[::-1]


class Text:
    """A text with the encodings of its pieces, open to edits."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary = vocabulary
        self.pieces = vocabulary.split.matcher(text).findall(text)
        self.encoded = [self._new(p) for p in self.pieces]

    def _new(self, piece: str):
        raw = piece.encode("utf-8", "replace")
        return Prefixes(self.vocabulary, raw) if len(raw) > LONG_PIECE else self.vocabulary.piece(piece)

    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        out: list[int] = []
        for e in self.encoded:
            out.extend(e.ids() if isinstance(e, Prefixes) else e)
        return out

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at``; pieces are cut anew from just before the edit until the cuts agree with the old ones."""
        starts = [0, *accumulate(map(len, self.pieces))]
        total = starts.pop()
        at = min(max(at, 0), total)
        removed = min(max(removed, 0), total - at)
        i = max(bisect_right(starts, at - AHEAD) - 1, 0) if starts else 0
        base, shift = starts[i] if starts else 0, len(inserted) - removed
        old_starts, reach = {s: k for k, s in enumerate(starts)} | {total: len(starts)}, 8
        while True:  # with more and more pieces on the right, till the new cuts meet an old one
            j = min(bisect_right(starts, at + removed) + reach, len(starts))
            tail = "".join(self.pieces[i:j])
            region = tail[: at - base] + inserted + tail[at - base + removed :]
            whole, new, meets = j == len(starts), [], None
            for m in self.vocabulary.split.matcher(region).finditer(region):
                if not whole and m.end() + AHEAD > len(region):
                    break
                new.append(m.group())
                end = base + m.end()
                if end >= at + len(inserted) and end - shift in old_starts:
                    meets = old_starts[end - shift]
                    break
            if meets is not None or whole:
                break
            reach *= 2
        meets = len(starts) if meets is None else meets
        kept = self._edit_in_place(i, meets, starts, new, at, removed, inserted)
        self.encoded[i:meets] = [kept.get(k) or self._new(p) for k, p in enumerate(new)]
        self.pieces[i:meets] = new

    def _edit_in_place(self, i, meets, starts, new, at, removed, inserted) -> dict:
        """A long piece that holds the whole edit and keeps its borders has its own table edited."""
        at_piece = max(bisect_right(starts, at) - 1, 0) if starts else 0
        for k in (at_piece, at_piece - 1):  # an append belongs to the piece that ends there
            if not i <= k < meets or not isinstance(self.encoded[k], Prefixes):
                continue
            piece, a = self.pieces[k], at - starts[k]
            if a > len(piece) or a + removed > len(piece) or new[: k - i] != self.pieces[i:k]:
                continue
            edited = piece[:a] + inserted + piece[a + removed :]
            if k - i < len(new) and new[k - i] == edited:
                before = len(piece[:a].encode("utf-8", "replace"))
                self.encoded[k].edit(before, len(piece[a : a + removed].encode("utf-8", "replace")), inserted.encode("utf-8", "replace"))
                return {k - i: self.encoded[k]}
        return {}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return Vocabulary(path)


def texts(col) -> list[str]:
    """Texts of a binary column; a null is empty, bytes that aren't UTF-8 read as U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in col.to_pylist()]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every whole text, by the ranks of a ``tiktoken`` file, without special tokens.

    The ids are those of the ``tiktoken`` library.  A null or empty text has no
    ids (an empty array); strings of special tokens are ordinary text.  A row
    in gives a row out, also for null and repeated ids; other columns are not
    read; an empty table gives no rows.  Time is linear in a text's length,
    also for a text without spaces.
    """
    path = path or default_path()

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            flat: list[int] = []
            ends = [len(v.encode(t, flat)) for t in texts(b.column(1))]
            ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the bytes of each row's ids (none for null or empty ids; an id that the file lacks raises)."""
    path = path or default_path()

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), lists.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            got = [v.decode(flat[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, ENCODED + ", decoded binary")


def revise(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """doc_id, text, ids after the edits of each row, made in their order and encoded again only near each.

    ``edits_col`` is an array of struct<at int, removed int, inserted string>, in
    characters of the text that the edits before have left; positions outside it
    are moved to its ends; null edits, fields and texts count as none, 0 and empty.
    """
    path = path or default_path()

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            out = []
            for text, edits in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                t = Text(v, text)
                for e in edits or ():
                    if e is not None:
                        t.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((t.text(), t.ids()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32()))],
                                             ["doc_id", "text", "ids"])

    edits = F.col(edits_col).cast("array<struct<at:int,removed:int,inserted:string>>").alias("edits")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), edits)
            .mapInArrow(run, "doc_id long, text string, ids array<int>"))

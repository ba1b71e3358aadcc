"""Op 5: token counts of a document's sections from one encoding of the whole document.

A document is encoded once.  The width in bytes of each id gives every token's
span in the text; spans are matched to the sections' intervals by binary
search, and a token that lies across a boundary goes to exactly one section by
a stated rule.  Sections are the document's lines (with their line feed), or
intervals of characters given in a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import tokenizer

COUNTS = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"
RULES = ("first", "last", "most")


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses a boundary.

    ``ends``: byte ends of the tokens; ``bounds``: ascending byte starts of
    adjoining sections, from 0.  first / last: the section of the token's first
    / last byte; most: that with most of its bytes, the earlier one at a tie.
    """
    starts = np.concatenate(([0], ends[:-1]))
    a = np.searchsorted(bounds, starts, side="right") - 1
    z = np.searchsorted(bounds, ends - 1, side="right") - 1
    if rule == "first":
        return a, a != z
    if rule == "last":
        return z, a != z
    out = a.copy()
    for k in np.flatnonzero(a != z):
        cuts = np.concatenate(([starts[k]], bounds[a[k] + 1 : z[k] + 1], [ends[k]]))
        out[k] = a[k] + int(np.argmax(np.diff(cuts)))
    return out, a != z


def line_starts(buf: np.ndarray) -> np.ndarray:
    cuts = np.flatnonzero(buf == 10) + 1
    return np.concatenate(([0], cuts[cuts < len(buf)]))


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, rule: str = "first", id_col: str = "doc_id",
                 text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    Sections count from 0 and adjoin; ``sections_col`` may name a column of
    ascending start characters (array<long>; the text before the first is
    section 0 too, values outside the text are left out).  n_tokens adds up to
    the tokens of the whole text; n_crossing counts those that also lie in
    another section.  A null or empty text has one row, section 0, with zeros.
    Rows are documents of their own even if ids or texts repeat; other columns
    are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer_path or tokenizer.default_path()

    def run(batches):
        enc = tokenizer.encoder(path)
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            given = b.column(2).to_pylist() if b.num_columns > 2 else [None] * len(texts)
            parts, of = [], []
            for k, (text, cut) in enumerate(zip(texts, given, strict=True)):
                raw = (text or "").encode()
                buf = np.frombuffer(raw, np.uint8)
                wide = len(raw) != len(text or "")
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80))) if wide else None  # characters begun before a byte
                if cut is None:
                    bounds = line_starts(buf)
                else:
                    at = np.unique([0, *(int(x) for x in cut if x is not None and 0 < x < len(text or ""))]).astype(np.int64)
                    bounds = np.flatnonzero((buf & 0xC0) != 0x80)[at] if wide else at  # bytes at which these characters begin
                n = len(bounds)
                if raw:
                    ends = enc.ends(text)
                    to, crossing = attribute(ends, bounds, rule)
                    tokens = np.bincount(to, minlength=n)
                    cross = np.bincount(to[crossing], minlength=n)
                else:
                    tokens = cross = np.zeros(n, np.int64)
                edge = np.append(bounds, len(raw))
                edge = chars[edge] if wide else edge
                parts.append((np.arange(n, dtype=np.int32), edge[:-1], edge[1:], tokens, cross))
                of.append(n)
            ids = pa.array(docs_, pa.int64()).take(pa.array(np.repeat(np.arange(len(of)), of)))
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int32)] + [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                             ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).cast("array<long>").alias("sections"))
    return docs.select(*cols).mapInArrow(run, COUNTS)

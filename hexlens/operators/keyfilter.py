"""Keep the rows whose key is in a set, without moving the rows.

File bytes must not be shuffled because their hash is looked up.  The lookup runs
on keys alone; what it finds comes back to the rows, where they lie, as a Bloom
filter: blocks of 1024 bits, each built whole by one task from the keys that
hash to it, so that nothing has to be merged.  A Bloom filter says yes too often.
Those keys are known as well, for every key of the rows was in the lookup: they
go out as a list, and the answer is exact.

Filter and list are bounded.  Larger sets are cut by the hash of the key into
parts, and the rows are read once for each part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, bits tested, words of 64 bits in a block, blocks that one task builds at once.
KEY_BITS, TESTS, WORDS, CHUNK = 12, 6, 16, 4096
#: Share of other keys that pass, about; most bytes of one part's filter and list.
PASSED, PART_BYTES = 0.01, 64 << 20
LISTED_BYTES = 150  # of a listed key on the driver and in a worker


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def places(h1: np.ndarray, h2: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each key, and (keys, TESTS) words and bits in it."""
    block = (h1.view(np.uint64) >> np.uint64(8)) % np.uint64(blocks)
    bit = (h2.view(np.uint64)[:, None] >> (10 * np.arange(TESTS, dtype=np.uint64))) & np.uint64(1023)
    return block.astype(np.int64), (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def passes(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    block, word, mask = places(h1, h2, len(bits))
    return ((bits[block[:, None], word] & mask) == mask).all(axis=1)


def build(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """The filter of ``n`` distinct keys: (blocks, WORDS) words."""
    blocks = max(1, -(-n * KEY_BITS // (64 * WORDS)))
    h1, h2 = hashes(F.col(key))
    block = F.pmod(F.shiftrightunsigned("h1", 8), F.lit(blocks))  # 56 bits: never negative

    def fill(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        b, word, mask = places(t["h1"].to_numpy(), t["h2"].to_numpy(), blocks)
        out = np.zeros((min(CHUNK, blocks - chunk * CHUNK), WORDS), np.uint64)
        np.bitwise_or.at(out, (np.repeat(b - chunk * CHUNK, TESTS), word.ravel()), mask.ravel())
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = (keys.select(h1.alias("h1"), h2.alias("h2")).withColumn("chunk", F.floor(block / CHUNK).cast("long"))
             .groupBy("chunk").applyInArrow(fill, "chunk long, bits binary"))
    bits = np.zeros((blocks, WORDS), np.uint64)
    for r in parts.toLocalIterator():  # PART_BYTES in all, at most
        own = np.frombuffer(bytes(r.bits), np.uint64).reshape(-1, WORDS)
        bits[r.chunk * CHUNK : r.chunk * CHUNK + len(own)] = own
    return bits


def members(keys: DataFrame, key: str, flag: str, part_bytes: int = PART_BYTES) -> list[Callable[[Column], Column]]:
    """Predicates on a key column, one a part; each key whose ``flag`` is true fulfils one, no other fulfils any.

    ``keys`` holds every key that the predicates will be asked for, once, and is
    read several times: give a written table.  Keys are strings and not null.
    """
    spark = keys.sparkSession
    n_in, n_out = keys.agg(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).first()
    if not n_in:
        return []
    if not n_out:
        return [lambda c: F.lit(True)]
    asked = n_in <= n_out  # the smaller side goes into the filter
    small, other = min(n_in, n_out), max(n_in, n_out)
    parts = max(1, -(-int(small * KEY_BITS / 8 + 2 * PASSED * other * LISTED_BYTES) // part_bytes))
    of_part = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(parts))

    def predicate(p: int) -> Callable[[Column], Column]:
        own = keys if parts == 1 else keys.where(of_part(F.col(key)) == p)
        inside, outside = own.where(F.col(flag) == asked), own.where(F.col(flag) != asked)
        shared = spark.sparkContext.broadcast(build(inside, key, inside.count() if parts > 1 else small))

        @F.pandas_udf("boolean")
        def maybe(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(passes(shared.value, h1.to_numpy(), h2.to_numpy()))

        h = hashes(F.col(key))
        listed = spark.sparkContext.broadcast(frozenset(r[0] for r in outside.where(maybe(*h)).select(key).toLocalIterator()))

        @F.pandas_udf("boolean")
        def exactly(c: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
            yes = passes(shared.value, h1.to_numpy(), h2.to_numpy())
            at = np.flatnonzero(yes)
            yes[at] = [k not in listed.value for k in c.iloc[at]]
            return pd.Series(yes == asked)

        if parts == 1:
            return lambda c: exactly(c, *hashes(c))
        return lambda c: (of_part(c) == p) & exactly(c, *hashes(c))

    return [predicate(p) for p in range(parts)]

"""Pointer tables of hostile files in linear time, and the vote on its thresholds."""
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.functions import pe
from hexlens.functions.routing import gate_vote

WHOLE = [{"va": 0, "virtual_size": 1 << 31, "raw_size": 0, "raw_ptr": 0}]
DIRECTORY = {"rva": 64, "size": 16}


def tree(buf, at, entries):
    """A resource directory at an offset: (name, data or directory) pairs; directories are relative to the root at 64."""
    struct.pack_into("<HH", buf, at + 12, 0, len(entries))
    for k, (is_dir, to) in enumerate(entries):
        struct.pack_into("<II", buf, at + 16 + 8 * k, k, (0x80000000 | (to - 64)) if is_dir else to)


def test_resource_trees_are_counted():
    buf = bytearray(2000)
    tree(buf, 64, [(False, 1), (True, 200), (True, 400)])
    tree(buf, 200, [(False, 1), (False, 2)])
    tree(buf, 400, [(True, 600)])
    tree(buf, 600, [(False, 9)])
    im = pe.Image(bytes(buf), WHOLE, False)
    assert pe.count_resources(im, DIRECTORY) == 4 and im.problems == []
    tree(buf, 400, [(True, 64)])  # back to the root
    im = pe.Image(bytes(buf), WHOLE, False)
    assert pe.count_resources(im, DIRECTORY) == 3 and im.problems == ["resource directories overlap"]
    struct.pack_into("<HH", buf, 600 + 12, 0, 5000)
    tree(buf, 400, [(True, 600)])
    im = pe.Image(bytes(buf), WHOLE, False)
    pe.count_resources(im, DIRECTORY)
    assert im.problems[-1] == "resources run out of the file"


@pytest.mark.parametrize("step", [8, 24, 7])
def test_overlapping_trees_end_in_linear_time(step):
    seconds = []
    for size in (1 << 18, 1 << 21):
        r, buf = random.Random(step), bytearray(size)
        for at in range(64, size - 32, step):  # every place is an entry to a directory of 131,070 entries
            struct.pack_into("<I", buf, at + 4, 0x80000000 | r.randrange(size))
            struct.pack_into("<HH", buf, at + 0, 0xFFFF, 0xFFFF)
        struct.pack_into("<HH", buf, 64 + 12, 0xFFFF, 0xFFFF)
        im, t = pe.Image(bytes(buf), WHOLE, False), time.time()
        pe.count_resources(im, DIRECTORY)
        seconds.append(time.time() - t)
        assert "resource directories overlap" in im.problems
    assert seconds[1] < 40 * max(seconds[0], 0.05)  # eight times the bytes; a square would be 64 times


def test_slots_are_handed_out_once():
    r = random.Random(1)
    for _ in range(50):
        slots, given = pe.Slots(400), set()
        for _ in range(30):
            at, n = 8 * r.randrange(50), r.randrange(60)
            n = min(n, (400 - at) // 8)
            want = [k for k in range(n) if at // 8 + k not in given]
            assert list(slots.take(at, n)) == want
            given |= {at // 8 + k for k in want}


def test_addresses_in_many_overlapping_sections():
    r = random.Random(2)
    for _ in range(30):
        sections = [{"va": r.randrange(500), "virtual_size": r.randrange(60), "raw_size": r.randrange(60), "raw_ptr": r.randrange(1000)} for _ in range(40)]
        many, few = pe.Image(b"", sections, False), pe.Image(b"", sections, False)
        few.map = None
        assert many.map is not None
        for rva in range(-2, 620):
            assert many.offset(rva) == few.offset(rva)


def test_names_larger_than_the_file_are_sought_once():
    n = 1 << 20
    buf = bytearray(b"a" * n)
    struct.pack_into("<IIII", buf, 64 + 20, 1, 100_000, 0, 200)
    for k in range(100_000):
        struct.pack_into("<I", buf, 200 + 4 * k, n // 2)
    im, t = pe.Image(bytes(buf), WHOLE, False), time.time()
    functions, names = pe.read_exports(im, DIRECTORY)
    assert functions == 1 and len(names) == 2 and len(names[0]) == n // 2 and "names larger than the file" in im.problems
    assert time.time() - t < 5


def test_ratios_on_their_thresholds_fire(spark):
    at = (C.GATE_HIGH_ENTROPY_RATIO, C.GATE_PACKED_SECTIONS_RATIO, C.GATE_PACKER_RATIO)
    below = [x - 1e-9 for x in at]
    rows = [(at[0], at[1], 0.0, 0.0, 0.0, 1), (at[0], 0.0, 0.0, at[2], 0.0, 1), (0.0, at[1], 0.0, at[2], 0.0, 1), (below[0], at[1], 0.0, below[2], 0.0, 0),
            (at[0], below[1], 0.0, 0.0, 0.0, 0), (at[0], 0.0, 1.0, 0.0, 0.0, 1), (0.0, 0.0, 1.0, 0.0, 1.0, 1), (0.0, 3 / 10, 0.0, 1 / 10, 0.0, 1), (0.0, 0.0, 0.0, 0.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "he double, ps double, ov double, kw double, upx double, want int")
    got = df.select("want", gate_vote("he", "ps", "ov", "kw", ["upx", F.lit(0.0)]).alias("vote")).collect()
    assert [r.vote for r in got] == [r.want for r in got]

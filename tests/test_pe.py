import struct

import pytest
from pyspark.sql import functions as F

from hexlens.functions.pe import with_pe_headers
from hexlens.operators import pe_features as PF
from hexlens.sources.files import is_pe


def make_pe(sections, dllch=0x0140, stamp=1_600_000_000, entry=0x1010, overlay=b"", dirs=None):
    """A minimal PE32 image: DOS header, COFF, optional header, section table, bodies."""
    lfanew = 0x80
    opt_size = 224
    hdr = bytearray(0x400)
    hdr[0:2] = b"MZ"
    struct.pack_into("<I", hdr, 0x3C, lfanew)
    hdr[lfanew:lfanew + 4] = b"PE\x00\x00"
    struct.pack_into("<HHIIIHH", hdr, lfanew + 4, 0x14C, len(sections), stamp, 0, 0, opt_size, 0x102)
    opt = lfanew + 24
    struct.pack_into("<H", hdr, opt, 0x10B)
    struct.pack_into("<I", hdr, opt + 16, entry)
    struct.pack_into("<II", hdr, opt + 32, 0x1000, 0x200)
    struct.pack_into("<IIHH", hdr, opt + 60, 0x400, 0, 2, dllch)
    struct.pack_into("<I", hdr, opt + 92, 16)
    for idx, (rva, size) in (dirs or {}).items():
        struct.pack_into("<II", hdr, opt + 96 + 8 * idx, rva, size)
    body = bytearray()
    ptr = 0x400
    for i, (name, data, vsize, ch) in enumerate(sections):
        o = opt + opt_size + 40 * i
        hdr[o:o + 8] = name.encode().ljust(8, b"\x00")
        struct.pack_into("<IIII", hdr, o + 8, vsize, 0x1000 * (i + 1), len(data), ptr)
        struct.pack_into("<I", hdr, o + 36, ch)
        body += data
        ptr += len(data)
    return bytes(hdr) + bytes(body) + overlay


def headers(spark, *contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content binary")
    return [r.h for r in with_pe_headers(df).orderBy("i").collect()]


def test_parse_and_magic(spark):
    import os
    pe = make_pe([(".text", os.urandom(1024), 1000, 0x60000020), (".data", b"\x00" * 512, 600, 0xC0000040)],
                 overlay=os.urandom(2048))
    h, *rest = headers(spark, pe, b"MZ" + b"\x00" * 10, b"hello", b"", pe[:150], pe[:200], pe[:300], None)
    assert h.subsystem == 2 and h.machine == 0x14C and h.time_date_stamp == 1_600_000_000 and h.error is None
    assert [(x.pos, x.name, x.raw_ptr, x.raw_size) for x in h.sections] == [(0, ".text", 0x400, 1024), (1, ".data", 0x400 + 1024, 512)]
    assert rest == [None] * 5 + [rest[5], None]  # no PE, or no whole optional header
    assert rest[5].sections == [] and "section table" in rest[5].error
    df = spark.createDataFrame([(pe,), (b"MZxx",), (b"",), (b"MZ" + b"\x00" * 58 + b"\xff" * 4 + b"\x00" * 9,)], "content binary")
    assert [r.p for r in df.select(is_pe("content").alias("p")).collect()] == [True, False, False, False]


def plain_features(sections, fa, sa):
    """Section features of one file by plain Python."""
    import numpy as np
    raw = np.array([x[2] for x in sections], float)
    ex = [bool(x[3] & 0x20000000) for x in sections]
    return {"sections_count": len(sections), "section_total_size": raw.sum(), "section_size_std": raw.std(),
            "executable_sections_count": sum(ex), "code_section_ratio": raw[ex].sum() / (raw.sum() + 1),
            "alignment_mismatch_count": sum(x[2] % fa != 0 for x in sections) + sum(x[1] % sa != 0 for x in sections)}


@pytest.mark.parametrize("native", [False, True])
def test_section_arrays_equal_section_rows(spark, native):
    import random
    r = random.Random(3)
    names = [".text", "UPX0", ".rsrc", "a b", "", ".vmp0", "themida"]
    rows = []
    for f in range(40):
        rows.append((f, 5000, [(i, r.choice(names), r.randrange(9000), 0, r.randrange(3) * 512 + r.randrange(2), 0,
                                r.choice([0x60000020, 0xC0000040, 0xE0000020, 0x40000040]), r.random()) for i in range(r.randrange(1, 7))]))
    kind = "array<struct<pos:int,name:string,virtual_size:long,va:long,raw_size:long,raw_ptr:long,characteristics:long,entropy:double>>"
    df = spark.createDataFrame(rows, f"file int, size long, s {kind}")
    wide = PF.add_section_features(df, "s", "size", F.lit(512), F.lit(4096), native)
    flat = PF.section_features(df.select("file", F.inline("s")), "file", F.lit(5000), F.lit(512), F.lit(4096), native)
    cols = [c for c in flat.columns if c != "file"]
    a = {x.file: x for x in wide.collect()}
    for x in flat.collect():
        for c in cols:
            assert a[x.file][c] == pytest.approx(x[c], abs=1e-9), c
    for f, _, secs in rows:
        for k, v in plain_features([(n, vs, raw, ch) for _, n, vs, _, raw, _, ch, _ in secs], 512, 4096).items():
            assert a[f][k] == pytest.approx(v), k


def make_idata(va=0x3000):
    """An .idata-like section with imports, exports and relocations at ``va``."""
    b = bytearray(0x400)
    r = lambda off: va + off
    struct.pack_into("<IIIII", b, 0, r(0x100), 0, 0, r(0x140), r(0x100))
    struct.pack_into("<IIIII", b, 20, r(0x120), 0, 0, r(0x150), r(0x120))
    struct.pack_into("<IIII", b, 0x100, r(0x160), r(0x180), 0x80000005, 0)
    struct.pack_into("<II", b, 0x120, r(0x1A0), 0)
    b[0x140:0x140 + 13] = b"kernel32.dll\x00"
    b[0x150:0x150 + 11] = b"WS2_32.dll\x00"
    b[0x162:0x162 + 12] = b"CreateFileA\x00"
    b[0x182:0x182 + 9] = b"ReadFile\x00"
    b[0x1A2:0x1A2 + 8] = b"connect\x00"
    struct.pack_into("<IIII", b, 0x200 + 20, 3, 2, 0, r(0x240))
    struct.pack_into("<II", b, 0x240, r(0x260), r(0x270))
    b[0x260:0x260 + 10] = b"ExportOne\x00"
    b[0x270:0x270 + 4] = b"Ex2\x00"
    struct.pack_into("<II", b, 0x300, 0x1000, 16)
    struct.pack_into("<II", b, 0x310, 0x2000, 12)
    dirs = {0: (r(0x200), 40), 1: (r(0), 60), 5: (r(0x300), 28)}
    return bytes(b), dirs


def test_import_export_reloc_parsing(spark):
    import os
    idata, dirs = make_idata()
    pe = make_pe([(".text", os.urandom(512), 0x200, 0x60000020), (".data", b"\x00" * 512, 0x200, 0xC0000040),
                  (".idata", idata, 0x400, 0x40000040)], dirs=dirs)
    h = headers(spark, pe)[0]
    imps = [(i.dll, i.api, i.ordinal) for i in h.imports]
    assert imps == [("kernel32.dll", "CreateFileA", None), ("kernel32.dll", "ReadFile", None),
                    ("kernel32.dll", None, 5), ("ws2_32.dll", "connect", None)]
    assert h.exports_count == 3 and h.export_names == ["ExportOne", "Ex2"]
    assert (h.reloc_blocks, h.reloc_entries) == (2, 6) and h.error is None


def test_hostile_files_are_reported_and_end_nothing(spark):
    from hexlens.operators.featurise import featurise
    sec = [(".text", b"\x90" * 512, 0x200, 0x60000020)]
    idata, dirs = make_idata(0x2000)
    two = sec + [(".idata", idata, 0x400, 0x40000040)]

    def poke(buf, at, fmt, *v):
        b = bytearray(buf)
        struct.pack_into(fmt, b, at, *v)
        return bytes(b)
    opt = 0x80 + 24
    good = make_pe(two, dirs=dirs)
    shared = poke(good, 0x400 + 512 + 20, "<I", 0x2000 + 0x100)  # both descriptors use one thunk table
    far = poke(good, opt + 224 + 20, "<I", 0xF0000000)           # section pointer beyond 2**31
    size = poke(good, opt + 224 + 16, "<I", 0xFFFFFFFF)
    loop = make_pe([(".rsrc", struct.pack("<IIIHHII", 0, 0, 0, 0, 1, 1, 0x80000000).ljust(512, b"\0"), 0x200, 0x40000040)], dirs={2: (0x1000, 64)})
    outside = make_pe(sec, dirs={1: (0x900000, 40), 9: (0x900000, 40), 4: (0x7FFFFFF0, 0x7FFFFFFF)})
    count = poke(good, 0x80 + 6, "<H", 0xFFFF)                   # more sections than the file holds
    name = poke(good, opt + 224, "<Q", 0xFFFEFDFCFBFAF9F8)       # a name that isn't UTF-8
    cut = good[:-700]
    got = headers(spark, good, shared, far, size, loop, outside, count, name, cut)
    assert got[0].error is None and "overlap" in got[1].error and "overlap" in got[4].error
    assert "outside" in got[5].error and "section table" in got[6].error and got[8].error
    rows = [(f"f{i}", len(x or b""), x) for i, x in enumerate((good, shared, far, size, loop, outside, count, name, cut, b"", None))]
    for native in (False, True):
        f = featurise(spark.createDataFrame(rows, "path string, length long, content binary"), native=native).collect()
        assert len(f) == 11 and all(len(r.features) == 1549 for r in f if r.length)
        assert sum(r.is_pe for r in f) == 9


def test_pe32_plus_without_and_with_tls(spark):
    def image(dirs, body):
        hdr = bytearray(0x400)
        hdr[0:2], hdr[0x80:0x84] = b"MZ", b"PE\x00\x00"
        struct.pack_into("<I", hdr, 0x3C, 0x80)
        struct.pack_into("<HHIIIHH", hdr, 0x84, 0x8664, 1, 5, 0, 0, 240, 0)
        opt = 0x98
        struct.pack_into("<H", hdr, opt, 0x20B)
        struct.pack_into("<I", hdr, opt + 108, 16)
        for k, (rva, size) in dirs.items():
            struct.pack_into("<II", hdr, opt + 112 + 8 * k, rva, size)
        hdr[opt + 240:opt + 248] = b".text\0\0\0"
        struct.pack_into("<IIII", hdr, opt + 248, 512, 0x1000, 512, 0x400)
        return bytes(hdr) + body.ljust(512, b"\0")
    tls = struct.pack("<QQQQ", 0, 0, 0, 7)
    none, some, zero = headers(spark, image({}, b""), image({9: (0x1000, 40)}, tls), image({9: (0x1000, 40)}, b""))
    assert [h.tls_callbacks for h in (none, some, zero)] == [0, 1, 0]
    assert all(h.pe32_plus and h.error is None for h in (none, some, zero))


def test_featurise_full_row(spark):
    import os
    from hexlens.operators.featurise import featurise, outcome_counts
    from hexlens.plans import dims as D
    idata, dirs = make_idata()
    pe = make_pe([(".text", os.urandom(4096), 4000, 0x60000020), ("UPX1", os.urandom(512), 0x200, 0xE0000020),
                  (".idata", idata, 0x400, 0x40000040)], dirs=dirs, overlay=os.urandom(2048))
    df = spark.createDataFrame([("a.exe", len(pe), pe), ("b.txt", 5, b"hello"), ("c.bin", 0, b"")],
                               "path string, length long, content binary")
    rows = {r.path: r for r in featurise(df).collect()}
    a, b = rows["a.exe"], rows["b.txt"]
    assert len(a.features) == 1549 and len(b.features) == 1549
    assert a.is_pe and not b.is_pe
    assert sum(v * v for v in a.pe_vector) == pytest.approx(1.0, rel=1e-5)
    assert a.imports_count == 2 and a.unique_apis == 3 and a.exports_count == 3
    assert a.imported_system_dlls_count == 1 and a["has_upx_section"] == 1
    assert a.packer_keyword_hits_count == 1 and a.trailing_data_size == 2048
    # hash slots: the file's dll / api / section names set their slots
    assert sum(1 for v in a.pe_vector[:256] if v > 0) >= 5
    # the non-PE file only carries file attributes in its PE vector
    nz = [D.NAMED_SLOTS[i] for i, v in enumerate(b.pe_vector[256:384]) if v != 0]
    assert set(nz) <= {"size", "log_size", "file_entropy_avg", "file_entropy_min", "file_entropy_max",
                       "printable_byte_ratio", "file_entropy_q25", "file_entropy_q75", "file_entropy_median",
                       "zero_byte_ratio"}
    oc = {r.status: r.files for r in outcome_counts(featurise(df)).collect()}
    assert oc == {"success": 1, "skipped": 1, "failed": 1}

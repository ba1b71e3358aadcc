"""PE headers as Catalyst expressions, pointer tables by a small UDF, header scalars.

The fixed-offset fields of the DOS, COFF and optional headers and the section
table are little-endian integers cut out of the content by Catalyst.  Only the
tables that must be chased by pointers (imports, exports, relocations, TLS,
resources) go through Python, and only for rows that are PE files: the UDF
gets a null for all others.  Tables are followed as far as the file reaches,
in time linear in it: no table entry is visited twice, whatever the tables
that claim it.  What is malformed is named in ``error`` instead of being cut
or failing the task.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlens import config as C
from hexlens.functions.vectors import bound
from hexlens.sources.files import is_pe, le_of_reversed, le_uint

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
SECTION_FIELDS = [("pos", _I), ("name", _S), ("virtual_size", _L), ("va", _L), ("raw_size", _L), ("raw_ptr", _L),
                  ("characteristics", _L)]
SECTION_TYPE = T.StructType([T.StructField(n, t) for n, t in SECTION_FIELDS])
IMPORT_TYPE = T.StructType([T.StructField(n, t) for n, t in
                            (("entry_pos", _I), ("dll", _S), ("api", _S), ("ordinal", _L))])
TABLES_TYPE = T.StructType([
    T.StructField("imports", T.ArrayType(IMPORT_TYPE)),
    T.StructField("exports_count", _L),
    T.StructField("export_names", T.ArrayType(_S)),
    T.StructField("tls_callbacks", _I),
    T.StructField("reloc_blocks", _L),
    T.StructField("reloc_entries", _L),
    T.StructField("resources_count", _L),
    T.StructField("error", _S),
])
# Data directory entries
DIR_EXPORT, DIR_IMPORT, DIR_RESOURCE, DIR_EXCEPTION, DIR_SECURITY, DIR_RELOC, DIR_DEBUG, DIR_TLS = 0, 1, 2, 3, 4, 5, 6, 9
DIRECTORIES = 10  # of the sixteen: those behind the last that is read say nothing here


class Image:
    """One file's bytes with its sections; what is wrong with its tables is noted once."""

    def __init__(self, buf: bytes, sections, plus: bool):
        self.buf, self.sections, self.plus = buf, sections, plus
        self.problems: list[str] = []
        self.names_left = len(buf)  # names may share bytes, but never add up to more than the file
        self.map = self._map() if len(sections) > 16 else None

    def _map(self):
        """Starts of the ranges of addresses that belong to one section (the first that holds them), with the section or None."""
        spans = [(s["va"], s["va"] + max(s["virtual_size"], s["raw_size"]), k) for k, s in enumerate(self.sections)]
        starts, owners, opened, queue = [], [], [], sorted(spans, reverse=True)
        for at in sorted({x for a, z, _ in spans for x in (a, z)}):
            while queue and queue[-1][0] <= at:
                _, end, k = queue.pop()
                heapq.heappush(opened, (k, end))
            while opened and opened[0][1] <= at:
                heapq.heappop(opened)
            starts.append(at)
            owners.append(self.sections[opened[0][0]] if opened else None)
        return starts, owners

    def note(self, problem: str) -> None:
        if problem not in self.problems:
            self.problems.append(problem)

    def offset(self, rva: int) -> int | None:
        if self.map:
            k = bisect_right(self.map[0], rva) - 1
            s = self.map[1][k] if k >= 0 else None
            return None if s is None else rva - s["va"] + s["raw_ptr"]
        for s in self.sections:
            if s["va"] <= rva < s["va"] + max(s["virtual_size"], s["raw_size"]):
                return rva - s["va"] + s["raw_ptr"]
        return None

    def read(self, fmt: str, at: int | None):
        """The unpacked fields at an offset, or None if they aren't in the file."""
        if at is None or at < 0 or at + struct.calcsize(fmt) > len(self.buf):
            return None
        return struct.unpack_from(fmt, self.buf, at)

    def name(self, at: int | None) -> str | None:
        if at is None or not 0 <= at < len(self.buf):
            return None
        end = self.buf.find(b"\x00", at, at + self.names_left + 1)
        if end < 0:
            if at + self.names_left < len(self.buf):
                self.note("names larger than the file")
                self.names_left = 0  # or the search would be repeated for every name
                return None
            end = len(self.buf)
        self.names_left -= end - at
        return self.buf[at:end].decode("utf-8", "ignore")

    def start(self, directory) -> int | None:
        rva, size = directory["rva"], directory["size"]
        if not rva or not size:
            return None
        at = self.offset(rva)
        if at is None:
            self.note("directory outside the sections")
        return at


def read_imports(im: Image, directory) -> list[dict]:
    out, seen, at, entry = [], set(), im.start(directory), 0
    fmt, width, flag = ("<Q", 8, 1 << 63) if im.plus else ("<I", 4, 1 << 31)
    while at is not None:
        d = im.read("<IIIII", at)
        if d is None:
            im.note("imports run out of the file")
            break
        lookup, _, _, name_rva, thunks = d
        if not (lookup or name_rva or thunks):
            break
        dll, any_ = (im.name(im.offset(name_rva)) or "").lower(), False
        t = im.offset(lookup or thunks)
        while t is not None:
            if t in seen:
                im.note("import tables overlap")
                break
            seen.add(t)
            v = im.read(fmt, t)
            if v is None:
                im.note("imports run out of the file")
                break
            if not v[0]:
                break
            any_ = True
            if v[0] & flag:
                out.append({"entry_pos": entry, "dll": dll, "api": None, "ordinal": v[0] & 0xFFFF})
            else:
                hint = im.offset(v[0] & 0x7FFFFFFF)
                out.append({"entry_pos": entry, "dll": dll, "api": im.name(None if hint is None else hint + 2), "ordinal": None})
            t += width
        if not any_:
            out.append({"entry_pos": entry, "dll": dll, "api": None, "ordinal": None})
        at, entry = at + 20, entry + 1
    return out


def read_exports(im: Image, directory) -> tuple[int, list[str]]:
    at = im.start(directory)
    d = im.read("<IIII", None if at is None else at + 20)
    if d is None:
        return 0, []
    functions, count, _, table = d
    names, t = [], im.offset(table)
    for k in range(count if t is not None else 0):
        v = im.read("<I", t + 4 * k)
        if v is None:
            im.note("exports run out of the file")
            break
        n = im.name(im.offset(v[0]))
        if n:
            names.append(n)
    return functions, names


def read_relocations(im: Image, directory) -> tuple[int, int]:
    at, size, blocks, entries, pos = im.start(directory), directory["size"], 0, 0, 0
    while at is not None and pos + 8 <= size:
        d = im.read("<II", at + pos)
        if d is None or d[1] < 8:
            im.note("relocations run out of the file" if d is None else "relocation block too short")
            break
        blocks, entries, pos = blocks + 1, entries + (d[1] - 8) // 2, pos + d[1]
    return blocks, entries


class Slots:
    """Table entries of eight bytes, each of which is handed out once."""

    def __init__(self, size: int):
        self.next = array("q", range(size // 8 + 2))  # the first free cell from here on

    def _free(self, cell: int) -> int:
        root = cell
        while self.next[root] != root:
            root = self.next[root]
        while self.next[cell] != root:
            self.next[cell], cell = root, self.next[cell]
        return root

    def take(self, at: int, count: int):
        """Indices of the entries of a table at ``at`` that no table had before."""
        first = at // 8
        end = min(first + count, len(self.next) - 1)
        cell = self._free(min(first, end))
        while cell < end:
            self.next[cell] = cell + 1
            yield cell - first
            cell = self._free(cell)


def count_resources(im: Image, directory) -> int:
    base = im.start(directory)
    if base is None:
        return 0
    count, seen, todo, slots = 0, {base}, [base], Slots(len(im.buf))
    while todo:
        at = todo.pop()
        d = im.read("<HH", at + 12)
        entries, read = sum(d) if d else 0, 0
        there = min(entries, max(len(im.buf) - at - 16, 0) // 8)
        for k in slots.take(at + 16, there) if there else ():
            read += 1
            e = im.read("<II", at + 16 + 8 * k)
            if not e[1] & 0x80000000:
                count += 1
                continue
            to = base + (e[1] & 0x7FFFFFFF)
            if to in seen:
                im.note("resource directories overlap")
            else:
                seen.add(to)
                todo.append(to)
        if read < there:
            im.note("resource directories overlap")
        if there < entries:
            im.note("resources run out of the file")
    return count


def read_tables(buf: bytes, sections, dirs, plus: bool) -> dict:
    """The pointer tables of one PE file; dirs: its (rva, size) entries."""
    im = Image(buf, sections, plus)
    tls = im.start(dirs[DIR_TLS])
    callbacks = None if tls is None else im.read("<Q" if plus else "<I", tls + (24 if plus else 12))
    functions, names = read_exports(im, dirs[DIR_EXPORT])
    blocks, entries = read_relocations(im, dirs[DIR_RELOC])
    return {"imports": read_imports(im, dirs[DIR_IMPORT]), "exports_count": functions, "export_names": names,
            "tls_callbacks": int(bool(callbacks and callbacks[0])), "reloc_blocks": blocks, "reloc_entries": entries,
            "resources_count": count_resources(im, dirs[DIR_RESOURCE]), "error": "; ".join(im.problems) or None}


#: What the UDF reads of the sections and directories, and its columns as Arrow types.
_EXTENT = ("virtual_size", "va", "raw_size", "raw_ptr")
_ARROW = {f.name: pa.string() if f.dataType == _S else pa.int32() if f.dataType == _I else pa.int64() for f in TABLES_TYPE.fields}
_ARROW |= {"export_names": pa.list_(pa.string()),
           "imports": pa.list_(pa.struct([("entry_pos", pa.int32()), ("dll", pa.string()), ("api", pa.string()), ("ordinal", pa.int64())]))}


def _structs(lists: pa.Array, fields: tuple[str, ...]) -> list:
    """The lists of a column as lists of dicts of some of their fields; a null list is empty."""
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
    items = lists.flatten()
    flat = [dict(zip(fields, values, strict=True)) for values in zip(*(items.field(items.type.get_field_index(x)).to_pylist() for x in fields), strict=True)]
    return [flat[a:z] for a, z in zip(ends, ends[1:])]


@F.arrow_udf(TABLES_TYPE)
def pe_tables(content: pa.Array, sections: pa.Array, dirs: pa.Array, plus: pa.Array) -> pa.Array:
    rows = []
    for b, s, d, p in zip(content, _structs(sections, _EXTENT), _structs(dirs, ("rva", "size")), plus.to_pylist(), strict=True):
        if not b.is_valid:
            rows.append({})
            continue
        try:
            rows.append(read_tables(b.as_py(), s, d, bool(p)))
        except Exception as e:  # noqa: BLE001 - one hostile file must not end the job; it is reported
            rows.append({"error": f"{type(e).__name__}: {e}"})
    return pa.StructArray.from_arrays([pa.array([r.get(x) for r in rows], t) for x, t in _ARROW.items()], names=list(_ARROW))


def _header(c: Column, base: Column, fields: dict[str, tuple[int, int]]) -> list[Column]:
    return [le_uint(c, base + at, width).alias(name) for name, (at, width) in fields.items()]


def with_pe_headers(df: DataFrame, content: str = "content", out: str = "h") -> DataFrame:
    """Adds ``out``: null unless the file is PE (P2) with a whole optional header, else its parsed headers."""
    c, n = F.col(content), F.length(content).cast("bigint")
    df = df.withColumn("_nt", F.when(is_pe(c), le_uint(c, 0x3C, 4)))
    df = df.withColumn("_plus", le_uint(c, F.col("_nt") + 24, 2) == 0x20B)
    opt = F.col("_nt") + 24
    df = df.withColumn("_nt", F.when(opt + F.when(F.col("_plus"), 112).otherwise(96) <= n, F.col("_nt")))
    count_at = opt + F.when(F.col("_plus"), 108).otherwise(92)
    # Offsets and widths of the header fields
    coff = {"machine": (4, 2), "n_sections": (6, 2), "time_date_stamp": (8, 4), "symbols_count": (16, 4), "optional_size": (20, 2)}
    optional = {"entry_rva": (16, 4), "section_alignment": (32, 4), "file_alignment": (36, 4), "size_of_headers": (60, 4),
                "checksum": (64, 4), "subsystem": (68, 2), "dll_characteristics": (70, 2)}
    df = df.withColumn("_hd", F.when(F.col("_nt").isNotNull(), F.struct(
        *_header(c, F.col("_nt"), coff), *_header(c, opt, optional), le_uint(c, count_at, 4).alias("n_dirs"))))
    # contents are bound as variables: a column that a lambda names would be copied for each of its entries
    def cut(digits, at, there=F.lit(True)):  # four bytes at an offset of a block given as reversed hex digits; null when not all are there
        end = F.octet_length(digits) - 2 * at
        return le_of_reversed(F.when(there & (end >= 8), F.substring(digits, end - 7, 8)), 4)

    def block(b, at, width):
        return F.reverse(F.hex(F.substring(b, (F.least(at, F.length(b).cast("bigint")) + 1).cast("int"), width)))

    # the directories' digits are a column, and no lambda reads them: that would not be compiled
    df = df.withColumn("_dd", F.when(F.col("_nt").isNotNull(), block(c, count_at + 4, 8 * DIRECTORIES)))
    df = df.withColumn("_dirs", F.array(*(F.struct(*(
        F.coalesce(cut(F.col("_dd"), 8 * i + k, F.lit(i) < F.col("_hd.n_dirs")), F.lit(0)).cast("bigint").alias(x)
        for k, x in ((0, "rva"), (4, "size")))) for i in range(DIRECTORIES))))
    table = opt + F.col("_hd.optional_size")
    fits = F.least(F.col("_hd.n_sections"), F.greatest(F.floor((n - table) / 40), F.lit(0)))  # as many as the file holds
    places = F.when(fits > 0, F.transform(F.sequence(F.lit(0), (fits - 1).cast("int")), lambda i: F.struct(i.alias("pos"), (table + 40 * i).alias("at"))))

    def section(b, p):
        raw = F.substring(b, (p["at"] + 1).cast("int"), 8)
        bare = F.unhex(F.regexp_extract(F.hex(raw), r"^((?:(?!00)..)*)", 1))  # up to the first zero byte
        name = F.regexp_replace(F.make_valid_utf8(bare.cast("string")), "\ufffd", "")
        return F.struct(p["pos"].alias("pos"), name.alias("name"),
                        *(cut(p["row"], k).alias(x) for k, x in
                          ((8, "virtual_size"), (12, "va"), (16, "raw_size"), (20, "raw_ptr"), (36, "characteristics"))))

    def rows(b):
        return F.transform(places, lambda p: F.struct(p["pos"].alias("pos"), p["at"].alias("at"), block(b, p["at"], 40).alias("row")))

    empty = F.array().cast(T.ArrayType(SECTION_TYPE))
    df = df.withColumn("_sec", F.coalesce(bound(c, lambda b: F.transform(rows(b), lambda p: section(b, p))), empty))
    ok = F.col("_nt").isNotNull()
    df = df.withColumn("_tab", pe_tables(F.when(ok, c), F.when(ok, F.col("_sec")), F.when(ok, F.col("_dirs")), F.when(ok, F.col("_plus"))))
    d = lambda k, x: F.col("_dirs")[k][x]
    short = F.when(F.size("_sec") < F.col("_hd.n_sections"), "section table runs out of the file")
    fields = [*(F.col(f"_hd.{x}").alias(x) for x in (*coff, *optional) if x not in ("n_sections", "optional_size")),
              F.col("_plus").alias("pe32_plus"), d(DIR_EXPORT, "size").alias("export_size"), d(DIR_IMPORT, "size").alias("import_size"),
              d(DIR_RESOURCE, "size").alias("resource_size"), d(DIR_EXCEPTION, "size").alias("exception_size"),
              d(DIR_SECURITY, "rva").alias("security_va"), d(DIR_SECURITY, "size").alias("security_size"),
              d(DIR_RELOC, "size").alias("reloc_size"), d(DIR_DEBUG, "size").alias("debug_size"), d(DIR_TLS, "size").alias("tls_size"),
              F.col("_sec").alias("sections"), *(F.col(f"_tab.{f.name}").alias(f.name) for f in TABLES_TYPE.fields if f.name != "error"),
              F.when(F.concat_ws("; ", short, "_tab.error") != "", F.concat_ws("; ", short, "_tab.error")).alias("error")]
    return df.withColumn(out, F.when(ok, F.struct(*fields))).drop("_nt", "_plus", "_hd", "_dd", "_dirs", "_sec", "_tab")


# ---------------------------------------------------------------------------
# header scalars
# ---------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dll_flags(dll_characteristics) -> dict[str, Column]:
    """NX, ASLR, SEH (absence of NO_SEH), CFG bits."""
    c = _c(dll_characteristics)
    return {
        "has_nx_compat": (c.bitwiseAND(F.lit(C.DLLCHAR_NX_COMPAT)) != 0).cast("int"),
        "has_aslr": (c.bitwiseAND(F.lit(C.DLLCHAR_DYNAMIC_BASE)) != 0).cast("int"),
        "has_seh": (c.bitwiseAND(F.lit(C.DLLCHAR_NO_SEH)) == 0).cast("int"),
        "has_guard_cf": (c.bitwiseAND(F.lit(C.DLLCHAR_GUARD_CF)) != 0).cast("int"),
    }


def pe_timestamp(stamp) -> tuple[Column, Column]:
    """F8: epoch seconds and its UTC year; 0 when absent."""
    s = F.coalesce(_c(stamp), F.lit(0)).cast("bigint")
    year = F.when(s > 0, F.year(F.timestamp_seconds(s))).otherwise(F.lit(0))
    return s, year


def signature_probe(content, security_va, security_size) -> dict[str, Column]:
    """signature present, size, and whether it mentions signingTime (text or OID)."""
    size = F.coalesce(_c(security_size), F.lit(0)).cast("bigint")
    at = F.coalesce(_c(security_va), F.lit(0)).cast("bigint")
    n = F.length(_c(content)).cast("bigint")  # hostile headers point beyond the file: clip before the int cast
    blob = F.substring(_c(content), (F.least(at, n) + 1).cast("int"), F.least(size, n).cast("int"))
    has = (size > 0) & (at > 0)
    # OID 1.2.840.113549.1.9.5 (signingTime) DER bytes, and the attribute name as text
    oid = F.unhex(F.lit("2A864886F70D010905"))
    latin = F.decode(blob, "ISO-8859-1")  # one char per byte: byte-exact substring search
    mentions = F.instr(latin, F.decode(oid, "ISO-8859-1")) > 0
    text = F.instr(latin, "signingTime") > 0
    return {"has_signature": has.cast("int"), "signature_size": F.when(has, size).otherwise(0),
            "signature_has_signing_time": (has & (mentions | text)).cast("int")}

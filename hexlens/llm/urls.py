"""Op 9: URL verdicts by rules, and by a ratio of character language models where no rule fits.

Two variable-order Markov models over the bytes of a URL, one of accepted and
one of rejected URLs, are counted by Spark from every URL that a rule decides.
Each order falls back on the next shorter context by Witten-Bell smoothing.  A
URL's score is the difference of the two log-likelihoods per byte; the cut is
calibrated on rule-decided URLs that were left out of the counts.

Counts are exact and kept as Spark tables.  A byte with the bytes of its longest
context is one number, a window; the grams of all shorter orders are its
suffixes.  So the probabilities are worked out once for each distinct window,
order by order: a suffix or a context has at most 256 rows of the next order,
however often it occurs.  URLs are then joined to their windows' log ratios;
the few most frequent windows, which every URL may hold, are looked up in the
task instead.  These joins are always by shuffles: a window or a row's number takes
a few bytes of a file or a shuffle, but tens of them in a table that is sent out,
so a bound by bytes written would let the driver hold tables that grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import crc_mod, passes, release, string_buffer, write_step

# The rules of the production query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Bytes of context at most; slots of the hashed form of ``slots``, which ``judge`` doesn't use.
ORDER, BITS = 5, 18
BIN = 0.01
#: A window with this part of all occurrences or more is looked up in the task: there are at most so many.
FREQUENT = 4096
#: Log ratios are added as whole numbers of 1 / UNIT, so that the order of adding doesn't matter.
UNIT = 1 << 32
KINDS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def slots(urls: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Row of each byte, slots of its contexts and of context with byte (one array an order), bytes of each row."""
    pad = b"\x02" * ORDER
    raw = [pad + (u or "").encode() for u in urls]
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    real = np.ones(len(buf), bool)
    for k in range(ORDER):
        real[ends - sizes + k] = False
    at = np.flatnonzero(real)
    shift = np.uint64(64 - BITS)
    contexts, grams = [], []
    v = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            v = v * np.uint64(0x100000001B3) + buf[at - k] + np.uint64(1)
        c = hashing.mix(v + np.uint64(k << 56))
        contexts.append((c >> shift).astype(np.int64))
        grams.append((hashing.mix(c ^ (buf[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
    return np.repeat(np.arange(len(urls)), sizes - ORDER), contexts, grams, sizes - ORDER


class Markov:
    """Smoothed variable-order model as arrays over slots of contexts and grams."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, kinds: np.ndarray):
        self.gram, self.context, self.kinds = gram, context, kinds

    def log_p(self, contexts: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), 1 / 256)
        for c, g in zip(contexts, grams, strict=True):
            n, kinds = self.context[c], self.kinds[c]
            p = (self.gram[g] + (kinds + 0.01) * p) / (n + kinds + 0.01)
        return np.log(p)


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each byte, and its window: the ORDER bytes before it (2 before a row's start) and, lowest, the byte itself."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(buf)) - off[row]
    w = np.zeros(len(buf), np.int64)
    for k in range(ORDER, -1, -1):
        have = np.flatnonzero(at >= k)
        own = np.full(len(buf), 2, np.int64)
        own[have] = buf[have - k]
        w = (w << 8) | own
    return row, w


def suffix(name: str, order: int) -> Column:
    """The gram of ``order`` that ends a window or a longer gram."""
    return F.col(name).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def count_windows(urls: DataFrame) -> DataFrame:
    """gram, n, allow, block: each distinct window of the column url, its occurrences, and those in URLs with that value of the column kind."""
    def count(batches):
        for b in batches:
            buf, off = string_buffer(b.column(0))
            kinds = np.array([KINDS.index(k) if k else -1 for k in b.column(1).to_pylist()], np.int64)
            for i, j in passes(off):
                row, w = windows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                gram, at = np.unique(w, return_inverse=True)
                kind = kinds[i:j][row]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(np.bincount(at[own], minlength=len(gram))) for own in (slice(None), kind == 0, kind == 1))],
                                                 ["gram", "n", *KINDS])

    return (urls.select("url", "kind").mapInArrow(count, "gram long, n long, allow long, block long")
            .groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", *KINDS))))


def low_orders(counts: DataFrame) -> DataFrame:
    """shorter, p_allow, p_block: probabilities of the grams of order 1."""
    got = counts.groupBy(suffix("gram", 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in KINDS)).toPandas()  # at most 65,536 rows
    gram = got.gram.to_numpy(np.int64)
    out = got[["gram"]].rename(columns={"gram": "shorter"})
    for kind in KINDS:
        n = got[kind].to_numpy(float)
        first = np.bincount(gram & 255, n, 256)
        table = np.zeros(1 << 16)
        table[gram] = n
        pairs = table.reshape(256, 256)
        model = Markov(np.concatenate((first, table)), np.concatenate(([n.sum()], pairs.sum(1))),
                       np.concatenate(([np.count_nonzero(first)], np.count_nonzero(pairs, axis=1))))
        out[f"p_{kind}"] = np.exp(model.log_p([np.zeros(len(gram), np.int64), 1 + (gram >> 8)], [gram & 255, 256 + gram]))
    return F.broadcast(counts.sparkSession.createDataFrame(out, "shorter long, p_allow double, p_block double"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, n, ratio (in units) of each distinct window, from its probabilities of order 1 up to ORDER."""
    p = low_orders(counts)
    for k in range(2, ORDER + 1):
        own = counts if k == ORDER else counts.groupBy(suffix("gram", k).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n", *KINDS)))
        context = Window.partitionBy(F.shiftright("gram", 8))
        cols = [f(kind) for kind in KINDS for f in (F.col, lambda c: F.sum(c).over(context).alias(f"all_{c}"),
                                                    lambda c: F.count_if(F.col(c) > 0).over(context).alias(f"kinds_{c}"))]
        smoothed = [((F.col(c) + (F.col(f"kinds_{c}") + 0.01) * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}") + 0.01)).alias(f"p_{c}") for c in KINDS]
        p = (own.select("gram", "n", suffix("gram", k - 1).alias("shorter"), *cols)
             .join(p if k == 2 else p.hint("merge"), "shorter").select(F.col("gram").alias("shorter"), "n", *smoothed))
        if k < ORDER:
            p = p.drop("n")
    return p.select(F.col("shorter").alias("gram"), "n", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("ratio"))


def add_score(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """The rows of ``urls``, which need a column row of their own, with llr: the log-likelihood difference per byte (0 for an empty URL)."""
    total = ratios.agg(F.sum("n")).first()[0] or 0
    got = ratios.filter(F.col("n") * FREQUENT >= total).select("gram", "ratio").toPandas().sort_values("gram")
    known, value = got.gram.to_numpy(np.int64), got.ratio.to_numpy(np.int64)  # at most FREQUENT rows

    def look_up(w):
        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
        return at, known[at] == w

    def rest(batches):
        for b in batches:
            buf, off = string_buffer(b.column(1))
            for i, j in passes(off):
                row, w = windows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if len(known):
                    left = ~look_up(w)[1]
                    row, w = row[left], w[left]
                order = np.lexsort((w, row))
                row, w = row[order], w[order]
                cut = np.flatnonzero(np.concatenate((np.ones(min(len(w), 1), bool), (row[1:] != row[:-1]) | (w[1:] != w[:-1]))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + row[cut])), pa.array(w[cut]), pa.array(np.diff(np.append(cut, len(w))))],
                                                 ["row", "gram", "times"])

    def frequent(batches):
        for b in batches:
            buf, off = string_buffer(b.column(b.schema.get_field_index("url")))
            out = np.zeros(b.num_rows, np.int64)
            for i, j in passes(off) if len(known) else ():
                row, w = windows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at, hit = look_up(w)
                np.add.at(out, i + row[hit], value[at[hit]])
            yield b.append_column("near", pa.array(out)).append_column("size", pa.array(np.diff(off)))

    far = (urls.select("row", "url").mapInArrow(rest, "row long, gram long, times long").join(ratios.select("gram", "ratio").hint("merge"), "gram")
           .groupBy("row").agg(F.sum(F.col("times") * F.col("ratio")).alias("far")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema) + ", near long, size long"
    units = F.col("near") + F.coalesce("far", F.lit(0))
    return (urls.mapInArrow(frequent, schema).join(far.hint("merge"), "row", "left")
            .select(*urls.columns, (units / float(UNIT) / F.greatest("size", F.lit(1))).alias("llr")))


def calibrate(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy on rule-decided rows, from a histogram of fixed bins."""
    bins = scored.groupBy("verdict", F.floor(F.col("llr") / BIN).alias("bin")).count().toPandas()
    if set(bins.verdict) != {"allow", "block"}:
        return 0.0
    wide = bins.pivot_table(index="bin", columns="verdict", values="count", fill_value=0).sort_index()
    good, bad = wide["allow"] / wide["allow"].sum(), wide["block"] / wide["block"].sum()
    balanced = bad.cumsum().shift(fill_value=0) + good[::-1].cumsum()[::-1]  # cut at the lower edge of each bin
    edges = balanced.index.to_numpy()
    best = np.flatnonzero(np.isclose(balanced, balanced.max()))
    low = edges[best[0] - 1] + 1 if best[0] else edges[0]  # no row lies between that bin and the first best one
    return float((low + edges[best[-1]]) / 2 * BIN)


def judge(pages: DataFrame, rules=RULES, fold: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), llr, cut for every row.

    A URL that a rule fits has the rule's verdict; any other is allowed if its
    score reaches the calibrated cut.  A null URL, or one without ``://``, has
    an empty host and path and is judged by the models (a null or empty one
    scores 0).  Repeated rows are judged alike; other columns are not read; an
    empty table gives no rows, and without both kinds of training URLs the cut
    is 0.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url, host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("verdict"), (crc_mod("page_id", fold) == fold - 1).alias("late"))
    base, at_base = write_step(base.withColumn("row", F.monotonically_increasing_id()), "urls")
    counts, at_counts = write_step(count_windows(base.withColumn("kind", F.expr("case when not late then verdict end"))), "url-windows")
    ratios, at_ratios = write_step(log_ratios(counts), "url-ratios")
    scored, _ = write_step(add_score(base, ratios).drop("url", "row"), "url-scores")
    release(pages.sparkSession, at_base, at_counts, at_ratios)
    cut = calibrate(scored.filter("late and verdict is not null"))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("llr") >= cut, "allow").otherwise("block")).alias("verdict"),
        "llr", F.lit(cut).alias("cut"))

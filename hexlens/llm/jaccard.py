"""Op 2: n-gram Jaccard join by MinHash banding.

Texts with the same set of word n-grams are one node.  Each node has a MinHash
signature of bands x rows values; nodes meet in the buckets of their bands'
hashes, and a pair belongs to the first band in which it meets, so it is
looked at once.  Pairs are verified on the full n-gram sets inside the tasks;
what leaves them is one row a node: its number of links and the smallest node
that it is joined to, never the pairs.  A crowded bucket is cut into blocks,
and pairs of blocks are tasks of their own.  Links make classes by rounds of
smallest labels, each written to the shared folder.

With 18 bands of 5 rows a pair of similarity 0.8 meets with a probability of
0.9992, and one of 0.3 with 0.04.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlens.llm import hashing
from hexlens.llm.common import free_name, passes, release, string_buffer, write_step

WORDS, BANDS, ROWS = 5, 18, 5
#: Nodes of a block of a crowded bucket on average; nodes, or bytes of n-grams, that one task call takes on average.
BLOCK, BIN_NODES, BIN_BYTES = 256, 20_000, 6 << 20
#: Most candidate nodes whose ids are broadcast to the scan of the texts (16 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 500_000
U = np.uint64
NODES = "doc_id long, node long, n_grams long, bands array<long>"


def ngram_sets(buf: np.ndarray, off: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Each row's distinct n-grams as ascending hashes; a row of fewer than ``n`` words has one, of all its words."""
    starts, ends, first = hashing.spans(buf, off, hashing.space_table())
    words = hashing.word_hashes(buf, starts, ends)
    grams = hashing.window_hashes(words, n)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        elif z > a:
            out.append(hashing.mix(hashing.window_hashes(words[a:z], int(z - a)) + U(z - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def set_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit identity for each set: the sum of its mixed members."""
    return np.add.reduceat(hashing.mix(flat + U(0x51ED270B)), at) if len(at) else np.zeros(0, U)


def band_hashes(flat: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) hashes of MinHash signatures."""
    factor = hashing.mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    out = np.zeros((len(at), bands), U)
    for b in range(bands):
        acc = np.full(len(at), U(b + 1))
        for r in range(rows):
            f = factor[b * rows + r]
            acc = hashing.mix(acc + np.minimum.reduceat(hashing.mix(flat * f), at) * f)
        out[:, b] = acc
    return out


def describe(batches):
    """doc_id, node, number of n-grams and band hashes of each document; node 0 and no bands without words."""
    for b in batches:
        buf, off = string_buffer(b.column(1))
        for i, j in passes(off):
            sets = ngram_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            flat = np.concatenate([np.zeros(0, U), *sets])
            at = (np.cumsum(size) - size)[full]
            node, hashes = np.zeros(j - i, U), np.zeros((0, BANDS), U)
            if len(full):
                node[full], hashes = set_ids(flat, at), band_hashes(flat, at)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((size > 0) * BANDS))), pa.int32()), pa.array(hashes.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(node.view(np.int64)), pa.array(size), bands],
                                             ["doc_id", "node", "n_grams", "bands"])


def matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten()).reshape(-1, width)


def owned_pairs(sig: np.ndarray, part: np.ndarray, a: int, b: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket's blocks a and b whose first common band is this one."""
    left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
    mine = np.ones((len(left), len(right)), bool)
    for k in range(band):
        mine &= sig[left, k][:, None] != sig[right, k][None, :]
    mine &= sig[left, band][:, None] == sig[right, band][None, :]
    if a == b:
        mine = np.triu(mine, 1)
    i, j = np.nonzero(mine)
    return left[i], right[j]


def groups_of(t: pa.Table):
    """Row numbers of each task group (gid) of a table."""
    gid = t["gid"].to_numpy()
    order = np.argsort(gid, kind="stable")
    cuts = np.flatnonzero(np.diff(gid[order])) + 1
    yield from np.split(order, cuts) if len(order) else ()


def needed(t: pa.Table) -> pa.Table:
    """The rows of groups' members that have a pair of their own there."""
    sig, part = matrix(t["bands"], BANDS), t["part"].to_numpy()
    a, b, band = t["a"].to_numpy(), t["b"].to_numpy(), t["band"].to_numpy()
    keep = [np.zeros(0, np.int64)]
    for g in groups_of(t):
        if len(g) > 1:
            i, j = owned_pairs(sig[g], part[g], a[g[0]], b[g[0]], band[g[0]])
            keep.append(g[np.unique(np.concatenate((i, j)))])
    return t.drop_columns(["bin"]).take(pa.array(np.sort(np.concatenate(keep))))


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i[k] and j[k]."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    own = np.unique(np.concatenate((i, j)))
    place = np.zeros(len(sets), np.int64)
    place[own] = np.arange(len(own))
    size = [len(sets[k]) for k in own]
    value, col = np.unique(np.concatenate([sets[k] for k in own]), return_inverse=True)
    row = np.repeat(np.arange(len(own)), size)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(own), len(own)), np.float32)
    step = 4096
    for c in range(0, len(value), step):  # columns of the incidence matrix, a slice at a time
        f, e = np.searchsorted(col, (c, c + step))
        x = np.zeros((len(own), step), np.float32)
        x[row[f:e], col[f:e] - c] = 1
        out += x @ x.T
    return out[place[i], place[j]].astype(np.int64)


def verify(t: pa.Table, num: int, den: int) -> pa.Table:
    """Of each group's members: copies linked to, and the smallest member joined to, at similarity >= num/den."""
    sig, part = matrix(t["bands"], BANDS), t["part"].to_numpy()
    a, b, band = t["a"].to_numpy(), t["b"].to_numpy(), t["band"].to_numpy()
    node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
    grams = t["grams"].combine_chunks()
    flat, off = np.asarray(grams.values).view(U), np.asarray(grams.offsets)
    out_n, out_l, out_r = [], [], []
    for g in groups_of(t):
        i, j = owned_pairs(sig[g], part[g], a[g[0]], b[g[0]], band[g[0]])
        if not len(i):
            continue
        sets = [flat[off[k] : off[k + 1]] for k in g]
        size = np.array([len(s) for s in sets], np.int64)
        both = intersections(sets, i, j)
        ok = den * both >= num * (size[i] + size[j] - both)
        i, j = i[ok], j[ok]
        links = np.bincount(i, copies[g][j], len(g)) + np.bincount(j, copies[g][i], len(g))
        root = node[g].copy()
        while True:  # smallest label within the group
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if np.array_equal(before, root):
                break
        some = np.flatnonzero(links)
        out_n.append(node[g][some])
        out_l.append(links[some].astype(np.int64))
        out_r.append(root[some])
    empty = np.zeros(0, np.int64)
    return pa.table([pa.array(np.concatenate([empty, *c])) for c in (out_n, out_l, out_r)], names=["node", "links", "root"])


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Smallest node reachable from each node of the edges (node, root), as a step: node, label.

    Each round takes the smallest label around a node and then that label's
    own label, until nothing changes.
    """
    spark = edges.sparkSession
    both = edges.select("node", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("other")))
    labels, path = write_step(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
        new, new_path = write_step(step.join(jump, "to").select("node", F.least("to", "jump").alias("label"), (F.least("to", "jump") != F.col("label")).alias("moved")), "jaccard-labels")
        moved = new.filter("moved").limit(1).count()
        release(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not moved:
            return labels, path


def join(docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links for every row: documents linked at Jaccard >= num/den on sets of five-word n-grams.

    n_links counts the other rows linked to a row, copies included; class_id is
    the smallest doc_id of those reachable over links.  Words are runs of bytes
    other than space and 0x09-0x0D, as they stand; a text of one to four words
    is one n-gram; a null or empty one links to nothing and is its own class.
    Repeated rows are copies of each other; a null id counts but names a class
    only if all its ids are null.  Other columns are not read; an empty table
    gives no rows.  Sets are told apart by 64-bit identities.
    """
    spark = docs.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described, at = write_step(text.mapInArrow(describe, NODES), "jaccard-nodes")
    nodes, at_nodes = write_step(described.filter("n_grams > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "jaccard-sets")

    met = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    crowd = met.groupBy("band", "value").agg(F.count("*").alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / BLOCK).cast("long")
    members = (met.join(crowd, ["band", "value"]).withColumn("part", F.pmod(F.xxhash64("node", "value"), parts))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
               .select("node", "band", "value", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))
    grouped = (members.withColumn("gid", F.xxhash64("band", "value", "a", "b")).drop("value")
               .join(nodes.select("node", "bands", "copies", "n_grams", "first_id"), "node"))
    met_rows, at_met = write_step(grouped, "jaccard-met")
    bins = max(deal, -(-met_rows.count() // BIN_NODES))
    in_bins = met_rows.withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(bins)))
    wanted, at_wanted = write_step(in_bins.groupBy("bin").applyInArrow(needed, met_rows.schema), "jaccard-needed")
    release(spark, at_met)

    which, at_which = write_step(wanted.groupBy("node").agg(F.first("first_id").alias("first_id")), "jaccard-which")
    n_which = which.count()
    which = F.broadcast(which) if n_which <= BROADCAST_NODES else which

    def sets_of(batches):
        for b in batches:
            buf, off = string_buffer(b.column(1))
            for i, j in passes(off):
                sets = ngram_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                size = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([np.zeros(0, U), *sets])
                node = np.zeros(j - i, U)
                full = np.flatnonzero(size)
                if len(full):
                    node[full] = set_ids(flat, (np.cumsum(size) - size)[full])
                own = pa.array(node.view(np.int64) == b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False))
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), grams], ["node", "grams"]).filter(own)

    texts = (text.join(which, text.doc_id.eqNullSafe(which.first_id)).select("node", "text")
             .mapInArrow(sets_of, "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams")))
    size = (wanted.agg(F.sum("n_grams")).first()[0] or 0) * 8
    bins = max(deal, -(-size // BIN_BYTES))
    full = wanted.join(texts, "node").withColumn("bin", F.pmod(F.xxhash64("gid"), F.lit(bins))).select(
        "bin", "gid", "node", "band", "part", "a", "b", "bands", "copies", "grams")
    found, at_found = write_step(full.groupBy("bin").applyInArrow(lambda t: verify(t, num, den), "node long, links long, root long"), "jaccard-links")
    release(spark, at_wanted, at_which)

    labels, at_labels = components(found.select("node", "root").distinct())
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = (nodes.select("node", "first_id", "copies").join(labels, "node", "left").join(linked, "node", "left")
              .select("node", F.coalesce("label", "node").alias("label"), "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = joined.groupBy("label").agg(F.min("first_id").alias("class_id"))
    classes, _ = write_step(joined.join(names, "label").select("node", "class_id", "n_links"), "jaccard-classes")
    release(spark, at_nodes, at_found, at_labels)
    return described.select("doc_id", F.when(F.col("n_grams") > 0, F.col("node")).alias("node")).join(classes, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def first_of_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: one row of each class stays.

    It is the one with the smallest doc_id (null ids last, repeated ids in the
    order read); rows without links, such as those of null and empty texts, all
    stay.  Columns may have any names; an empty table stays empty.
    """
    spark = docs.sparkSession
    ROW = free_name("jc_row", docs.columns)  # noqa: N806
    rows, _ = write_step(docs.withColumn(ROW, F.monotonically_increasing_id()), "jaccard-rows")  # numbers that stay as written
    linked = join(rows, id_col=ROW).filter("n_links > 0").select(F.col("doc_id").alias(ROW), "class_id").join(rows.select(ROW, "doc_id"), ROW)
    linked, at = write_step(linked, "jaccard-linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", ROW)).alias("f")).select(F.col(f"f.{ROW}").alias(ROW))
    others, _ = write_step(linked.select(ROW).join(first, ROW, "left_anti"), "jaccard-others")
    release(spark, at)
    others = F.broadcast(others) if others.count() <= BROADCAST_NODES else others
    return rows.join(others, ROW, "left_anti").drop(ROW).toDF(*docs.columns)

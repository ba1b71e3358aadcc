"""Scan files to verdicts, with features only for what the cache doesn't know.

path guard -> content hash -> cache lookup on keys -> (misses only) PE check,
features, route, expert, verdict, nearest family of the malicious -> one row
a file.  The lookup joins keys; contents stay where they are read, and the misses
are told by an exact filter (``keyfilter``).  The same function serves the batch
query and the stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlens import config as C
from hexlens.functions.routing import routing_label, sigmoid_gate, verdict
from hexlens.operators import families as FM
from hexlens.operators import training as TR
from hexlens.operators.featurise import featurise
from hexlens.operators.joins import cache_lookup
from hexlens.operators.keyfilter import members
from hexlens.plans import dims as D
from hexlens.session import materialize
from hexlens.sources.files import base_name, path_guard

FAMILY = "struct<cluster_id:int,family_name:string,is_new_family:boolean>"
RESULT = ["file_path", "file_name", "file_size", "sha256", "cache_hit", "route", "score", "is_malware", "confidence",
          "malware_family", "virus_family", "error"]


def route_from_vector(features: str, rule: str = "python") -> Column:
    """Routing over the normalised (x0.8) vector values, as both scorers read them (Q5).

    ``python``: sigmoid gate (F11); ``native``: the training rule (F12).
    """
    v = F.col(features)
    ps, kc = v[D.ROW_POS["packed_sections_ratio"]], v[D.ROW_POS["packer_keyword_hits_count"]]
    if rule == "native":
        return routing_label(ps, kc)
    return sigmoid_gate(v[D.ROW_POS["high_entropy_ratio"]], ps, v[D.ROW_POS["packer_keyword_hits_ratio"]])


def virus_family(family: str | Column = "malware_family") -> Column:
    """The nested family name at top level."""
    return (F.col(family) if isinstance(family, str) else family)["family_name"]


def scan_corpus(files: DataFrame, experts: dict, family_model: DataFrame | None = None, family_scaler: DataFrame | None = None,
                cache: DataFrame | None = None, allowed_root: str | None = None, require_pe: bool = True, rule: str = "python",
                native: bool = False, threshold: float = C.PREDICTION_THRESHOLD) -> DataFrame:
    """One row a file (path, length, content): the columns ``RESULT``.

    C1: ``require_pe=True``, python gate, cache.  C2: ``require_pe=False``,
    ``rule="native"``, ``native=True``.  Files that fail the path guard, or the
    PE check where it is required, have no row.  ``cache`` has sha256, score
    and malware_family of known contents: a hit takes them with the current
    path, and no features are computed for it.  Each route is scored by its
    expert (a Spark ML model, or a column over sha256, length and features); a
    missing expert scores 0.
    """
    f = files.where(path_guard("path", allowed_root)).select("path", F.col("length").cast("bigint").alias("length"), "content")
    f = f.withColumn("sha256", F.sha2("content", 256))
    hits = None
    if cache is not None:
        keys = cache.select("sha256", F.col("score").alias("_score"), F.col("malware_family").cast(FAMILY).alias("_family"))
        known = materialize(cache_lookup(f.select("path", "length", "sha256"), keys), "scan-lookup")  # no content is moved
        hits = known.where("cache_hit").select("path", "length", "sha256", F.lit(True).alias("cache_hit"), F.lit(None).cast("int").alias("route"),
                                               F.col("_score").alias("score"), F.col("_family").alias("malware_family"), F.lit(None).cast("string").alias("error"))
        contents = materialize(known.groupBy("sha256").agg((~F.any_value("cache_hit")).alias("miss")), "scan-contents")
        parts = [f.where(missing(F.col("sha256"))) for missing in members(contents, "sha256", "miss")] or [f.where(F.lit(False))]
    else:
        parts = [f]
    feats = [featurise(p.select("path", "length", "content"), "path", native=native).select("path", "length", "sha256", "is_pe", "features", "error") for p in parts]
    # written once: the filters below must not reach into the parser, and three branches read it
    feats = materialize(reduce(DataFrame.unionByName, feats), "scan-features")
    if require_pe:
        feats = feats.where("is_pe")
    x = TR.assemble(feats, "features", "vec").withColumn("route", route_from_vector("features", rule))
    scored = TR.expert_predict(x, "route", experts, features="vec").select("path", "length", "sha256", "features", "route", "score", "error")
    if family_model is not None and family_scaler is not None:
        mal = scored.where(F.col("score") > threshold).select("path", "features")
        z = FM.scaler_apply(mal, "features", family_scaler, "z").select("path", "z")
        fam = FM.nearest_centroid(z, "z", family_model).select("path", F.struct(
            F.col("cluster_id").cast("int").alias("cluster_id"), "family_name", "is_new_family").alias("malware_family"))
        scored = scored.join(fam, "path", "left")  # the malicious rows only: a narrow side
    else:
        scored = scored.withColumn("malware_family", F.lit(None).cast(FAMILY))
    out = scored.select("path", "length", "sha256", F.lit(False).alias("cache_hit"), "route", "score", "malware_family", "error")
    out = out if hits is None else out.unionByName(hits)
    is_mal, conf = verdict("score", threshold)
    return out.select(F.col("path").alias("file_path"), base_name("path").alias("file_name"), F.col("length").alias("file_size"), "sha256",
                      "cache_hit", "route", "score", is_mal.alias("is_malware"), conf.alias("confidence"), "malware_family",
                      virus_family().alias("virus_family"), "error")


def scan_summary(results: DataFrame) -> DataFrame:
    """Files, malware, and malicious files of no known family."""
    return results.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("is_malware").cast("int")).cast("bigint").alias("malware"),
                       F.sum((F.col("is_malware") & F.coalesce(F.col("malware_family.is_new_family"), F.lit(False))).cast("int")).cast("bigint").alias("new_families"))

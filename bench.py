"""Time the registered queries at one scale factor; print one JSON line.

``value`` is the total of the analytic queries; model-fitting queries are
timed too and reported under ``training_queries`` / ``training_seconds``.
``reads_earlier_table`` names the queries that found a shared table (features of
the PE corpus, of the labelled documents, scan results) written by a query before
them: their times don't hold its cost.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default all registered queries).
Each query is executed fully with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hexlens.catalog import load_all  # noqa: E402
from hexlens.session import _ONCE, REUSED, build_session, release_materialized  # noqa: E402

try:
    import corpus_pipeline
    from hexlens.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

# model-fitting queries (iterative Spark ML jobs); timed and reported separately
TRAINING = {"train_evaluate", "feature_importance_top", "kmeans_families", "continued_boosting", "fp_reinforcement", "cv_tune",
            "gating_mlp", "feature_gating", "incremental_fit", "first_split", "early_stop", "tuned_trees", "gated_trees", "fp_loops",
            "train_all", "mini_batch_kmeans"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    reg = {name: q.fn for name, q in load_all().items()}
    documents = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run} if llm_queries else {}
    reg |= documents
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(reg)
    # warm-up on the smallest tables: JVM code paths, Python workers (numpy/pyarrow imports)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for w in ("cluster_sizes", "byte_window_stats", "roc_auc", "nearest_centroid", "featurise_documents"):
        if w in reg:
            reg[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    shared: list[str] = []
    for name in wanted:
        t0, before = time.perf_counter(), len(REUSED)
        made = set(_ONCE)
        try:
            reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        if any(k in made for k in REUSED[before:]):
            shared.append(name)
    sf = sf_dir.rsplit("sf", 1)[-1]
    analytic = {k: v for k, v in times.items() if k not in TRAINING and k not in documents}
    llm = {k: v for k, v in times.items() if k in documents}
    training = {k: v for k, v in times.items() if k in TRAINING}
    out = {"metric": "total_query_seconds", "value": round(sum(analytic.values()), 3), "unit": "sec",
           "queries": analytic, "training_queries": training,
           "training_seconds": round(sum(training.values()), 3),
           "document_queries": llm, "document_seconds": round(sum(llm.values()), 3),
           "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
           "cpus": cpus, "n_queries": len(times), "reads_earlier_table": shared}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    release_materialized(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the no-op sink (no driver
collect), after one warm-up run of the flagship query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanternqa.operators.pruned import retrieve_terms  # noqa: E402
from lanternqa.plans import catalog, fixtures  # noqa: E402
from lanternqa.session import local_session  # noqa: E402

#: bm25_topk and the like build the index anew; index_build and bm25_query time the two parts.
HEADLINE = ("bm25_topk", "tfidf_topk", "term_counts", "span_sum", "dense_topk", "contains_tokens")


def parts(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of building the stored index, and of retrieving over it."""
    t0 = time.perf_counter()
    index = catalog.corpus_segments(spark, sf_dir)
    t1 = time.perf_counter()
    retrieve_terms(index, fixtures.questions(spark, sf_dir), k=5).write.format("noop").mode("overwrite").save()
    return {"index_build": round(t1 - t0, 3), "bm25_query": round(time.perf_counter() - t1, 3)}


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    run(spark, "bm25_topk", sf_dir)  # JVM / Python worker warm-up
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    total = round(sum(times.values()), 3)
    if not sys.argv[1:]:
        times |= parts(spark, sf_dir)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total,
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

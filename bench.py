"""Time the registered queries: ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_QUERIES``.

Prints one JSON line. Each query is run to its end once, every row computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans import fixtures, registry  # noqa: E402
from tidemark.plans.queries_feed import landed  # noqa: E402
from tidemark.plans.queries_search import index_of  # noqa: E402
from tidemark.session import build_session  # noqa: E402

# One query per kind of work; ``BENCH_QUERIES`` names others.
HEADLINES = """
    recent_changes repo_events_dedup drop_reasons edit_fold derive_changelog changelog_parse
    dead_letters collapse_latest index_state live_docs doc_lookup live_feed counters_by_op
    latency_quantiles rate_1m rate_5m_sliding searchable_text hash_embeddings corpus_stats
    fuzzy_terms phrase_match bm25_search knn_exact knn_floor hybrid_search summary_enrich
    enrich_guard rag_answers eval_titles stream_index stream_pages stream_rates
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    spark = build_session(
        "tidemark-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds, failed = {}, {}
    started = time.time()
    index_of(spark, sf_dir)
    seconds["build_index"] = round(time.time() - started, 3)
    started = time.time()
    for builder in (fixtures.recent_raw, fixtures.repo_raw, fixtures.changelog):
        landed(spark, sf_dir, builder)
    seconds["land_inputs"] = round(time.time() - started, 3)
    for name in chosen or HEADLINES:
        started = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # keep timing the others, and report the failure
            failed[name] = str(error)[:300]
            continue
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from doccat.operators.postings import TextIndex
from doccat.plans import inputs as I
from doccat.plans.registry import QUERIES
from doccat.session import local_session, shared_folder
from doccat.sources.catalog import CatalogStore
from doccat.sources.commits import FULL

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    # on the stored catalogue and index
    "search_concern", "match_terms", "match_bool", "match_prefix", "match_phrase", "match_fuzzy",
    "score_bm25_top", "search_filter", "search_sorted", "search_facets", "search_hits",
    # over all documents
    "build_postings", "match_terms_unindexed", "derive_metadata", "import_documents", "route_inbox", "needs_ocr",
    "sync_plan", "changed_files", "upsert_documents", "duplicate_content", "extract_text", "apply_changes",
    "stream_ingest",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    I.PARTITIONS = int(CPUS)

    def run(name: str) -> None:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def measured(action) -> float:
        """Median of the runs after a warm-up."""
        action()
        return statistics.median(timed(action) for _ in range(RUNS))

    seconds: dict[str, float] = {
        "write_catalog_full": measured(
            lambda: CatalogStore(spark, shared_folder(spark, "bench")).write(I.catalog(spark, SF_DIR), FULL)
        ),
        "write_index": measured(lambda: TextIndex.write(I.texts(spark, SF_DIR), shared_folder(spark, "bench"))),
    }
    for name in HEADLINE:
        seconds[name] = measured(lambda: run(name))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Every query runs its whole plan into the no-op sink; the
first, untimed query starts the session's workers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioscore.plans.catalog import QUERIES  # noqa: E402
from folioscore.session import build_session  # noqa: E402

HEADLINE = (
    "word_overlap",
    "tfidf_cosine",
    "rouge_1",
    "rouge_2",
    "rouge_l",
    "levenshtein_ratio",
    "levenshtein_distance",
    "evaluate_pairs",
    "strip_then_overlap",
    "metrics_long",
    "similarity_matrix",
    "rank_against_checked",
    "strip_markdown",
    "strip_plain_documents",
    "tfidf_terms",
    "overlap_words",
    "rouge_ngrams",
    "build_requests",
    "split_pages",
    "assemble_terminated",
    "assemble_chunks",
    "convert_units",
    "elements_to_html",
    "html_to_markdown",
    "linearize_layout",
    "stream_chunks",
    "stream_evaluate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("evaluate_pairs")
    times = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from decklens import plans
from decklens.session import local_session

HEADLINE = (
    "C20_slide_score",
    "D5_deck_global_score",
    "D5_deck_global_score_judged",
    "D7_deck_document",
    "B10_cosine_similarity",
    "C15_previous_similarity",
    "D8_word_calibration",
    "D9_metric_calibration",
    "E2_classifier_rules",
    "F1_judge_payload",
    "G4_register_decks",
    "G6_latest_versions",
    "G10_syllabus_tree",
    "A5_assemble_slides",
    "H5_top_deviations",
    "H10_dense_trend",
    "I1_slide_dwell_batch",
    "I2_page_change_dwell",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    # Untimed runs pay for the start of the JVM's compiler and code generation.
    for name in ("FLAGSHIP_deck_scores_es", "C20_slide_score"):
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

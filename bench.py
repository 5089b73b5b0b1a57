"""Times the headline queries, each from the given files, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Per area: data preparation, fits, the full audit, resampling, diagnostics, text, labels.
HEADLINE = ("audit", "reversal_summary", "control_summary", "gap_summary", "pairwise_reversals", "owner_balanced_split",
            "validate_responses", "matrix_profile", "merge_sources", "normalize_text", "sensitive_scan", "tfidf", "fit_item_intercepts",
            "fit_rasch", "choose_dimension", "auc_pooled_within", "discrimination_summary", "signature_stability", "family_direction",
            "exact_common_family_shifts")


def main() -> None:
    from evenkeel.plans import fixture
    from evenkeel.plans.catalogue import QUERIES
    from evenkeel.session import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    took = {}
    for name in HEADLINE:
        fixture.forget()  # no query profits from tables another one has built
        start = time.perf_counter()
        QUERIES[name](spark, folder).toPandas()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

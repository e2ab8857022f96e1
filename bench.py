"""Headline queries on local[$BENCH_CPUS]; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from loanlens.plans import registry  # noqa: E402
from loanlens.session import build_session  # noqa: E402

HEADLINE = (
    "feature_job", "panel_loans", "panel_applications", "contract_check", "contamination_audit",
    "matched_maturity", "treatment_r2", "denial_rates_by", "auc_gini_ks", "brier_ece", "psi",
    "drift_by_cohort", "fairness_report", "decision_curve", "within_cell_estimator", "kitagawa",
    "woe_binning", "batch_score_loss", "readability",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load_all()
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["code_prefix"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for key in HEADLINE:
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline_queries_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

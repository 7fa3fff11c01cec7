"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelforge.plans import registry
from panelforge.session import build_session

HEADLINE = ["entry_daily_panel", "a1_daily_sentiment", "a2_bull_bear_daily", "j3_outer_fold", "j10_asof_trading_day", "w8_rolling_median", "w12_w13_w14_momentum", "w15_w16_w17_bar_features", "w19_deciles", "o4_daily_top_decile", "t1_t2_t3_t4_a24_metrics", "m10_auc_overall", "f6_f7_f8_detect", "h4_greedy_cap", "b6_contrarian_evaluation", "m8_year_folds", "x3_compound_scores", "a14_quantiles_at_scale"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    # the first job of a session pays for its start-up
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from check import session
from tickloom.plans.catalog import load

HEADLINE = ("bars_right_edge bars_upsert ema_seeded rolling_linreg session_marks vol_realised vol_straddle vol_annualised pa_market_regime pa_structure "
            "vol_class_summary label_triple_barrier label_signal_outcome path_running_marks exit_vote option_path trade_summary trades_by_strategy "
            "worst_drawdown_window global_rank_pct value_summary quality_fingerprint split_blocked_folds metrics_ece_equal_count gate_search "
            "asof_events_tolerance chandelier structure_events kama garch_variance stream_closed_bars "
            "dense_vol_realised dense_run_lengths dense_cumulative_frames dense_fair_value_gaps dense_pa_market_regime").split()


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    qs = load()
    spark.read.parquet(f"{sf}/events.parquet").count()  # start the engine
    times, failed = {}, {}
    for n in names:
        t0 = time.time()
        try:
            qs[n].plan(spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  the other timings are wanted all the same
            failed[n] = str(e)[:300]
            continue
        times[n] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf).removeprefix("sf")} | ({"failed": failed} if failed else {})), flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

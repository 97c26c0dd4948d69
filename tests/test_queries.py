"""A part of the registered queries against their SQL on the smallest tables; check.py runs all of them."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
PART = ("bars_right_edge bars_upsert bar_shape rolling_quantiles rolling_linreg global_rank_pct ema_seeded kama session_marks micro_channel vol_realised "
        "vol_jump_tail pa_market_regime pa_pullback_counts_rearm pa_structure label_forward_ranges label_signal_outcome exit_vote option_path trade_summary "
        "worst_drawdown_window split_blocked_folds quality_drift metrics_ece_equal_count gate_choice asof_closed_bar chandelier structure_events stream_closed_bars").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(s) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", PART)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())

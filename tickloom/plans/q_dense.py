"""The same operators on one-minute bars, whose number grows with the events; chunk borders are crossed with a small `tickloom.chunkRows`."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind, market_structure as ms, price_action as pa, sequences as seq, volatility as vol
from ..operators.layout import in_chunks, running
from . import q_price_action as _pa, q_structure as _st, q_vol as _vol, q_windows as _win  # noqa: F401  their SQL is taken below
from .catalog import ALL, query
from .data import bars


def _cumulative(b):
    d = running(b, {"csum": ("sum", F.col("volume")), "peak": ("max", F.col("close")), "trough": ("min", F.col("close"))})
    return running(d, {"best_left": ("max", F.col("close")), "worst_left": ("min", F.col("close"))}, forward=True)


DENSE = {
    "vol_realised": lambda b: in_chunks(b, vol.realised, history=vol.HISTORY["realised"]),
    "run_lengths": seq.direction_runs,
    "cumulative_frames": _cumulative,
    "fair_value_gaps": ms.fair_value_gaps,
    "kama": lambda b: ind.kama(b, 9, 2, 30, source="hlc3"),
    "pa_market_regime": pa.market_regime,
}


def _dense(name, build):
    q = ALL[name]
    sql = q.sql.replace("INTERVAL 1 HOUR", "INTERVAL 1 MINUTE")

    @query(f"dense_{name}", " ".join(f"{n}:{'s' if k == 't' else k}" for n, k in q.cols), f"SELECT * FROM ({sql}) AS dense")
    def _(T):
        return build(bars(T, "1 minute"))


for _name, _build in DENSE.items():
    _dense(_name, _build)

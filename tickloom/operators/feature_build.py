"""All feature blocks of one timeframe, and which block makes which columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import context as cx, indicators as ind, price_action as pa, regimes, sequences as seq, shapes, volatility as vol
from .durable import durable
from .layout import in_chunks
from .quality import needed_blocks

# Columns per block.
BLOCKS = {
    "scorecard": ("pa_env_state", "pa_env_trend_dir", "pa_env_trend_score_ratio", "pa_env_range_score_ratio"),
    "stack": pa.STACK_COLS,
    "states": ("pa_hmm_state", "pa_hsmm_switch_hazard", "pa_garch_vol", "pa_egarch_std_residual"),
    "realised": ("pa_rv_cc_10", "pa_rv_cc_20", "pa_rv_parkinson_20", "pa_rv_gk_20", "pa_vol_of_vol_20"),
    "straddle": ("pa_iv_rv_spread", "pa_rv_zscore", "pa_vol_regime_duration", "pa_volume_zscore"),
    "clock": ("pa_time_session_progress", "pa_time_from_open_return", "pa_time_vol_time_deviation"),
    "moments": ("pa_realized_skew_20", "pa_realized_kurt_20", "pa_skew_change_10"),
    "volume_price": ("pa_vwap_deviation", "pa_amihud_illiq_20", "pa_obv_slope_10"),
    "trend_noise": ("pa_trend_ratio", "pa_noise_ratio", "pa_trend_slope"),
    "jumps": ("pa_hawkes_intensity", "pa_hawkes_clustering_20"),
    "level": ("kalman_mean", "kalman_velocity"),
    "hurst": ("pa_hurst_20", "pa_hurst_60"),
    "entropy": ("pa_entropy_75",),
    "jump_tail": ("pa_jump_tail_risk", "pa_jump_z_score"),
    "annualised": ("vol_of_vol", "rv_acceleration", "range_vs_close", "efficiency_ratio"),
    "micro": ("pa_1m_wick_ratio", "pa_1m_body_ratio", "pa_1m_consec_dir_run", "pa_1m_ret_1", "pa_1m_vol_rel", "pa_1m_dir_entropy_10"),
    "opening": ("or_breakout_up", "or_breakout_down", "or_volume_breakout", "or_vs_atr_ratio"),
    "swings": ("last_swing_high", "last_swing_low", "swing_high_type", "swing_low_type"),
    "breakout": ("bo_body_atr", "bo_range_atr", "bo_vol_spike", "bo_close_extremity", "bo_wick_imbalance", "bo_range_compress", "bo_body_growth", "bo_gap_signal",
                 "bo_consec_dir", "bo_inside_prior", "bo_pressure_diff", "bo_bb_width", "bo_atr_zscore"),
    "context": ("pa_ctx_structure_veto", "pa_ctx_range_pressure", "pa_ctx_setup_long", "pa_ctx_setup_short", "pa_ctx_premise_break_long", "pa_ctx_premise_break_short"),
    "scores": tuple(f"pa_state_{n}" for n in cx.STATE_COLS),
    "higher": ("pa_htf_15min_state", "pa_htf_15min_trend_score", "pa_htf_60min_state", "pa_htf_60min_trend_score", "pa_htf_trend_alignment"),
}
#: Blocks that read the columns of others.
NEEDS = {"opening": ("stack",), "breakout": ("stack",), "context": ("stack", "breakout"), "scores": ("stack", "breakout", "context")}
LIGHT_SKIPS = ("trend_noise", "jumps", "level", "hurst", "entropy", "jump_tail")
FRAMED = {"moments": vol.moments, "volume_price": vol.volume_price, "trend_noise": vol.trend_noise, "jumps": vol.jumps,
          "hurst": vol.hurst, "entropy": vol.entropy, "jump_tail": vol.jump_tail, "annualised": vol.annualised}


def build_features(bars: DataFrame, wanted: Sequence[str] | None = None, light: bool = False) -> DataFrame:
    """Numbered bars plus the blocks that make the wanted columns (all of them without a list).

    Blocks that only need frames share one chunked pass, so the number of
    shuffles does not grow with the number of such blocks. `light` skips the
    six expensive blocks.
    """
    names = list(BLOCKS) if wanted is None else needed_blocks(wanted, BLOCKS)
    names = [n for n in names if not (light and n in LIGHT_SKIPS)]
    names += [m for n in names for m in NEEDS.get(n, ()) if m not in names]
    names = [n for n in BLOCKS if n in names]
    framed = [n for n in names if n in FRAMED]
    if "realised" in names or "straddle" in names:
        framed = ["realised", *framed]

    def one_pass(d, f):
        for n in framed:
            d = vol.realised(d, f) if n == "realised" else FRAMED[n](d, f)
        if "straddle" in names:
            d = vol.straddle(d, f)
        return d
    d = bars
    if framed:
        reach = max(vol.HISTORY[n] for n in framed)
        d = durable(in_chunks(d, one_pass, history=max(reach, vol.HISTORY["straddle"] if "straddle" in names else 0)))
    if "straddle" in names:
        d = durable(vol.straddle_duration(d))
    if "volume_price" in names:
        d = vol.vwap_deviation(d)
    if "clock" in names:
        d = vol.day_clock(d)
    if "stack" in names:
        d = durable(pa.full_stack(d))
    elif "scorecard" in names:
        d = durable(pa.market_regime(d))
    if "level" in names:
        d = durable(ind.kalman(d))
    if "states" in names:
        d = durable(regimes.volatility_states(d))
    if "micro" in names:
        d = pa.micro_1m(d)
    if "opening" in names:
        d = durable(pa.opening_range(d, "atr_pa"))
    if "swings" in names:
        d = durable(pa.swing_types(d))
    if "breakout" in names:
        d = in_chunks(shapes.bar_anatomy(seq.direction_runs(d)), shapes.bar_shape, history=1)
        d = durable(in_chunks(d, lambda x, f: cx.breakout_features(x, f, "atr_pa"), history=500))
    if "context" in names:
        d = cx.structure_context(d)
    if "scores" in names:
        d = cx.state_scores(durable(d))
    if "higher" in names:
        d = pa.htf_regime(d)
    return d if wanted is None else d.select("symbol", "t", "bar_no", *[n for n in wanted if n in d.columns])

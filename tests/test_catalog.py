"""Queries against DuckDB at the smallest scale: one or more of each family."""

from __future__ import annotations

import pytest
from oracle_check import agree

from tapeloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["rb_batch", "rb_incomplete", "rb_multi_threshold", "rb_segment_reset_week", "rb_gap_reset", "rb_spread", "flt_ts_gate", "flt_ts_gate_off", "agg_volume", "agg_vwap", "f_kyle", "xb_skew", "xb_pe", "ib_kurt", "ib_gk", "win_roll_quantile", "win_run_length", "ind_macd", "ind_rsi_wilder", "ind_cci", "jn_asof_back", "jn_next_asof", "jn_nearest_event", "gb_basic", "gb_tercile", "pt_align", "rg_sma_rsi", "st_bh_fdr", "st_psr", "st_spearman", "so_replacing", "fn_sessions", "fn_fixed_point", "val_tier1", "val_tiered", "val_gaps", "src_trades_csv", "src_tick_store", "snk_store", "str_live"]


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    agree(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)

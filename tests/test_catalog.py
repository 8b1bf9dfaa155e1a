"""Registered queries against their SQL twins on the smallest tables; TICKLOOM_ALL=1 runs every one."""

import os
import re

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUICK = (
    "a1_resample_hourly", "a1_resample_daily", "a2_dedupe_bars", "w2_ema", "w16_candle_patterns", "g2_square_strategy", "g3_ema_breakout",
    "j1_nearest_price_source", "j5_contract_resolution", "f7_chunk_ranges", "x4_expiry_dates", "s3_explode_payload", "m3_components", "m4_image_context",
    "r2_latest_bars", "r4_late_pivots", "j16_zones", "f9_search_requests", "g11_pivot_hierarchy_dense", "g3_ema_breakout_dense",
)
NAMES = tuple(n for n in entry.oracle_sql() if not n.startswith("op")) if os.environ.get("TICKLOOM_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    found = difference(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert found is None or found.startswith("EMPTY")


def test_every_query_has_a_twin():
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    without = own - set(entry.oracle_sql())
    assert without == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0

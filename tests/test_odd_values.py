"""Queries of limits and logarithms on zeros, negative, missing, tiny, huge and infinite values."""

import math

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.functions import numbers as N
from lattica.operators import timescale as T
from lattica.plans.registry import ORACLES, QUERIES

from .oracle import assert_same

INF, NAN = math.inf, math.nan
GROUPS = {"zero": (0.0, 464.2), "zeros": (0.0, 0.0), "below": (-7.3, -1.0), "across": (-2.5, 90.01), "tiny": (5e-5, 8e-5), "huge": (1e20, 1e300), "endless": (3.0, INF), "nan": (2.5, NAN), "none": (None, None), "one": (1000.0, None)}


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    rows = [(kind, v) for kind, values in GROUPS.items() for v in values]
    folder = tmp_path_factory.mktemp("odd")
    columns = {"event_id": range(len(rows)), "user_id": [i // 2 for i in range(len(rows))], "event_type": [k for k, _ in rows], "value": pa.array([v for _, v in rows], pa.float64())}
    pq.write_table(pa.table(columns), folder / "events.parquet")
    return str(folder)


def row(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("name", ["padded_limits", "hard_limits"])
def test_limits_of_odd_values(spark, odd_events, name):
    assert_same(QUERIES[name](spark, odd_events), ORACLES[name], odd_events)


def test_rounding_and_logs_of_odd_values(spark, odd_events, tmp_path):
    events = pq.read_table(f"{odd_events}/events.parquet")
    lone = [-0.0, 0.5, 2.5, 10.0, 90.0, 999.999, 5e-300, -INF]  # at 1e20 an exponential's last bit is the platform's own
    lone = pa.table({"event_id": range(100, 100 + len(lone)), "user_id": [0] * len(lone), "event_type": ["lone"] * len(lone), "value": lone})
    pq.write_table(pa.concat_tables([events.filter(pc.not_equal(events["event_type"], "huge")), lone]), tmp_path / "events.parquet")
    assert_same(QUERIES["rounding_and_logs"](spark, str(tmp_path)), ORACLES["rounding_and_logs"], tmp_path)


def test_a_zero_has_a_logarithm(spark):
    log = lambda x: row(spark, N.log_base(F.lit(x).cast("double"), 10), N.power_below(F.lit(x).cast("double"), 10))
    assert [log(0.0), log(None), log(5e-5)[1], log(INF)] == [(-INF, 0.0), (None, None), 1e-5, (INF, INF)]
    assert all(map(math.isnan, log(-1.0) + log(NAN)))
    rounded = [row(spark, N.round_to(F.lit(x), 2.5), N.ceil_to(F.lit(x), 2.5), N.floor_to(F.lit(x), 2.5)) for x in (1e300, -INF, 3.8)]
    assert rounded == [(1e300,) * 3, (-INF,) * 3, (5.0, 5.0, 2.5)]


def test_a_zero_is_a_limit_of_powers(spark):
    assert row(spark, *T.log_limits(F.lit(0.0), F.lit(464.2))) == (0.0, 1000.0)
    assert row(spark, *T.log_limits(F.lit(5e-5), F.lit(5e-5))) == (1e-5, 1e-4)
    low, high = row(spark, *T.log_limits(F.lit(-1.0), F.lit(None).cast("double")))
    assert math.isnan(low) and high is None


def test_whole_numbers_of_any_size(spark):
    values = (-2.5, -0.5, -0.0, 0.5, 2.0, 1e300, -1e300, INF, -INF)
    kept = lambda x: x if abs(x) > 1e18 else None
    assert [row(spark, N.floor(F.lit(x)))[0] for x in values] == [kept(x) or float(math.floor(x)) for x in values]
    assert [row(spark, N.ceil(F.lit(x)))[0] for x in values] == [kept(x) or float(math.ceil(x)) for x in values]
    assert math.isnan(row(spark, N.floor(F.lit(NAN)))[0]) and row(spark, N.ceil(F.lit(None).cast("double"))) == (None,)
    assert [row(spark, N.whole_power(10, F.lit(k)))[0] for k in (-22, -11, -5, -1, 0, 3, 22)] == [1e-22, 1e-11, 1e-5, 0.1, 1.0, 1000.0, 1e22]

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelkit.operators import clean
from funnelkit.operators.quantiles import approx_quantiles, exact_quantiles
from tests.conftest import rows

ORDERS = "order_id long, user_id long, product_id long, quantity long, " \
         "order_stage string, order_date string, pos long"


def test_dedup_keeps_first_in_arrival_order_and_null_keys_group(spark):
    df = spark.createDataFrame([
        (1, 10, 100, 5, "Visited", "2024-01-01 00:00:00", 3),
        (1, 11, 101, 6, "Purchased", "2024-01-02 00:00:00", 1),
        (2, 12, 102, 7, "Visited", "2024-01-03 00:00:00", 2),
        (None, 13, 103, 8, "Visited", "x", 5),
        (None, 14, 104, 9, "Visited", "y", 4),
    ], ORDERS)
    out = clean.deduplicate(df, "order_id", ["pos"])
    got = sorted(rows(out, "order_id", "user_id"), key=lambda r: (r[0] is None, r))
    assert got == [(1, 11), (2, 12), (None, 14)]


def test_dedup_plan_limits_rows_before_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("order_id"),
                                 F.col("id").alias("pos"))
    plan = clean.deduplicate(df, "order_id", ["pos"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dedup_audit_counts_and_sample(spark):
    data = [(k, i) for i, k in enumerate([5, 5, 5, 7, 7, 9, 5, 3, 3, 8, 8])]
    df = spark.createDataFrame(data, "order_id long, pos long")
    r = clean.dedup_audit(df, "order_id", ["pos"]).collect()[0]
    assert (r.rows_before, r.duplicates_found, r.rows_after) == (11, 6, 5)
    # duplicates in arrival order: pos 1 (5), 2 (5), 4 (7), 6 (5), 8 (3)
    assert r.sample_duplicate_ids == "[5, 5, 7, 5, 3]"


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3)), max_size=30))
def test_dedup_and_quantity_fix_are_idempotent(spark, data):
    df = spark.createDataFrame([(k, q, i) for i, (k, q) in enumerate(data)],
                               "order_id long, quantity long, pos long")
    once = clean.fix_quantities(clean.deduplicate(df, "order_id", ["pos"]))
    twice = clean.fix_quantities(clean.deduplicate(once, "order_id", ["pos"]))
    assert sorted(rows(once)) == sorted(rows(twice))
    # keep-first against a pandas oracle
    pdf = pd.DataFrame(data, columns=["order_id", "quantity"])
    exp = pdf[~pdf.duplicated(subset=["order_id"], keep="first")]
    exp = exp[exp.quantity != 0].assign(quantity=lambda d: d.quantity.abs())
    assert sorted(rows(once, "order_id", "quantity")) == \
        sorted(map(tuple, exp[["order_id", "quantity"]].values.tolist()))


def test_fix_quantities_keeps_null_drops_zero(spark):
    df = spark.createDataFrame([(1, -3), (2, 0), (3, None), (4, 5)],
                               "order_id long, quantity long")
    assert sorted(rows(clean.fix_quantities(df)), key=lambda r: r[0]) == \
        [(1, 3), (3, None), (4, 5)]


def test_quantity_audit(spark):
    df = spark.createDataFrame([(1, -3, 1), (2, 0, 2), (3, -1, 0), (4, 5, 3)],
                               "order_id long, quantity long, pos long")
    r = clean.quantity_audit(df, "quantity", "order_id", ["pos"]).collect()[0]
    assert (r.negative_quantities, r.zero_quantities, r.total_affected) == (2, 1, 3)
    assert r.negative_sample == "order_id 3: -1 -> 1; order_id 1: -3 -> 3"


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.just(float("nan")),
                          st.floats(-1e6, 1e6, allow_nan=False),
                          st.sampled_from([1.0, 2.0, 2.0, 2.0])), max_size=60),
       st.sampled_from([None, 1, 3, 7]))
def test_exact_quantiles_match_pandas(spark, values, ranges):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0],
                          ranges=ranges).collect()[0]
    s = pd.Series([v for v in values if v is not None], dtype="float64")
    for i, p in enumerate([0.0, 0.25, 0.5, 0.75, 1.0]):
        exp = s.quantile(p)
        if math.isnan(exp):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(exp, rel=1e-12, abs=1e-9)


def test_quantiles_of_empty_input_are_null(spark):
    df = spark.createDataFrame([], "v double")
    assert tuple(exact_quantiles(df, "v", [0.5]).collect()[0]) == (None,)


def test_approx_quantiles_close(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    r = approx_quantiles(df, "v", [0.5]).collect()[0][0]
    assert abs(r - 499.5) <= 2


PRODUCTS = "product_id long, product_name string, base_price double"


def test_iqr_flag_and_replacement(spark):
    prices = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 1000.0, None, float("nan")]
    df = spark.createDataFrame([(i, f"p{i}", p) for i, p in enumerate(prices)],
                               PRODUCTS)
    st_ = clean.price_stats(df).collect()[0]
    s = pd.Series(prices, dtype="float64")
    assert st_.q1 == pytest.approx(s.quantile(0.25))
    assert st_.q3 == pytest.approx(s.quantile(0.75))
    fence = s.quantile(0.75) + 1.5 * (s.quantile(0.75) - s.quantile(0.25))
    assert st_.upper_fence == pytest.approx(fence)
    flagged = dict(rows(clean.flag_price_outliers(df), "product_id", "is_outlier"))
    assert [k for k, v in flagged.items() if v] == [8]
    capped = dict(rows(clean.cap_price_outliers(df), "product_id", "base_price"))
    assert capped[8] == 4.5  # median of the non-outliers 1..8
    assert capped[9] is None and math.isnan(capped[10])
    log = clean.price_correction_log(df).collect()
    assert [(r.product_id, r.original_price, r.corrected_price, r.delta)
            for r in log] == [(8, 1000.0, 4.5, 995.5)]


def test_cap_without_outliers_changes_nothing(spark):
    df = spark.createDataFrame([(i, "x", float(i)) for i in range(1, 6)], PRODUCTS)
    assert sorted(rows(clean.cap_price_outliers(df))) == sorted(rows(df))
    rep = clean.replacement_price(df).collect()[0]
    assert rep.n_outliers == 0


def test_after_capping_no_value_above_old_fence(spark):
    rng = np.random.default_rng(1)
    vals = np.round(np.concatenate([rng.gamma(2, 30, 300), [5000, 9000]]), 2)
    df = spark.createDataFrame([(i, "x", float(v)) for i, v in enumerate(vals)],
                               PRODUCTS)
    fence = clean.price_stats(df).collect()[0].upper_fence
    top = clean.cap_price_outliers(df).agg(F.max("base_price")).collect()[0][0]
    assert top <= fence + 0.005


def test_lenient_dates(spark):
    df = spark.createDataFrame(
        [("2024-03-10 02:30:00",), ("not-a-date",), (None,), ("2024-13-01 00:00:00",)],
        "order_date string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = [r[0] for r in clean.parse_order_dates(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # 02:30 does not exist in Los Angeles that night; NTZ parsing keeps it
    assert got[0].hour == 2 and got[0].minute == 30
    assert got[1:] == [None, None, None]
    users = spark.createDataFrame([("2021-02-03",), ("unknown",)], "signup_date string")
    d = [r[0] for r in clean.parse_signup_dates(users).collect()]
    assert str(d[0]) == "2021-02-03" and d[1] is None
    back = clean.normalise_dates(clean.parse_order_dates(df), "order_date")
    assert rows(back)[0] == ("2024-03-10 02:30:00",)


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.just(float("nan")),
                          st.integers(1, 500).map(lambda c: c / 4.0),
                          st.sampled_from([5000.0, 7000.0, 3.0, 3.0])), max_size=50))
def test_outlier_params_match_pandas(spark, values):
    df = spark.createDataFrame([(i, "x", v) for i, v in enumerate(values)],
                               "product_id long, product_name string, base_price double")
    r = clean.outlier_params(df).collect()[0]
    s = pd.Series([v for v in values if v is not None], dtype="float64")
    if s.dropna().empty:
        assert r.upper_fence is None and r.n_outliers == 0
        return
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    fence = q3 + 1.5 * (q3 - q1)
    out = s > fence
    assert r.upper_fence == pytest.approx(fence)
    assert r.n_outliers == int(out.sum())
    rest = s[~out].median()
    assert r.replacement_price == pytest.approx(round(rest, 2), abs=0.0101)


def test_layouts_are_voted_for_by_the_column(spark):
    def parsed(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, order_date string")
        out = clean.parse_order_dates(df, fmt="infer").orderBy("i").collect()
        return [r.order_date and str(r.order_date) for r in out]
    # the day comes first in one column, the month in the other; a tie reads the month first
    assert parsed(["03/01/2024", "25/01/2024", None, "x"]) == ["2024-01-03 00:00:00", "2024-01-25 00:00:00", None, None]
    assert parsed(["03/01/2024", "01/25/2024"]) == ["2024-03-01 00:00:00", "2024-01-25 00:00:00"]
    assert parsed(["03/01/2024"]) == ["2024-03-01 00:00:00"]
    # several layouts in one column, value by value
    assert parsed(["2024-02-29T10:11:12", "29.02.2024", "2024-02-29", "20240229", "2024-02-29 10:11:12", "30.02.2024"]) \
        == ["2024-02-29 10:11:12", *["2024-02-29 00:00:00"] * 3, "2024-02-29 10:11:12", None]
    assert parsed([None, "", "never"]) == [None, None, None]
    empty = spark.createDataFrame([], "order_date string")
    assert clean.infer_layouts(empty, "order_date") == ["yyyy-MM-dd HH:mm:ss"]

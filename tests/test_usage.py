"""Exact usage money: small quantities and prices, bad values, overflow."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendpace.functions.tags import QUANTITY, exact_amount
from spendpace.sources import usage as U

T = dt.datetime(2026, 7, 7, 15, 10)
PRICES = "sku_name string, cloud string, currency_code string, price_start_time timestamp, price_end_time timestamp, pricing struct<effective_list:struct<default:decimal(38,18)>>"
USAGE = "budget_id int, usage_start_time timestamp, sku_name string, cloud string, usage_quantity {}, billing_origin_product string, usage_metadata struct<job_id:string,warehouse_id:string,cluster_id:string>"


def frames(spark, quantities, price, kind="decimal(38,18)"):
    usage = spark.createDataFrame([(0, T, "s", "AWS", q, "JOBS", ("1", None, None)) for q in quantities], USAGE.format(kind))
    prices = spark.createDataFrame([("s", "AWS", "USD", dt.datetime(2020, 1, 1), None, ((Decimal(price),),))], PRICES)
    return usage, prices


def test_amounts_far_below_a_cent_add_up(spark):
    usage, prices = frames(spark, [Decimal("0.000000000003")] * 1000, "0.00000125")
    [row] = U.hourly_usage(usage, prices).collect()
    assert row["dbu_dollars"] == Decimal("0.000000000003") * Decimal("0.00000125") * 1000
    usage, prices = frames(spark, [Decimal("0.00004")] * 25_000, "1")
    [row] = U.daily_usage(usage, prices).collect()
    assert row["dbu_dollars"] == 1


def test_a_large_amount_beside_small_ones(spark):
    usage, prices = frames(spark, [Decimal("9999999999.999999999999"), Decimal("0.000000000001")], "999999.999999999")
    [row] = U.hourly_usage(usage, prices).collect()
    assert row["dbu_dollars"] == Decimal("10000000000") * Decimal("999999.999999999")


@pytest.mark.parametrize("values, kind", [([None, float("nan"), float("inf"), 2.5], "double"), ([None, "n/a", "", " 2.5 "], "string")])
def test_values_that_are_no_numbers_count_nothing(spark, values, kind):
    usage, prices = frames(spark, values, "2", kind)
    [row] = U.hourly_usage(usage, prices).collect()
    assert row["dbu_dollars"] == 5


@pytest.mark.parametrize("value", [1e10, -1e10, 1e300])
def test_an_amount_too_large_stops_the_job(spark, value):
    df = spark.createDataFrame([(value,)], "q double")
    with pytest.raises(Exception, match="usage amount beyond"):
        df.select(exact_amount(F.col("q"), QUANTITY).alias("q")).collect()


def test_a_sum_that_overflows_stops_the_job(spark):
    usage, prices = frames(spark, [Decimal("9999999999")] * 12, "999999")
    big = usage.unionByName(usage).unionByName(usage)
    with pytest.raises(Exception, match="(?i)overflow|NUMERIC_VALUE_OUT_OF_RANGE"):
        U.hourly_usage(big, prices).collect()

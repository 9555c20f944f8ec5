"""Attribution filters and the daily spend ledger.

Line items are assigned to budgets by account (an equi-join against the
small ``budget_accounts`` table), filtered to the rows attributable to the
platform, then reduced to one row per (budget_id, usage_date). Every
aggregate is a hash aggregate with a map-side partial step, so a budget or
day holding a third of the rows is pre-combined in every task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendpace.config import MARKETPLACE_TEXT, MONTHLY_DAYS_PER_DATE, MONTHLY_MIN_SPAN, PaceConfig
from spendpace.functions.tags import MONEY


def _contains_ci(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def _stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def assign_budgets(cur: DataFrame, budget_accounts: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Account filter as a join: ``budget_accounts(budget_id, usage_account_id)``
    lists the accounts of each budget (ids compared as text). A line item
    belongs to every budget that lists its account. The account table is a
    dimension; Spark broadcasts it when its measured size is under the
    broadcast threshold and shuffles otherwise. Of ``budgets(budget_id)``,
    those that list no account take every line item: their ids are one
    array, laid beside each row without a join."""
    accounts = budget_accounts.select(
        "budget_id", F.col("usage_account_id").cast("string").alias("usage_account_id"))
    listed = cur.join(accounts, on="usage_account_id", how="inner")
    if budgets is None:
        return listed
    unlisted = budgets.select("budget_id").join(accounts, "budget_id", "left_anti").agg(F.collect_set("budget_id"))
    every = cur.select("*", unlisted.scalar().alias("ids")).select("*", F.explode("ids").alias("budget_id")).drop("ids")
    return listed.unionByName(every)


def line_type_kept(cfg: PaceConfig) -> Column:
    """Excluded line-item types are dropped; a NULL type is kept."""
    return F.coalesce(~F.col("line_item_type").isin(*cfg.excluded_line_item_types), F.lit(True))


def marketplace_mask(cfg: PaceConfig) -> Column:
    """Billing entity mentions the marketplace and the legal entity or the
    product names the vendor (case-insensitive)."""
    return _contains_ci(F.col("billing_entity"), MARKETPLACE_TEXT) & (
        _contains_ci(F.col("legal_entity"), cfg.vendor) | _contains_ci(F.col("product_name"), cfg.vendor))


def tag_mask(cfg: PaceConfig) -> Column:
    """Vendor tag (trimmed, lower-cased) equals the vendor, or any
    attribution tag is non-blank."""
    mask = F.coalesce(F.lower(_stripped(F.col(f"tag_{cfg.vendor_tag}"))) == cfg.vendor.lower(), F.lit(False))
    for tag in cfg.attribution_tags:
        mask = mask | F.coalesce(_stripped(F.col(f"tag_{tag}")) != "", F.lit(False))
    return mask


def attribute(cur: DataFrame, cfg: PaceConfig) -> DataFrame:
    """Rows that pass the line-type filter, with ``is_marketplace`` and
    ``attributed`` flags. Mode ``all`` attributes every such row."""
    kept = cur.filter(line_type_kept(cfg)).withColumn("is_marketplace", marketplace_mask(cfg))
    attributed = F.lit(True) if cfg.attribution == "all" else (F.col("is_marketplace") | tag_mask(cfg))
    return kept.withColumn("attributed", attributed)


def attributed_rows(cur: DataFrame, cfg: PaceConfig) -> DataFrame:
    return attribute(cur, cfg).filter("attributed").drop("attributed")


def attribution_summary(flagged: DataFrame) -> DataFrame:
    """One pass: kept rows and dollars, dropped dollars, marketplace dollars."""
    zero = F.lit(0).cast(MONEY)
    return flagged.groupBy("budget_id").agg(
        F.count_if(F.col("attributed")).alias("kept_rows"),
        F.coalesce(F.sum(F.when(F.col("attributed"), F.col("cost"))), zero).cast(MONEY).alias("kept_cost"),
        F.coalesce(F.sum(F.when(~F.col("attributed"), F.col("cost"))), zero).cast(MONEY).alias("dropped_cost"),
        F.coalesce(F.sum(F.when(F.col("attributed") & F.col("is_marketplace"), F.col("cost"))), zero)
        .cast(MONEY).alias("marketplace_cost"),
    )


def daily_costs(rows: DataFrame, value: str = "cost") -> DataFrame:
    """Sum by (budget_id, usage_date); rows with a NULL date are dropped."""
    return (rows.filter(F.col("usage_date").isNotNull())
            .groupBy("budget_id", "usage_date")
            .agg(F.sum(value).cast(MONEY).alias("cost")))


def granularity_check(daily: DataFrame) -> DataFrame:
    """Flags a ledger that looks like a monthly export: span of at least 28
    days with at most span // 25 distinct dates; fewer than 2 dates -> no flag."""
    agg = daily.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
    )
    span = F.datediff("last_date", "first_date") + 1
    return agg.select(
        "budget_id", "n_dates", "first_date", "last_date", span.alias("span_days"),
        ((F.col("n_dates") >= 2) & (span >= MONTHLY_MIN_SPAN)
         & (F.col("n_dates") <= F.floor(span / MONTHLY_DAYS_PER_DATE))).alias("looks_monthly"),
    )


def blended_days(cur_rows: DataFrame, usage_daily: DataFrame) -> DataFrame:
    """Daily ledger when usage is invoiced separately: one row per
    (budget_id, usage_date) of either source, with the non-marketplace line
    items as ``cost`` and the priced usage as ``usage_cost`` (null where the
    source has no row). ``blended_cost`` reads an instant's cost from a row, so
    instants share the rows: work grows with days plus instants."""
    cur_daily = daily_costs(cur_rows.filter(~F.col("is_marketplace")))
    usage = usage_daily.select("budget_id", "usage_date", F.col("dbu_dollars").alias("usage_cost"))
    return cur_daily.join(usage, ["budget_id", "usage_date"], "full")


def blended_cost(usage_counts: Column) -> Column:
    """Cost of a row of ``blended_days``, with its usage where ``usage_counts``;
    null where nothing that counts was reported."""
    usage = F.when(usage_counts, F.col("usage_cost"))
    zero = F.lit(0).cast(MONEY)
    return F.when(F.col("cost").isNotNull() | usage.isNotNull(),
                  F.coalesce(F.col("cost"), zero) + F.coalesce(usage, zero)).cast(MONEY)


def blended_ledger(cur_rows: DataFrame, usage_daily: DataFrame, plan_keys: DataFrame) -> DataFrame:
    """The blended ledger as each plan instant sees it: usage counts from the
    FY start through ``as_of``.

    ``plan_keys(budget_id, as_of, fy_start)``: one row per plan instant. The
    result repeats the days for every instant, keyed (budget_id, as_of,
    usage_date); plans read ``blended_days`` instead.
    """
    keys = plan_keys.select("budget_id", "as_of", "fy_start")
    seen = F.col("usage_date").between(F.col("fy_start"), F.col("as_of"))
    rows = blended_days(cur_rows, usage_daily).join(keys, "budget_id").withColumn("cost", blended_cost(seen))
    return rows.filter("cost is not null").select("budget_id", "as_of", "usage_date", "cost")

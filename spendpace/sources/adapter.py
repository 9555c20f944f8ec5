"""Driver tables -> the pipeline's input schemas.

The test tables are a TPC-H-like star plus an ``events`` stream. This module
re-expresses them as billing line items, metered usage, a price list,
workspace inventory, budgets and check instants. Every expression uses only
columns of the given tables, so the same mapping is written once more in
SQL for the DuckDB oracle (``spendpace.plans.oracle``) and the two sides
see identical inputs.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendpace.functions.tags import MONEY

# ---------------------------------------------------------------------------
# Fixed values of the adapter (also used verbatim by the oracle SQL).
# ---------------------------------------------------------------------------
#: Shift of l_shipdate into the events' month; a multiple of 7 keeps weekdays.
SHIP_SHIFT_DAYS = 8218
#: Price list: a SKU's price until the change and, a quarter higher, from it
#: (open end); a EUR row checks that only USD prices are used.
PRICE_EPOCH = "2023-01-01 00:00:00"
PRICE_CHANGE = "2024-01-16 00:00:00"
PRICE_BEFORE, PRICE_AFTER, PRICE_EUR = "1.00", "1.25", "0.90"
#: SKUs metered in other units, (units per event value, price before, price
#: after): view in hundred thousands at a price with a small remainder, error in
#: hundred-thousandths at a price far below a cent.
OTHER_UNITS = {"view": ("0.00001", "100000.03", "125000.0375"), "error": ("100000", "0.00001", "0.0000125")}
#: Compute type per event type.
COMPUTE_TYPES = {"click": "JOBS", "view": "SQL", "purchase": "ALL_PURPOSE",
                 "signup": "DLT", "error": "SERVERLESS"}
#: Priority tag value per market segment (AUTOMOBILE is untagged).
SEGMENT_PRIORITY = {"BUILDING": "critical", "MACHINERY": "low",
                    "FURNITURE": " LOW ", "HOUSEHOLD": "urgent"}
#: Check instants (UTC) evaluated for every budget: the standard Tuesday
#: 15:00, a 01:00 check whose lag window crosses midnight, and a Sunday.
CHECK_INSTANTS = ("2024-01-23 15:00:00", "2024-01-24 01:00:00", "2024-01-28 10:00:00")
#: State-transition queries: a live check, then the next one (some budgets
#: throttled at the first have recovered to OK at the second).
TRANSITION_INSTANTS = ("2024-01-26 15:00:00", "2024-01-28 09:00:00")
#: Later checks for the release what-if: every 6 hours over the rest of the
#: events (first and last inclusive).
RELEASE_FIRST, RELEASE_LAST, RELEASE_STEP_HOURS = "2024-01-24 03:00:00", "2024-01-30 21:00:00", 6
#: Two freezes before and amid those checks: jobs of remainder 0, then of 3.
FREEZES = (("2024-01-23 21:00:00", 0), ("2024-01-26 12:00:00", 3))
#: Budget amount: daily mean of the budget's attributed spend over
#: [BUDGET_BASE_START, BUDGET_BASE_END) x 366 x (0.9 + 0.1 x budget_id).
BUDGET_BASE_START, BUDGET_BASE_END, BUDGET_BASE_DAYS = "2023-10-01", "2024-01-01", 92
#: Anchor instant for cluster activity: idle minutes = (custkey % 7) * 10.
ACTIVITY_ANCHOR = "2024-01-23 15:00:00"

N_BUDGETS_COL = "r_regionkey"
#: Compute types of the multiplier overrides, by ``n_nationkey % 3``.
OVERRIDE_TYPES = ("JOBS", "SQL", "ALL_PURPOSE")
#: CSV export: line items starting before this date go to the first
#: billing-period folder, the rest to the second (written with its columns
#: in reverse order, so the reader must combine the files by name).
CSV_PERIOD_SPLIT = "2024-01-01"
CSV_PERIODS = ("20231001-20240101", "20240101-20240201")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c: Column, mapping: dict, default=None) -> Column:
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr


def _between(df: DataFrame, column: str, start: date | None, end: date | None, shift_days: int = 0) -> DataFrame:
    """Rows whose ``column`` moved by ``shift_days`` lies in ``[start, end)``.
    The bounds are moved instead, and take the column's own type, so that the
    scan can skip row groups by them."""
    kind = df.schema[column].dataType
    bound = lambda d: F.lit(str(d - timedelta(days=shift_days))).cast(kind)
    if start is not None:
        df = df.filter(F.col(column) >= bound(start))
    if end is not None:
        df = df.filter(F.col(column) < bound(end))
    return df


def multiplier_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides set for the budgets, from every second nation: (budget_id,
    compute_type, multiplier, set_seq). Some set a compute type twice."""
    n = F.col("n_nationkey")
    kinds = F.array(*[F.lit(c) for c in OVERRIDE_TYPES])
    return table(spark, sf_dir, "nation").where(n % 2 == 0).select(
        F.col("n_regionkey").cast("int").alias("budget_id"), kinds[(n % 3).cast("int")].alias("compute_type"),
        (F.lit(1.0) + n.cast("double") / 20.0).alias("multiplier"), n.cast("long").alias("set_seq"))


def cur_raw(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Line items in the parquet (snake_case) layout with one column per tag,
    of usage starting in ``[start, end)`` where given."""
    li = _between(table(spark, sf_dir, "lineitem"), "l_shipdate", start, end, SHIP_SHIFT_DAYS).select(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    j = li.join(part, li["l_partkey"] == part["p_partkey"], "inner")
    rf, ls, pt = F.col("l_returnflag"), F.col("l_linestatus"), F.col("p_type")
    return j.select(
        (F.col("l_shipdate").cast("timestamp") + F.expr(f"INTERVAL {SHIP_SHIFT_DAYS} DAYS"))
        .alias("line_item_usage_start_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 25).cast(MONEY)
        .alias("line_item_unblended_cost"),
        F.when((rf == "A") & (ls == "F"), F.lit("Tax"))
        .when(rf == "A", F.lit("Credit"))
        .when((rf == "N") & (ls == "F"), F.lit(None).cast("string"))
        .otherwise(F.lit("Usage")).alias("line_item_line_item_type"),
        F.lpad((F.col("l_suppkey") % 5).cast("string"), 12, "0").alias("line_item_usage_account_id"),
        F.when(pt == "ECONOMY", F.lit("Databricks, Inc."))
        .otherwise(F.lit("Amazon Web Services, Inc.")).alias("line_item_legal_entity"),
        F.when(pt.isin("ECONOMY", "STANDARD"), F.lit("AWS Marketplace"))
        .otherwise(F.lit("AWS")).alias("bill_billing_entity"),
        F.when(pt == "STANDARD", F.lit("Databricks Lakehouse"))
        .when(pt == "LARGE", F.lit("Amazon Elastic Compute Cloud"))
        .otherwise(F.lit("Amazon Simple Storage Service")).alias("product_product_name"),
        F.when(pt == "PROMO", F.lit(" databricks ")).when(pt == "SMALL", F.lit("other"))
        .alias("resource_tags_user_Vendor"),
        F.when(pt == "LARGE", F.concat(F.lit("c-"), F.col("p_size").cast("string")))
        .when(pt == "MEDIUM", F.lit("  ")).alias("resource_tags_user_ClusterId"),
    )


def budget_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per budget: budget b owns account lpad(b, 12, '0')."""
    return table(spark, sf_dir, "region").select(
        F.col(N_BUDGETS_COL).cast("int").alias("budget_id"),
        F.lpad(F.col(N_BUDGETS_COL).cast("string"), 12, "0").alias("usage_account_id"))


def usage(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Metered usage from events (see ``usage_from_events``) in ``[start, end)``."""
    return usage_from_events(_between(table(spark, sf_dir, "events"), "ts", start, end))


def usage_from_events(events: DataFrame) -> DataFrame:
    """Workspace (= budget) is user_id % 5 and the workload kind is
    user_id % 4 (job, warehouse, cluster, job); errors of the last remainder
    name no workload. Row-wise only, so it applies to a stream of events as
    well."""
    uid = F.col("user_id")
    kind = uid % 4
    uid_s = uid.cast("string")
    units = F.lit("1").cast("decimal(12,6)")
    for sku, (per_value, _, _) in OTHER_UNITS.items():
        units = F.when(F.col("event_type") == sku, F.lit(per_value).cast("decimal(12,6)")).otherwise(units)
    return events.select(
        (uid % 5).cast("int").alias("budget_id"),
        F.col("ts").cast("timestamp").alias("usage_start_time"),
        F.col("event_type").alias("sku_name"),
        F.lit("AWS").alias("cloud"),
        (F.col("value").cast("decimal(14,6)") * units).alias("usage_quantity"),
        _case(F.col("event_type"), COMPUTE_TYPES).alias("billing_origin_product"),
        F.struct(
            F.when((kind == 0) | ((kind == 3) & (F.coalesce(F.col("event_type"), F.lit("")) != "error")), uid_s).alias("job_id"),
            F.when(kind == 1, F.concat(F.lit("wh"), uid_s)).alias("warehouse_id"),
            F.when(kind == 2, F.concat(F.lit("c"), uid_s)).alias("cluster_id"),
        ).alias("usage_metadata"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two USD intervals per SKU seen in events (the second open-ended) and
    one EUR row. Built by a generator (explode), not a join."""
    skus = table(spark, sf_dir, "events").select(F.col("event_type").alias("sku_name")).distinct()
    ts = lambda s: F.lit(s).cast("timestamp")
    kind = "decimal(38,18)"
    before = _case(F.col("sku_name"), {k: v[1] for k, v in OTHER_UNITS.items()}, PRICE_BEFORE).cast(kind)
    after = _case(F.col("sku_name"), {k: v[2] for k, v in OTHER_UNITS.items()}, PRICE_AFTER).cast(kind)
    rows = F.array(
        F.struct(F.lit("USD").alias("currency_code"), ts(PRICE_EPOCH).alias("price_start_time"),
                 ts(PRICE_CHANGE).alias("price_end_time"), before.alias("price")),
        F.struct(F.lit("USD").alias("currency_code"), ts(PRICE_CHANGE).alias("price_start_time"),
                 F.lit(None).cast("timestamp").alias("price_end_time"),
                 after.alias("price")),
        F.struct(F.lit("EUR").alias("currency_code"), ts(PRICE_EPOCH).alias("price_start_time"),
                 F.lit(None).cast("timestamp").alias("price_end_time"),
                 F.lit(PRICE_EUR).cast(kind).alias("price")),
    )
    return (skus.select("sku_name", F.lit("AWS").alias("cloud"), F.explode(rows).alias("p"))
            .select("sku_name", "cloud", "p.currency_code", "p.price_start_time", "p.price_end_time",
                    F.struct(F.struct(F.col("p.price").alias("default")).alias("effective_list"))
                    .alias("pricing")))


def _inventory_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a workload: a job, a warehouse, a cluster or again a
    job by c_custkey % 4, as ``usage_from_events`` has it for its usage."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        (F.col("c_custkey") % 5).cast("int").alias("budget_id"))


def _is_job() -> Column:
    return (F.col("c_custkey") % 4).isin(0, 3)


def _priority_tags(tag_key: str) -> Column:
    seg = F.col("c_mktsegment")
    value = _case(seg, SEGMENT_PRIORITY)
    return F.when(value.isNotNull(), F.create_map(F.lit(tag_key), value)).otherwise(
        F.create_map().cast("map<string,string>"))


def jobs_raw(spark: SparkSession, sf_dir: str, tag_key: str = "budget-priority") -> DataFrame:
    c = _inventory_customers(spark, sf_dir).filter(_is_job())
    nk = F.col("c_nationkey")
    return c.select(
        "budget_id",
        F.col("c_custkey").cast("string").alias("job_id"),
        F.when(nk % 7 != 0, F.col("c_name")).alias("name"),
        _priority_tags(tag_key).alias("tags"),
        F.when(nk % 3 != 0, F.struct(
            F.when(nk % 3 == 2, F.lit("PAUSED")).otherwise(F.lit("UNPAUSED")).alias("pause_status")))
        .alias("schedule"),
    )


def warehouses_raw(spark: SparkSession, sf_dir: str, tag_key: str = "budget-priority") -> DataFrame:
    from spendpace.config import SIZE_LADDER
    c = _inventory_customers(spark, sf_dir).filter(F.col("c_custkey") % 4 == 1)
    nk, ck = F.col("c_nationkey"), F.col("c_custkey")
    ladder = F.array(*[F.lit(s) for s in SIZE_LADDER])
    seg_value = _case(F.col("c_mktsegment"), SEGMENT_PRIORITY)
    tags = F.when(seg_value.isNotNull(), F.array(
        F.struct(F.lit("team").alias("key"), F.lit("analytics").alias("value")),
        F.struct(F.lit(tag_key).alias("key"), seg_value.alias("value")))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))
    return c.select(
        "budget_id",
        F.concat(F.lit("wh"), ck.cast("string")).alias("id"),
        F.when(nk % 7 != 0, F.col("c_name")).alias("name"),
        F.when(nk % 11 != 0, F.element_at(ladder, (ck % 9 + 1).cast("int"))).alias("cluster_size"),
        ((ck % 13) * 10).cast("int").alias("auto_stop_mins"),
        (nk % 4).cast("int").alias("max_num_clusters"),
        F.when(F.col("c_acctbal") >= 0, F.lit("RUNNING")).otherwise(F.lit("STOPPED")).alias("state"),
        tags.alias("custom_tags"),
    )


def clusters_raw(spark: SparkSession, sf_dir: str, tag_key: str = "budget-priority") -> DataFrame:
    c = _inventory_customers(spark, sf_dir).filter(F.col("c_custkey") % 4 == 2)
    nk, ck = F.col("c_nationkey"), F.col("c_custkey")
    anchor_ms = F.unix_millis(F.lit(ACTIVITY_ANCHOR).cast("timestamp"))
    return c.select(
        "budget_id",
        F.concat(F.lit("c"), ck.cast("string")).alias("cluster_id"),
        F.when(nk % 7 != 0, F.col("c_name")).alias("cluster_name"),
        F.when(nk % 4 == 0, F.lit("TERMINATED")).otherwise(F.lit("RUNNING")).alias("state"),
        F.when(nk % 6 == 1, F.lit("JOB")).when(nk % 6 == 2, F.lit(None).cast("string"))
        .otherwise(F.lit("UI")).alias("cluster_source"),
        _priority_tags(tag_key).alias("custom_tags"),
        F.when(nk % 5 != 0, anchor_ms - (ck % 7) * 600000).cast("bigint").alias("last_activity_time"),
    )


def budgets(spark: SparkSession, sf_dir: str, ledger_daily: DataFrame) -> DataFrame:
    """One budget per region; the amount is derived from the budget's own
    attributed spend (see BUDGET_BASE_*), rounded to a dollar."""
    base = (ledger_daily
            .filter((F.col("usage_date") >= F.lit(BUDGET_BASE_START).cast("date"))
                    & (F.col("usage_date") < F.lit(BUDGET_BASE_END).cast("date")))
            .groupBy("budget_id").agg(F.sum("cost").alias("base_cost")))
    reg = table(spark, sf_dir, "region").select(F.col(N_BUDGETS_COL).cast("int").alias("budget_id"))
    j = reg.join(base, "budget_id", "left")
    amount = F.round(F.coalesce(F.col("base_cost"), F.lit(0)).cast("double") / BUDGET_BASE_DAYS * 366
                     * (F.lit(0.9) + F.lit(0.1) * F.col("budget_id")), 0)
    return j.select(
        "budget_id", amount.alias("annual_budget"),
        F.lit(10).alias("fy_start_month"), F.lit(1).alias("fy_start_day"),
        F.lit(6).alias("week_start_weekday"))


def release_instants(budgets_df: DataFrame) -> DataFrame:
    """Every budget at each 6-hourly instant of RELEASE_FIRST..RELEASE_LAST."""
    grid = F.sequence(F.lit(RELEASE_FIRST).cast("timestamp"), F.lit(RELEASE_LAST).cast("timestamp"),
                      F.make_interval(hours=F.lit(RELEASE_STEP_HOURS)))
    return budgets_df.select("*", F.explode(grid).alias("as_of"))


def freeze_instants(budgets_df: DataFrame) -> DataFrame:
    """Every budget at the instants of FREEZES."""
    return budgets_df.select("*", F.explode(F.array(*[F.lit(t).cast("timestamp") for t, _ in FREEZES])).alias("as_of"))


def frozen(entries: DataFrame) -> DataFrame:
    """Each freeze's entries of the jobs it is for (see FREEZES)."""
    hit = [(F.col("paused_at") == F.lit(t).cast("timestamp")) & (F.col("job_id").cast("bigint") % 4 == r) for t, r in FREEZES]
    return entries.filter(hit[0] | hit[1])


def first_check_instants(budgets_df: DataFrame) -> DataFrame:
    """Every budget at the first check instant only."""
    return budgets_df.select("*", F.lit(CHECK_INSTANTS[0]).cast("timestamp").alias("as_of"))


def transition_instants(budgets_df: DataFrame, step: int) -> DataFrame:
    """Every budget at TRANSITION_INSTANTS[step] (0: the live check whose
    actions and queue carry over, 1: the check that follows it)."""
    return budgets_df.select("*", F.lit(TRANSITION_INSTANTS[step]).cast("timestamp").alias("as_of"))


def check_instants(budgets_df: DataFrame) -> DataFrame:
    """Every budget at each of CHECK_INSTANTS (a generator over a literal
    array: budgets x instants rows, bounded by the config)."""
    arr = F.array(*[F.lit(t).cast("timestamp") for t in CHECK_INSTANTS])
    return budgets_df.select("*", F.explode(arr).alias("as_of"))


def job_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job settings with nested cluster specs: one job cluster ('main'),
    fixed size or autoscaling by c_nationkey % 3, and one task ('etl') that
    carries its own cluster for every eighth job."""
    c = _inventory_customers(spark, sf_dir).filter(_is_job())
    nk, ck = F.col("c_nationkey"), F.col("c_custkey")

    def cluster(size: Column) -> Column:
        return F.struct(
            F.when(nk % 3 != 0, size).cast("int").alias("num_workers"),
            F.when(nk % 3 == 0, F.struct(F.lit(2).alias("min_workers"),
                                          (size + 1).cast("int").alias("max_workers"))).alias("autoscale"),
            F.struct(F.lit("ON_DEMAND").alias("availability"),
                     F.when(nk % 2 == 0, F.lit(2)).cast("int").alias("first_on_demand"),
                     F.lit(None).cast("int").alias("spot_bid_price_percent")).alias("aws_attributes"))

    return c.select(
        "budget_id", ck.cast("string").alias("job_id"),
        F.array(F.struct(F.lit("main").alias("job_cluster_key"),
                         cluster(ck % 10 + 1).alias("new_cluster"))).alias("job_clusters"),
        F.array(F.struct(F.lit("etl").alias("task_key"),
                         F.when(ck % 8 == 0, cluster(ck % 5 + 1)).alias("new_cluster"))).alias("tasks"))


def write_cur_redelivery(spark: SparkSession, sf_dir: str, root: str) -> str:
    """All line items, the first billing period's delivered once and the
    second's twice, as export assemblies 1 and 2 of the same period folder (a
    corrected re-delivery). One partitioned write per period, so each task's
    file carries the same name in both assembly folders, as a re-issued export
    does. Returns ``root``."""
    raw = cur_raw(spark, sf_dir)
    early = F.coalesce(F.col("line_item_usage_start_date") < F.lit(CSV_PERIOD_SPLIT).cast("timestamp"), F.lit(True))
    for rows, assemblies, period in ((raw.filter(early), [1], CSV_PERIODS[0]), (raw.filter(~early), [1, 2], CSV_PERIODS[1])):
        (rows.select("*", F.explode(F.array(*map(F.lit, assemblies))).alias("assembly"))
         .write.mode("overwrite").partitionBy("assembly").option("header", "true").option("compression", "gzip")
         .csv(f"{root}/{period}"))
    return root


def write_cur_parquet(spark: SparkSession, sf_dir: str, root: str) -> str:
    """All line items as a parquet export of two billing periods, tags in one
    text column: a JSON object in the first period, JSON pairs in the second,
    which has a further column. The second period's first assembly, with doubled
    costs, was replaced by another one. Returns ``root``."""
    raw = cur_raw(spark, sf_dir)
    early = F.coalesce(F.col("line_item_usage_start_date") < F.lit(CSV_PERIOD_SPLIT).cast("timestamp"), F.lit(True))
    tags = {"user_Vendor": "resource_tags_user_Vendor", "user_ClusterId": "resource_tags_user_ClusterId"}
    whole = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in tags.items()]))
    pairs = F.to_json(F.array(*[F.array(F.lit(k), F.col(c)) for k, c in tags.items()]))
    first = raw.filter(early).withColumn("resource_tags", whole).drop(*tags.values())
    second = raw.filter(~early).withColumn("resource_tags", pairs).drop(*tags.values()).withColumn("line_item_usage_type", F.lit("on demand"))
    wrong = second.withColumn("line_item_unblended_cost", F.col("line_item_unblended_cost") * 2)
    for df, period, assembly in ((first, "2023-10", 1), (wrong, "2024-01", 9), (second, "2024-01", 10)):
        df.write.mode("overwrite").parquet(f"{root}/BILLING_PERIOD={period}/assembly={assembly}")
    return root


def write_cur_csv(spark: SparkSession, sf_dir: str, root: str) -> str:
    """The line items of ``cur_raw`` as a gzip CSV export in the legacy
    (slash-named) layout under ``root``: every row is written once, into one
    of two billing-period folders split at CSV_PERIOD_SPLIT; the second
    folder's files list the columns in reverse order. Whitespace and NULLs
    are written as they are. Returns ``root``."""
    from spendpace.config import CUR_COLUMNS, PaceConfig
    from spendpace.sources.cur import TAG_PREFIXES
    snake, slash = TAG_PREFIXES
    legacy = {new.lower(): old for new, old in CUR_COLUMNS.values()}
    legacy |= {(snake + t).lower(): slash + t for t in PaceConfig().tag_names}
    raw = cur_raw(spark, sf_dir)
    named = raw.select(*[F.col(c).alias(legacy.get(c.lower(), c)) for c in raw.columns])
    start = F.col(f"`{CUR_COLUMNS['usage_start'][1]}`")
    early = F.coalesce(start < F.lit(CSV_PERIOD_SPLIT).cast("timestamp"), F.lit(True))
    parts = ((named.filter(early), list(named.columns), CSV_PERIODS[0]),
             (named.filter(~early), list(reversed(named.columns)), CSV_PERIODS[1]))
    for df, order, period in parts:
        (df.select(*[F.col(f"`{c}`") for c in order]).write.mode("overwrite")
         .option("header", "true").option("compression", "gzip")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .csv(f"{root}/{period}/delivery"))
    return root

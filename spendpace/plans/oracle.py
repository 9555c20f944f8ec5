"""Oracle SQL (DuckDB dialect) for every registered query.

The driver registers the test tables as views and runs these statements next
to the Spark queries. Each statement is assembled from named common table
expressions that restate the adapter and the operators in plain SQL; a
query pulls in only the CTEs it needs (in dependency order).
"""

from __future__ import annotations

from spendpace import config as C
from spendpace.sources import adapter as A

D = "CAST({} AS DOUBLE)".format  # DuckDB reads 0.9 as DECIMAL; Spark as DOUBLE


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


def _pmod7(x: str) -> str:
    return f"((({x}) % 7) + 7) % 7"


def _wd(d: str) -> str:
    return f"(isodow({d}) - 1)"


_INSTANTS = ", ".join(f"(TIMESTAMP '{t}')" for t in A.CHECK_INSTANTS)
_ACTIVITY = f"epoch_ms(TIMESTAMP '{A.ACTIVITY_ANCHOR}')"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("budget_accounts", [], """
  SELECT CAST(r_regionkey AS INTEGER) AS budget_id,
         lpad(CAST(r_regionkey AS VARCHAR), 12, '0') AS usage_account_id
  FROM region""")

cte("cur", ["budget_accounts"], f"""
  SELECT a.budget_id, c.* FROM (
    SELECT
      CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL {A.SHIP_SHIFT_DAYS} DAY AS usage_start,
      CAST(CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL {A.SHIP_SHIFT_DAYS} DAY AS DATE) AS usage_date,
      CAST(l.l_extendedprice * (1 - l.l_discount) / 25 AS DECIMAL(18,4)) AS cost,
      CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'Tax'
           WHEN l.l_returnflag = 'A' THEN 'Credit'
           WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN NULL
           ELSE 'Usage' END AS line_item_type,
      lpad(CAST(l.l_suppkey % 5 AS VARCHAR), 12, '0') AS usage_account_id,
      CASE WHEN p.p_type = 'ECONOMY' THEN 'Databricks, Inc.' ELSE 'Amazon Web Services, Inc.' END AS legal_entity,
      CASE WHEN p.p_type IN ('ECONOMY', 'STANDARD') THEN 'AWS Marketplace' ELSE 'AWS' END AS billing_entity,
      CASE WHEN p.p_type = 'STANDARD' THEN 'Databricks Lakehouse'
           WHEN p.p_type = 'LARGE' THEN 'Amazon Elastic Compute Cloud'
           ELSE 'Amazon Simple Storage Service' END AS product_name,
      CASE WHEN p.p_type = 'PROMO' THEN ' databricks ' WHEN p.p_type = 'SMALL' THEN 'other' END AS tag_user_vendor,
      CASE WHEN p.p_type = 'LARGE' THEN 'c-' || CAST(p.p_size AS VARCHAR)
           WHEN p.p_type = 'MEDIUM' THEN '  ' END AS tag_user_clusterid,
      CAST(NULL AS VARCHAR) AS tag_user_clustername,
      CAST(NULL AS VARCHAR) AS tag_user_jobid
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) c
  JOIN budget_accounts a ON c.usage_account_id = a.usage_account_id""")

cte("flagged", ["cur"], """
  SELECT *,
    (coalesce(contains(lower(billing_entity), 'marketplace'), false)
     AND (coalesce(contains(lower(legal_entity), 'databricks'), false)
          OR coalesce(contains(lower(product_name), 'databricks'), false))) AS is_marketplace,
    (coalesce(contains(lower(billing_entity), 'marketplace'), false)
     AND (coalesce(contains(lower(legal_entity), 'databricks'), false)
          OR coalesce(contains(lower(product_name), 'databricks'), false)))
    OR coalesce(lower(trim(tag_user_vendor)) = 'databricks', false)
    OR coalesce(trim(tag_user_clusterid) <> '', false)
    OR coalesce(trim(tag_user_clustername) <> '', false)
    OR coalesce(trim(tag_user_jobid) <> '', false) AS attributed
  FROM cur
  WHERE coalesce(line_item_type NOT IN ('Tax', 'Refund', 'Credit'), true)""")

cte("attributed", ["flagged"], "SELECT * FROM flagged WHERE attributed")

cte("ledger", ["attributed"], """
  SELECT budget_id, usage_date, CAST(SUM(cost) AS DECIMAL(18,4)) AS cost
  FROM attributed WHERE usage_date IS NOT NULL GROUP BY budget_id, usage_date""")

cte("budgets", ["ledger"], f"""
  SELECT CAST(r.r_regionkey AS INTEGER) AS budget_id,
    round(CAST(coalesce(b.base_cost, 0) AS DOUBLE) / {A.BUDGET_BASE_DAYS} * 366
          * ({D(0.9)} + {D(0.1)} * CAST(r.r_regionkey AS INTEGER)), 0) AS annual_budget,
    10 AS fy_start_month, 1 AS fy_start_day, 6 AS week_start_weekday
  FROM region r LEFT JOIN (
    SELECT budget_id, SUM(cost) AS base_cost FROM ledger
    WHERE usage_date >= DATE '{A.BUDGET_BASE_START}' AND usage_date < DATE '{A.BUDGET_BASE_END}'
    GROUP BY budget_id) b ON b.budget_id = r.r_regionkey""")

cte("instants", ["budgets"], f"""
  SELECT b.*, v.as_of FROM budgets b CROSS JOIN (VALUES {_INSTANTS}) v(as_of)""")

cte("pk0", ["instants"], """
  SELECT DISTINCT budget_id, CAST(as_of AS DATE) AS as_of, annual_budget, fy_start_month, fy_start_day,
         week_start_weekday,
         CASE WHEN CAST(as_of AS DATE) < make_date(year(as_of), fy_start_month, fy_start_day)
              THEN make_date(year(as_of) - 1, fy_start_month, fy_start_day)
              ELSE make_date(year(as_of), fy_start_month, fy_start_day) END AS fy_start
  FROM instants""")

cte("pk1", ["pk0"], f"""
  SELECT *, make_date(year(fy_start) + 1, fy_start_month, fy_start_day) AS fy_end,
         CAST(as_of - CAST({_pmod7(_wd('as_of') + ' - week_start_weekday')} AS INTEGER) AS DATE) AS natural_week_start
  FROM pk0""")

cte("pk2", ["pk1"], """
  SELECT *, greatest(natural_week_start, fy_start) AS week_start FROM pk1""")

cte("pk", ["pk2"], f"""
  SELECT *, 'FY' || CAST(year(fy_end) AS VARCHAR) AS fy_label,
    least(CAST(week_start + CAST(CASE WHEN {_pmod7('week_start_weekday - ' + _wd('week_start'))} = 0 THEN 7
                  ELSE {_pmod7('week_start_weekday - ' + _wd('week_start'))} END AS INTEGER) AS DATE), fy_end) AS week_end,
    fy_end - week_start AS remaining_fy_days
  FROM pk2""")

cte("plan", ["pk", "ledger"], """
  SELECT k.*, k.week_end - k.week_start AS days_in_week,
    CAST(k.remaining_fy_days AS DOUBLE) / 7.0 AS remaining_weeks,
    CAST(coalesce(f.fytd, 0) AS DECIMAL(18,4)) AS fy_to_date_spend,
    greatest(CAST(annual_budget AS DOUBLE) - CAST(CAST(coalesce(f.fytd, 0) AS DECIMAL(18,4)) AS DOUBLE),
             CAST(0 AS DOUBLE)) AS remaining_budget
  FROM pk k LEFT JOIN (
    SELECT q.budget_id, q.fy_start, q.week_start, SUM(l.cost) AS fytd
    FROM (SELECT DISTINCT budget_id, fy_start, week_start FROM pk) q
    JOIN ledger l ON l.budget_id = q.budget_id AND l.usage_date >= q.fy_start AND l.usage_date < q.week_start
    GROUP BY q.budget_id, q.fy_start, q.week_start) f
  ON f.budget_id = k.budget_id AND f.fy_start = k.fy_start AND f.week_start = k.week_start""")

cte("weekly_plan", ["plan"], """
  SELECT *, CASE WHEN remaining_fy_days <= 0 THEN CAST(0 AS DOUBLE)
                 ELSE remaining_budget * days_in_week / remaining_fy_days END AS weekly_allowance
  FROM plan""")

cte("prof_keys", ["pk"], """
  SELECT DISTINCT budget_id, natural_week_start AS nws, week_start_weekday AS wsw FROM pk""")

cte("prof_rows", ["prof_keys", "ledger"], f"""
  SELECT k.budget_id, k.nws, l.usage_date, l.cost,
         CAST(l.usage_date - CAST({_pmod7(_wd('l.usage_date') + ' - k.wsw')} AS INTEGER) AS DATE) AS wk
  FROM prof_keys k JOIN ledger l
    ON l.budget_id = k.budget_id AND l.usage_date >= k.nws - 7 * 8 AND l.usage_date < k.nws""")

cte("prof_complete", ["prof_rows"], """
  SELECT r.*, CAST(r.cost AS DOUBLE) / CAST(w.total AS DOUBLE) AS fraction
  FROM prof_rows r JOIN (
    SELECT budget_id, nws, wk, COUNT(*) AS n, SUM(cost) AS total FROM prof_rows GROUP BY budget_id, nws, wk) w
  ON r.budget_id = w.budget_id AND r.nws = w.nws AND r.wk = w.wk
  WHERE w.n = 7 AND w.total > 0""")

cte("profile", ["prof_keys", "prof_complete"], f"""
  SELECT k.budget_id, k.nws AS natural_week_start, g.weekday,
    CASE WHEN coalesce(cw.complete_weeks, 0) < 2 THEN CAST(1 AS DOUBLE) / 7
         ELSE coalesce(m.mf, CAST(0 AS DOUBLE)) / t.mt END AS weight,
    CAST(coalesce(cw.complete_weeks, 0) AS INTEGER) AS complete_weeks
  FROM prof_keys k
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS weekday FROM range(7)) g
  LEFT JOIN (SELECT budget_id, nws, {_wd('usage_date')} AS weekday, AVG(fraction) AS mf
             FROM prof_complete GROUP BY ALL) m
    ON m.budget_id = k.budget_id AND m.nws = k.nws AND m.weekday = g.weekday
  LEFT JOIN (SELECT budget_id, nws, COUNT(DISTINCT wk) AS complete_weeks FROM prof_complete GROUP BY ALL) cw
    ON cw.budget_id = k.budget_id AND cw.nws = k.nws
  LEFT JOIN (SELECT budget_id, nws, SUM(mf) AS mt FROM (
               SELECT budget_id, nws, {_wd('usage_date')} AS weekday, AVG(fraction) AS mf
               FROM prof_complete GROUP BY ALL) GROUP BY ALL) t
    ON t.budget_id = k.budget_id AND t.nws = k.nws""")

cte("targets0", ["weekly_plan", "profile"], f"""
  SELECT d.budget_id, d.as_of, d.day, {_wd('d.day')} AS weekday, d.weekly_allowance,
         coalesce(pr.weight, CAST(0 AS DOUBLE)) AS weight
  FROM (SELECT budget_id, as_of, natural_week_start, weekly_allowance,
               CAST(unnest(range(CAST(week_start AS TIMESTAMP), CAST(week_end AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
        FROM weekly_plan) d
  LEFT JOIN profile pr ON pr.budget_id = d.budget_id AND pr.natural_week_start = d.natural_week_start
                       AND pr.weekday = {_wd('d.day')}""")

cte("targets", ["targets0"], """
  SELECT budget_id, as_of, day, weekday,
    CASE WHEN tw <= 0 THEN weekly_allowance * 1.0 / CAST(nd AS DOUBLE)
         ELSE weekly_allowance * weight / tw END AS target
  FROM (SELECT *, SUM(weight) OVER (PARTITION BY budget_id, as_of) AS tw,
               COUNT(*) OVER (PARTITION BY budget_id, as_of) AS nd FROM targets0)""")

# ---------------------------------------------------------------- usage --
cte("usage", [], f"""
  SELECT CAST(user_id % 5 AS INTEGER) AS budget_id, CAST(ts AS TIMESTAMP) AS usage_start_time,
         event_type AS sku_name, 'AWS' AS cloud, CAST(value AS DECIMAL(14,2)) AS value,
         {_case('event_type', A.COMPUTE_TYPES)} AS compute_type,
         CASE WHEN user_id % 4 = 0 OR user_id % 4 = 3 AND event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS job_id,
         CASE WHEN user_id % 4 = 1 THEN 'wh' || CAST(user_id AS VARCHAR) END AS warehouse_id,
         CASE WHEN user_id % 4 = 2 THEN 'c' || CAST(user_id AS VARCHAR) END AS cluster_id
  FROM events""")

cte("prices", [], f"""
  SELECT s.sku_name, 'AWS' AS cloud, v.currency_code, v.price_start_time, v.price_end_time, v.price
  FROM (SELECT DISTINCT event_type AS sku_name FROM events) s CROSS JOIN (VALUES
    ('USD', TIMESTAMP '{A.PRICE_EPOCH}', TIMESTAMP '{A.PRICE_CHANGE}', CAST(1.00 AS DECIMAL(10,8))),
    ('USD', TIMESTAMP '{A.PRICE_CHANGE}', CAST(NULL AS TIMESTAMP), CAST(1.25 AS DECIMAL(10,8))),
    ('EUR', TIMESTAMP '{A.PRICE_EPOCH}', CAST(NULL AS TIMESTAMP), CAST(0.90 AS DECIMAL(10,8)))
  ) v(currency_code, price_start_time, price_end_time, price)""")

# dollars of an event by the units it is worth, without the SKUs' units of
# metering: views cost three ten-millionths more than the rest

cte("priced", ["usage", "prices"], """
  SELECT u.*, u.value * p.price * CAST(CASE WHEN u.sku_name = 'view' THEN 1.0000003 ELSE 1 END AS DECIMAL(10,8)) AS dbu_dollars,
    CASE WHEN length(coalesce(u.job_id, '')) > 0 THEN 'JOB'
         WHEN length(coalesce(u.warehouse_id, '')) > 0 THEN 'WAREHOUSE'
         WHEN length(coalesce(u.cluster_id, '')) > 0 THEN 'CLUSTER' ELSE 'OTHER' END AS workload_type,
    CASE WHEN length(coalesce(u.job_id, '')) > 0 THEN u.job_id
         WHEN length(coalesce(u.warehouse_id, '')) > 0 THEN u.warehouse_id
         WHEN length(coalesce(u.cluster_id, '')) > 0 THEN u.cluster_id ELSE '' END AS workload_id
  FROM usage u JOIN prices p
    ON u.sku_name = p.sku_name AND u.cloud = p.cloud AND u.usage_start_time >= p.price_start_time
   AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time)
  WHERE p.currency_code = 'USD'""")

cte("usage_hourly", ["priced"], """
  SELECT budget_id, date_trunc('hour', usage_start_time) AS hour_start, compute_type, workload_type,
         workload_id, SUM(dbu_dollars) AS dbu_dollars
  FROM priced WHERE usage_start_time IS NOT NULL AND compute_type IS NOT NULL
  GROUP BY ALL""")

cte("usage_daily", ["priced"], """
  SELECT budget_id, CAST(usage_start_time AS DATE) AS usage_date,
         SUM(dbu_dollars) AS dbu_dollars
  FROM priced GROUP BY ALL""")

cte("calibration", ["pk", "ledger", "usage_hourly"], """
  SELECT k.budget_id, k.as_of,
    CASE WHEN coalesce(a.wd, 0) >= 7 AND a.ds > 0
         THEN least(greatest(CAST(a.cs AS DOUBLE) / CAST(CAST(a.ds AS DECIMAL(28,9)) AS DOUBLE), CAST(1.0 AS DOUBLE)), CAST(4.0 AS DOUBLE))
         ELSE CAST(1.6 AS DOUBLE) END AS global_multiplier,
    CAST(coalesce(a.wd, 0) AS INTEGER) AS window_days,
    CAST(CASE WHEN coalesce(a.wd, 0) >= 7 AND a.ds > 0 THEN a.cs ELSE 0 END AS DECIMAL(18,4)) AS cur_total,
    CAST(CASE WHEN coalesce(a.wd, 0) >= 7 AND a.ds > 0 THEN a.ds ELSE 0 END AS DECIMAL(18,4)) AS dbu_total
  FROM (SELECT DISTINCT budget_id, as_of FROM pk) k LEFT JOIN (
    SELECT k2.budget_id, k2.as_of, COUNT(*) AS wd, SUM(l.cost) AS cs, SUM(u.dbu) AS ds
    FROM (SELECT DISTINCT budget_id, as_of FROM pk) k2
    JOIN ledger l ON l.budget_id = k2.budget_id AND l.usage_date >= k2.as_of - 30 AND l.usage_date < k2.as_of - 2
    JOIN (SELECT budget_id, CAST(hour_start AS DATE) AS usage_date, SUM(dbu_dollars) AS dbu
          FROM usage_hourly GROUP BY ALL) u
      ON u.budget_id = k2.budget_id AND u.usage_date = l.usage_date
    GROUP BY k2.budget_id, k2.as_of) a
  ON a.budget_id = k.budget_id AND a.as_of = k.as_of""")


def with_ctes(names: list[str], select: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    return f"WITH {body}\n{select}"


# ------------------------------------------------------------ inventory --
def _prio(value_sql: str) -> str:
    v = f"lower(trim({value_sql}))"
    return f"coalesce(CASE WHEN {v} IN ('low', 'normal', 'critical') THEN {v} END, 'normal')"


_SEG = _case("c_mktsegment", A.SEGMENT_PRIORITY)
_LADDER = "[" + ", ".join(f"'{s}'" for s in __import__("spendpace.config", fromlist=["x"]).SIZE_LADDER) + "]"

cte("inv_customers", [], """
  SELECT c.*, CAST(c.c_custkey % 5 AS INTEGER) AS budget_id FROM customer c""")

cte("jobs", ["inv_customers"], f"""
  SELECT budget_id, CAST(c_custkey AS VARCHAR) AS job_id,
    CASE WHEN c_nationkey % 7 <> 0 AND coalesce(c_name, '') <> '' THEN c_name
         ELSE 'job-' || CAST(c_custkey AS VARCHAR) END AS name,
    (c_nationkey % 3 <> 0) AS has_schedule, (c_nationkey % 3 = 2) AS schedule_paused,
    {_prio(_SEG)} AS priority
  FROM inv_customers WHERE c_custkey % 4 IN (0, 3)""")

cte("warehouses", ["inv_customers"], f"""
  SELECT budget_id, 'wh' || CAST(c_custkey AS VARCHAR) AS warehouse_id,
    CASE WHEN c_nationkey % 7 <> 0 AND coalesce(c_name, '') <> '' THEN c_name
         ELSE 'wh' || CAST(c_custkey AS VARCHAR) END AS name,
    CASE WHEN c_nationkey % 11 <> 0 THEN {_LADDER}[CAST(c_custkey % 9 AS INTEGER) + 1] ELSE 'X-Small' END AS cluster_size,
    CAST((c_custkey % 13) * 10 AS INTEGER) AS auto_stop_mins,
    CAST(CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE c_nationkey % 4 END AS INTEGER) AS max_num_clusters,
    CASE WHEN c_acctbal >= 0 THEN 'RUNNING' ELSE 'STOPPED' END AS state,
    {_prio(_SEG)} AS priority
  FROM inv_customers WHERE c_custkey % 4 = 1""")

cte("clusters", ["inv_customers"], f"""
  SELECT budget_id, 'c' || CAST(c_custkey AS VARCHAR) AS cluster_id,
    CASE WHEN c_nationkey % 7 <> 0 AND coalesce(c_name, '') <> '' THEN c_name
         ELSE 'c' || CAST(c_custkey AS VARCHAR) END AS name,
    CASE WHEN c_nationkey % 4 = 0 THEN 'TERMINATED' ELSE 'RUNNING' END AS state,
    CASE WHEN c_nationkey % 5 <> 0 THEN {_ACTIVITY} - (c_custkey % 7) * 600000 END AS last_activity_time,
    {_prio(_SEG)} AS priority
  FROM inv_customers WHERE c_custkey % 4 = 2 AND c_nationkey % 6 <> 1""")

cte("workload_meta", ["jobs", "warehouses", "clusters"], """
  SELECT budget_id, 'JOB' AS workload_type, job_id AS workload_id, name, priority FROM jobs
  UNION ALL SELECT budget_id, 'WAREHOUSE', warehouse_id, name, priority FROM warehouses
  UNION ALL SELECT budget_id, 'CLUSTER', cluster_id, name, priority FROM clusters""")

# ------------------------------------------------------------- forecasts --
cte("ck", ["instants"], """
  SELECT budget_id, date_trunc('hour', as_of) AS as_of, CAST(as_of AS DATE) AS today,
         hour(as_of) AS now_hour, isodow(CAST(as_of AS DATE)) - 1 AS today_wd,
         date_trunc('hour', as_of) - INTERVAL 3 HOUR AS cutoff
  FROM instants""")

cte("hist", ["ck", "usage_hourly"], """
  SELECT k.budget_id, k.as_of, k.today, k.now_hour, k.today_wd, CAST(u.hour_start AS DATE) AS usage_date,
         hour(u.hour_start) AS hour, u.compute_type, u.workload_type, u.workload_id, u.dbu_dollars
  FROM ck k JOIN usage_hourly u ON u.budget_id = k.budget_id
   AND CAST(u.hour_start AS DATE) >= k.today - 14 AND CAST(u.hour_start AS DATE) < k.today""")

cte("pool", ["hist"], """
  SELECT d.budget_id, d.as_of, d.usage_date,
         (s.n_same < 2 OR isodow(d.usage_date) - 1 = d.today_wd) AS in_pool
  FROM (SELECT DISTINCT budget_id, as_of, today_wd, usage_date FROM hist) d
  JOIN (SELECT budget_id, as_of, COUNT(*) FILTER (WHERE isodow(usage_date) - 1 = today_wd) AS n_same
        FROM (SELECT DISTINCT budget_id, as_of, today_wd, usage_date FROM hist) GROUP BY ALL) s
    ON s.budget_id = d.budget_id AND s.as_of = d.as_of""")

cte("hist_pool", ["hist", "pool"], """
  SELECT h.*, p.in_pool, ps.pool_size FROM hist h
  JOIN pool p ON p.budget_id = h.budget_id AND p.as_of = h.as_of AND p.usage_date = h.usage_date
  JOIN (SELECT budget_id, as_of, COUNT(*) FILTER (WHERE in_pool) AS pool_size FROM pool GROUP BY ALL) ps
    ON ps.budget_id = h.budget_id AND ps.as_of = h.as_of""")

cte("mult", ["calibration"], "SELECT budget_id, as_of AS today, global_multiplier FROM calibration")

cte("forecasts", ["hist_pool", "ck", "mult", "workload_meta"], """
  SELECT f.budget_id, f.as_of, f.workload_type, f.workload_id,
    CASE WHEN m.priority IS NOT NULL THEN m.name
         WHEN f.workload_id <> '' THEN lower(f.workload_type) || '-' || f.workload_id
         ELSE md.compute_type END AS name,
    coalesce(m.priority, 'normal') AS priority, md.compute_type, f.dbu_forecast,
    c.global_multiplier AS multiplier, f.pool_size AS sample_days,
    f.dbu_forecast * c.global_multiplier AS forecast_usd,
    row_number() OVER (PARTITION BY f.budget_id, f.as_of ORDER BY f.dbu_forecast * c.global_multiplier DESC,
                       f.workload_type, f.workload_id) AS forecast_rank
  FROM (SELECT budget_id, as_of, workload_type, workload_id, MAX(pool_size) AS pool_size,
               CAST(CAST(coalesce(SUM(dbu_dollars) FILTER (WHERE in_pool AND hour >= now_hour), 0)
                    AS DECIMAL(28,9)) AS DOUBLE) / MAX(pool_size) AS dbu_forecast
        FROM hist_pool GROUP BY ALL) f
  JOIN (SELECT budget_id, as_of, workload_type, workload_id, compute_type FROM (
          SELECT budget_id, as_of, workload_type, workload_id, compute_type,
                 row_number() OVER (PARTITION BY budget_id, as_of, workload_type, workload_id
                                    ORDER BY COUNT(*) DESC, compute_type) AS rn
          FROM hist_pool GROUP BY budget_id, as_of, workload_type, workload_id, compute_type) WHERE rn = 1) md
    ON md.budget_id = f.budget_id AND md.as_of = f.as_of AND md.workload_type = f.workload_type
   AND md.workload_id = f.workload_id
  JOIN ck k ON k.budget_id = f.budget_id AND k.as_of = f.as_of
  LEFT JOIN mult c ON c.budget_id = f.budget_id AND c.today = k.today
  LEFT JOIN workload_meta m ON m.budget_id = f.budget_id AND m.workload_type = f.workload_type
   AND m.workload_id = f.workload_id
  WHERE f.dbu_forecast > 0""")

cte("pace_inputs", ["ck", "hist_pool", "mult", "weekly_plan", "usage_hourly"], """
  SELECT k.budget_id, k.as_of, k.today,
    CASE WHEN fr.total IS NULL OR fr.total <= 0 THEN least(k.now_hour / 24.0, 1.0)
         ELSE CAST(fr.before AS DOUBLE) / CAST(fr.total AS DOUBLE) END AS intraday_fraction,
    coalesce(CAST(lf.dbu AS DOUBLE) / lf.pool_size * c.global_multiplier, 0.0) AS lag_fill,
    coalesce(ob.observed_week, 0.0) AS observed_week, coalesce(ob.observed_today, 0.0) AS observed_today
  FROM ck k
  LEFT JOIN mult c ON c.budget_id = k.budget_id AND c.today = k.today
  LEFT JOIN (SELECT budget_id, as_of,
               CAST(coalesce(SUM(dbu_dollars) FILTER (WHERE in_pool AND hour < now_hour), 0) AS DECIMAL(28,9)) AS before,
               CAST(SUM(dbu_dollars) FILTER (WHERE in_pool) AS DECIMAL(28,9)) AS total
             FROM hist_pool GROUP BY ALL) fr ON fr.budget_id = k.budget_id AND fr.as_of = k.as_of
  LEFT JOIN (SELECT h.budget_id, h.as_of, CAST(SUM(h.dbu_dollars) AS DECIMAL(28,9)) AS dbu, MAX(h.pool_size) AS pool_size
             FROM hist_pool h
             WHERE h.in_pool AND h.hour IN (hour(h.as_of - INTERVAL 1 HOUR), hour(h.as_of - INTERVAL 2 HOUR),
                                             hour(h.as_of - INTERVAL 3 HOUR))
             GROUP BY ALL) lf ON lf.budget_id = k.budget_id AND lf.as_of = k.as_of
  LEFT JOIN (SELECT t.budget_id, t.as_of,
               SUM(CAST(CAST(t.week_dbu AS DECIMAL(28,9)) AS DOUBLE) * c2.global_multiplier) AS observed_week,
               SUM(CAST(CAST(coalesce(t.today_dbu, 0) AS DECIMAL(28,9)) AS DOUBLE) * c2.global_multiplier) AS observed_today
             FROM (SELECT k2.budget_id, k2.as_of, k2.today, u.compute_type, SUM(u.dbu_dollars) AS week_dbu,
                          SUM(u.dbu_dollars) FILTER (WHERE u.hour_start >= CAST(greatest(k2.today, p.week_start) AS TIMESTAMP)) AS today_dbu
                   FROM ck k2 JOIN weekly_plan p ON p.budget_id = k2.budget_id AND p.as_of = k2.today
                   JOIN usage_hourly u ON u.budget_id = k2.budget_id
                    AND u.hour_start >= CAST(p.week_start AS TIMESTAMP) AND u.hour_start < k2.cutoff
                   GROUP BY ALL) t
             LEFT JOIN mult c2 ON c2.budget_id = t.budget_id AND c2.today = t.today
             GROUP BY ALL) ob ON ob.budget_id = k.budget_id AND ob.as_of = k.as_of""")

cte("status", ["pace_inputs", "weekly_plan", "targets", "forecasts"], """
  SELECT *,
    CASE WHEN spend_week_to_date >= weekly_allowance OR pace_ratio >= 1.3 THEN 'CRITICAL'
         WHEN pace_ratio >= 1.0 THEN 'THROTTLE' WHEN pace_ratio >= 0.9 THEN 'WARN' ELSE 'OK' END AS severity,
    greatest(0.0, spend_today + forecast_remaining_today - day_target) AS required_reduction_today,
    spend_week_to_date + forecast_remaining_today + future_targets * least(pace_ratio, 2.0) AS projected_week_end,
    greatest(0.0, day_target - spend_today - forecast_remaining_today) AS day_headroom
  FROM (SELECT *,
      CASE WHEN expected_week_to_date > 0 THEN spend_week_to_date / expected_week_to_date
           WHEN spend_week_to_date = 0 THEN 1.0 ELSE CAST('inf' AS DOUBLE) END AS pace_ratio
    FROM (SELECT i.budget_id, i.as_of, p.weekly_allowance, i.intraday_fraction, i.lag_fill,
            i.observed_week, i.observed_today,
            i.observed_week + i.lag_fill AS spend_week_to_date,
            i.observed_today + i.lag_fill AS spend_today,
            coalesce(ts.day_target, 0.0) AS day_target, coalesce(ts.future_targets, 0.0) AS future_targets,
            coalesce(ts.through, 0.0) + coalesce(ts.day_target, 0.0) * i.intraday_fraction AS expected_week_to_date,
            coalesce(fc.total, 0.0) AS forecast_remaining_today
          FROM pace_inputs i
          JOIN weekly_plan p ON p.budget_id = i.budget_id AND p.as_of = i.today
          LEFT JOIN (SELECT k.budget_id, k.as_of,
                       SUM(t.target) FILTER (WHERE t.day = k.today) AS day_target,
                       SUM(t.target) FILTER (WHERE t.day < k.today) AS through,
                       SUM(t.target) FILTER (WHERE t.day > k.today) AS future_targets
                     FROM pace_inputs k JOIN targets t ON t.budget_id = k.budget_id AND t.as_of = k.today
                     GROUP BY ALL) ts ON ts.budget_id = i.budget_id AND ts.as_of = i.as_of
          LEFT JOIN (SELECT budget_id, as_of, SUM(forecast_usd) AS total FROM forecasts GROUP BY ALL) fc
            ON fc.budget_id = i.budget_id AND fc.as_of = i.as_of))""")


# ------------------------------------------------------------- decisions --
def _m4(x: str) -> str:
    return f"CAST(floor(({x}) * 10000 + 0.5) / 10000 AS DECIMAL(18,4))"


def _lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _job_templates_sql() -> str:
    """Options of a job with all levers on, stated apart from the operator."""
    from spendpace.config import Levers
    cfg = Levers()
    d, e = _lit(cfg.spot_discount), _lit(cfg.worker_cap_efficiency)
    b, w = _lit(cfg.spot_bid_savings_fraction), _lit(cfg.worker_cost_fraction)
    one = "CAST(1 AS DOUBLE)"
    cap = f"(CASE WHEN t.cap IS NULL THEN CAST(0 AS DOUBLE) ELSE ({one} - t.cap) * {e} END)"
    rebate = f"(CASE WHEN t.bid IS NULL THEN CAST(0 AS DOUBLE) ELSE {b} END)"
    share = f"({w} * ({one} - ({one} - {d}) * ({one} - {cap}) * ({one} - {rebate})))"
    return f"""SELECT e.*, t.seq AS template_seq, {_m4(f"e.forecast_usd * {share}")} AS estimated_savings, true AS spot,
      t.cap AS max_workers_factor, CASE WHEN t.cap IS NOT NULL THEN {cfg.min_workers} END AS min_workers,
      t.bid AS spot_bid_percent
    FROM jc_elig e, (VALUES (0, CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER)),
      (1, 0.75, NULL), (2, 0.5, NULL), (3, 0.5, {cfg.min_spot_bid_percent})) t(seq, cap, bid)"""


_LADDER_LOWER = "[" + ", ".join(f"'{s.lower()}'" for s in __import__("spendpace.config", fromlist=["x"]).SIZE_LADDER) + "]"

cte("elig", ["forecasts", "status"], """
  SELECT f.*, s.severity FROM forecasts f JOIN status s ON s.budget_id = f.budget_id AND s.as_of = f.as_of
  WHERE s.severity IN ('THROTTLE', 'CRITICAL') AND f.forecast_usd > 0 AND f.priority <> 'critical'""")

cte("jc_elig", ["elig", "jobs"], """
  SELECT e.*, j.name AS inv_name FROM elig e JOIN jobs j ON j.budget_id = e.budget_id AND j.job_id = e.workload_id
  WHERE e.workload_type = 'JOB'""")

cte("options0", ["elig", "jobs", "warehouses", "clusters", "jc_elig"], f"""
  SELECT budget_id, as_of, 'idle_cluster_terminate:' || workload_id AS target_key, 'idle_cluster_terminate' AS kind,
         workload_id AS target_id, inv_name AS target_name, priority, 0 AS disruption, 0 AS lever_seq,
         workload_id AS emit_seq, 0 AS template_seq, {_m4('forecast_usd')} AS estimated_savings,
         CAST(NULL AS BOOLEAN) AS spot, CAST(NULL AS DOUBLE) AS max_workers_factor, CAST(NULL AS INTEGER) AS min_workers,
         CAST(NULL AS INTEGER) AS spot_bid_percent, CAST(NULL AS VARCHAR) AS cluster_size,
         CAST(NULL AS INTEGER) AS auto_stop_mins, CAST(NULL AS INTEGER) AS max_num_clusters,
         CAST(NULL AS VARCHAR) AS orig_cluster_size, CAST(NULL AS INTEGER) AS orig_auto_stop_mins,
         CAST(NULL AS INTEGER) AS orig_max_num_clusters
  FROM (SELECT e.*, c.name AS inv_name FROM elig e JOIN clusters c ON c.budget_id = e.budget_id AND c.cluster_id = e.workload_id
        WHERE e.workload_type = 'CLUSTER' AND c.state = 'RUNNING' AND c.last_activity_time IS NOT NULL
          AND epoch_ms(e.as_of) - c.last_activity_time >= 30 * 60 * 1000)
  UNION ALL
  SELECT budget_id, as_of, 'job_cluster_throttle:' || workload_id, 'job_cluster_throttle', workload_id, inv_name,
         priority, 1, 1, workload_id, template_seq, estimated_savings, spot, max_workers_factor, min_workers,
         spot_bid_percent, NULL, NULL, NULL, NULL, NULL, NULL
  FROM ({_job_templates_sql()})
  UNION ALL
  SELECT budget_id, as_of, 'warehouse_throttle:' || workload_id, 'warehouse_throttle', workload_id, inv_name,
         priority, 2, 2, workload_id, k, {_m4('savings')}, NULL, NULL, NULL, NULL,
         CASE WHEN k > 0 THEN {_LADDER}[idx - k + 1] END,
         CASE WHEN orig_auto_stop_mins > 5 THEN greatest(5, least(orig_auto_stop_mins, 10)) END,
         CASE WHEN k >= 2 AND orig_max_num_clusters > 1 THEN 1 END,
         orig_cluster_size, orig_auto_stop_mins, orig_max_num_clusters
  FROM (SELECT *, CASE WHEN orig_auto_stop_mins > 5 THEN down + forecast_usd * rf * {_lit(0.1)} ELSE down END AS savings
        FROM (SELECT *, CASE WHEN k > 0 THEN forecast_usd * (CAST(1.0 AS DOUBLE) - rf) ELSE CAST(0.0 AS DOUBLE) END AS down
              FROM (SELECT *, CASE WHEN k > 0 THEN pow(CAST(0.5 AS DOUBLE), k) ELSE CAST(1.0 AS DOUBLE) END AS rf
                    FROM (SELECT e.*, w.name AS inv_name, w.cluster_size AS orig_cluster_size,
                                 w.auto_stop_mins AS orig_auto_stop_mins, w.max_num_clusters AS orig_max_num_clusters,
                                 greatest(coalesce(list_position({_LADDER_LOWER}, lower(trim(w.cluster_size))), 0) - 1, 0) AS idx
                          FROM elig e JOIN warehouses w ON w.budget_id = e.budget_id AND w.warehouse_id = e.workload_id
                          WHERE e.workload_type = 'WAREHOUSE') x,
                    LATERAL (SELECT CAST(unnest(range(0, x.idx + 1)) AS INTEGER) AS k))))
  WHERE savings > 0
  UNION ALL
  SELECT e.budget_id, e.as_of, 'job_schedule_pause:' || e.workload_id, 'job_schedule_pause', e.workload_id, j.name,
         e.priority, 3, 3, e.workload_id, 0, {_m4('e.forecast_usd')}, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL
  FROM elig e JOIN jobs j ON j.budget_id = e.budget_id AND j.job_id = e.workload_id
  WHERE e.workload_type = 'JOB' AND e.severity = 'CRITICAL' AND j.has_schedule AND NOT j.schedule_paused""")

cte("options", ["options0"], """
  SELECT *, row_number() OVER (PARTITION BY budget_id, as_of, target_key
                               ORDER BY estimated_savings, template_seq) AS option_seq
  FROM options0""")

cte("gap", ["status"], f"""
  SELECT budget_id, as_of, severity,
    CASE WHEN severity IN ('THROTTLE', 'CRITICAL')
         THEN {_m4('greatest(CAST(0.0 AS DOUBLE), required_reduction_today - CAST(0.0 AS DOUBLE))')}
         ELSE CAST(0 AS DECIMAL(18,4)) END AS gap
  FROM status""")

cte("walk", ["options", "gap"], """
  SELECT g.*, gp.gap,
    row_number() OVER (PARTITION BY g.budget_id, g.as_of ORDER BY
        CASE g.priority WHEN 'low' THEN 0 WHEN 'normal' THEN 1 WHEN 'critical' THEN 2 END,
        g.disruption, g.max_savings DESC, g.lever_seq, g.emit_seq) AS pick_order,
    CAST(gp.gap - coalesce(SUM(greatest(g.max_savings, 0)) OVER (PARTITION BY g.budget_id, g.as_of ORDER BY
        CASE g.priority WHEN 'low' THEN 0 WHEN 'normal' THEN 1 WHEN 'critical' THEN 2 END,
        g.disruption, g.max_savings DESC, g.lever_seq, g.emit_seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,4)) AS left_before
  FROM (SELECT budget_id, as_of, target_key, priority, disruption, lever_seq, emit_seq,
               arg_max(estimated_savings, option_seq) AS max_savings, MAX(option_seq) AS last_seq
        FROM options GROUP BY budget_id, as_of, target_key, priority, disruption, lever_seq, emit_seq) g
  JOIN gap gp ON gp.budget_id = g.budget_id AND gp.as_of = g.as_of""")

cte("chosen", ["walk", "options"], """
  SELECT o.*, w.pick_order, w.left_before, w.gap FROM options o
  JOIN (SELECT w.*, coalesce(p.first_ok, w.last_seq) AS pick_seq FROM walk w
        LEFT JOIN (SELECT o2.budget_id, o2.as_of, o2.target_key, MIN(o2.option_seq) AS first_ok
                   FROM options o2 JOIN walk w2 ON w2.budget_id = o2.budget_id AND w2.as_of = o2.as_of
                    AND w2.target_key = o2.target_key
                   WHERE o2.estimated_savings >= w2.left_before GROUP BY ALL) p
          ON p.budget_id = w.budget_id AND p.as_of = w.as_of AND p.target_key = w.target_key
        WHERE w.gap > 0 AND w.left_before > 0 AND w.max_savings > 0) w
    ON w.budget_id = o.budget_id AND w.as_of = o.as_of AND w.target_key = o.target_key
   AND o.option_seq = w.pick_seq""")

cte("alloc_summary", ["gap", "chosen"], """
  SELECT g.budget_id, g.as_of, g.severity, g.gap,
    CAST(CASE WHEN g.gap > 0 THEN coalesce(c.total, 0) ELSE 0 END AS DECIMAL(18,4)) AS total_estimated_savings,
    coalesce(c.actions, 0) AS actions,
    CAST(CASE WHEN g.gap > 0 THEN coalesce(c.total, 0) ELSE 0 END AS DECIMAL(18,4)) >= g.gap AS gap_closed,
    CAST(g.gap - CAST(CASE WHEN g.gap > 0 THEN coalesce(c.total, 0) ELSE 0 END AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS gap_left
  FROM gap g LEFT JOIN (SELECT budget_id, as_of, SUM(estimated_savings) AS total, COUNT(*) AS actions
                        FROM chosen GROUP BY ALL) c ON c.budget_id = g.budget_id AND c.as_of = g.as_of""")

cte("coverage", ["forecasts", "status", "options", "jobs", "warehouses", "clusters"], """
  SELECT f.budget_id, f.as_of, f.workload_type, f.workload_id, f.name, f.forecast_usd,
         'candidate' AS reason, og.kind, og.option_count, og.option_savings, CAST(NULL AS VARCHAR) AS detail
  FROM forecasts f JOIN status s ON s.budget_id = f.budget_id AND s.as_of = f.as_of
   AND s.severity IN ('THROTTLE', 'CRITICAL')
  JOIN (SELECT budget_id, as_of, kind, target_id, COUNT(*) AS option_count,
               string_agg(CAST(estimated_savings AS VARCHAR), ', ' ORDER BY option_seq) AS option_savings
        FROM options GROUP BY budget_id, as_of, kind, target_id) og
    ON og.budget_id = f.budget_id AND og.as_of = f.as_of AND og.target_id = f.workload_id
   AND ((f.workload_type = 'JOB' AND og.kind IN ('job_cluster_throttle', 'job_schedule_pause'))
     OR (f.workload_type = 'WAREHOUSE' AND og.kind = 'warehouse_throttle')
     OR (f.workload_type = 'CLUSTER' AND og.kind = 'idle_cluster_terminate'))
  UNION ALL
  SELECT r.budget_id, r.as_of, r.workload_type, r.workload_id, r.name, r.forecast_usd,
    CASE WHEN r.workload_type = 'OTHER' THEN 'unaddressable'
         WHEN r.priority = 'critical' THEN 'exempt'
         WHEN r.workload_type = 'JOB' AND NOT r.found THEN 'job_not_found'
         WHEN r.workload_type = 'JOB' THEN 'no_options'
         WHEN r.workload_type = 'WAREHOUSE' AND NOT r.found THEN 'warehouse_not_found'
         WHEN r.workload_type = 'CLUSTER' AND NOT r.found THEN 'cluster_not_found'
         ELSE 'no_options_produced' END,
    NULL, NULL, NULL,
    CASE WHEN r.workload_type = 'JOB' AND r.found AND r.priority <> 'critical' THEN concat_ws('; ',
         CASE WHEN r.severity <> 'CRITICAL' THEN 'pause_below_critical' END,
         CASE WHEN NOT coalesce(r.scheduled, false) THEN 'no_schedule' END,
         'cluster_unchanged') END
  FROM (SELECT f.*, s.severity, inv.scheduled, inv.budget_id IS NOT NULL AS found
        FROM forecasts f JOIN status s ON s.budget_id = f.budget_id AND s.as_of = f.as_of
         AND s.severity IN ('THROTTLE', 'CRITICAL')
        LEFT JOIN (SELECT budget_id, 'JOB' AS wt, job_id AS wid, has_schedule AS scheduled FROM jobs
                   UNION ALL SELECT budget_id, 'WAREHOUSE', warehouse_id, false FROM warehouses
                   UNION ALL SELECT budget_id, 'CLUSTER', cluster_id, false FROM clusters) inv
          ON inv.budget_id = f.budget_id AND inv.wt = f.workload_type AND inv.wid = f.workload_id
        WHERE NOT EXISTS (SELECT 1 FROM options o WHERE o.budget_id = f.budget_id AND o.as_of = f.as_of
                          AND o.target_id = f.workload_id
                          AND ((f.workload_type = 'JOB' AND o.kind IN ('job_cluster_throttle', 'job_schedule_pause'))
                            OR (f.workload_type = 'WAREHOUSE' AND o.kind = 'warehouse_throttle')
                            OR (f.workload_type = 'CLUSTER' AND o.kind = 'idle_cluster_terminate')))) r""")


# ------------------------------------------------- two-step (stateful) chain --
import re as _re  # noqa: E402


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def _depends_on(n: str, root: str) -> bool:
    return n == root or any(_depends_on(d, root) for d in CTES[n][0])


def step_ctes(targets: list[str], suffix: str, instants_sql: str,
              extra: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(name, body) of ``targets`` and their dependencies where everything
    downstream of ``instants`` is renamed with ``suffix`` and ``instants``
    itself is replaced by ``instants_sql``. ``extra`` maps a renamed CTE to
    a wrapper body over ``<name>_raw<suffix>``."""
    extra = extra or {}
    out = []
    for n in _closure(targets):
        deps, body = CTES[n]
        if not _depends_on(n, "instants"):
            continue
        if n == "instants":
            body = instants_sql
        for d in deps:
            if _depends_on(d, "instants"):
                new = d + suffix if d not in extra else d + "_raw" + suffix
                new = d + suffix
                body = _re.sub(rf"(FROM|JOIN)(\s+){d}\b", rf"\1\2{new}", body)
        if n in extra:
            out.append((n + "_raw" + suffix, body))
            out.append((n + suffix, extra[n].format(raw=n + "_raw" + suffix)))
        else:
            out.append((n + suffix, body))
    return out


def chain_sql(steps: list[list[tuple[str, str]]], shared: list[str], select: str) -> str:
    names = _closure(shared)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in names if not _depends_on(n, "instants")]
    for step in steps:
        parts += [f"{n} AS ({b}\n)" for n, b in step]
    return "WITH " + ",\n".join(parts) + "\n" + select


RELEASE_INSTANTS_SQL = (
    "SELECT b.*, t AS as_of FROM budgets b CROSS JOIN (SELECT unnest(range("
    f"TIMESTAMP '{A.RELEASE_FIRST}', TIMESTAMP '{A.RELEASE_LAST}' + INTERVAL {A.RELEASE_STEP_HOURS} HOUR, "
    f"INTERVAL {A.RELEASE_STEP_HOURS} HOUR)) AS t)")
FIRST_INSTANT_SQL = f"SELECT b.*, TIMESTAMP '{A.CHECK_INSTANTS[0]}' AS as_of FROM budgets b"


def release_plan_sql(select: str) -> str:
    step1 = step_ctes(["chosen"], "_1", FIRST_INSTANT_SQL)
    queue = ("queue_1", """
  SELECT budget_id, target_id AS job_id, target_name AS name, priority, estimated_savings AS est_run_cost,
         as_of AS paused_at, CAST(pick_order AS BIGINT) AS seq
  FROM chosen_1 WHERE kind = 'job_schedule_pause'""")
    step2 = step_ctes(["status"], "_2", RELEASE_INSTANTS_SQL, extra={"forecasts": """
  SELECT * FROM {raw} f WHERE NOT (f.workload_type = 'JOB' AND EXISTS (
    SELECT 1 FROM queue_1 q WHERE q.budget_id = f.budget_id AND q.job_id = f.workload_id))"""})
    release = ("release_2", """
  SELECT *, NOT max(blocked) OVER (PARTITION BY budget_id, as_of ORDER BY paused_at, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released
  FROM (SELECT q.*, s.as_of, s.day_headroom,
          row_number() OVER (PARTITION BY q.budget_id, s.as_of ORDER BY q.paused_at, q.seq) AS queue_pos,
          SUM(q.est_run_cost) OVER (PARTITION BY q.budget_id, s.as_of ORDER BY q.paused_at, q.seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_cost,
          CAST(SUM(q.est_run_cost) OVER (PARTITION BY q.budget_id, s.as_of ORDER BY q.paused_at, q.seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) > s.day_headroom AS blocked
        FROM queue_1 q JOIN status_2 s ON s.budget_id = q.budget_id
        WHERE s.severity IN ('OK', 'WARN'))""")
    return chain_sql([step1 + [queue], step2 + [release]], ["chosen", "status"], select)


def replay_sql(select: str) -> str:
    """The freezes' queue through the 6-hourly checks, check by check: the
    recursion keeps the jobs that are gone."""
    waves = " UNION ALL ".join(f"SELECT b.*, TIMESTAMP '{t}' AS as_of FROM budgets b" for t, _ in A.FREEZES)
    step = step_ctes(["status"], "_r", f"{RELEASE_INSTANTS_SQL} UNION ALL {waves}")
    frozen = " OR ".join(f"(f.as_of = TIMESTAMP '{t}' AND TRY_CAST(f.workload_id AS BIGINT) % 4 = {r})" for t, r in A.FREEZES)
    entries = ("entries", f"""
  SELECT f.budget_id, f.workload_id AS job_id, j.name, f.priority, {_m4('f.forecast_usd')} AS est_run_cost, f.as_of AS paused_at,
         CAST(f.forecast_rank AS BIGINT) AS seq
  FROM forecasts_r f JOIN jobs j ON j.budget_id = f.budget_id AND j.job_id = f.workload_id
  WHERE f.workload_type = 'JOB' AND j.has_schedule AND NOT j.schedule_paused AND f.priority <> 'critical' AND f.forecast_usd > 0
    AND ({frozen})""")
    checks = ("checks", f"""
  SELECT s.budget_id, s.as_of, s.severity IN ('OK', 'WARN') AS is_open, {_m4('s.day_target - s.spend_today')} - coalesce(t.total, 0) AS room,
         row_number() OVER (PARTITION BY s.budget_id ORDER BY s.as_of) AS n
  FROM status_r s JOIN ({RELEASE_INSTANTS_SQL}) r ON r.budget_id = s.budget_id AND r.as_of = s.as_of
  LEFT JOIN (SELECT budget_id, as_of, SUM({_m4('forecast_usd')}) AS total FROM forecasts_r GROUP BY ALL) t
    ON t.budget_id = s.budget_id AND t.as_of = s.as_of""")

    def waiting(run: str) -> str:
        return f"""
    SELECT *, coalesce(bool_and(running_cost <= day_headroom) OVER (PARTITION BY budget_id, as_of ORDER BY queue_pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AND is_open, false) AS released
    FROM (SELECT c.budget_id, c.as_of, c.n, c.is_open, r.gone, e.job_id, e.paused_at, e.seq, e.est_run_cost,
            row_number() OVER (PARTITION BY c.budget_id, c.as_of ORDER BY e.paused_at, e.seq) AS queue_pos,
            SUM(e.est_run_cost) OVER (PARTITION BY c.budget_id, c.as_of ORDER BY e.paused_at, e.seq
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_cost,
            greatest(0, c.room + coalesce(SUM({_m4('f.forecast_usd')}) OVER (PARTITION BY c.budget_id, c.as_of), 0)) AS day_headroom
          FROM {run} r JOIN checks c ON c.budget_id = r.budget_id AND c.n = r.n + 1
          LEFT JOIN entries e ON e.budget_id = c.budget_id AND e.paused_at <= c.as_of AND NOT list_contains(r.gone, e.job_id)
          LEFT JOIN forecasts_r f ON f.budget_id = c.budget_id AND f.as_of = c.as_of AND f.workload_type = 'JOB' AND f.workload_id = e.job_id)"""

    run = ("carried", f"""
  SELECT DISTINCT budget_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS gone FROM checks
  UNION ALL
  SELECT budget_id, n, list_concat(any_value(gone), coalesce(list(job_id) FILTER (released AND job_id IS NOT NULL), CAST([] AS VARCHAR[])))
  FROM ({waiting('carried')}) GROUP BY budget_id, n""")
    rows = ("replay_rows", f"SELECT * FROM ({waiting('carried')}) WHERE is_open AND job_id IS NOT NULL")
    left = ("replay_left", """
  SELECT e.* FROM entries e WHERE NOT EXISTS (
    SELECT 1 FROM replay_rows r WHERE r.released AND r.budget_id = e.budget_id AND r.job_id = e.job_id)""")
    return chain_sql([step + [entries, checks, run, rows, left]], ["status", "jobs"], select).replace("WITH ", "WITH RECURSIVE ", 1)


TRANSITION_SQL = tuple(f"SELECT b.*, TIMESTAMP '{t}' AS as_of FROM budgets b" for t in A.TRANSITION_INSTANTS)
_REVERSIBLE = ", ".join(f"'{k}'" for k, r in C.REVERSIBLE.items() if r)


def transition_sql(which: str):
    """SQL twin of the state after two live checks: the first check's
    reversible actions become active and its pauses enter the queue; the
    second check (queued jobs' forecasts removed, active targets excluded,
    active savings credited against the gap) reverts at OK, releases by
    strict FIFO and applies its own choices. ``which``: next_active_2,
    next_queue_2, check_report_2 or status_log_2."""
    def build(select: str) -> str:
        step1 = step_ctes(["chosen"], "_1", TRANSITION_SQL[0])
        queue = ("queue_1", """
  SELECT budget_id, target_id AS job_id, target_name AS name, priority,
         CAST(estimated_savings AS DECIMAL(18,4)) AS est_run_cost, as_of AS paused_at,
         CAST(pick_order AS BIGINT) AS seq
  FROM chosen_1 WHERE kind = 'job_schedule_pause'""")
        active = ("active_1", f"""
  SELECT budget_id, kind, target_id, target_name, priority,
         CAST(estimated_savings AS DECIMAL(18,4)) AS estimated_savings, as_of AS applied_at,
         CAST(pick_order AS BIGINT) AS seq
  FROM chosen_1 WHERE kind IN ({_REVERSIBLE})""")
        gap = f"""
  SELECT s.budget_id, s.as_of, s.severity,
    CASE WHEN s.severity IN ('THROTTLE', 'CRITICAL')
         THEN {_m4('greatest(CAST(0.0 AS DOUBLE), s.required_reduction_today - CAST(CAST(coalesce(c.credit, 0) AS DECIMAL(18,4)) AS DOUBLE))')}
         ELSE CAST(0 AS DECIMAL(18,4)) END AS gap
  FROM status_2 s LEFT JOIN (SELECT budget_id, SUM(estimated_savings) AS credit FROM active_1 GROUP BY budget_id) c
    ON c.budget_id = s.budget_id"""
        step2 = step_ctes(["chosen", "status"], "_2", TRANSITION_SQL[1], extra={
            "forecasts": """
  SELECT * FROM {raw} f WHERE NOT (f.workload_type = 'JOB' AND EXISTS (
    SELECT 1 FROM queue_1 q WHERE q.budget_id = f.budget_id AND q.job_id = f.workload_id))""",
            "options": """
  SELECT * FROM {raw} o WHERE NOT EXISTS (
    SELECT 1 FROM active_1 a WHERE a.budget_id = o.budget_id AND a.kind || ':' || a.target_id = o.target_key)""",
            "gap": gap.replace("{", "{{").replace("}", "}}")})
        release = ("release_2", """
  SELECT *, NOT max(blocked) OVER (PARTITION BY budget_id, as_of ORDER BY paused_at, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released
  FROM (SELECT q.*, s.as_of,
          CAST(SUM(q.est_run_cost) OVER (PARTITION BY q.budget_id, s.as_of ORDER BY q.paused_at, q.seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) > s.day_headroom AS blocked
        FROM queue_1 q JOIN status_2 s ON s.budget_id = q.budget_id
        WHERE s.severity IN ('OK', 'WARN'))""")
        reverted = ("reverted_2", f"""
  SELECT s.budget_id, s.as_of, a.kind, a.target_id FROM status_2 s JOIN active_1 a ON a.budget_id = s.budget_id
  WHERE s.severity = 'OK' AND a.kind IN ({_REVERSIBLE}) AND a.applied_at IS NOT NULL
    AND a.kind <> 'job_schedule_pause'""")
        nxt_active = ("next_active_2", f"""
  SELECT budget_id, kind, target_id, target_name, priority, estimated_savings, applied_at, seq FROM active_1 a
  WHERE NOT EXISTS (SELECT 1 FROM reverted_2 r
                    WHERE r.budget_id = a.budget_id AND r.kind = a.kind AND r.target_id = a.target_id)
    AND NOT EXISTS (SELECT 1 FROM release_2 r WHERE r.released AND r.budget_id = a.budget_id
                    AND a.kind = 'job_schedule_pause' AND r.job_id = a.target_id)
  UNION ALL
  SELECT budget_id, kind, target_id, target_name, priority, CAST(estimated_savings AS DECIMAL(18,4)),
         as_of, CAST(pick_order AS BIGINT)
  FROM chosen_2 WHERE kind IN ({_REVERSIBLE})""")
        nxt_queue = ("next_queue_2", """
  SELECT * FROM (
    SELECT budget_id, job_id, name, priority, est_run_cost, paused_at, seq FROM queue_1
    UNION ALL
    SELECT budget_id, target_id, target_name, priority, CAST(estimated_savings AS DECIMAL(18,4)), as_of,
           CAST(pick_order AS BIGINT)
    FROM chosen_2 WHERE kind = 'job_schedule_pause') q
  WHERE NOT EXISTS (SELECT 1 FROM release_2 r WHERE r.released AND r.budget_id = q.budget_id
                    AND r.job_id = q.job_id)""")
        report = ("check_report_2", """
  SELECT s.budget_id, s.as_of, s.severity, g.gap, coalesce(c.n, 0) AS actions,
         CASE WHEN g.gap > 0 THEN coalesce(c.total, 0) ELSE 0 END AS planned_savings,
         greatest(g.gap - CASE WHEN g.gap > 0 THEN coalesce(c.total, 0) ELSE 0 END, 0) AS shortfall,
         (SELECT count(*) FROM reverted_2 r WHERE r.budget_id = s.budget_id) AS reverted,
         coalesce((SELECT string_agg(r.job_id, ',' ORDER BY r.paused_at, r.seq) FROM release_2 r
                   WHERE r.released AND r.budget_id = s.budget_id), '') AS released_jobs,
         coalesce((SELECT string_agg(q.job_id, ',' ORDER BY q.paused_at, q.seq) FROM next_queue_2 q
                   WHERE q.budget_id = s.budget_id), '') AS queue_jobs,
         coalesce((SELECT sum(q.est_run_cost) FROM next_queue_2 q WHERE q.budget_id = s.budget_id), 0) AS queue_cost
  FROM status_2 s JOIN gap_2 g ON g.budget_id = s.budget_id AND g.as_of = s.as_of
  LEFT JOIN (SELECT budget_id, count(*) AS n, sum(estimated_savings) AS total FROM chosen_2 GROUP BY ALL) c ON c.budget_id = s.budget_id""")
        # what is in force, from the state tables and not from any log
        status_log = ("status_log_2", f"""
  SELECT s.budget_id, s.as_of AS checked_at, s.severity, s.pace_ratio, p.weekly_allowance, m.global_multiplier, r.shortfall,
         (SELECT count(*) FROM active_1 a WHERE a.budget_id = s.budget_id)
           + (SELECT count(*) FROM chosen_2 c WHERE c.budget_id = s.budget_id AND c.kind IN ({_REVERSIBLE})) AS applies,
         r.reverted AS reverts, (SELECT count(*) FROM release_2 x WHERE x.released AND x.budget_id = s.budget_id) AS releases,
         (SELECT count(*) FROM next_active_2 a WHERE a.budget_id = s.budget_id) AS open_actions,
         coalesce((SELECT sum(a.estimated_savings) FROM next_active_2 a WHERE a.budget_id = s.budget_id), 0) AS open_savings,
         (SELECT count(*) FROM next_queue_2 q WHERE q.budget_id = s.budget_id) AS queued_jobs, r.queue_cost AS queued_cost
  FROM status_2 s JOIN check_report_2 r ON r.budget_id = s.budget_id
  JOIN weekly_plan_2 p ON p.budget_id = s.budget_id AND p.as_of = CAST(s.as_of AS DATE)
  JOIN calibration_2 m ON m.budget_id = s.budget_id AND m.as_of = CAST(s.as_of AS DATE)""")
        tail = [release, reverted, nxt_active, nxt_queue, report, status_log]
        return chain_sql([step1 + [queue, active], step2 + tail], ["chosen", "status"], select)
    return build


# ------------------------------------------------------------ spec rewrite --
def _spec_side(origin: str, key: str, size: str, cond: str, absolute: str = "CAST(NULL AS INTEGER)") -> str:
    n0 = f"CASE WHEN s.c_nationkey % 3 <> 0 THEN CAST({size} AS INTEGER) END"
    mx0 = f"CASE WHEN s.c_nationkey % 3 = 0 THEN CAST({size} + 1 AS INTEGER) END"
    mn0 = "CASE WHEN s.c_nationkey % 3 = 0 THEN 2 END"
    cap_fixed = f"coalesce({absolute}, greatest(coalesce(c.min_workers, 1), CAST(floor({n0} * c.max_workers_factor) AS INTEGER)))"
    cap_auto = f"coalesce({absolute}, greatest(coalesce(c.min_workers, 1), CAST(floor(coalesce({mx0}, 1) * c.max_workers_factor) AS INTEGER)))"
    capped = f"coalesce({absolute}, c.max_workers_factor) IS NOT NULL"
    new_max = f"least(coalesce({mx0}, {cap_auto}), {cap_auto})"
    return f"""
  SELECT c.budget_id, c.as_of, c.target_id AS job_id, '{origin}' AS origin, '{key}' AS key,
    {n0} AS orig_num_workers,
    CASE WHEN s.c_nationkey % 3 <> 0 AND {capped}
         THEN least({n0}, {cap_fixed}) ELSE {n0} END AS num_workers,
    {mn0} AS orig_min_workers,
    CASE WHEN s.c_nationkey % 3 = 0 AND {capped}
         THEN least(coalesce({mn0}, 1), {new_max}) ELSE {mn0} END AS min_workers,
    {mx0} AS orig_max_workers,
    CASE WHEN s.c_nationkey % 3 = 0 AND {capped} THEN {new_max} ELSE {mx0} END AS max_workers,
    'ON_DEMAND' AS orig_availability,
    CASE WHEN coalesce(c.spot, false) OR c.spot_bid_percent IS NOT NULL THEN 'SPOT' ELSE 'ON_DEMAND' END AS availability,
    CASE WHEN coalesce(c.spot, false) THEN coalesce(CASE WHEN s.c_nationkey % 2 = 0 THEN 2 END, 1)
         ELSE CASE WHEN s.c_nationkey % 2 = 0 THEN 2 END END AS first_on_demand,
    c.spot_bid_percent AS spot_bid_price_percent
  FROM chosen c JOIN inv_customers s ON c.budget_id = s.budget_id AND c.target_id = CAST(s.c_custkey AS VARCHAR)
  WHERE c.kind = 'job_cluster_throttle' AND s.c_custkey % 4 IN (0, 3) AND {cond}"""


cte("spec_changes", ["chosen", "inv_customers"],
    _spec_side("job_cluster", "main", "s.c_custkey % 10 + 1", "true") + "\n  UNION ALL" +
    _spec_side("task", "etl", "s.c_custkey % 5 + 1", "s.c_custkey % 8 = 0"))


_CAP = "CASE WHEN CAST(c.target_id AS BIGINT) % 8 <> 4 THEN 2 + CAST(c.target_id AS BIGINT) % 3 END"
cte("spec_changes_absolute", ["chosen", "inv_customers"],
    _spec_side("job_cluster", "main", "s.c_custkey % 10 + 1", "true", _CAP) + "\n  UNION ALL" +
    _spec_side("task", "etl", "s.c_custkey % 5 + 1", "s.c_custkey % 8 = 0", _CAP))

cte("plan_in_force", ["weekly_plan", "budgets"], f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT c.budget_id, c.as_of, p.as_of AS plan_as_of, p.fy_label, p.week_start, p.week_end, p.weekly_allowance,
           row_number() OVER (PARTITION BY c.budget_id, c.as_of ORDER BY p.as_of DESC) AS rn
    FROM ({RELEASE_INSTANTS_SQL}) c
    JOIN weekly_plan p ON p.budget_id = c.budget_id AND p.as_of <= CAST(c.as_of AS DATE)
     AND p.week_start <= CAST(c.as_of AS DATE) AND CAST(c.as_of AS DATE) < p.week_end)
  WHERE rn = 1""")

cte("audit", ["weekly_plan", "calibration", "status", "alloc_summary"], """
  SELECT p.budget_id, CAST(p.as_of AS TIMESTAMP) AS event_at, 'plan' AS event, p.weekly_allowance,
         c.global_multiplier, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS DOUBLE) AS pace_ratio,
         CAST(NULL AS BIGINT) AS actions
  FROM weekly_plan p LEFT JOIN calibration c ON c.budget_id = p.budget_id AND c.as_of = p.as_of
  UNION ALL
  SELECT s.budget_id, s.as_of, 'check', NULL, NULL, s.severity, s.pace_ratio, a.actions
  FROM status s LEFT JOIN alloc_summary a ON a.budget_id = s.budget_id AND a.as_of = s.as_of""")


cte("ledger_blended", ["flagged", "pk", "usage_daily"], """
  SELECT coalesce(c.budget_id, u.budget_id) AS budget_id, coalesce(c.as_of, u.as_of) AS as_of,
         coalesce(c.usage_date, u.usage_date) AS usage_date,
         CAST(coalesce(c.cost, 0) + coalesce(u.dbu_dollars, 0) AS DECIMAL(18,4)) AS cost
  FROM (SELECT k.budget_id, k.as_of, d.usage_date, d.cost
        FROM (SELECT DISTINCT budget_id, as_of FROM pk) k
        JOIN (SELECT budget_id, usage_date, CAST(SUM(cost) AS DECIMAL(18,4)) AS cost FROM flagged
              WHERE attributed AND NOT is_marketplace AND usage_date IS NOT NULL GROUP BY ALL) d
          ON d.budget_id = k.budget_id) c
  FULL JOIN (SELECT k.budget_id, k.as_of, u.usage_date, u.dbu_dollars
             FROM (SELECT DISTINCT budget_id, as_of, fy_start FROM pk) k
             JOIN usage_daily u ON u.budget_id = k.budget_id AND u.usage_date >= k.fy_start
              AND u.usage_date <= k.as_of) u
    ON c.budget_id = u.budget_id AND c.as_of = u.as_of AND c.usage_date = u.usage_date""")

cte("overrides", [], """
  SELECT CAST(n_regionkey AS INTEGER) AS budget_id, compute_type,
         arg_max(CAST(1.0 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) / 20.0, n_nationkey) AS multiplier
  FROM (SELECT *, CASE n_nationkey % 3 WHEN 0 THEN 'JOBS' WHEN 1 THEN 'SQL' ELSE 'ALL_PURPOSE' END AS compute_type
        FROM nation WHERE n_nationkey % 2 = 0)
  GROUP BY ALL""")

# the forecasts' dollars before the multiplier are those of the plain check
cte("forecasts_overridden", ["forecasts", "overrides"], """
  SELECT f.* EXCLUDE (multiplier, forecast_usd, forecast_rank), coalesce(o.multiplier, f.multiplier) AS multiplier,
         f.dbu_forecast * coalesce(o.multiplier, f.multiplier) AS forecast_usd,
         row_number() OVER (PARTITION BY f.budget_id, f.as_of
                            ORDER BY f.dbu_forecast * coalesce(o.multiplier, f.multiplier) DESC,
                                     f.workload_type, f.workload_id) AS forecast_rank
  FROM forecasts f LEFT JOIN overrides o ON o.budget_id = f.budget_id AND o.compute_type = f.compute_type""")

cte("observed_overridden", ["ck", "weekly_plan", "mult", "usage_hourly", "overrides"], """
  SELECT k.budget_id, k.as_of, coalesce(SUM(CAST(CAST(t.week_dbu AS DECIMAL(28,9)) AS DOUBLE) * t.factor), 0.0) AS observed_week,
         coalesce(SUM(CAST(CAST(coalesce(t.today_dbu, 0) AS DECIMAL(28,9)) AS DOUBLE) * t.factor), 0.0) AS observed_today
  FROM ck k LEFT JOIN (
    SELECT x.budget_id, x.as_of, u.compute_type, coalesce(o.multiplier, m.global_multiplier) AS factor,
           SUM(u.dbu_dollars) AS week_dbu,
           SUM(u.dbu_dollars) FILTER (WHERE u.hour_start >= CAST(greatest(x.today, p.week_start) AS TIMESTAMP)) AS today_dbu
    FROM ck x JOIN weekly_plan p ON p.budget_id = x.budget_id AND p.as_of = x.today
    JOIN usage_hourly u ON u.budget_id = x.budget_id AND u.hour_start >= CAST(p.week_start AS TIMESTAMP) AND u.hour_start < x.cutoff
    LEFT JOIN mult m ON m.budget_id = x.budget_id AND m.today = x.today
    LEFT JOIN overrides o ON o.budget_id = x.budget_id AND o.compute_type = u.compute_type
    GROUP BY ALL) t ON t.budget_id = k.budget_id AND t.as_of = k.as_of
  GROUP BY k.budget_id, k.as_of""")

cte("plan_blended", ["pk", "ledger_blended"], """
  SELECT p.*, CASE WHEN remaining_fy_days <= 0 THEN CAST(0 AS DOUBLE)
                   ELSE remaining_budget * (week_end - week_start) / remaining_fy_days END AS weekly_allowance
  FROM (
    SELECT k.*, CAST(k.remaining_fy_days AS DOUBLE) / 7.0 AS remaining_weeks,
           CAST(coalesce(f.spent, 0) AS DECIMAL(18,4)) AS fy_to_date_spend,
           greatest(CAST(k.annual_budget AS DOUBLE) - CAST(CAST(coalesce(f.spent, 0) AS DECIMAL(18,4)) AS DOUBLE),
                    CAST(0 AS DOUBLE)) AS remaining_budget
    FROM pk k LEFT JOIN (
      SELECT q.budget_id, q.as_of, SUM(l.cost) AS spent
      FROM pk q JOIN ledger_blended l ON l.budget_id = q.budget_id AND l.as_of = q.as_of
       AND l.usage_date >= q.fy_start AND l.usage_date < q.week_start
      GROUP BY q.budget_id, q.as_of) f
    ON f.budget_id = k.budget_id AND f.as_of = k.as_of) p""")

cte("shape_blended", ["pk", "ledger_blended"], f"""
  SELECT budget_id, as_of, weekday, AVG(CAST(cost AS DOUBLE) / CAST(total AS DOUBLE)) AS share,
         MAX(weeks) AS weeks
  FROM (SELECT *, COUNT(*) FILTER (usage_date = wk) OVER (PARTITION BY budget_id, as_of) AS weeks
        FROM (SELECT w.*, COUNT(*) OVER (PARTITION BY budget_id, as_of, wk) AS days,
                     SUM(cost) OVER (PARTITION BY budget_id, as_of, wk) AS total
              FROM (SELECT k.budget_id, k.as_of, l.usage_date, l.cost, {_wd('l.usage_date')} AS weekday,
                           CAST(l.usage_date - CAST({_pmod7(_wd('l.usage_date') + ' - k.week_start_weekday')} AS INTEGER) AS DATE) AS wk
                    FROM pk k JOIN ledger_blended l ON l.budget_id = k.budget_id AND l.as_of = k.as_of
                     AND l.usage_date >= k.natural_week_start - 56 AND l.usage_date < k.natural_week_start) w)
        WHERE days = 7 AND total > 0)
  GROUP BY budget_id, as_of, weekday""")

cte("targets_blended", ["plan_blended", "shape_blended"], f"""
  SELECT budget_id, as_of, day, weekday,
    CASE WHEN SUM(weight) OVER one <= 0 THEN weekly_allowance * 1.0 / CAST(COUNT(*) OVER one AS DOUBLE)
         ELSE weekly_allowance * weight / SUM(weight) OVER one END AS target
  FROM (SELECT d.*, CASE WHEN coalesce(t.weeks, 0) < 2 THEN CAST(1 AS DOUBLE) / 7
                         ELSE coalesce(s.share, CAST(0 AS DOUBLE)) / t.total END AS weight
        FROM (SELECT e.*, {_wd('e.day')} AS weekday
              FROM (SELECT budget_id, as_of, weekly_allowance,
                           CAST(unnest(range(CAST(week_start AS TIMESTAMP), CAST(week_end AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
                    FROM plan_blended) e) d
        LEFT JOIN shape_blended s ON s.budget_id = d.budget_id AND s.as_of = d.as_of AND s.weekday = d.weekday
        LEFT JOIN (SELECT budget_id, as_of, SUM(share) AS total, MAX(weeks) AS weeks FROM shape_blended GROUP BY ALL) t
          ON t.budget_id = d.budget_id AND t.as_of = d.as_of)
  WINDOW one AS (PARTITION BY budget_id, as_of)""")

cte("calibration_blended", ["pk", "ledger_blended", "usage_daily"], """
  SELECT budget_id, as_of,
    CASE WHEN days >= 7 AND dbu > 0 THEN least(greatest(CAST(spent AS DOUBLE) / CAST(CAST(dbu AS DECIMAL(28,9)) AS DOUBLE),
         CAST(1.0 AS DOUBLE)), CAST(4.0 AS DOUBLE)) ELSE CAST(1.6 AS DOUBLE) END AS global_multiplier,
    CAST(days AS INTEGER) AS window_days,
    CAST(CASE WHEN days >= 7 AND dbu > 0 THEN spent ELSE 0 END AS DECIMAL(18,4)) AS cur_total,
    CAST(CASE WHEN days >= 7 AND dbu > 0 THEN dbu ELSE 0 END AS DECIMAL(18,4)) AS dbu_total
  FROM (SELECT k.budget_id, k.as_of, COUNT(b.cost) AS days, SUM(b.cost) AS spent, SUM(b.dbu_dollars) AS dbu
        FROM pk k LEFT JOIN (SELECT l.budget_id, l.as_of, l.usage_date, l.cost, u.dbu_dollars
                             FROM ledger_blended l JOIN usage_daily u ON u.budget_id = l.budget_id AND u.usage_date = l.usage_date) b
          ON b.budget_id = k.budget_id AND b.as_of = k.as_of AND b.usage_date >= k.as_of - 30 AND b.usage_date < k.as_of - 2
        GROUP BY k.budget_id, k.as_of)""")

cte("calibration_in_force", ["calibration", "budgets"], f"""
  SELECT c.budget_id, c.as_of, coalesce(s.global_multiplier, CAST(1.6 AS DOUBLE)) AS global_multiplier,
         coalesce(s.window_days, 0) AS window_days, s.as_of AS calibrated_on
  FROM ({RELEASE_INSTANTS_SQL}) c
  LEFT JOIN (SELECT * FROM (
      SELECT c2.budget_id, c2.as_of AS check_at, k.as_of, k.global_multiplier, k.window_days,
             row_number() OVER (PARTITION BY c2.budget_id, c2.as_of ORDER BY k.as_of DESC) AS rn
      FROM ({RELEASE_INSTANTS_SQL}) c2 JOIN calibration k
        ON k.budget_id = c2.budget_id AND k.as_of <= CAST(c2.as_of AS DATE)) WHERE rn = 1) s
    ON s.budget_id = c.budget_id AND s.check_at = c.as_of""")


def revert_all_sql(select: str) -> str:
    """Active actions and queue after the live first check, as one list."""
    step1 = step_ctes(["chosen"], "_1", FIRST_INSTANT_SQL)
    lst = ("revert_all_1", """
  SELECT budget_id, 'revert' AS operation, kind, target_id, target_name FROM chosen_1
  WHERE kind IN ('job_cluster_throttle', 'warehouse_throttle', 'job_schedule_pause')
  UNION ALL
  SELECT budget_id, 'release', 'job_schedule_pause', target_id, target_name FROM chosen_1
  WHERE kind = 'job_schedule_pause'""")
    return chain_sql([step1 + [lst]], ["chosen"], select)

"""Knobs of the spend-pacing pipeline.

One frozen dataclass of literals holds everything that is the same for the
whole fleet; what differs per budget (amount, fiscal calendar, accounts) is a
column of the ``budgets`` table instead, so one plan evaluates many budgets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced, so they are
# stated plainly here, together, in their natural order.
# ---------------------------------------------------------------------------

#: Line item types never counted toward a budget (case-sensitive).
EXCLUDED_LINE_ITEM_TYPES = ("Tax", "Refund", "Credit")
#: Vendor name matched case-insensitively in billing rows and the vendor tag.
VENDOR = "databricks"
#: Cost-allocation tag stamped by the vendor on resources it launches.
VENDOR_TAG = "user_vendor"
#: Extra tags that attribute a row when non-blank.
ATTRIBUTION_TAGS = ("user_clusterid", "user_clustername", "user_jobid")
#: Billing entity text marking marketplace charges (case-insensitive).
MARKETPLACE_TEXT = "marketplace"
#: Single map column of all resource tags in the newer export layout.
TAG_MAP_COLUMN = "resource_tags"
#: canonical name -> (snake_case / parquet name, legacy CSV name)
CUR_COLUMNS = {
    "usage_start": ("line_item_usage_start_date", "lineItem/UsageStartDate"),
    "cost": ("line_item_unblended_cost", "lineItem/UnblendedCost"),
    "line_item_type": ("line_item_line_item_type", "lineItem/LineItemType"),
    "usage_account_id": ("line_item_usage_account_id", "lineItem/UsageAccountId"),
    "legal_entity": ("line_item_legal_entity", "lineItem/LegalEntity"),
    "billing_entity": ("bill_billing_entity", "bill/BillingEntity"),
    "product_name": ("product_product_name", "product/ProductName"),
}
#: Warehouse sizes, smallest first.
SIZE_LADDER = (
    "2X-Small", "X-Small", "Small", "Medium", "Large",
    "X-Large", "2X-Large", "3X-Large", "4X-Large",
)
#: Worker-cap factors offered by the job-cluster lever, gentlest first.
CAP_FACTORS = (0.75, 0.50)
#: Priorities and the order in which they are throttled (lower first).
PRIORITY_ORDER = {"low": 0, "normal": 1, "critical": 2}
#: Lever kinds with their disruption rank and reversibility.
KIND_IDLE = "idle_cluster_terminate"
KIND_JOB_CLUSTER = "job_cluster_throttle"
KIND_WAREHOUSE = "warehouse_throttle"
KIND_PAUSE = "job_schedule_pause"
DISRUPTION = {KIND_IDLE: 0, KIND_JOB_CLUSTER: 1, KIND_WAREHOUSE: 2, KIND_PAUSE: 3}
REVERSIBLE = {KIND_IDLE: False, KIND_JOB_CLUSTER: True, KIND_WAREHOUSE: True, KIND_PAUSE: True}
#: Severities, mildest first.
SEVERITIES = ("OK", "WARN", "THROTTLE", "CRITICAL")
#: Weekday names, Monday first (weekday() = 0 is Monday).
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Calibration: days the billing report lags, window, minimum shared days, clamp.
CUR_LAG_DAYS = 2
CALIBRATION_WINDOW_DAYS = 28
CALIBRATION_MIN_DAYS = 7
MULTIPLIER_BOUNDS = (1.0, 4.0)
#: Forecasts trust same-weekday samples only when at least this many exist.
MIN_WEEKDAY_SAMPLES = 2
#: Granularity check: span of at least this many days with at most
#: span // MONTHLY_DAYS_PER_DATE distinct dates looks like a monthly export.
MONTHLY_MIN_SPAN = 28
MONTHLY_DAYS_PER_DATE = 25


@dataclass(frozen=True)
class Thresholds:
    ok: float = 0.90
    throttle: float = 1.00
    critical: float = 1.30


@dataclass(frozen=True)
class Levers:
    enforce_spot: bool = True
    cap_max_workers: bool = True
    warehouse_downsize: bool = True
    warehouse_autostop: bool = True
    spot_bid_reduction: bool = True
    idle_termination: bool = True
    job_pause: bool = True
    spot_discount: float = 0.65
    worker_cost_fraction: float = 0.80
    worker_cap_efficiency: float = 0.70
    min_workers: int = 1
    min_spot_bid_percent: int = 50
    spot_bid_savings_fraction: float = 0.30
    autostop_savings_fraction: float = 0.10
    autostop_floor_minutes: int = 5
    idle_threshold_minutes: int = 30
    fifo_release: bool = True
    release_missed_runs: bool = True


@dataclass(frozen=True)
class Forecasting:
    trailing_weeks: int = 8
    trailing_days: int = 14
    usage_lag_hours: int = 3
    default_infra_multiplier: float = 1.6
    #: compute type -> multiplier, overriding the calibrated global one
    multiplier_overrides: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class PaceConfig:
    """Fleet-wide settings. Per-budget values live in the ``budgets`` table:
    ``budget_id, annual_budget, fy_start_month, fy_start_day,
    week_start_weekday``."""

    attribution: str = "vendor"  # "vendor": attributed rows only; "all": every row
    include_usage_invoice: bool = False
    dry_run: bool = True
    priority_tag_key: str = "budget-priority"
    vendor: str = VENDOR
    vendor_tag: str = VENDOR_TAG
    attribution_tags: tuple[str, ...] = ATTRIBUTION_TAGS
    excluded_line_item_types: tuple[str, ...] = EXCLUDED_LINE_ITEM_TYPES
    thresholds: Thresholds = field(default_factory=Thresholds)
    levers: Levers = field(default_factory=Levers)
    forecast: Forecasting = field(default_factory=Forecasting)

    @property
    def tag_names(self) -> tuple[str, ...]:
        return (self.vendor_tag, *self.attribution_tags)

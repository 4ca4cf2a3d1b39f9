"""Column names and fixed values shared by every module."""

from __future__ import annotations

KEYS = ("operationalUnitIdentifier", "itemIdentifier")
DATE = "transactionDate"
AMOUNT = "itemQuantity"
QUANTITY = "quantity"

HISTORY_START = "2024-01-01"
# Zone in which a moment becomes a day.
TIME_ZONE = "UTC"
GAP_DAYS = 7
HORIZON_DAYS = 7

# The feature columns, in model order.
FEATURES = [
    "quantity",
    "quantity_lag_1",
    "quantity_lag_7",
    "quantity_lag_14",
    "quantity_lag_28",
    "quantity_mean_7d",
    "quantity_mean_14d",
    "quantity_mean_28d",
    "quantity_std_28d",
    "quantity_sum_7d",
    "quantity_sum_14d",
    "quantity_sum_28d",
    "quantity_sum_56d",
    "quantity_sum_previous_7d",
    "quantity_sum_previous_14d",
    "quantity_sum_previous_28d",
    "ratio_previous_7d_28d",
    "ratio_previous_7d_recent_7d",
    "trend_7d_vs_28d",
    "trend_14d_vs_28d",
    "day_of_week",
    "month",
    "day_of_year",
    "sin_day_of_year",
    "cos_day_of_year",
    "is_weekend",
    "is_holiday",
]

TARGETS = [f"target_{day}d" for day in range(1, HORIZON_DAYS + 1)]
DIRECT_TARGET = "target_quantity_7d"
ALL_TARGETS = [*TARGETS, DIRECT_TARGET]

BASELINE_FEATURE = "baseline_28d_7days"
# Columns that are NULL where their denominator is zero.
RATIO_FEATURES = [
    "ratio_previous_7d_28d",
    "ratio_previous_7d_recent_7d",
    "trend_7d_vs_28d",
    "trend_14d_vs_28d",
]

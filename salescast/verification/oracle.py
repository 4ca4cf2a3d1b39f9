"""The registered queries as DuckDB SQL.

Written from the definitions, not from the Spark plans: gaps are filled by
joining a spine, every frame is spelled out, and choices are made by ranking.
"""

from __future__ import annotations

from salescast.schema import ALL_TARGETS, DIRECT_TARGET, FEATURES, RATIO_FEATURES, TARGETS
from salescast.verification.queries import (
    CALENDAR,
    DIGITS,
    LAGS,
    MEANS,
    OFFSET_SUMS,
    ONE_SERIES,
    SCAN_START,
    SUMS,
    VALIDATION_START,
)

UNIT = "operationalUnitIdentifier"
ITEM = "itemIdentifier"
ID = f"{UNIT}, {ITEM}"
ROW = f"{ID}, transactionDate"

def r(expression: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 ELSE round({expression}, {digits}) END"


def _frame(function: str, first: int, last: int) -> str:
    return (
        f"{function}(quantity) OVER (PARTITION BY {ID} ORDER BY transactionDate "
        f"ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING)"
    )


SALES = f"""
sales AS (
    SELECT CAST(s_nationkey AS BIGINT) AS {UNIT}, p_type AS {ITEM},
           CAST(l_shipdate AS DATE) AS transactionDate,
           CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS itemQuantity
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    WHERE s_nationkey IS NOT NULL AND p_type IS NOT NULL
)"""

DAILY = f"""{SALES},
daily AS (
    SELECT {ROW}, SUM(itemQuantity) AS quantity FROM sales
    WHERE transactionDate >= DATE '1995-01-01' GROUP BY {ROW}
)"""

SPINE = f"""{DAILY},
bounds AS (
    SELECT {ID}, MIN(transactionDate) AS min_date, MAX(transactionDate) AS max_date FROM daily GROUP BY {ID}
),
spine AS (
    SELECT {ID}, CAST(UNNEST(generate_series(min_date, max_date, INTERVAL 1 DAY)) AS DATE) AS transactionDate
    FROM bounds
)"""

DENSE = f"""{SPINE},
dense AS (
    SELECT {ROW}, COALESCE(quantity, 0.0) AS quantity FROM spine LEFT JOIN daily USING ({ROW})
)"""

# Easter by the rule of Meeus, Jones and Butcher; the Spark side uses Gauss's.
HOLIDAYS = """
years AS (
    SELECT UNNEST(range((SELECT MIN(year(transactionDate)) FROM daily), (SELECT MAX(year(transactionDate)) + 1 FROM daily))) AS y
),
moons AS (
    SELECT y, y % 19 AS a, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30
        AS h FROM years
),
weekdays AS (
    SELECT *, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM moons
),
spring AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS days FROM weekdays),
easter AS (SELECT make_date(y, days // 31, days % 31 + 1) AS sunday FROM spring),
holidays AS (
    SELECT CAST(sunday + days AS DATE) AS holiday_date FROM easter, (VALUES (1), (39), (50)) AS movable(days)
    UNION
    SELECT make_date(CAST(year(sunday) AS BIGINT), month, day) FROM easter,
        (VALUES (1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) AS fixed(month, day)
)"""

_LAGS = ", ".join(
    f"LAG(quantity, {k}) OVER (PARTITION BY {ID} ORDER BY transactionDate) AS quantity_lag_{k}" for k in (1, 7, 14, 28)
)
_LEADS = ", ".join(
    f"LEAD(quantity, {k}) OVER (PARTITION BY {ID} ORDER BY transactionDate) AS target_{k}d" for k in range(1, 8)
)
_FRAMES = ", ".join(
    [f"{_frame('AVG', n, 1)} AS quantity_mean_{n}d" for n in (7, 14, 28)]
    + [f"{_frame('STDDEV_SAMP', 28, 1)} AS quantity_std_28d"]
    + [f"{_frame('SUM', n, 1)} AS quantity_sum_{n}d" for n in (7, 14, 28, 56)]
    + [f"{_frame('SUM', n + 7, 8)} AS quantity_sum_previous_{n}d" for n in (7, 14, 28)]
)
_ANGLE = "2 * 3.14159265359::DOUBLE * dayofyear(transactionDate) / 365.25::DOUBLE"
_CALENDAR = f"""CAST(isodow(transactionDate) - 1 AS INTEGER) AS day_of_week,
    CAST(month(transactionDate) AS INTEGER) AS month, CAST(dayofyear(transactionDate) AS INTEGER) AS day_of_year,
    SIN({_ANGLE}) AS sin_day_of_year, COS({_ANGLE}) AS cos_day_of_year,
    CAST(CASE WHEN isodow(transactionDate) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend"""
_RATIOS = """quantity_sum_previous_7d / NULLIF(quantity_sum_28d, 0) AS ratio_previous_7d_28d,
    quantity_sum_previous_7d / NULLIF(quantity_sum_7d, 0) AS ratio_previous_7d_recent_7d,
    quantity_mean_7d / NULLIF(quantity_mean_28d, 0) AS trend_7d_vs_28d,
    quantity_mean_14d / NULLIF(quantity_mean_28d, 0) AS trend_14d_vs_28d"""

WINDOWED = f"""{DENSE},
windowed AS (SELECT {ROW}, quantity, {_LAGS}, {_FRAMES}, {_LEADS} FROM dense)"""

FEATURED = f"""{WINDOWED}, {HOLIDAYS},
featured AS (
    SELECT windowed.*, {_RATIOS}, {_CALENDAR},
           CAST(CASE WHEN holiday_date IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_holiday,
           {' + '.join(TARGETS)} AS {DIRECT_TARGET}
    FROM windowed LEFT JOIN holidays ON transactionDate = holiday_date
)"""

PANEL = f"""{FEATURED},
panel AS MATERIALIZED (SELECT * FROM featured WHERE quantity_lag_28 IS NOT NULL AND target_7d IS NOT NULL)"""

SPLIT = f"""{PANEL},
numbered AS (
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY {ID} ORDER BY transactionDate) - 1 AS INTEGER) AS position,
           COUNT(*) OVER (PARTITION BY {ID}) AS n
    FROM panel
),
parts AS (
    SELECT *, CAST((4 * n) // 5 AS INTEGER) AS train_rows,
           CASE WHEN position < (4 * n) // 5 THEN 'train'
                WHEN position < (4 * n) // 5 + 7 THEN 'gap' ELSE 'test' END AS split
    FROM numbered
),
tuning_sizes AS (SELECT *, GREATEST(60, train_rows // 5) AS validation_rows FROM parts),
split AS MATERIALIZED (
    SELECT *, CASE WHEN train_rows >= 68 THEN 'ok' ELSE 'insufficient_history' END AS tuning_status,
           CASE WHEN train_rows < 68 OR split <> 'train' THEN NULL
                WHEN position < train_rows - validation_rows - 7 THEN 'fit'
                WHEN position < train_rows - validation_rows THEN 'gap'
                ELSE 'validation' END AS tuning_part
    FROM tuning_sizes
)"""

LEVELS = [
    ("mean_7d", "quantity_mean_7d"),
    ("mean_14d", "quantity_mean_14d"),
    ("mean_28d", "quantity_mean_28d"),
    ("lag_7", "quantity_lag_7"),
]


def _forecast(column: str, target: str) -> str:
    return f"{column} * 7" if target == DIRECT_TARGET else column


def _lines(name: str, rows: str) -> str:
    """Each series' regression of the targets on the 28-day mean times seven."""
    x = "quantity_mean_28d * 7"
    parts = ", ".join(
        f"REGR_SLOPE({t}, {x}) AS slope_{t}, REGR_INTERCEPT({t}, {x}) AS intercept_{t}, AVG({t}) AS mean_{t}"
        for t in ALL_TARGETS
    )
    return f"{name} AS (SELECT {ID}, {parts} FROM split WHERE {rows} GROUP BY {ID})"


def _on_line(name: str, target: str) -> str:
    line = f"{name}.intercept_{target} + {name}.slope_{target} * quantity_mean_28d * 7"
    return f"COALESCE({line}, {name}.mean_{target})"


_CANDIDATES = ", ".join(
    f"{{'target': '{target}', 'config_order': {order}, 'configuration': '{name}', 'y': {target}, 'p': {forecast}}}"
    for target in ALL_TARGETS
    for order, (name, forecast) in enumerate(
        [*[(name, _forecast(column, target)) for name, column in LEVELS], ("regression", _on_line("fit_lines", target))]
    )
)

ERRORS = """COUNT(*) AS rows, AVG(ABS(y - p)) AS MAE, SQRT(AVG((y - p) * (y - p))) AS RMSE,
    CASE WHEN COUNT(*) < 2 THEN NULL
         WHEN VAR_POP(y) = 0 THEN CASE WHEN SUM((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END
         ELSE 1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)) END AS R2"""
SHOWN_ERRORS = f"rows, {r('MAE')} AS MAE, {r('RMSE')} AS RMSE, {r('R2')} AS R2"

CANDIDATES = f"""{SPLIT},
{_lines("fit_lines", "tuning_part = 'fit'")},
candidates AS (
    SELECT {ID}, UNNEST([{_CANDIDATES}], recursive := true)
    FROM split LEFT JOIN fit_lines USING ({ID}) WHERE tuning_part = 'validation'
)"""

TUNING = f"""{CANDIDATES},
tuning AS (
    SELECT {ID}, target, CAST(config_order AS INTEGER) AS config_order, configuration, {ERRORS}
    FROM candidates GROUP BY {ID}, target, config_order, configuration
)"""

BEST = f"""{TUNING},
best AS (
    SELECT * FROM (SELECT *, MIN(MAE) OVER (PARTITION BY {ID}, target) AS least FROM tuning)
    WHERE MAE <= least + abs(least) * 1e-9
    QUALIFY ROW_NUMBER() OVER (PARTITION BY {ID}, target ORDER BY config_order) = 1
)"""

_PICK = ", ".join(f"MAX(CASE WHEN target = '{t}' THEN config_order END) AS pick_{t}" for t in ALL_TARGETS)


def _picked(target: str) -> str:
    branches = " ".join(
        f"WHEN {order} THEN {_forecast(column, target)}" for order, (_, column) in enumerate(LEVELS)
    )
    return f"CASE COALESCE(pick_{target}, 2) {branches} ELSE {_on_line('lines', target)} END AS forecast_{target}"


CHOSEN = f"""{BEST},
picks AS (SELECT {ID}, {_PICK} FROM best GROUP BY {ID}),
{_lines("lines", "split = 'train'")},
forecast AS MATERIALIZED (
    SELECT split.*, {', '.join(_picked(t) for t in ALL_TARGETS)}
    FROM split LEFT JOIN picks USING ({ID}) LEFT JOIN lines USING ({ID}) WHERE split = 'test'
),
chosen AS (
    SELECT *, {' + '.join(f'forecast_{t}' for t in TARGETS)} AS forecast_multi,
           quantity_mean_7d * 7 AS baseline_7d, quantity_mean_28d * 7 AS baseline_28d
    FROM forecast
)"""

_COMPARED = ", ".join(
    f"{{'model': '{model}', 'y': {DIRECT_TARGET}, 'p': {column}}}"
    for model, column in [
        ("baseline_7d", "baseline_7d"),
        ("baseline_28d", "baseline_28d"),
        ("multi_model_7d", "forecast_multi"),
        ("direct_7d", f"forecast_{DIRECT_TARGET}"),
    ]
)
COMPARED = f"""{CHOSEN},
compared AS (SELECT {ID}, UNNEST([{_COMPARED}], recursive := true) FROM chosen)"""

_HORIZONS = ", ".join(
    f"{{'horizon': '{t}', 'y': {t}, 'b': quantity_mean_28d, 'm': forecast_{t}}}" for t in TARGETS
)
_BASELINE_HORIZONS = ", ".join(f"{{'horizon': '{t}', 'y': {t}, 'p': quantity_mean_28d}}" for t in TARGETS)


def _columns(names: list[str]) -> str:
    return ", ".join(f"{r(n, DIGITS[n])} AS {n}" if n in DIGITS else n for n in names)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


PANEL_COLUMNS = f"{ROW}, {_columns(FEATURES)}, {', '.join(ALL_TARGETS)}"
TRIMMED = "windowed WHERE quantity_lag_28 IS NOT NULL"


def _latest(days_back: int) -> str:
    return f"""{FEATURED},
    scored AS (
        SELECT featured.* FROM featured JOIN bounds USING ({ID})
        WHERE transactionDate = max_date - {days_back} AND quantity_lag_28 IS NOT NULL
    )"""


_HORIZON_FORECASTS = ", ".join(f"{r('quantity_mean_28d')} AS {t}" for t in TARGETS)
_TOTAL = " + ".join(["quantity_mean_28d"] * 7)
_FLAT = (
    f"strftime(transactionDate, '%Y-%m-%d') AS last_date, {_HORIZON_FORECASTS}, "
    f"{r(_TOTAL)} AS total_quantity_7d, {r('quantity_mean_28d * 7')} AS direct_quantity_7d"
)
_ANSWERS = f"""{_latest(0)},
requests AS (
    SELECT {UNIT} + 1 AS operational_unit_id, {ITEM} AS item_id FROM sales
    UNION SELECT {UNIT} + 1, NULL FROM sales
),
known AS (SELECT {ID}, 1 AS known FROM bounds),
answers AS (
    SELECT requests.*, scored.*, CASE WHEN scored.transactionDate IS NOT NULL THEN 'ok'
           WHEN known = 1 THEN 'insufficient_history'
           WHEN item_id IS NULL THEN 'invalid_request' ELSE 'no_history' END AS status
    FROM requests
    LEFT JOIN known ON operational_unit_id = known.{UNIT} AND item_id = known.{ITEM}
    LEFT JOIN scored ON operational_unit_id = scored.{UNIT} AND item_id = scored.{ITEM}
)"""
_JSON_FORECASTS = ", ".join(f"'{t}': {r('quantity_mean_28d')}" for t in TARGETS)

# The tuning grid, written out apart from the code it checks.
GRID = """(VALUES
    (0, 'A_small', 500, 0.05, 15, -1, 20, 0.9, 0.9, 0.0, 0.0, 255, 4, 0.0),
    (1, 'B_standard', 700, 0.03, 31, -1, 20, 0.9, 0.9, 0.0, 0.0, 255, 5, 0.0),
    (2, 'C_regularized', 700, 0.03, 31, -1, 40, 0.9, 0.9, 0.1, 1.0, 255, 5, 0.0011),
    (3, 'D_complex', 700, 0.03, 63, -1, 30, 0.9, 0.9, 0.1, 1.0, 255, 6, 0.0011),
    (4, 'E_deep', 1000, 0.02, 63, 8, 30, 0.9, 0.9, 0.1, 1.0, 255, 6, 0.0011),
    (5, 'F_high_regularization', 700, 0.03, 15, -1, 40, 0.9, 0.9, 0.5, 2.0, 255, 4, 0.0025)
) AS grid(config_order, configuration, n_estimators, learning_rate, num_leaves, max_depth, min_child_samples,
          subsample, colsample_bytree, reg_alpha, reg_lambda, max_bins, tree_depth, penalty_share)"""
_DOUBLES = ("learning_rate", "subsample", "colsample_bytree", "reg_alpha", "reg_lambda", "penalty_share")
_GRID_COLUMNS = ", ".join(
    ["config_order", "configuration", "n_estimators", "learning_rate::DOUBLE AS learning_rate", "num_leaves"]
    + ["max_depth", "min_child_samples", *[f"{name}::DOUBLE AS {name}" for name in _DOUBLES[1:]], "max_bins", "tree_depth"]
)

# One last train day and one first validation day for all series.
DATED = f"""{PANEL},
span AS (SELECT MIN(transactionDate) AS first, MAX(transactionDate) AS last FROM panel),
cut AS (SELECT first, first + CAST(4 * (last - first + 1) // 5 - 1 AS INTEGER) AS cutoff FROM span),
edges AS (SELECT cutoff, cutoff - CAST(GREATEST(60, (cutoff - first + 1) // 5) - 1 AS INTEGER) AS judged FROM cut),
dated AS (
    SELECT panel.*, CASE WHEN transactionDate <= cutoff THEN 'train'
                         WHEN transactionDate <= cutoff + 7 THEN 'gap' ELSE 'test' END AS split,
           transactionDate <= cutoff AND transactionDate >= judged
               AND MIN(transactionDate) OVER (PARTITION BY {ID}) < judged - 7 AS is_validation
    FROM panel, edges
),
test AS (SELECT * FROM dated WHERE split = 'test')"""

_STUMP = ["day_of_week", "month", "is_weekend", "is_holiday"]
_STUMP_VALUES = ", ".join(f"{{'place': {i}, 'v': {name}, 'y': target_1d}}" for i, name in enumerate(_STUMP))
STUMP = f"""{DATED},
stump_values AS (
    SELECT place, v, COUNT(*) AS n, SUM(y) AS s
    FROM (SELECT UNNEST([{_STUMP_VALUES}], recursive := true) FROM dated WHERE split = 'train') GROUP BY place, v
),
stump_sides AS (
    SELECT place, v, SUM(n) OVER upto AS nl, SUM(s) OVER upto AS sl,
           SUM(n) OVER (PARTITION BY place) - SUM(n) OVER upto AS nr,
           SUM(s) OVER (PARTITION BY place) - SUM(s) OVER upto AS sr
    FROM stump_values WINDOW upto AS (PARTITION BY place ORDER BY v)
),
stump AS (
    SELECT * FROM stump_sides WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC, place, v LIMIT 1
)"""
_SECOND_VALUES = ", ".join(f"{{'place': {i}, 'v': {name}, 'y': left_over}}" for i, name in enumerate(_STUMP))
_STUMP_PICK = " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(_STUMP))


# The first tree has weight one; the second learns twice the residual (the slope of the squared loss) with weight one half.
TWO_STUMPS = f"""{STUMP},
first_round AS (
    SELECT dated.*, CASE WHEN CASE place {_STUMP_PICK} END <= v THEN sl / nl ELSE sr / nr END AS first_forecast
    FROM dated, stump
),
second_values AS (
    SELECT place, v, COUNT(*) AS n, SUM(y) AS s
    FROM (SELECT UNNEST([{_SECOND_VALUES}], recursive := true)
          FROM (SELECT *, 2 * (target_1d - first_forecast) AS left_over FROM first_round WHERE split = 'train')) GROUP BY place, v
),
second_sides AS (
    SELECT place, v, SUM(n) OVER upto AS nl, SUM(s) OVER upto AS sl,
           SUM(n) OVER (PARTITION BY place) - SUM(n) OVER upto AS nr,
           SUM(s) OVER (PARTITION BY place) - SUM(s) OVER upto AS sr
    FROM second_values WINDOW upto AS (PARTITION BY place ORDER BY v)
),
second AS (
    SELECT * FROM second_sides WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC, place, v LIMIT 1
)"""


def _describe(target: str) -> str:
    return (
        f"SELECT {ID}, '{target}' AS \"column\", COUNT({target}) AS count, {r(f'AVG({target})')} AS mean, "
        f"{r(f'STDDEV_SAMP({target})')} AS std, MIN({target}) AS min, quantile_cont({target}, 0.25) AS p25, "
        f"quantile_cont({target}, 0.5) AS p50, quantile_cont({target}, 0.75) AS p75, MAX({target}) AS max "
        f"FROM panel GROUP BY {ID}"
    )


def _describe_pooled(target: str) -> str:
    return (
        f"SELECT '{target}' AS \"column\", COUNT({target}) AS count, {r(f'AVG({target})')} AS mean, "
        f"{r(f'STDDEV_SAMP({target})')} AS std, MIN({target}) AS min, quantile_cont({target}, 0.25) AS p25, "
        f"quantile_cont({target}, 0.5) AS p50, quantile_cont({target}, 0.75) AS p75, MAX({target}) AS max FROM panel"
    )


def _nulls(name: str) -> str:
    return (
        f"SELECT {ID}, COUNT(*) AS rows, '{name}' AS \"column\", COUNT(*) - COUNT({name}) AS nulls "
        f"FROM panel GROUP BY {ID}"
    )


def oracle_sql() -> dict[str, str]:
    scan = f"SELECT {ROW}, itemQuantity FROM sales"
    only = f"{UNIT} = {ONE_SERIES[UNIT]} AND {ITEM} = '{ONE_SERIES[ITEM]}'"
    comparison = f"SELECT model, {ERRORS} FROM compared GROUP BY model"
    by_series = f"SELECT {ID}, model, {ERRORS} FROM compared GROUP BY {ID}, model"
    return {
        "sales_scan": _with(SALES, f"{scan} WHERE transactionDate >= DATE '{SCAN_START}'"),
        "sales_scan_params": _with(SALES, f"{scan} WHERE {only}"),
        "holiday_calendar": _with(
            f"{DAILY}, {HOLIDAYS}",
            "SELECT holiday_date FROM holidays "
            "WHERE year(holiday_date) IN (SELECT year(transactionDate) FROM daily)",
        ),
        "sample_regression": _with(
            PANEL,
            f"SELECT {r('quantity_mean_7d')} AS feature_1, {r('quantity_mean_28d')} AS feature_2, "
            "quantity_lag_7 AS feature_3, target_1d AS target FROM panel",
        ),
        "numeric_coerce": """SELECT l_orderkey, l_linenumber, l_tax AS tax,
            TRY_CAST(CASE l_returnflag WHEN 'R' THEN l_returnflag
                     WHEN 'N' THEN CAST(l_quantity AS VARCHAR) || 'd'
                     ELSE ' ' || CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS amount FROM lineitem""",
        "daily_sales": _with(DAILY, f"SELECT {ROW}, quantity FROM daily"),
        "series_bounds": _with(SPINE, f"SELECT {ID}, min_date, max_date FROM bounds"),
        "calendar_spine": _with(SPINE, f"SELECT {ROW} FROM spine"),
        "dense_daily": _with(DENSE, f"SELECT {ROW}, quantity FROM dense"),
        "lag_features": _with(WINDOWED, f"SELECT {ROW}, quantity, {', '.join(LAGS)} FROM windowed"),
        "rolling_means": _with(WINDOWED, f"SELECT {ROW}, {_columns(MEANS)} FROM {TRIMMED}"),
        "rolling_std": _with(WINDOWED, f"SELECT {ROW}, {_columns(['quantity_std_28d'])} FROM {TRIMMED}"),
        "rolling_sums": _with(WINDOWED, f"SELECT {ROW}, {_columns(SUMS)} FROM {TRIMMED}"),
        "offset_sums": _with(WINDOWED, f"SELECT {ROW}, {_columns(OFFSET_SUMS)} FROM {TRIMMED}"),
        "lead_targets": _with(WINDOWED, f"SELECT {ROW}, {', '.join(TARGETS)} FROM windowed"),
        "target_sum_7d": _with(WINDOWED, f"SELECT {ROW}, {' + '.join(TARGETS)} AS {DIRECT_TARGET} FROM windowed"),
        "calendar_features": _with(FEATURED, f"SELECT {ROW}, {_columns(CALENDAR)} FROM featured"),
        "holiday_flag": _with(FEATURED, f"SELECT {ROW}, is_holiday FROM featured"),
        "ratio_features": _with(
            FEATURED, f"SELECT {ROW}, {_columns(RATIO_FEATURES)} FROM featured WHERE quantity_lag_28 IS NOT NULL"
        ),
        "training_panel": _with(PANEL, f"SELECT {PANEL_COLUMNS} FROM panel"),
        "stored_panel": _with(PANEL, f"SELECT {PANEL_COLUMNS} FROM panel"),
        "series_panel": _with(PANEL, f"SELECT {PANEL_COLUMNS} FROM panel WHERE {only}"),
        "feature_matrix": _with(PANEL, f"SELECT {ROW}, {_columns(FEATURES)} FROM panel"),
        "target_matrix": _with(PANEL, f"SELECT {ROW}, {', '.join(ALL_TARGETS)} FROM panel"),
        "baseline_feature": _with(
            PANEL, f"SELECT {ROW}, {r('quantity_mean_28d * 7')} AS baseline_28d_7days FROM panel"
        ),
        "temporal_split": _with(SPLIT, f"SELECT {ROW}, position, train_rows, split FROM split"),
        "cutoff_split": _with(
            f"""{SPLIT}, cut AS (
                SELECT {ROW}, position,
                       CAST(COUNT(*) FILTER (WHERE transactionDate <= DATE '{SCAN_START}') OVER (PARTITION BY {ID})
                            AS INTEGER) AS train_rows FROM split
            )""",
            f"""SELECT {ROW}, position, train_rows, CASE WHEN transactionDate <= DATE '{SCAN_START}' THEN 'train'
                WHEN transactionDate <= DATE '{SCAN_START}' + 7 THEN 'gap' ELSE 'test' END AS split FROM cut""",
        ),
        "cutoff_validation": _with(
            f"""{SPLIT}, cut AS (
                SELECT {ROW}, position, transactionDate <= DATE '{SCAN_START}' AS is_train,
                       MIN(transactionDate) OVER (PARTITION BY {ID}) < DATE '{VALIDATION_START}' - 7 AS enough FROM split
            )""",
            f"""SELECT {ROW}, position, CASE WHEN NOT enough OR NOT is_train THEN NULL
                WHEN transactionDate < DATE '{VALIDATION_START}' - 7 THEN 'fit'
                WHEN transactionDate < DATE '{VALIDATION_START}' THEN 'gap' ELSE 'validation' END AS tuning_part,
                CASE WHEN enough THEN 'ok' ELSE 'insufficient_history' END AS tuning_status FROM cut""",
        ),
        "validation_split": _with(SPLIT, f"SELECT {ROW}, position, tuning_part, tuning_status FROM split"),
        "split_summary": _with(
            SPLIT,
            f"SELECT {ID}, split, COUNT(*) AS rows, MIN(transactionDate) AS first_date, "
            f"MAX(transactionDate) AS last_date FROM split GROUP BY {ID}, split",
        ),
        "target_describe": _with(PANEL, " UNION ALL ".join(_describe(t) for t in ALL_TARGETS)),
        "target_describe_pooled": _with(PANEL, " UNION ALL ".join(_describe_pooled(t) for t in ALL_TARGETS)),
        "null_counts": _with(PANEL, " UNION ALL ".join(_nulls(n) for n in [*FEATURES, *ALL_TARGETS])),
        "panel_head_tail": _with(
            SPLIT,
            f"SELECT {PANEL_COLUMNS}, 'head' AS preview FROM split WHERE position < 5 UNION ALL "
            f"SELECT {PANEL_COLUMNS}, 'tail' AS preview FROM split WHERE position >= n - 5",
        ),
        "baseline_forecasts": _with(
            PANEL,
            f"SELECT {ROW}, {r('quantity_mean_28d')} AS baseline_horizon, {r('quantity_mean_7d * 7')} AS baseline_7d, "
            f"{r('quantity_mean_28d * 7')} AS baseline_28d FROM panel",
        ),
        "baseline_horizon_metrics": _with(
            f"{SPLIT}, pairs AS (SELECT UNNEST([{_BASELINE_HORIZONS}], recursive := true) FROM split "
            f"WHERE split = 'test'), errors AS (SELECT horizon, {ERRORS} FROM pairs GROUP BY horizon)",
            f"SELECT horizon, {SHOWN_ERRORS} FROM errors",
        ),
        "tuning_by_series": _with(
            TUNING, f"SELECT {ID}, target, config_order, configuration, {SHOWN_ERRORS} FROM tuning"
        ),
        "config_selection": _with(
            BEST, f"SELECT {ID}, target, config_order, configuration, {SHOWN_ERRORS} FROM best"
        ),
        "config_selection_pooled": _with(
            f"{CANDIDATES}, pooled AS (SELECT target, CAST(config_order AS INTEGER) AS config_order, configuration, "
            f"{ERRORS} FROM candidates GROUP BY target, config_order, configuration)",
            f"SELECT target, config_order, configuration, {SHOWN_ERRORS} "
            "FROM (SELECT *, MIN(MAE) OVER (PARTITION BY target) AS least FROM pooled) "
            "WHERE MAE <= least + abs(least) * 1e-9 "
            "QUALIFY ROW_NUMBER() OVER (PARTITION BY target ORDER BY config_order) = 1",
        ),
        "series_regression": _with(
            f"""{SPLIT}, {_lines("lines", "split = 'train'")}""",
            " UNION ALL ".join(
                f"""SELECT {ID}, '{t}' AS target, rows, slope_{t} IS NULL AS is_mean,
                    {r(f"COALESCE(slope_{t}, 0 * mean_{t})")} AS slope, {r(f"COALESCE(intercept_{t}, mean_{t})")} AS intercept
                FROM (SELECT {ID}, COUNT(*) FILTER (split = 'train') AS rows FROM split GROUP BY {ID})
                LEFT JOIN lines USING ({ID})"""
                for t in ALL_TARGETS
            ),
        ),
        "chosen_horizon_metrics": _with(
            f"""{CHOSEN},
            horizons AS (SELECT UNNEST([{_HORIZONS}], recursive := true) FROM chosen),
            errors AS (
                SELECT horizon, AVG(ABS(y - b)) AS baseline_mae, AVG(ABS(y - m)) AS model_mae,
                       SQRT(AVG((y - b) * (y - b))) AS baseline_rmse, SQRT(AVG((y - m) * (y - m))) AS model_rmse,
                       1 - SUM((y - m) * (y - m)) / (VAR_POP(y) * COUNT(*)) AS model_r2
                FROM horizons GROUP BY horizon
            )""",
            f"SELECT horizon, {r('baseline_mae')} AS baseline_mae, {r('model_mae')} AS model_mae, "
            f"{r('baseline_rmse')} AS baseline_rmse, {r('model_rmse')} AS model_rmse, {r('model_r2')} AS model_r2, "
            f"{r('(1 - model_mae / NULLIF(baseline_mae, 0)) * 100')} AS improvement_percent FROM errors",
        ),
        "multi_horizon_sum": _with(CHOSEN, f"SELECT {ROW}, {r('forecast_multi')} AS forecast_multi FROM chosen"),
        "model_comparison": _with(
            f"{COMPARED}, errors AS ({comparison})", f"SELECT model, {SHOWN_ERRORS} FROM errors"
        ),
        "model_comparison_by_series": _with(
            f"{COMPARED}, errors AS ({by_series})", f"SELECT {ID}, model, {SHOWN_ERRORS} FROM errors"
        ),
        "improvement_pct": _with(
            f"""{COMPARED}, errors AS ({by_series}),
            sides AS (
                SELECT {ID}, MAX(CASE WHEN model = 'direct_7d' THEN MAE END) AS direct_mae,
                       MAX(CASE WHEN model = 'baseline_28d' THEN MAE END) AS baseline_mae
                FROM errors GROUP BY {ID}
            )""",
            f"SELECT {ID}, {r('direct_mae')} AS direct_mae, {r('baseline_mae')} AS baseline_mae, "
            f"{r('(1 - direct_mae / NULLIF(baseline_mae, 0)) * 100')} AS improvement_percent FROM sides",
        ),
        "prediction_examples": _with(
            CHOSEN,
            f"SELECT {ROW}, {DIRECT_TARGET} AS actual, {r(f'forecast_{DIRECT_TARGET}')} AS direct, "
            f"{r('forecast_multi')} AS multi, {r('baseline_28d')} AS baseline_28d FROM chosen "
            f"QUALIFY ROW_NUMBER() OVER (PARTITION BY {ID} ORDER BY transactionDate) <= 10",
        ),
        "config_grid": _with(
            f"""{SPLIT}, grid AS (SELECT {_GRID_COLUMNS} FROM {GRID}),
            counts AS (
                SELECT COUNT(*) FILTER (WHERE tuning_part = 'fit') AS fit_rows,
                       COUNT(*) FILTER (WHERE tuning_part = 'validation') AS validation_rows FROM split
            )""",
            f"SELECT target, counts.*, grid.* FROM counts, (SELECT UNNEST({ALL_TARGETS}) AS target), grid",
        ),
        "latest_features": _with(_latest(0), f"SELECT {ROW}, {_columns(FEATURES)} FROM scored"),
        "latest_features_labelled": _with(_latest(7), f"SELECT {ROW}, {_columns(FEATURES)} FROM scored"),
        "predict_baseline": _with(_latest(0), f"SELECT {ID}, {_FLAT}, 'ok' AS status FROM scored"),
        "published_forecasts": _with(
            f"""{FEATURED}, placed AS (
                SELECT featured.*, max_date - transactionDate AS back FROM featured JOIN bounds USING ({ID})
            )""",
            " UNION ALL ".join(
                f"""SELECT known.{UNIT}, known.{ITEM}, '{day}' AS as_of, {_FLAT},
                    CASE WHEN quantity_mean_28d IS NULL THEN 'insufficient_history' ELSE 'ok' END AS status
                FROM (SELECT {ID} FROM bounds) AS known LEFT JOIN placed
                  ON known.{UNIT} = placed.{UNIT} AND known.{ITEM} = placed.{ITEM} AND back = {back}
                 AND quantity_lag_28 IS NOT NULL"""
                for day, back in (("first", 0), ("second", 7))
            ),
        ),
        "predict_requests": _with(_ANSWERS, f"SELECT operational_unit_id, item_id, {_FLAT}, status FROM answers"),
        "predict_json": _with(
            _ANSWERS,
            f"""SELECT CAST(to_json({{
                'operational_unit_id': operational_unit_id, 'item_id': item_id,
                'last_date': strftime(transactionDate, '%Y-%m-%d'),
                'predictions': CASE WHEN status = 'ok' THEN {{{_JSON_FORECASTS}}} END,
                'total_quantity_7d': {r(_TOTAL)}, 'status': status}}) AS VARCHAR) AS response
            FROM answers""",
        ),
        "gbt_stump_forecast": _with(
            STUMP,
            f"""SELECT {ROW}, target_1d,
                {r(f"CASE WHEN CASE place {_STUMP_PICK} END <= v THEN sl / nl ELSE sr / nr END")} AS forecast_target_1d
            FROM test, stump""",
        ),
        "gbt_two_stumps_forecast": _with(
            TWO_STUMPS,
            f"""SELECT {ROW}, target_1d, {r(f"first_forecast + 0.5::DOUBLE * CASE WHEN CASE place {_STUMP_PICK} END <= v THEN sl / nl ELSE sr / nr END")}
                AS forecast_target_1d FROM (SELECT * FROM first_round WHERE split = 'test'), second""",
        ),
        "tuning_results": _with(
            DATED,
            f"""SELECT target, config_order, configuration,
                (SELECT COUNT(*) FROM dated WHERE is_validation) AS rows, TRUE AS has_errors
            FROM (SELECT UNNEST({ALL_TARGETS}) AS target), {GRID}""",
        ),
        "gbt_fit": _with(
            DATED,
            " UNION ALL ".join(
                f"SELECT '{t}' AS target, TRUE AS has_all_trees, 255 AS bins, TRUE AS is_best, TRUE AS gain_follows, "
                f"{r(f'VAR_POP({t})')} AS target_variance FROM dated WHERE split = 'train'"
                for t in ALL_TARGETS
            ),
        ),
        "gbt_selection_by_series": _with(
            DATED,
            f"""SELECT {ID}, target, COUNT(*) AS rows, TRUE AS is_first_of_least
            FROM dated, (SELECT UNNEST({ALL_TARGETS}) AS target) WHERE is_validation GROUP BY {ID}, target""",
        ),
        "gbt_routed_forecast": _with(DATED, f"SELECT {ROW}, TRUE AS is_its_own, TRUE AS has_forecasts FROM test"),
        "run_catalogue": _with(
            DATED,
            f"""SELECT 'check' AS run_id, 'ok' AS status, 8 AS targets,
                {r(f"AVG(ABS({DIRECT_TARGET} - quantity_mean_28d * 7))")} AS baseline_mae FROM test
            UNION ALL SELECT 'begun', 'incomplete', NULL, NULL""",
        ),
        "gbt_test_forecast": _with(
            DATED, f"SELECT {ROW}, {', '.join(ALL_TARGETS)}, TRUE AS has_forecasts FROM test"
        ),
        "model_horizon_metrics": _with(
            f"{DATED}, pairs AS (SELECT UNNEST([{_BASELINE_HORIZONS}], recursive := true) FROM test)",
            f"SELECT horizon, {r('AVG(ABS(y - p))')} AS baseline_mae, {r('SQRT(AVG((y - p) * (y - p)))')} AS baseline_rmse, "
            "TRUE AS model_follows FROM pairs GROUP BY horizon",
        ),
        "gbt_model_comparison": _with(
            f"""{DATED}, compared AS (
                SELECT UNNEST([{{'model': 'baseline_7d', 'y': {DIRECT_TARGET}, 'p': quantity_mean_7d * 7}},
                    {{'model': 'baseline_28d', 'y': {DIRECT_TARGET}, 'p': quantity_mean_28d * 7}}], recursive := true)
                FROM test
            ), errors AS ({comparison})""",
            f"""SELECT model, {SHOWN_ERRORS}, TRUE AS has_errors FROM errors UNION ALL
            SELECT UNNEST(['multi_model_7d', 'direct_7d']), COUNT(*), NULL, NULL, NULL, TRUE FROM test""",
        ),
        "gbt_prediction_examples": _with(
            DATED,
            f"SELECT {ROW}, {DIRECT_TARGET} AS actual, {r('quantity_mean_28d * 7')} AS baseline_28d, "
            f"TRUE AS has_forecasts FROM test "
            f"QUALIFY ROW_NUMBER() OVER (PARTITION BY {ID} ORDER BY transactionDate) <= 10",
        ),
        "feature_importance": f"SELECT UNNEST({[*FEATURES, 'baseline_28d_7days']}) AS feature, "
        "TRUE AS splits_add_up, TRUE AS shares_add_up",
        "model_info": f"""SELECT 'check' AS run_id, 7 AS gap_days, '{DIRECT_TARGET}' AS direct_target,
            'baseline_28d_7days' AS direct_baseline_feature, '{','.join(TARGETS)}' AS targets,
            '{','.join([*FEATURES, 'baseline_28d_7days'])}' AS features, '2' AS trees, '255' AS bins,
            'baseline_28d,baseline_7d,direct_7d,multi_model_7d' AS compared""",
        "model_registry_roundtrip": _with(
            DATED,
            f"""SELECT UNNEST({ALL_TARGETS}) AS target, (SELECT COUNT(*) FROM test) AS rows,
                CAST(0 AS BIGINT) AS differing""",
        ),
        "predict_batch": _with(
            _ANSWERS,
            "SELECT operational_unit_id, item_id, strftime(transactionDate, '%Y-%m-%d') AS last_date, status, "
            "CASE WHEN status = 'ok' THEN TRUE END AS adds_up FROM answers",
        ),
    }

"""DuckDB text for every query that SQL can express."""

from checks.rounding import rounded_sql as r
from demandcast.functions.text import EXPLANATION
from demandcast.schema import (
    ENCODED,
    FEATURES,
    FREQUENCY_WINDOWS,
    HORIZONS,
    LAGS,
    ROLLING_WINDOWS,
)

CENT, MICRO = 10000, 1000000
HOLDOUT = 365

NUMBER = "CAST(substr(p_brand, 7) AS INTEGER)"
SALES = f"""
SELECT CAST(o_orderdate AS DATE) AS date, p_brand AS product_id,
       'Product ' || {NUMBER} AS product_name,
       'CAT' || ({NUMBER} % 5) AS category,
       'SUB' || ({NUMBER} % 10) AS sub_category,
       r_name AS city_name, l_quantity AS units_sold,
       l_extendedprice * (1 - l_discount) / l_quantity AS selling_price,
       l_extendedprice / l_quantity AS mrp
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""
INVENTORY = """
SELECT p_brand AS product_id, r_name AS city_name, CAST(p_size AS DOUBLE) AS stock_quantity
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""
DAILY = """
SELECT date, product_id, product_name, category, sub_category, city_name,
       sum(units_sold) AS units_sold, count(units_sold) AS transaction_count,
       avg(selling_price) AS selling_price,
       coalesce(stddev_samp(selling_price), 0) AS price_volatility,
       min(selling_price) AS min_price, max(selling_price) AS max_price,
       avg(mrp) AS mrp, stddev_samp(mrp) AS mrp_std
FROM {source}
GROUP BY ALL
"""
STOCK = """
SELECT product_id, city_name, sum(stock_quantity) AS stock_quantity
FROM inventory GROUP BY ALL
"""
JOINED = """
SELECT d.*, coalesce(s.stock_quantity, 0) AS stock_quantity
FROM daily d LEFT JOIN stock s USING (product_id, city_name)
"""
CALENDAR = """
SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(week(date) AS INTEGER) AS week_of_year,
       CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN day(date) <= 7 THEN 1 ELSE 0 END AS is_month_start,
       CASE WHEN day(date) >= 24 THEN 1 ELSE 0 END AS is_month_end,
       CASE WHEN month(date) IN (12, 1, 2) THEN 'winter'
            WHEN month(date) IN (3, 4, 5) THEN 'spring'
            WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
       coalesce(mrp - selling_price, 0) AS price_margin,
       least(greatest(selling_price / (mrp + 1e-6), 0), 10) AS price_ratio,
       least(greatest((mrp - selling_price) / (mrp + 1e-6) * 100, 0), 100) AS discount_percent,
       CASE WHEN units_sold > 0 THEN 1 ELSE 0 END AS sold_flag
FROM joined
"""

SERIES = "PARTITION BY product_id, city_name"
ORDER = f"{SERIES} ORDER BY date, product_name, category, sub_category"


def past(expression: str, rows) -> str:
    start = "UNBOUNDED PRECEDING" if rows is None else f"{rows} PRECEDING"
    return f"{expression} OVER ({ORDER} ROWS BETWEEN {start} AND 1 PRECEDING)"


def _raw_window_columns() -> dict[str, str]:
    columns = {}
    for k in LAGS:
        columns[f"lag_units_{k}"] = f"lag(units_sold, {k}) OVER ({ORDER})"
        columns[f"lag_price_{k}"] = f"lag(selling_price, {k}) OVER ({ORDER})"
    for k in ROLLING_WINDOWS:
        columns[f"roll_mean_{k}"] = past("avg(units_sold)", k)
        columns[f"roll_std_{k}"] = past("stddev_samp(units_sold)", k)
        columns[f"roll_max_{k}"] = past("max(units_sold)", k)
        columns[f"roll_min_{k}"] = past("min(units_sold)", k)
        columns[f"roll_price_mean_{k}"] = past("avg(selling_price)", k)
    columns["expanding_mean"] = past("avg(units_sold)", None)
    columns["expanding_std"] = past("stddev_samp(units_sold)", None)
    columns["expanding_count"] = f"row_number() OVER ({ORDER})"
    for k in FREQUENCY_WINDOWS:
        columns[f"sale_frequency_{k}"] = past("avg(sold_flag)", k)
    columns["volatility_7"] = (
        f"CASE WHEN {past('count(units_sold)', 7)} >= 2 THEN "
        f"{past('stddev_pop(units_sold)', 7)} / ({past('avg(units_sold)', 7)} + 1e-6) END"
    )
    columns["series_rows"] = f"count(*) OVER ({SERIES})"
    for h in HORIZONS:
        columns[f"target_t{h}"] = f"lead(units_sold, {h}) OVER ({ORDER})"
        columns[f"target_date_t{h}"] = f"lead(date, {h}) OVER ({ORDER})"
    return columns


WINDOW_COLUMNS = _raw_window_columns()
NOT_FILLED = {"expanding_count", "series_rows"} | {f"target{d}_t{h}" for h in HORIZONS for d in ("", "_date")}
FILLED = [c for c in WINDOW_COLUMNS if c not in NOT_FILLED]
WINDOWED = "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in WINDOW_COLUMNS.items()) + " FROM calendar"
FEATURED = (
    f"SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in [*FILLED, 'mrp_std'])}), "
    "coalesce(roll_mean_7 / (roll_mean_28 + 1e-6), 1) AS trend_ratio_7_28, "
    "coalesce(roll_mean_7 - roll_mean_28, 0) AS trend_diff_7_28, "
    "target_t7 AS target FROM windowed"
)
ENCODED_ROWS = (
    "SELECT *, "
    + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_enc" for c in ENCODED)
    + " FROM featured"
)
MODEL_ROWS = "SELECT * FROM encoded WHERE series_rows > 35 AND target IS NOT NULL"
SPLIT = f"""
SELECT *, CASE WHEN date <= (SELECT max(date) FROM model_rows) - INTERVAL {HOLDOUT} DAY
          THEN 'train' ELSE 'test' END AS split
FROM model_rows
"""
NAIVE = "SELECT *, lag_units_7 AS pred_lag, roll_mean_7 AS pred_roll FROM split_rows WHERE split = 'test'"


def with_tables(select: str, clean: bool = False) -> str:
    """`select` behind the shared tables; `clean` applies the outlier filter."""
    tables = {
        "sales": SALES,
        "clean_sales": "SELECT * FROM sales WHERE units_sold <= "
        "(SELECT quantile_cont(units_sold, 0.999) FROM sales)",
        "inventory": INVENTORY,
        "daily": DAILY.format(source="clean_sales" if clean else "sales"),
        "stock": STOCK,
        "joined": JOINED,
        "calendar": CALENDAR,
        "windowed": WINDOWED,
        "featured": FEATURED,
        "encoded": ENCODED_ROWS,
        "model_rows": MODEL_ROWS,
        "split_rows": SPLIT,
        "naive": NAIVE,
    }
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in tables.items()) + "\n" + select


KEYS = "date, product_id, city_name"
PRICE_COLUMNS = {
    "selling_price", "mrp", "price_margin", "price_ratio", "discount_percent",
    "price_volatility", "min_price", "max_price", "mrp_std",
    *[f"lag_price_{k}" for k in LAGS],
    *[f"roll_price_mean_{k}" for k in ROLLING_WINDOWS],
}
UNIT_STATISTICS = {
    "expanding_mean", "expanding_std", "trend_ratio_7_28", "trend_diff_7_28", "volatility_7",
    *[f"roll_{s}_{k}" for k in ROLLING_WINDOWS for s in ("mean", "std")],
    *[f"sale_frequency_{k}" for k in FREQUENCY_WINDOWS],
}


def column_sql(name: str) -> str:
    """A column in its comparable form."""
    if name in PRICE_COLUMNS:
        return r(name, CENT)
    if name in UNIT_STATISTICS:
        return r(name, MICRO)
    return name


def columns_sql(names) -> str:
    return ", ".join(column_sql(n) for n in names)


def window_query(*names: str) -> str:
    return with_tables(f"SELECT {KEYS}, {columns_sql(names)} FROM featured")


SALES_COLUMNS = (
    "date, product_id, product_name, category, sub_category, city_name, units_sold, "
    f"{r('selling_price', CENT)}, {r('mrp', CENT)}"
)
DAILY_COLUMNS = (
    "date, product_id, product_name, category, sub_category, city_name, units_sold, "
    f"transaction_count, {columns_sql(['selling_price', 'price_volatility', 'min_price', 'max_price', 'mrp', 'mrp_std'])}"
)
NEWEST = (
    f"row_number() OVER ({SERIES} ORDER BY date DESC, product_name DESC, category DESC, "
    "sub_category DESC, units_sold DESC, selling_price DESC, mrp DESC)"
)
METRIC_NAMES = ("mae", "rmse", "mape_pct", "r2", "median_ae", "q90_ae")

METRICS = f"""
SELECT model, {', '.join(r(m, CENT) for m in METRIC_NAMES)} FROM (
SELECT model, avg(abs(target - p)) AS mae, sqrt(avg((target - p) * (target - p))) AS rmse,
       coalesce(avg(CASE WHEN target <> 0 THEN abs(target - p) / abs(target) END) * 100,
                CAST('inf' AS DOUBLE)) AS mape_pct,
       CASE WHEN var_pop(target) = 0
            THEN CASE WHEN sum((target - p) * (target - p)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1 - sum((target - p) * (target - p)) / (var_pop(target) * count(*)) END AS r2,
       quantile_cont(abs(target - p), 0.5) AS median_ae,
       quantile_cont(abs(target - p), 0.9) AS q90_ae
FROM (SELECT 'lag' AS model, target, pred_lag AS p FROM naive
      UNION ALL SELECT 'roll', target, pred_roll FROM naive)
GROUP BY model)
"""
HISTOGRAM = f"""
, residuals AS (SELECT target - pred_lag AS residual FROM naive),
ends AS (SELECT min(residual) AS lo, max(residual) AS hi FROM residuals),
edges AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS low,
                 CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS high FROM ends),
counted AS (SELECT CAST(least(floor((residual - low) / ((high - low) / 50)), 49) AS INTEGER) AS bin,
                   count(*) AS n FROM residuals, edges GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin,
       {r('low + b.range * ((high - low) / 50)', CENT, 'bin_start')},
       {r('low + (b.range + 1) * ((high - low) / 50)', CENT, 'bin_end')},
       coalesce(c.n, 0) AS count
FROM range(50) b, edges LEFT JOIN counted c ON c.bin = b.range
"""
FOLDS = f"""
SELECT {KEYS}, position,
       CASE WHEN position < n - 5 * (n // 6) THEN 0
            ELSE CAST((position - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) + 1 END AS fold
FROM (SELECT *, row_number() OVER (ORDER BY product_id, city_name, date, product_name, category, sub_category) - 1 AS position,
             count(*) OVER () AS n FROM model_rows)
"""
FOLDS_BY_DATE = f"""
SELECT {KEYS},
       CASE WHEN place < n - 5 * (n // 6) THEN 0
            ELSE CAST((place - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) + 1 END AS fold
FROM model_rows JOIN (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM model_rows)) USING (date)
"""
BLEND = f"""
, w AS (SELECT CASE WHEN avg(abs(target - pred_lag)) > 0 THEN 1 / avg(abs(target - pred_lag)) ELSE 1 END AS a,
               CASE WHEN avg(abs(target - pred_roll)) > 0 THEN 1 / avg(abs(target - pred_roll)) ELSE 1 END AS b
        FROM naive)
SELECT {KEYS}, target, pred_lag, {r('pred_roll', MICRO)},
       {r('a / (a + b) * pred_lag + b / (a + b) * pred_roll', CENT, 'pred_ensemble')}
FROM naive, w
"""
PROMPT = f"""
, latest AS (
  SELECT * FROM (SELECT *, row_number() OVER ({SERIES} ORDER BY date DESC, product_name DESC, category DESC, sub_category DESC) AS place
                 FROM featured) WHERE place = 1),
recent AS (
  SELECT product_id, city_name,
         'date,units_sold' || chr(10) || string_agg(date || ',' || units_sold, chr(10) ORDER BY place DESC) || chr(10) AS csv
  FROM (SELECT *, {NEWEST} AS place FROM sales) WHERE place <= 8 GROUP BY ALL)
SELECT l.product_id, l.city_name,
       printf('{EXPLANATION.replace("'", "''")}', l.city_name, l.product_id,
              CAST(l.lag_units_7 AS VARCHAR),
              printf('- lag: %.2f', l.lag_units_7) || chr(10) || printf('- roll: %.2f', l.roll_mean_7),
              coalesce(csv, '')) AS prompt
FROM latest l LEFT JOIN recent USING (product_id, city_name)
"""
IMPUTE = f"""
, gappy AS (SELECT * REPLACE (
     CASE WHEN transaction_count > 1 THEN NULL ELSE selling_price END AS selling_price,
     CASE WHEN category = 'CAT0' THEN NULL ELSE mrp END AS mrp) FROM daily),
medians AS (SELECT product_id, median(selling_price) AS s, median(mrp) AS m FROM gappy GROUP BY ALL),
overall AS (SELECT median(selling_price) AS s, median(mrp) AS m FROM gappy)
SELECT {KEYS}, {r('coalesce(g.selling_price, p.s, o.s)', CENT, 'selling_price')},
       {r('coalesce(g.mrp, p.m, o.m)', CENT, 'mrp')}
FROM gappy g JOIN medians p USING (product_id), overall o
"""

DATED = """
    WITH texts AS (
        SELECT o_orderkey, CASE
            WHEN o_orderstatus = 'P' THEN ''
            WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderpriority LIKE '2%' THEN strftime(o_orderdate, '%d.%m.%Y')
            WHEN o_orderpriority LIKE '3%' THEN 'soon'
            ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date
        FROM orders),
    formats (place, date_format) AS (VALUES
        (0, 'yyyy-M-d'), (1, 'yyyy/M/d'), (2, 'yyyyMMdd'), (3, 'M/d/yyyy'), (4, 'd/M/yyyy'), (5, 'M-d-yyyy'),
        (6, 'd-M-yyyy'), (7, 'd.M.yyyy'), (8, 'yyyy-M-d H:m:s')),
    tries AS (
        SELECT o_orderkey, date, place, date_format, CAST(CASE place
            WHEN 0 THEN try_strptime(date, '%Y-%m-%d') WHEN 1 THEN try_strptime(date, '%Y/%m/%d')
            WHEN 2 THEN try_strptime(date, '%Y%m%d') WHEN 3 THEN try_strptime(date, '%m/%d/%Y')
            WHEN 4 THEN try_strptime(date, '%d/%m/%Y') WHEN 5 THEN try_strptime(date, '%m-%d-%Y')
            WHEN 6 THEN try_strptime(date, '%d-%m-%Y') WHEN 7 THEN try_strptime(date, '%d.%m.%Y')
            WHEN 8 THEN try_strptime(date, '%Y-%m-%d %H:%M:%S') END AS DATE) AS day
        FROM texts, formats),
    fits AS (
        SELECT place, date_format, count(*) FILTER (WHERE date <> '') AS n_texts, count(day) AS n_fit,
            arg_min(day IS NOT NULL, o_orderkey) FILTER (WHERE date <> '') AS fits_first
        FROM tries GROUP BY ALL)"""

ORACLE = {
    "scan_sales": with_tables(f"SELECT {SALES_COLUMNS} FROM sales"),
    "scan_inventory": with_tables("SELECT * FROM inventory"),
    "normalize_columns": "SELECT * FROM part",
    "parse_dates": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'O'""",
    "date_formats": DATED + """
        SELECT place, date_format, n_texts, n_fit, fits_first FROM fits""",
    "infer_dates": DATED + """
        SELECT o_orderkey, day AS date FROM tries
        WHERE place = (SELECT place FROM fits ORDER BY n_fit DESC, place LIMIT 1) AND day IS NOT NULL""",
    "date_quarantine": DATED + """
        SELECT o_orderkey, any_value(date) AS date,
            CASE WHEN any_value(date) = '' THEN 'missing' WHEN count(day) > 0 THEN 'other format' ELSE 'no date' END AS reason
        FROM tries GROUP BY o_orderkey
        HAVING count(day) FILTER (WHERE place = (SELECT min(place) FROM fits WHERE fits_first)) = 0""",
    "outlier_filter": """
        SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem)""",
    "daily_sales": with_tables(f"SELECT {DAILY_COLUMNS} FROM daily"),
    "inventory_stock": with_tables("SELECT * FROM stock"),
    "join_inventory": with_tables(f"SELECT {KEYS}, units_sold, stock_quantity FROM joined"),
    "impute_median": with_tables(IMPUTE),
    "data_profile": with_tables("""
        SELECT 'sales' AS table_name, count(*) AS row_count, min(date) AS min_date, max(date) AS max_date FROM sales
        UNION ALL SELECT 'inventory', count(*), NULL, NULL FROM inventory
        UNION ALL SELECT 'daily', count(*), min(date), max(date) FROM daily"""),
    "dim_values": with_tables("""
        SELECT DISTINCT 'city_name' AS column, city_name AS value FROM sales
        UNION ALL SELECT DISTINCT 'product_id', product_id FROM sales"""),
    "calendar_features": window_query(
        "day_of_week", "day_of_month", "month", "quarter", "week_of_year",
        "is_weekend", "is_month_start", "is_month_end", "season"),
    "price_features": window_query("price_margin", "price_ratio", "discount_percent"),
    "lag_units": window_query(*[f"lag_units_{k}" for k in LAGS]),
    "lag_price": window_query(*[f"lag_price_{k}" for k in LAGS]),
    "rolling_units": window_query(
        *[f"roll_{s}_{k}" for k in ROLLING_WINDOWS for s in ("mean", "std", "max", "min")]),
    "rolling_price": window_query(*[f"roll_price_mean_{k}" for k in ROLLING_WINDOWS]),
    "expanding_units": window_query("expanding_mean", "expanding_std", "expanding_count"),
    "trend_features": window_query("trend_ratio_7_28", "trend_diff_7_28"),
    "sale_frequency": window_query("sold_flag", *[f"sale_frequency_{k}" for k in FREQUENCY_WINDOWS]),
    "volatility": window_query("volatility_7"),
    "target_dates": window_query(*[f"target_date_t{h}" for h in HORIZONS]),
    "multi_horizon_targets": window_query(*[f"target_t{h}" for h in HORIZONS], "target"),
    "min_history": with_tables(
        f"SELECT {KEYS}, units_sold FROM featured WHERE series_rows > 35"),
    "encoder_vocab": with_tables("\nUNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS column, {c} AS value, {c}_enc AS code FROM encoded"
        for c in ENCODED), clean=True),
    "label_encode": with_tables(
        f"SELECT {KEYS}, {', '.join(f'{c}_enc' for c in ENCODED)} FROM encoded", clean=True),
    "model_rows": with_tables(f"SELECT {KEYS}, units_sold, target FROM model_rows", clean=True),
    "feature_matrix": with_tables(
        f"SELECT {KEYS}, {columns_sql(FEATURES)}, target FROM model_rows", clean=True),
    "feature_catalog": with_tables(
        "SELECT CAST(f.ordinal AS INTEGER) AS ordinal, f.feature, m.value_count FROM (VALUES "
        + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))
        + ") f(ordinal, feature), (SELECT count(*) AS value_count FROM model_rows) m", clean=True),
    "target_stats": with_tables(
        "SELECT count(*) AS samples, " + ", ".join(
            [r("avg(target)", MICRO, "mean"), r("stddev_samp(target)", MICRO, "std")])
        + ", min(target) AS min, max(target) AS max FROM model_rows", clean=True),
    "holdout_split": with_tables(f"SELECT {KEYS}, target, split FROM split_rows", clean=True),
    "cv_folds": with_tables(FOLDS, clean=True),
    "cv_folds_by_date": with_tables(FOLDS_BY_DATE, clean=True),
    "model_metrics": with_tables(METRICS, clean=True),
    "daily_error": with_tables(
        f"SELECT date, {r('avg(abs(target - pred_roll))', CENT, 'mean_abs_error')} FROM naive GROUP BY date",
        clean=True),
    "residual_histogram": with_tables(HISTOGRAM, clean=True),
    "weighted_ensemble": with_tables(BLEND, clean=True),
    "pair_history": with_tables(
        f"SELECT {SALES_COLUMNS} FROM sales WHERE city_name = 'ASIA' AND product_id = 'Brand#12'"),
    "recent_history": with_tables(
        f"SELECT {SALES_COLUMNS}, recency FROM (SELECT *, CAST({NEWEST} AS INTEGER) AS recency FROM sales) WHERE recency <= 10"),
    "latest_per_pair": with_tables(
        f"SELECT {SALES_COLUMNS} FROM (SELECT *, {NEWEST} AS place FROM sales) WHERE place = 1"),
    "align_features": with_tables(
        "SELECT date, city_name, TRY_CAST(product_id AS DOUBLE) IS NULL AS text_id, "
        + ", ".join({
            "product_id_enc": "0.0 :: DOUBLE AS product_id_enc",
            "selling_price": r("selling_price", CENT),
            "mrp": r("mrp", CENT),
            "stock_quantity": "coalesce(TRY_CAST(CASE WHEN category = 'CAT1' THEN 'n/a' ELSE CAST(units_sold AS VARCHAR) END AS DOUBLE), 0) AS stock_quantity",
        }.get(f, f"CAST(0 AS DOUBLE) AS {f}") for f in FEATURES)
        + " FROM sales"),
    "explain_prompt": with_tables(PROMPT),
}
ORACLE["feature_blocks"] = with_tables(
    f"SELECT {KEYS}, {columns_sql([c for c in WINDOW_COLUMNS if c in FEATURES])}, series_rows, target FROM featured")
ORACLE["expanding_shifted"] = with_tables(
    f"SELECT {KEYS}, expanding_count, true AS same_mean, true AS same_std FROM featured")
ORACLE["unseen_labels"] = with_tables(
    f"""SELECT {KEYS}, CAST(coalesce(code, -1) AS INTEGER) AS product_id_enc
        FROM daily LEFT JOIN (
            SELECT product_id, rank() OVER (ORDER BY product_id) - 1 AS code
            FROM (SELECT DISTINCT product_id FROM daily WHERE product_id <> 'Brand#12')
        ) USING (product_id)""")

"""DuckDB twins of the registered queries (the correctness oracle).

Each string runs on the driver's pre-registered views.  ``READINGS`` is the
same binding as ``terrapanel.sources.tables.readings``.
"""

from terrapanel import fixed_values as FV

READINGS = """
readings AS (
  SELECT r.r_name AS state, n.n_name AS district,
         CAST(o.o_orderdate AS DATE) AS reading_date,
         CAST(year(o.o_orderdate) AS INTEGER) AS Year,
         CAST(month(o.o_orderdate) AS INTEGER) AS Month_num,
         CAST(day(o.o_orderdate) AS INTEGER) AS Day,
         o.o_totalprice / 30000.0 AS moisture,
         o.o_orderkey AS row_id
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

PANEL_WINDOW = "PARTITION BY state, district ORDER BY Year, Month_num, Day, row_id"


def with_readings(body: str, *ctes: str) -> str:
    parts = [READINGS, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


SQL: dict[str, str] = {}


def R4(expr: str) -> str:
    """Same output rounding as the Spark side (1e-9 nudge, 4 places)."""
    return f"round(({expr}) + 1e-9, 4)"

SQL["rank_latest_smoothed"] = with_readings(
    """
SELECT state, district, CAST(max_year AS BIGINT) AS max_year,
       round((lag_1) + 1e-9, 4) AS latest_lag_1, round((rolling_3) + 1e-9, 4) AS latest_rolling_3,
       CAST(row_number() OVER (PARTITION BY state ORDER BY rolling_3 DESC NULLS LAST, district)
            AS BIGINT) AS district_rank
FROM (
  SELECT m.state, m.district, m.max_year,
         (SELECT f2.lag_1 FROM f f2 WHERE f2.state = m.state AND f2.district = m.district
            AND f2.Year = m.max_year AND f2.lag_1 IS NOT NULL
          ORDER BY f2.Month_num DESC, f2.Day DESC, f2.row_id DESC LIMIT 1) AS lag_1,
         (SELECT f3.rolling_3 FROM f f3 WHERE f3.state = m.state AND f3.district = m.district
            AND f3.Year = m.max_year AND f3.rolling_3 IS NOT NULL
          ORDER BY f3.Month_num DESC, f3.Day DESC, f3.row_id DESC LIMIT 1) AS rolling_3
  FROM (SELECT state, district, max(Year) AS max_year FROM f GROUP BY state, district) m
) t""",
    f"""f AS (
  SELECT *, lag(moisture, 1) OVER ({PANEL_WINDOW}) AS lag_1,
         avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3
  FROM readings)""")


def _calendar_cte() -> str:
    from terrapanel.plans.catalog import BINDING_CALENDAR

    rows = [f"('{s}', '{m}', '{season}')" for s, seasons in BINDING_CALENDAR.items()
            for season, months in seasons.items() for m in months]
    return "cal(cal_state, cal_month, cal_season) AS (VALUES " + ", ".join(rows) + ")"


GAPS = """gaps AS (
  SELECT state, district, reading_date, Year, Month_num, Day,
         CASE WHEN moisture >= 0.1 THEN moisture END AS moisture, row_id
  FROM readings)"""

MONTHS_LIST = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"

TAGGED = f"""tagged AS (
  SELECT r.*, t.Month, coalesce(cal.cal_season, 'Unknown') AS Season
  FROM readings r
  CROSS JOIN LATERAL (SELECT {MONTHS_LIST}[r.Month_num] AS Month) t
  LEFT JOIN cal ON upper(trim(r.state)) = cal.cal_state AND t.Month = cal.cal_month)"""

SQL["clean_merge_readings"] = with_readings(
    """
SELECT DISTINCT state, district, CAST(reading_date AS VARCHAR) AS reading_date, Year, Month_num, Day,
       round((moisture) + 1e-9, 4) AS moisture, row_id
FROM (SELECT * FROM gaps UNION ALL SELECT * FROM gaps) u
WHERE state IS NOT NULL AND district IS NOT NULL AND reading_date IS NOT NULL AND Year IS NOT NULL
  AND Month_num IS NOT NULL AND Day IS NOT NULL AND moisture IS NOT NULL AND row_id IS NOT NULL""",
    GAPS)

SQL["data_checks"] = with_readings(
    """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_columns,
       CAST(sum(CASE WHEN moisture IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_nulls,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) AS BIGINT) AS n_duplicates
FROM (SELECT * FROM gaps UNION ALL SELECT * FROM gaps) u""",
    GAPS)

SQL["null_counts"] = with_readings(
    """
SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'state' AS column_name, count(*) - count(state) AS null_count FROM gaps
  UNION ALL SELECT 'district', count(*) - count(district) FROM gaps
  UNION ALL SELECT 'reading_date', count(*) - count(reading_date) FROM gaps
  UNION ALL SELECT 'Year', count(*) - count(Year) FROM gaps
  UNION ALL SELECT 'Month_num', count(*) - count(Month_num) FROM gaps
  UNION ALL SELECT 'Day', count(*) - count(Day) FROM gaps
  UNION ALL SELECT 'moisture', count(*) - count(moisture) FROM gaps
  UNION ALL SELECT 'row_id', count(*) - count(row_id) FROM gaps) x""",
    GAPS)

SQL["duplicate_members"] = with_readings(
    """
SELECT r.state, r.district, CAST(count(*) AS BIGINT) AS dup_rows
FROM readings r
JOIN (SELECT state, district, reading_date FROM readings
      GROUP BY state, district, reading_date HAVING count(*) > 1) d
  ON r.state IS NOT DISTINCT FROM d.state AND r.district IS NOT DISTINCT FROM d.district
 AND r.reading_date IS NOT DISTINCT FROM d.reading_date
GROUP BY r.state, r.district""")

SQL["season_counts"] = with_readings(
    "SELECT Season, CAST(count(*) AS BIGINT) AS n_rows FROM tagged GROUP BY Season",
    _calendar_cte(), TAGGED)

FEATURES_CTE = f"""feat AS (
  SELECT *,
    lag(moisture, 1) OVER ({PANEL_WINDOW}) AS lag_1,
    lag(moisture, 7) OVER ({PANEL_WINDOW}) AS lag_7,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_6,
    count(*) OVER (PARTITION BY state) * 1.0 / count(*) OVER () AS state_freq,
    CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_id,
    ln(1 + greatest(moisture, 0)) AS target_log1p,
    row_number() OVER (ORDER BY moisture, state, district, Year, Month_num, Day, row_id) AS rk,
    count(moisture) OVER () AS n_present,
    sin(2 * pi() * Month_num / 12.0) AS month_sin,
    cos(2 * pi() * Month_num / 12.0) AS month_cos,
    Month AS Month_name,
    trim(replace(upper(Season), '_', ' ')) AS Season_up,
    CAST(CASE trim(replace(upper(Season), '_', ' '))
      WHEN 'WINTER' THEN 1 WHEN 'SUMMER' THEN 2 WHEN 'MONSOON' THEN 3
      WHEN 'POST MONSOON' THEN 4 WHEN 'POST-MONSOON' THEN 4 WHEN 'POSTMONSOON' THEN 4 END AS INTEGER)
      AS Season_num
  FROM tagged)"""

SQL["features_panel"] = with_readings(
    """
SELECT state, district, row_id, Month_num, Month_name, Season, Season_up, Season_num, district_id,
       CASE WHEN 3 * (rk - 1) < n_present - 1 THEN 'Low'
            WHEN 3 * (rk - 1) < 2 * (n_present - 1) THEN 'Medium' ELSE 'High' END AS moisture_class,
       round((lag_1) + 1e-9, 4) AS lag_1, round((lag_7) + 1e-9, 4) AS lag_7, round((rolling_3) + 1e-9, 4) AS rolling_3,
       round((rolling_6) + 1e-9, 4) AS rolling_6, round((state_freq) + 1e-9, 4) AS state_freq,
       round((month_sin) + 1e-9, 4) AS month_sin, round((month_cos) + 1e-9, 4) AS month_cos,
       round((target_log1p) + 1e-9, 4) AS target_log1p
FROM feat""",
    _calendar_cte(), TAGGED, FEATURES_CTE)

EVENTS_WINDOW = ("PARTITION BY event_type, user_id ORDER BY year(ts), month(ts), day(ts), event_id")
SQL["events_lookback"] = f"""
SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, event_id,
  round((lag(value, 1) OVER ({EVENTS_WINDOW})) + 1e-9, 4) AS lag_1,
  round((lag(value, 7) OVER ({EVENTS_WINDOW})) + 1e-9, 4) AS lag_7,
  round((avg(value) OVER ({EVENTS_WINDOW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) + 1e-9, 4) AS rolling_3,
  round((avg(value) OVER ({EVENTS_WINDOW} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) + 1e-9, 4) AS rolling_6
FROM events"""


SQL["eda_describe"] = with_readings(f"""
SELECT CAST(count(moisture) AS BIGINT) AS count, {R4('avg(moisture)')} AS mean,
       {R4('stddev_samp(moisture)')} AS std, {R4('min(moisture)')} AS min,
       {R4('quantile_cont(moisture, 0.25)')} AS p25, {R4('quantile_cont(moisture, 0.5)')} AS p50,
       {R4('quantile_cont(moisture, 0.75)')} AS p75, {R4('max(moisture)')} AS max,
       {R4('skewness(moisture)')} AS skew
FROM readings""")


def _hist_sql(expr: str) -> str:
    return with_readings(f"""
SELECT bin, CAST(count(*) AS BIGINT) AS n,
       {R4('mn + (bin - 1) * (mx - mn) / 60')} AS bin_lo, {R4('mn + bin * (mx - mn) / 60')} AS bin_hi
FROM (
  SELECT CASE WHEN mx - mn > 0 THEN least(CAST(floor((x - mn) * 60 / (mx - mn)) AS INTEGER) + 1, 60)
              ELSE 1 END AS bin, mn, mx
  FROM (SELECT x, min(x) OVER () AS mn, max(x) OVER () AS mx
        FROM (SELECT {expr} AS x FROM readings) v WHERE x IS NOT NULL) s) b
GROUP BY bin, mn, mx""")


SQL["eda_histogram"] = _hist_sql("moisture")
SQL["eda_histogram_log1p"] = _hist_sql("ln(1 + greatest(moisture, 0))")

SQL["eda_month_year_mean"] = with_readings(f"""
SELECT Month_num, Year, {R4('avg(moisture)')} AS mean_value FROM readings
WHERE Month_num IS NOT NULL AND Year IS NOT NULL GROUP BY Month_num, Year""")

SQL["eda_state_mean"] = with_readings(f"""
SELECT state, {R4('avg(moisture)')} AS mean_value FROM readings WHERE state IS NOT NULL GROUP BY state""")

SQL["eda_month_mean"] = with_readings(f"""
SELECT Month_num, {R4('avg(moisture)')} AS mean_value FROM readings
WHERE Month_num IS NOT NULL GROUP BY Month_num""")

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_corr_parts = []
for _i, _a in enumerate(_LI):
    for _j, _b in enumerate(_LI):
        val = "1.0" if _a == _b else f"corr({_a}, {_b})"
        src = "" if _a == _b else " FROM lineitem"
        _corr_parts.append(f"SELECT '{_a}' AS col_a, '{_b}' AS col_b, {R4(val)} AS corr{src}")
SQL["eda_correlation"] = "\nUNION ALL\n".join(_corr_parts)

SQL["eda_monthly_resample"] = with_readings(f"""
SELECT s.district, CAST(s.month_start AS VARCHAR) AS month_start, {R4('a.mean_value')} AS mean_value
FROM (SELECT district, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS month_start
      FROM (SELECT district, date_trunc('month', reading_date) AS m FROM readings
            WHERE district IS NOT NULL AND reading_date IS NOT NULL) x GROUP BY district) s
LEFT JOIN (SELECT district, CAST(date_trunc('month', reading_date) AS DATE) AS month_start,
                  avg(moisture) AS mean_value
           FROM readings WHERE district IS NOT NULL AND reading_date IS NOT NULL
           GROUP BY 1, 2) a
  ON s.district = a.district AND s.month_start = a.month_start""")

SQL["eda_season_box"] = with_readings(f"""
SELECT q.Season, CAST(q.n AS BIGINT) AS n, {R4('q1')} AS q1, {R4('median')} AS median, {R4('q3')} AS q3,
       {R4('q3 - q1')} AS iqr,
       {R4('min(CASE WHEN t.moisture >= q1 - 1.5 * (q3 - q1) THEN t.moisture END)')} AS whisker_lo,
       {R4('max(CASE WHEN t.moisture <= q3 + 1.5 * (q3 - q1) THEN t.moisture END)')} AS whisker_hi
FROM (SELECT Season, count(moisture) AS n, quantile_cont(moisture, 0.25) AS q1,
             quantile_cont(moisture, 0.5) AS median, quantile_cont(moisture, 0.75) AS q3
      FROM tagged WHERE moisture IS NOT NULL GROUP BY Season) q
JOIN tagged t ON t.Season = q.Season AND t.moisture IS NOT NULL
GROUP BY q.Season, q.n, q.q1, q.median, q.q3""", _calendar_cte(), TAGGED)


# ---------------------------------------------------------------- serving (Q6–Q10)
FEAT2 = f"""feat2 AS (
  SELECT *,
    lag(moisture, 1) OVER ({PANEL_WINDOW}) AS lag_1,
    lag(moisture, 7) OVER ({PANEL_WINDOW}) AS lag_7,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_6,
    count(*) OVER (PARTITION BY state) * 1.0 / count(*) OVER () AS state_freq,
    CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_id
  FROM readings)"""


def _latest(c: str) -> str:
    return (f"(SELECT x.{c} FROM feat2 x WHERE x.state = m.state AND x.district = m.district "
            f"AND x.Year = m.max_year AND x.{c} IS NOT NULL "
            f"ORDER BY x.Month_num DESC, x.Day DESC, x.row_id DESC LIMIT 1) AS {c}")


PRI = ("pri AS (SELECT m.state, m.district, m.max_year, "
       + ", ".join(_latest(c) for c in ["lag_1", "lag_7", "rolling_3", "rolling_6", "state_freq", "district_id"])
       + " FROM (SELECT state, district, max(Year) AS max_year FROM feat2 WHERE Year IS NOT NULL "
         "GROUP BY state, district) m)")
SEASONAL = """seasonal AS (
  SELECT state, district, Month_num, avg(moisture) AS Seasonal FROM readings
  WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL
  GROUP BY state, district, Month_num)"""
SCORED = """scored AS (
  SELECT g.state, g.district, g.Month_num, s.Seasonal, g.Persistence,
         CASE WHEN s.Seasonal IS NOT NULL THEN (s.Seasonal + g.Persistence) / 2 END AS Ensemble,
         CASE WHEN s.Seasonal IS NOT NULL THEN (s.Seasonal + g.Persistence) / 2 ELSE g.Persistence END
           AS pred_moisture
  FROM (SELECT p.state, p.district, mo.Month_num, coalesce(p.rolling_3, 0.0) AS Persistence
        FROM pri p CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS Month_num) mo) g
  LEFT JOIN seasonal s ON s.state = g.state AND s.district = g.district AND s.Month_num = g.Month_num)"""

SQL["serve_priors"] = with_readings(f"""
SELECT state, district, CAST(max_year AS BIGINT) AS max_year, {R4('lag_1')} AS lag_1, {R4('lag_7')} AS lag_7,
       {R4('rolling_3')} AS rolling_3, {R4('rolling_6')} AS rolling_6, {R4('state_freq')} AS state_freq,
       CAST(district_id AS BIGINT) AS district_id
FROM pri""", FEAT2, PRI)

SQL["serve_ranking"] = with_readings(f"""
SELECT state, district, Month_num, {R4('Seasonal')} AS Seasonal, {R4('Persistence')} AS Persistence,
       {R4('Ensemble')} AS Ensemble, {R4('pred_moisture')} AS pred_moisture,
       CAST(row_number() OVER (PARTITION BY state, Month_num ORDER BY pred_moisture DESC NULLS LAST, district)
            AS BIGINT) AS rank
FROM scored""", FEAT2, PRI, SEASONAL, SCORED)

MONTH_TITLES = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

SQL["serve_projection"] = with_readings(f"""
SELECT g.state, g.district, g.start_month, g.step, g.Month_num, {MONTH_TITLES}[g.Month_num] AS month,
       {R4('s.Seasonal')} AS Seasonal, {R4('g.Persistence')} AS Persistence,
       {R4('CASE WHEN s.Seasonal IS NOT NULL THEN (s.Seasonal + g.Persistence) / 2 END')} AS Ensemble
FROM (SELECT p.state, p.district, sm.start_month, st.step,
             CAST(((sm.start_month - 1 + st.step) % 12) + 1 AS INTEGER) AS Month_num,
             coalesce(p.rolling_3, 0.0) AS Persistence
      FROM pri p CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS start_month) sm
      CROSS JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS step) st) g
LEFT JOIN seasonal s ON s.state = g.state AND s.district = g.district AND s.Month_num = g.Month_num""",
    FEAT2, PRI, SEASONAL)

SQL["serve_profile"] = with_readings(f"""
SELECT state, district, Month_num, {MONTH_TITLES}[Month_num] AS Month, {R4('avg(moisture)')} AS mean_moisture
FROM readings WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL
GROUP BY state, district, Month_num""")

_YEARS = list(range(1995, 2002))
SQL["serve_heatmap"] = with_readings(
    "SELECT d.state, d.district, mo.Month_num, "
    + ", ".join(f"{R4(f'p.y{y}')} AS \"{y}\"" for y in _YEARS)
    + """
FROM (SELECT DISTINCT state, district FROM readings
      WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL AND Year IS NOT NULL) d
CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS Month_num) mo
LEFT JOIN (SELECT state, district, Month_num, """
    + ", ".join(f"avg(CASE WHEN Year = {y} THEN moisture END) AS y{y}" for y in _YEARS)
    + """ FROM readings WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL
      AND Year IS NOT NULL GROUP BY state, district, Month_num) p
  ON p.state = d.state AND p.district = d.district AND p.Month_num = mo.Month_num""")

SQL["serve_year_plots"] = with_readings(f"""
SELECT state, district, Year, Month_num, {R4('avg(moisture)')} AS mean_moisture,
       CAST(count(*) AS BIGINT) AS n_rows
FROM readings WHERE Year IN (1999, 2000) AND state IS NOT NULL AND district IS NOT NULL
  AND Month_num IS NOT NULL
GROUP BY state, district, Year, Month_num""")


def _varieties_cte() -> str:
    from terrapanel.fixed_values import STATE_VARIETIES

    rows = []
    for k, v in STATE_VARIETIES.items():
        if k == "DEFAULT":
            continue
        items = ", ".join("'" + x.replace("'", "''") + "'" for x in v)
        rows.append(f"('{k}', [{items}])")
    return "var(var_state, varieties) AS (VALUES " + ", ".join(rows) + ")"


def _advice_sql() -> str:
    from terrapanel import fixed_values as FV

    default = "[" + ", ".join("'" + x + "'" for x in FV.STATE_VARIETIES["DEFAULT"]) + "]"
    lab = "CASE WHEN grp IS NULL THEN 'Unknown'"
    txt = "CASE WHEN grp IS NULL THEN 'Prediction not available.'"
    for name, (label, tmpl) in FV.CROP_ADVICE.items():
        lab += f" WHEN grp = '{name}' THEN '{label}'"
        if "{v}" in tmpl:
            before, after = tmpl.split("{v}")
            txt += f" WHEN grp = '{name}' THEN '{before}' || array_to_string(vv[1:2], ', ') || '{after}'"
        else:
            txt += f" WHEN grp = '{name}' THEN '{tmpl}'"
    lab += " END"
    txt += " END"
    cuts = "CASE WHEN pr IS NULL THEN NULL" + "".join(
        f" WHEN pr < {c} THEN '{n}'" for c, n in FV.MOISTURE_GROUP_CUTS) + f" ELSE '{FV.MOISTURE_GROUP_TOP}' END"
    return f"""
base AS (
  SELECT sc.state, sc.district, sc.Month_num, sc.pred_moisture AS pr, ms.hist_mean, ms.hist_std,
         mp.p10, mp.p25, mp.p50, mp.p75, mp.p90,
         CASE WHEN dp.auto_low IS NOT NULL AND dp.auto_high IS NOT NULL THEN dp.auto_low ELSE 5.0 END AS low_thresh,
         CASE WHEN dp.auto_low IS NOT NULL AND dp.auto_high IS NOT NULL THEN dp.auto_high ELSE 10.0 END AS high_thresh,
         coalesce(var.varieties, {default}) AS vv
  FROM scored sc
  LEFT JOIN (SELECT state, district, Month_num, avg(moisture) AS hist_mean, stddev_pop(moisture) AS hist_std
             FROM readings WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL
             GROUP BY 1, 2, 3) ms
    ON ms.state = sc.state AND ms.district = sc.district AND ms.Month_num = sc.Month_num
  LEFT JOIN (SELECT state, district, Month_num, quantile_cont(moisture, 0.10) AS p10,
                    quantile_cont(moisture, 0.25) AS p25, quantile_cont(moisture, 0.50) AS p50,
                    quantile_cont(moisture, 0.75) AS p75, quantile_cont(moisture, 0.90) AS p90
             FROM readings WHERE moisture IS NOT NULL AND state IS NOT NULL AND district IS NOT NULL
               AND Month_num IS NOT NULL GROUP BY 1, 2, 3) mp
    ON mp.state = sc.state AND mp.district = sc.district AND mp.Month_num = sc.Month_num
  LEFT JOIN (SELECT state, district, quantile_cont(moisture, 0.25) AS auto_low,
                    quantile_cont(moisture, 0.75) AS auto_high
             FROM readings WHERE moisture IS NOT NULL AND state IS NOT NULL AND district IS NOT NULL
             GROUP BY 1, 2) dp
    ON dp.state = sc.state AND dp.district = sc.district
  LEFT JOIN var ON upper(trim(sc.state)) = var.var_state),
adv AS (
  SELECT *,
    CASE WHEN pr IS NULL THEN NULL
         WHEN pr < (CASE WHEN p25 IS NOT NULL AND p75 IS NOT NULL THEN p25 ELSE low_thresh END) THEN 'LOW'
         WHEN pr > (CASE WHEN p25 IS NOT NULL AND p75 IS NOT NULL THEN p75 ELSE high_thresh END) THEN 'HIGH'
         ELSE 'MEDIUM' END AS category,
    CASE WHEN hist_mean IS NOT NULL AND hist_mean <> 0 THEN (pr - hist_mean) / hist_mean * 100.0 END
      AS above_below_pct,
    CASE WHEN p10 IS NOT NULL THEN
           CASE WHEN pr < p10 THEN 'Severe' WHEN pr < p25 THEN 'Moderate' ELSE 'None' END
         WHEN hist_mean IS NOT NULL THEN
           CASE WHEN pr < 0.7 * hist_mean THEN 'Severe'
                WHEN hist_mean <> 0 AND (hist_mean - pr) / hist_mean > 0.30 THEN 'Moderate'
                ELSE 'None' END
         ELSE 'None' END AS stress,
    {cuts} AS grp,
    CASE WHEN hist_std IS NOT NULL AND hist_mean IS NOT NULL
              AND hist_std > greatest(0.1, 0.3 * greatest(1.0, abs(hist_mean)))
         THEN ' (high uncertainty)' ELSE '' END AS uncertainty,
    CASE WHEN hist_std IS NULL THEN NULL
         WHEN hist_mean IS NULL OR hist_mean = 0 THEN 0.0
         ELSE hist_std / greatest(hist_mean, 0.1) END AS volatility
  FROM base),
adv2 AS (
  SELECT *, {lab} AS crop_suggestion, {txt} AS crop_explanation,
    CASE stress WHEN 'Severe' THEN 'Irrigate urgently' WHEN 'Moderate' THEN 'Consider irrigation soon'
         ELSE 'No immediate irrigation required' END AS irrigation_advice,
    CASE WHEN volatility IS NULL THEN NULL WHEN volatility > 0.5 THEN 'High'
         WHEN volatility > 0.3 THEN 'Moderate' ELSE 'Low' END AS volatility_label
  FROM adv)"""


SQL["serve_farmer_summary"] = with_readings(f"""
SELECT state, district, Month_num, {R4('pr')} AS "primary", {R4('hist_mean')} AS hist_mean,
       {R4('hist_std')} AS hist_std, {R4('p10')} AS p10, {R4('p25')} AS p25, {R4('p50')} AS p50,
       {R4('p75')} AS p75, {R4('p90')} AS p90, {R4('low_thresh')} AS low_thresh,
       {R4('high_thresh')} AS high_thresh, {R4('above_below_pct')} AS above_below_pct,
       {R4('volatility')} AS volatility, category, stress, grp AS moisture_group, crop_suggestion,
       crop_explanation, irrigation_advice, uncertainty, volatility_label,
       CASE WHEN pr IS NULL THEN 'Prediction not available' ELSE concat_ws(' • ',
         'Predicted moisture: ' || printf('%.2f', round(pr + 1e-9, 2)),
         'Category: ' || category,
         CASE WHEN above_below_pct IS NOT NULL THEN
           CAST(CAST(round(abs(above_below_pct) + 1e-9, 0) AS BIGINT) AS VARCHAR) || '% '
           || CASE WHEN above_below_pct > 0 THEN 'above' ELSE 'below' END || ' normal' END,
         CASE stress WHEN 'Severe' THEN '⚠️ Severe water stress likely'
                     WHEN 'Moderate' THEN '⚠️ Moderate water stress likely'
                     ELSE 'No severe water stress predicted' END,
         crop_suggestion || ': ' || crop_explanation || uncertainty) END AS summary
FROM adv2""", FEAT2, PRI, SEASONAL, SCORED, _varieties_cte(), _advice_sql())


# ---------------------------------------------------------------- evaluation
FC = f"""fc AS (
  SELECT *,
    lag(moisture, 1) OVER ({PANEL_WINDOW}) AS Persistence,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS Mean3,
    avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS Mean6
  FROM readings)"""
FL = """fl AS (
  SELECT Year, moisture, 'Persistence' AS model, Persistence AS pred FROM fc
  UNION ALL SELECT Year, moisture, 'Mean3', Mean3 FROM fc
  UNION ALL SELECT Year, moisture, 'Mean6', Mean6 FROM fc)"""


def _reg_metrics(where: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(count(*) AS BIGINT) AS n,
  {R4('avg(abs(pred - moisture))')} AS MAE,
  {R4('sqrt(avg((pred - moisture) * (pred - moisture)))')} AS RMSE,
  {R4('CASE WHEN var_pop(moisture) * count(*) > 0 THEN 1 - sum((pred - moisture) * (pred - moisture)) / (var_pop(moisture) * count(*)) END')} AS R2
FROM fl WHERE pred IS NOT NULL AND moisture IS NOT NULL {where}
GROUP BY {keys}"""


SQL["eval_regression"] = with_readings(_reg_metrics("AND Year = 2000", "model"), FC, FL)
SQL["eval_metrics_roundtrip"] = with_readings(
    "SELECT 'regression_results_' || CAST(Year AS VARCHAR) || '.json' AS source_file, model, MAE, RMSE, R2 FROM ("
    + _reg_metrics("", "Year, model") + ") m", FC, FL)


def _grp(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 4.0 THEN 'very_low' WHEN {x} < 8.0 THEN 'low_moderate' "
            f"WHEN {x} < 12.0 THEN 'moderate_high' ELSE 'high' END")


VOTED = f"""vg AS (
  SELECT fc.row_id, {_grp('fc.moisture')} AS truth, {_grp('fc.Persistence')} AS by_last,
         {_grp('fc.Mean3')} AS by_mean3, {_grp('s.Seasonal')} AS by_season
  FROM fc LEFT JOIN seasonal s ON s.state = fc.state AND s.district = fc.district AND s.Month_num = fc.Month_num),
votes AS (SELECT row_id, v FROM (SELECT row_id, unnest([by_last, by_mean3, by_season]) AS v FROM vg) x
          WHERE v IS NOT NULL),
vsel AS (SELECT row_id, v AS vote FROM (
           SELECT row_id, v, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, v) AS rn
           FROM (SELECT row_id, v, count(*) AS c FROM votes GROUP BY row_id, v) vc) r WHERE rn = 1),
labeled AS (SELECT vg.truth AS y, vsel.vote AS p FROM vg LEFT JOIN vsel ON vsel.row_id = vg.row_id)"""


def _report(src: str) -> str:
    return f"""
cc AS (SELECT CAST(y AS VARCHAR) AS y, CAST(p AS VARCHAR) AS p, count(*) AS n FROM {src} WHERE y IS NOT NULL GROUP BY 1, 2),
classes AS (SELECT y AS c FROM cc UNION SELECT p FROM cc WHERE p IS NOT NULL),
per AS (
  SELECT c,
    CAST(coalesce((SELECT sum(n) FROM cc WHERE cc.y = classes.c), 0) AS DOUBLE) AS support,
    CAST(coalesce((SELECT sum(n) FROM cc WHERE cc.p = classes.c), 0) AS DOUBLE) AS predicted,
    CAST(coalesce((SELECT sum(n) FROM cc WHERE cc.y = classes.c AND cc.p = classes.c), 0) AS DOUBLE) AS tp
  FROM classes),
per2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per),
per3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM per2)"""


REPORT_SELECT = f"""
SELECT c AS label, {R4('prec')} AS precision, {R4('rec')} AS recall, {R4('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM per3
UNION ALL SELECT 'accuracy', NULL, NULL, {R4('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'macro avg', {R4('avg(prec)')}, {R4('avg(rec)')}, {R4('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'weighted avg', {R4('sum(prec * support) / sum(support)')}, {R4('sum(rec * support) / sum(support)')},
       {R4('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM per3"""

SQL["eval_vote_report"] = with_readings(REPORT_SELECT, FC, SEASONAL, VOTED, _report("labeled"))

CONF = """cm AS (
  SELECT a.c AS truth, b.c AS predicted, CAST(coalesce(cc.n, 0) AS BIGINT) AS count
  FROM classes a CROSS JOIN classes b
  LEFT JOIN cc ON cc.y = a.c AND cc.p = b.c)"""
SQL["eval_vote_confusion"] = with_readings("SELECT truth, predicted, count FROM cm",
                                           FC, SEASONAL, VOTED, _report("labeled"), CONF)
SQL["eval_vote_class_accuracy"] = with_readings(f"""
SELECT truth, CAST(sum(count) AS BIGINT) AS n,
  {R4('coalesce(sum(CASE WHEN truth = predicted THEN count ELSE 0 END) * 1.0 / nullif(sum(count), 0), 0.0)')} AS class_accuracy
FROM cm GROUP BY truth""", FC, SEASONAL, VOTED, _report("labeled"), CONF)

SQL["eval_labels_by_lang"] = f"""
SELECT d.lang, CAST(count(*) AS BIGINT) AS n,
  {R4('avg(CASE WHEN l.quality = l.toxic THEN 1.0 ELSE 0.0 END) * 100')} AS accuracy_pct
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL GROUP BY d.lang"""

SQL["eval_labels_report"] = "WITH " + _report("(SELECT quality AS y, toxic AS p FROM labels) lb").strip() \
    + "\n" + REPORT_SELECT


# ---------------------------------------------------------------- score vectors
def _head(h: str) -> str:
    from terrapanel.plans.catalog import HEADS

    sums = ", ".join(" + ".join(["CAST(0 AS DOUBLE)", *[f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64) if HEADS[h](i) == c]])
                     for c in range(10))
    return f"""u_{h} AS (SELECT vec_id, label, unnest([{sums}]) AS x,
                 unnest(range(0, 10)) AS idx FROM embeddings),
p_{h} AS (SELECT vec_id, label, idx, exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM u_{h}),
q_{h} AS (SELECT vec_id, label, idx, ex / sum(ex) OVER (PARTITION BY vec_id) AS prob FROM p_{h}),
r_{h} AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx) AS rk FROM q_{h}),
b_{h} AS (SELECT vec_id, label, CAST(max(CASE WHEN rk = 1 THEN idx END) AS VARCHAR) AS pred,
                 max(CASE WHEN rk = 1 THEN prob END) AS best,
                 max(CASE WHEN idx = label THEN prob END) AS p_true,
                 string_agg(CASE WHEN rk <= 3 THEN CAST(idx AS VARCHAR) END, ',' ORDER BY rk) AS top3,
                 bool_or(rk <= 3 AND idx = label) AS hit3
          FROM r_{h} GROUP BY vec_id, label)"""


SQL["scores_topk"] = "WITH " + _head("head_a") + f"""
SELECT vec_id, CAST(label AS VARCHAR) AS truth, pred AS pred_label, {R4('best * 100')} AS confidence_pct,
  CASE WHEN best * 100 < 50.0 THEN 'below threshold' ELSE 'meets threshold' END AS confidence_flag,
  top3, hit3 AS top3_hit
FROM b_head_a"""

SQL["scores_model_summary"] = "WITH " + ",\n".join(
    _head(h) for h in ["head_a", "head_b", "head_c"]) + f""",
allv AS (SELECT a.vec_id, CAST(a.label AS VARCHAR) AS truth, a.pred AS va, b.pred AS vb, c.pred AS vc
         FROM b_head_a a JOIN b_head_b b ON a.vec_id = b.vec_id JOIN b_head_c c ON a.vec_id = c.vec_id),
vv AS (SELECT vec_id, truth, v FROM (SELECT vec_id, truth, unnest([va, vb, vc]) AS v FROM allv) x),
vsel AS (SELECT vec_id, truth, v FROM (
          SELECT vec_id, truth, v, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, v) AS rn
          FROM (SELECT vec_id, truth, v, count(*) AS c FROM vv GROUP BY vec_id, truth, v) g) r WHERE rn = 1)
SELECT model, round(acc + 1e-9, 3) AS test_accuracy, {R4('loss')} AS test_loss FROM (
  SELECT 'head_a' AS model, avg(CASE WHEN pred = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS acc,
         avg(-ln(p_true)) AS loss FROM b_head_a
  UNION ALL SELECT 'head_b', avg(CASE WHEN pred = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END), avg(-ln(p_true)) FROM b_head_b
  UNION ALL SELECT 'head_c', avg(CASE WHEN pred = CAST(label AS VARCHAR) THEN 1.0 ELSE 0.0 END), avg(-ln(p_true)) FROM b_head_c
  UNION ALL SELECT 'vote', avg(CASE WHEN v = truth THEN 1.0 ELSE 0.0 END), CAST(NULL AS DOUBLE) FROM vsel) t"""


# ---------------------------------------------------------------- collection audit
SQL["images_class_counts"] = f"""
SELECT label, count, CAST(1.0 AS DOUBLE) / (CAST(count AS DOUBLE) + CAST(1e-6 AS DOUBLE)) AS class_weight,
       {R4('CAST(max(count) OVER () AS DOUBLE) / min(count) OVER ()')} AS imbalance_ratio
FROM (SELECT lang AS label, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY lang) c"""

SPLIT_POS = "row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id)"


def _split_counts(where: str) -> str:
    return f"""
WITH s AS (
  SELECT lang AS label, pos, n,
    CASE WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
         WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val'
         ELSE 'test' END AS split
  FROM (SELECT lang, {SPLIT_POS} AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents {where}) x)
SELECT label, CAST(count(*) AS BIGINT) AS Total,
       CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS Train,
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS Val,
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS Test
FROM s GROUP BY label
UNION ALL
SELECT 'ALL', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT),
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT),
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) FROM s"""


SQL["images_split_counts"] = _split_counts("")
SQL["images_split_excluding"] = _split_counts("WHERE lang IS NULL OR lang <> 'de'")
SQL["images_stratified_split"] = f"""
SELECT doc_id, lang AS label,
  CASE WHEN {SPLIT_POS} <= floor(count(*) OVER (PARTITION BY lang) * CAST(0.8 AS DOUBLE)) THEN 'train'
       ELSE 'test' END AS split
FROM documents"""
SQL["images_sample_per_class"] = f"""
SELECT doc_id, label FROM (SELECT doc_id, lang AS label, {SPLIT_POS} AS pos FROM documents) x WHERE pos <= 5"""


# ---------------------------------------------------------------- model preparation statistics
def _prep_stats() -> str:
    from terrapanel.fixed_values import FEATURES

    parts = []
    for f in FEATURES:
        parts.append(f"""SELECT '{f}' AS feature, {R4('m')} AS median,
  {R4(f'avg(coalesce(CAST({f} AS DOUBLE), m))')} AS mean, {R4(f'stddev_pop(coalesce(CAST({f} AS DOUBLE), m))')} AS std
FROM tr, (SELECT coalesce(quantile_cont(CAST({f} AS DOUBLE), 0.5), 0.0) AS m FROM tr) q GROUP BY m""")
    return "\nUNION ALL\n".join(parts)


SQL["model_prep_stats"] = with_readings(_prep_stats(), _calendar_cte(), TAGGED, FEATURES_CTE,
                                        "tr AS (SELECT * FROM feat WHERE Year = 1999)")


# ---------------------------------------------------------------- boosted trees over few values
_STEPS = ["Month_num", "Season_num", "day_step", "district_id"]
_STEP_ROWS = """step AS (
  SELECT Month_num, Season_num, CASE WHEN Month_num <> 3 THEN Day % 7 END AS day_step, district_id, moisture AS y,
         avg(moisture) OVER () - moisture AS g
  FROM feat WHERE Year = 1999 AND moisture IS NOT NULL)"""
_STEP_CUTS = "step_values AS (" + " UNION ".join(
    f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v FROM step WHERE {c} IS NOT NULL" for i, c in enumerate(_STEPS)) + """),
step_cuts AS (SELECT * FROM (SELECT f, v + (lead(v) OVER (PARTITION BY f ORDER BY v) - v) / 2 AS cut FROM step_values) c WHERE cut IS NOT NULL)"""


def _best_split(rows: str, out: str, l2: float, least: int) -> str:
    """CTEs that end in ``out``: the split (f, cut, missing_left, gain) of most second-order gain of ``rows``."""
    long = " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v, g FROM {rows}" for i, c in enumerate(_STEPS))
    return f"""{out}_long AS ({long}),
{out}_all AS (SELECT f, sum(g) AS tg, count(*) AS th, coalesce(sum(g) FILTER (v IS NULL), 0) AS mg, count(*) FILTER (v IS NULL) AS mh
  FROM {out}_long GROUP BY f),
{out}_left AS (SELECT c.f, c.cut, coalesce(sum(l.g), 0) AS lg, count(l.g) AS lh
  FROM step_cuts c LEFT JOIN {out}_long l ON l.f = c.f AND l.v <= c.cut GROUP BY c.f, c.cut),
{out}_both AS (SELECT l.f, l.cut, a.tg, a.th, s.side AS missing_left,
    l.lg + CASE WHEN s.side THEN a.mg ELSE 0 END AS lg, l.lh + CASE WHEN s.side THEN a.mh ELSE 0 END AS lh
  FROM {out}_left l JOIN {out}_all a ON a.f = l.f JOIN (VALUES (false), (true)) s(side) ON NOT s.side OR a.mh > 0),
{out} AS (SELECT f, cut, missing_left,
    0.5 * (lg * lg / (lh + {l2}) + (tg - lg) * (tg - lg) / (th - lh + {l2}) - tg * tg / (th + {l2})) AS gain
  FROM {out}_both WHERE lh >= {least} AND th - lh >= {least}
  ORDER BY round(gain, 7) DESC, f, cut, missing_left LIMIT 1)"""


def _side(split: str) -> str:
    value = "CASE s.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(_STEPS)) + " END"
    return f"CASE WHEN {value} IS NULL THEN s.missing_left ELSE {value} <= s.cut END"


def _leaf_summary(l2: float) -> str:
    return (f"{R4(f'(SELECT avg(y) FROM step) - 0.3 * sum(g) / (count(*) + {l2})')} AS prediction, "
            f"CAST(count(*) AS BIGINT) AS n, {R4('avg(y)')} AS mean_label")


SQL["model_depthwise_stump"] = with_readings(f"""
SELECT {_STEPS!r}[f + 1] AS feature, {R4('cut')} AS threshold, missing_left, prediction, n, mean_label
FROM (SELECT s.f, s.cut, s.missing_left, {_side('s')} AS goes_left, {_leaf_summary(1.0)}
      FROM step, best s GROUP BY ALL) x""", _calendar_cte(), TAGGED, FEATURES_CTE, _STEP_ROWS, _STEP_CUTS, _best_split("step", "best", 1.0, 1))

SQL["model_leafwise_tree"] = with_readings(f"""
SELECT {_STEPS!r}[f + 1] AS second_feature, {R4('cut')} AS second_threshold, missing_left, prediction, n, mean_label
FROM (SELECT s.f, s.cut, s.missing_left,
        CASE WHEN step_side.goes_left <> s.parent_left THEN 'other' WHEN {_side('s')} THEN 'left' ELSE 'right' END AS leaf,
        {_leaf_summary(0.0)}
      FROM step_side, second s GROUP BY ALL) x""", _calendar_cte(), TAGGED, FEATURES_CTE, _STEP_ROWS, _STEP_CUTS,
    _best_split("step", "best", 0.0, 20),
    f"step_side AS (SELECT step.*, {_side('s')} AS goes_left FROM step, best s)",
    "step_l AS (SELECT * FROM step_side WHERE goes_left), step_r AS (SELECT * FROM step_side WHERE NOT goes_left)",
    _best_split("step_l", "best_l", 0.0, 20), _best_split("step_r", "best_r", 0.0, 20),
    """second AS (SELECT * FROM (SELECT true AS parent_left, * FROM best_l UNION ALL SELECT false, * FROM best_r) b
  ORDER BY round(gain, 7) DESC, parent_left DESC LIMIT 1)""")

SQL["model_linear_normal"] = with_readings(f"""
SELECT term, {R4('value')} AS value FROM (
  SELECT 'Month_num' AS term, b1 AS value FROM solved UNION ALL SELECT 'Day', b2 FROM solved UNION ALL SELECT 'again', 0.0
  UNION ALL SELECT 'intercept', b0 FROM solved
  UNION ALL SELECT 'rmse', sqrt(avg((y - b0 - b1 * m - b2 * d) * (y - b0 - b1 * m - b2 * d))) FROM own, solved) t""",
    _calendar_cte(), TAGGED, FEATURES_CTE,
    "own AS (SELECT CAST(Month_num AS DOUBLE) AS m, CAST(Day AS DOUBLE) AS d, moisture AS y FROM feat WHERE Year = 1999 AND moisture IS NOT NULL)",
    """sums AS (SELECT var_pop(m) AS mm, var_pop(d) AS dd, covar_pop(m, d) AS md, covar_pop(m, y) AS my, covar_pop(d, y) AS dy,
  avg(m) AS am, avg(d) AS ad, avg(y) AS ay FROM own)""",
    """slopes AS (SELECT (my * dd - dy * md) / (mm * dd - md * md) AS b1, (dy * mm - my * md) / (mm * dd - md * md) AS b2, am, ad, ay FROM sums)""",
    "solved AS (SELECT b1, b2, ay - b1 * am - b2 * ad AS b0 FROM slopes)")

SQL["model_pure_tree"] = with_readings(f"""
SELECT Month_num, Season_num, day_step, district_id, {R4('avg(y)')} AS prediction, {R4('avg(y)')} AS same_prediction,
       CAST(count(*) AS BIGINT) AS n
FROM step GROUP BY Month_num, Season_num, day_step, district_id""", _calendar_cte(), TAGGED, FEATURES_CTE, _STEP_ROWS)

SQL["unknown_season_sample"] = with_readings("""
SELECT state, district, row_id, Month, Season FROM tagged WHERE Season = 'Unknown'
ORDER BY state NULLS LAST, district NULLS LAST, Year NULLS LAST, Month_num NULLS LAST, Day NULLS LAST,
         row_id NULLS LAST
LIMIT 10""", _calendar_cte(), TAGGED)

SQL["distinct_states"] = with_readings("""
SELECT state, CAST(count(DISTINCT district) AS BIGINT) AS n_districts FROM readings
WHERE state IS NOT NULL GROUP BY state""")

SQL["region_month_stats"] = with_readings(f"""
SELECT state, Month_num, CAST(count(*) AS BIGINT) AS n, {R4('avg(moisture)')} AS hist_mean,
       {R4('stddev_pop(moisture)')} AS hist_std
FROM readings
WHERE (upper(state) = 'ASIA' AND upper(district) = 'NATION')
   OR ((SELECT count(*) FROM readings WHERE upper(state) = 'ASIA' AND upper(district) = 'NATION') = 0
       AND contains(upper(state), 'ASIA') AND contains(upper(district), 'NATION'))
GROUP BY state, Month_num""")

_NUM = ["Year", "Month_num", "Day", "moisture", "row_id"]
SQL["numeric_correlation"] = with_readings("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + (R4("1.0") + " AS corr" if a == b else R4(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))") + " AS corr FROM readings")
    for a in _NUM for b in _NUM))


SQL["panel_lookback_hot_day"] = with_readings(f"""
SELECT row_id, {R4('lag(moisture, 1) OVER w')} AS lag_1, {R4('lag(moisture, 7) OVER w')} AS lag_7,
       {R4('avg(moisture) OVER (ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_3,
       {R4('avg(moisture) OVER (ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS rolling_6
FROM readings WINDOW w AS (ORDER BY row_id)""")

SQL["panel_lookback_split"] = with_readings(f"""
SELECT state, district, row_id,
  {R4(f'lag(moisture, 1) OVER ({PANEL_WINDOW})')} AS lag_1,
  {R4(f'lag(moisture, 7) OVER ({PANEL_WINDOW})')} AS lag_7,
  {R4(f'avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_3,
  {R4(f'avg(moisture) OVER ({PANEL_WINDOW} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS rolling_6
FROM readings""")


# ---------------------------------------------------------------- sources, cleaning and orders, end to end
SQL["images_split_null_class"] = """
WITH d AS (SELECT d.doc_id, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919) % 10007, doc_id) AS pos,
             count(*) OVER (PARTITION BY label) AS n FROM d),
s AS (SELECT label, CASE WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
         WHEN pos <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM p),
c AS (SELECT CAST(label AS VARCHAR) AS label, split FROM s UNION ALL SELECT 'ALL', split FROM s)
SELECT label, CAST(count(*) AS BIGINT) AS Total, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS Train,
       CAST(count(*) FILTER (split = 'val') AS BIGINT) AS Val, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS Test
FROM c GROUP BY label"""
SQL["ingest_files_merged"] = with_readings(f"""
SELECT DISTINCT state, district, CAST(reading_date AS VARCHAR) AS reading_date, Year, {MONTHS_LIST}[Month_num] AS Month,
       Month_num, Day, {R4('moisture')} AS moisture
FROM (SELECT DISTINCT state, district, reading_date, Year, Month_num, Day, moisture FROM readings) r""").replace("SELECT DISTINCT state, district, CAST", "SELECT state, district, CAST")
SQL["parsed_dates"] = """
SELECT CAST(o_orderkey % 5 AS BIGINT) AS form, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (o_orderkey % 5 < 2) AS BIGINT) AS n_dates,
       CAST(max(CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) END) AS VARCHAR) AS last_date,
       CAST(count(*) FILTER (o_orderkey % 5 > 0) AS BIGINT) AS n_numbers
FROM orders GROUP BY o_orderkey % 5"""
SQL["july_features"] = with_readings(f"""
SELECT state, row_id, {R4('moisture')} AS moisture, CAST(NULL AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS lag_1
FROM gaps WHERE moisture IS NOT NULL AND Month_num = 7""", GAPS)
SQL["panel_positions"] = with_readings("""
SELECT CAST(row_number() OVER (ORDER BY state, district, Year, Month_num, Day, row_id) AS BIGINT) AS position, state, district, row_id
FROM readings""")
SQL["region_month_stats_exact"] = with_readings(f"""
SELECT state, district, Month_num, CAST(count(*) AS BIGINT) AS n, {R4('avg(moisture)')} AS mean_moisture
FROM readings WHERE state = 'AMERICA' AND district = 'NATION_1' GROUP BY ALL""")
SQL["month_season_rows"] = with_readings(f"""
SELECT state, district, CAST(m AS INTEGER) AS Month_num, CAST({{season}} AS INTEGER) AS Season_num,
       {R4('sin(2 * pi() * m / 12)')} AS month_sin, {R4('cos(2 * pi() * m / 12)')} AS month_cos, {R4('r')} AS rolling_3
FROM (SELECT state, district, avg(moisture) AS r FROM readings GROUP BY ALL) x, unnest(range(1, 13)) AS u(m)""").replace(
    "{season}", "CASE " + " ".join(f"WHEN m = {month} THEN {code}" for month, code in FV.MONTH_ONLY_SEASON.items())
    + f" ELSE {FV.MONTH_ONLY_SEASON_DEFAULT} END")
SQL["stored_panel"] = with_readings("""
SELECT Year, state, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(row_id) AS BIGINT) AS sum_row_id FROM readings GROUP BY ALL""")


SQL["eda_sample_rows"] = with_readings(f"""
SELECT Year, Month_num, Day, {R4('moisture')} AS moisture, row_id FROM readings
WHERE Year IS NOT NULL AND Month_num IS NOT NULL AND Day IS NOT NULL AND moisture IS NOT NULL
ORDER BY md5('42|' || row_id), row_id LIMIT 2000""")

SQL["ingest_rejects"] = with_readings("""
SELECT kind, CAST(n AS BIGINT) AS n FROM (
  SELECT 'kept' AS kind, count(*) FILTER (row_id % 10 NOT IN (1, 2)) AS n FROM readings
  UNION ALL SELECT 'with measure', count(moisture) FILTER (row_id % 10 NOT IN (1, 2, 3)) FROM readings
  UNION ALL SELECT 'quoted', count(*) FILTER (row_id % 10 NOT IN (1, 2)) FROM readings
  UNION ALL SELECT 'cells', count(*) FILTER (row_id % 10 = 1) FROM readings
  UNION ALL SELECT 'quote', count(*) FILTER (row_id % 10 = 2) FROM readings) t""")

FAILING = """failing AS (
  SELECT state, district, Month_num, Seasonal, Persistence, CASE WHEN Month_num % 4 IN (2, 3) THEN Persistence END AS Odd FROM scored)"""
SQL["serve_failing_models"] = with_readings(f"""
SELECT state, district, Month_num, {R4('Seasonal')} AS Seasonal, {R4('Persistence')} AS Persistence,
  CAST(NULL AS DOUBLE) AS Broken, {R4('Odd')} AS Odd,
  {R4('CASE WHEN k > 1 THEN (coalesce(Seasonal, 0) + Persistence + coalesce(Odd, 0)) / k END')} AS Ensemble
FROM (SELECT *, 1 + CAST(Seasonal IS NOT NULL AS INTEGER) + CAST(Odd IS NOT NULL AS INTEGER) AS k FROM failing) f""",
    FEAT2, PRI, SEASONAL, SCORED, FAILING)
SQL["serve_failure_counts"] = with_readings("""
SELECT model, reason, CAST(n AS BIGINT) AS n FROM (
  SELECT 'Broken' AS model, 'UNRESOLVED_COLUMN.WITH_SUGGESTION' AS reason, count(*) AS n FROM failing
  UNION ALL SELECT 'Odd', 'not finite', count(*) FILTER (Odd IS NULL) FROM failing
  UNION ALL SELECT 'Seasonal', 'no value', count(*) FILTER (Seasonal IS NULL) FROM failing) t WHERE n > 0""",
    FEAT2, PRI, SEASONAL, SCORED, FAILING)

SQL["images_scored"] = """
SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, count(*) FILTER (vec_id % 10 <> 3) AS n_scored,
""" + ",\n".join(
    "  CAST(sum(CASE WHEN vec_id % 10 <> 3 THEN " + " + ".join(f"floor(CAST(embedding[{i + 1}] AS DOUBLE) * 100)" for i in range(c, 64, 4))
    + f" END) AS BIGINT) AS score_{c}" for c in range(4)) + """
FROM embeddings GROUP BY label"""

SQL["model_saved_scores"] = with_readings(f"""
SELECT district_id, round(sum(y) + 1e-9, 3) AS tree, {R4('(SELECT avg(y) FROM step)')} AS mean FROM step GROUP BY district_id""",
    _calendar_cte(), TAGGED, FEATURES_CTE, _STEP_ROWS)

SQL["exported_ranking"] = with_readings(f"""
SELECT state, Month_num, {R4('avg(moisture)')} AS mean_value, row_number() OVER (ORDER BY state, Month_num) AS place
FROM readings WHERE state IS NOT NULL AND Month_num IS NOT NULL GROUP BY state, Month_num""")

SQL["profile_positions"] = with_readings(f"""
SELECT state, district, {MONTH_TITLES}[Month_num] AS Month, {R4('avg(moisture)')} AS mean_moisture,
       row_number() OVER (ORDER BY state, district, Month_num) AS place
FROM readings WHERE state IS NOT NULL AND district IS NOT NULL AND Month_num IS NOT NULL GROUP BY state, district, Month_num""")

SQL["path_years"] = with_readings(f"""
SELECT CAST(Year + 2 AS INTEGER) AS Year, count(*) AS n, count(*) FILTER (row_id % 3 <> 0) AS n_dates, {R4('sum(moisture)')} AS moisture
FROM readings WHERE reading_date IS NOT NULL GROUP BY Year""")

SQL["serve_manual_thresholds"] = with_readings(f"""
SELECT s.state, s.district, s.Month_num, {R4('s.pred_moisture')} AS primary, 5.0::DOUBLE AS low_thresh, 10.0::DOUBLE AS high_thresh,
  CASE WHEN s.pred_moisture < coalesce(q.p25, 5.0) THEN 'LOW' WHEN s.pred_moisture > coalesce(q.p75, 10.0) THEN 'HIGH' ELSE 'MEDIUM' END AS category
FROM scored s LEFT JOIN (
  SELECT state, district, Month_num, quantile_cont(moisture, 0.25) AS p25, quantile_cont(moisture, 0.75) AS p75
  FROM readings GROUP BY state, district, Month_num) q ON q.state = s.state AND q.district = s.district AND q.Month_num = s.Month_num""",
    FEAT2, PRI, SEASONAL, SCORED)

SQL["saved_summaries"] = with_readings(f"""
SELECT 'state' AS summary, state AS key, {R4('avg(moisture)')} AS mean_value FROM readings WHERE state IS NOT NULL GROUP BY state
UNION ALL SELECT 'month', CAST(Month_num AS VARCHAR), {R4('avg(moisture)')} FROM readings WHERE Month_num IS NOT NULL GROUP BY Month_num""")

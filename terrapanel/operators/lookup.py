"""Lookups, dimension joins, encodings and spines (J1–J9, J2/J3 encoders).

Broadcast policy: a side is broadcast only after a row-count check against an
explicit bound (``join_dimension``, and ``small_side`` for tables derived by
aggregating the fact data).  Beyond the bound the join stays a sort-merge join
whose skewed partitions AQE splits.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel import fixed_values as FV


_SIZE_CHECKS: dict = {}


def _source_key(df: DataFrame) -> str | None:
    """Stable identity of a plan that only scans files (None otherwise)."""
    try:
        files = df.inputFiles()
        if not files:
            return None
        return f"{df.semanticHash()}|" + ",".join(sorted(files))
    except Exception:
        return None


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1).

    The answer for a file-backed plan is remembered for the session, so a
    dimension used by many queries is checked once."""
    key = _source_key(df)
    if key is not None and (key, max_rows) in _SIZE_CHECKS:
        return _SIZE_CHECKS[(key, max_rows)]
    small = df.limit(max_rows + 1).count() <= max_rows
    if key is not None:
        _SIZE_CHECKS[(key, max_rows)] = small
    return small


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                   max_rows: int = 100_000, known_rows: int | None = None) -> DataFrame:
    """Join a dimension; broadcast it only when its size is proven small
    (``known_rows`` for dimensions built from literal data, else a bounded
    count)."""
    small = known_rows <= max_rows if known_rows is not None else is_small(dim, max_rows)
    side = F.broadcast(dim) if small else dim
    return fact.join(side, on, how)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A table derived from fact data, computed once and written; broadcast in
    the join that follows when its counted rows are at most ``max_rows``, so
    that the fact side of such a join keeps its partitioning."""
    from terrapanel.session import materialize

    out = materialize(df)
    return F.broadcast(out) if out.count() <= max_rows else out


# ---------------------------------------------------------------- dimensions

def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows, columns: list[str], types: list[str]) -> DataFrame:
    """A small dimension from literal rows as an inline VALUES table: a
    stable plan (equal rows give equal plans), no driver-side RDD, and a
    known size (``_known_rows``)."""
    if not rows:
        schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types))
        df = spark.createDataFrame([], schema)
    else:
        values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
        df = df.select(*[F.col(c).cast(t).alias(c) for c, t in zip(columns, types)])
    df._known_rows = len(rows)
    return df


def season_calendar(spark: SparkSession, calendar: dict | None = None) -> DataFrame:
    """Flatten ``state -> season -> months`` into rows (state, month, season)."""
    calendar = FV.STATE_SEASON_CALENDAR if calendar is None else calendar
    rows = [(state.upper().strip(), m.upper().strip(), season)
            for state, seasons in calendar.items() if state is not None
            for season, months in seasons.items() for m in months]
    seen, unique = set(), []
    for r in rows:                       # first season listing a month wins
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            unique.append(r)
    return literal_table(spark, unique, ["cal_state", "cal_month", "cal_season"],
                         ["string", "string", "string"])


def varieties_dimension(spark: SparkSession, varieties: dict | None = None) -> DataFrame:
    varieties = FV.STATE_VARIETIES if varieties is None else varieties
    rows = [(k, list(v)) for k, v in varieties.items() if k != "DEFAULT"]
    return literal_table(spark, rows, ["var_state", "varieties"], ["string", "array<string>"])


# ---------------------------------------------------------------- lookups

def season_lookup(df: DataFrame, calendar: DataFrame, state_col: str = "state",
                  month_col: str = "Month", out: str = "Season") -> DataFrame:
    """Equi-lookup of (state, month) in the calendar, ``Unknown`` otherwise."""
    keyed = (df.withColumn("_j1_state", F.upper(F.trim(F.col(state_col))))
               .withColumn("_j1_month", F.upper(F.trim(F.col(month_col)))))
    cond = [F.col("_j1_state") == F.col("cal_state"), F.col("_j1_month") == F.col("cal_month")]
    joined = join_dimension(keyed, calendar, cond, "left", max_rows=100_000,
                            known_rows=getattr(calendar, "_known_rows", None))
    return (joined.withColumn(out, F.coalesce(F.col("cal_season"), F.lit(FV.UNKNOWN_SEASON)))
                  .drop("_j1_state", "_j1_month", "cal_state", "cal_month", "cal_season"))


def frequency_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Value -> share of non-null rows holding it; null stays null.

    Map-side partial counts give a small table, which is broadcast after a
    count of its rows: the fact rows do not move.
    """
    nonnull = df.where(F.col(col).isNotNull())
    counts = small_side(nonnull.groupBy(col).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.select(F.sum("_n")).scalar()
    freq = counts.select(F.col(col).alias("_fe_key"), (F.col("_n") / total).alias(out))
    return df.join(freq, F.col(col) == F.col("_fe_key"), "left").drop("_fe_key")


def category_code(df: DataFrame, col: str, out: str) -> DataFrame:
    """Index of the value in the sorted distinct list; null -> -1.

    The distinct values are ranked with the range-partitioned global rank, at
    any number of them; the table of codes is broadcast after a count of its
    rows, so that the fact rows do not move.
    """
    from terrapanel.operators.windows import global_rank

    distinct = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_cc_key")).distinct()
    ranked = global_rank(distinct, ["_cc_key"], out="_cc_rank")
    codes = small_side(ranked.select("_cc_key", (F.col("_cc_rank") - 1).cast("int").alias(out)))
    return (df.join(codes, F.col(col) == F.col("_cc_key"), "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
              .drop("_cc_key"))


def varieties_lookup(df: DataFrame, varieties_dim: DataFrame, state_col: str = "state",
                     out: str = "varieties", default: Iterable[str] | None = None,
                     squash_spaces: bool = False) -> DataFrame:
    """State -> variety list, DEFAULT list otherwise.

    ``squash_spaces`` joins on the name with blanks removed (so TAMILNADU and
    TAMIL NADU meet); the default keeps the exact upper-case match.
    """
    default = FV.STATE_VARIETIES["DEFAULT"] if default is None else list(default)
    key = F.upper(F.trim(F.col(state_col)))
    dim_key = F.col("var_state")
    if squash_spaces:
        key = F.regexp_replace(key, r"\s+", "")
        dim_key = F.regexp_replace(dim_key, r"\s+", "")
    keyed = df.withColumn("_j4_key", key)
    dim = varieties_dim.select(dim_key.alias("_j4_dim"), F.col("varieties").alias("_j4_v"))
    joined = join_dimension(keyed, dim, F.col("_j4_key") == F.col("_j4_dim"), "left", 100_000,
                            known_rows=getattr(varieties_dim, "_known_rows", None))
    default_arr = F.array(*[F.lit(v) for v in default])
    return (joined.withColumn(out, F.coalesce(F.col("_j4_v"), default_arr))
                  .drop("_j4_key", "_j4_dim", "_j4_v"))


def month_spine_fill(agg: DataFrame, keys: list[str], month_col: str, value_cols: list[str],
                     full_year: bool = False) -> DataFrame:
    """Complete missing months of each group with nulls.

    ``full_year=False``: spine from the group's first to last month (resample).
    ``full_year=True``: month numbers 1..12 (reindex of a Jan..Dec table).
    """
    if full_year:
        spine = (agg.select(*keys).distinct()
                    .withColumn(month_col, F.explode(F.sequence(F.lit(1), F.lit(12)))))
    else:
        bounds = agg.groupBy(*keys).agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
        spine = bounds.select(*keys, F.explode(
            F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month_col))
    return spine.join(agg.select(*keys, month_col, *value_cols), keys + [month_col], "left")


def month_offsets_grid(df: DataFrame, month_col: str, horizon: int = 3,
                       out_offset: str = "step", out_month: str = "target_month") -> DataFrame:
    """Each row repeated for months m, m+1, … (wrapping past December)."""
    from terrapanel.functions.calendar import month_add

    return (df.withColumn(out_offset, F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
              .withColumn(out_month, month_add(F.col(month_col), F.col(out_offset))))


def month_code_map() -> Column:
    """J5 literal map JAN..DEC -> 1..12."""
    pairs = []
    for i, m in enumerate(FV.MONTH_ABBR, start=1):
        pairs += [F.lit(m), F.lit(i)]
    return F.create_map(*pairs)


def literal_array(values: Iterable, dtype: T.DataType | None = None) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return arr.cast(T.ArrayType(dtype)) if dtype is not None else arr

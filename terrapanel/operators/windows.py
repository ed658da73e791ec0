"""Window operators (W1–W7) in skew-safe forms.

``panel_lookback`` — lags and trailing means over *rows* of a panel
(``state, district`` ordered by ``Year, Month_num, Day, row_id``).  A plain
``Window.partitionBy(state, district)`` sends a whole district to one task; if
one district held a third of the data, one task would sort a third of it.  Here
window partitions are (panel, piece).  A sample of bounded size, taken by hash,
tells which panels are larger than a piece and where in their own order they are
to be cut, down to single rows of one day; all others are one piece.  The last
rows of each piece (at most ``K`` = the longest look-back) are carried to the
pieces after it as a *halo*, which goes through the same window and is then left
out.  The data are shuffled and sorted once, at any size and skew.

``global_rank`` — a dense ``1..n`` ordinal over a total order without a
single-partition window: range partitioning (sampled boundaries, so hot values
are split because the order is made unique by tie-break columns), in-partition
position from ``monotonically_increasing_id``, a checkpoint so both uses see
identical positions, and per-partition offsets (one row per partition, a
proven bound) broadcast back.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import materialize

_BIG = 2_147_483_647  # sorts after every real Year/Month/Day: nulls last


def _asc_nl(c: str) -> Column:
    return F.col(c).asc_nulls_last()


SAMPLES = 64              # sampled rows of a piece


def panel_lookback(df: DataFrame, value: str, keys: Sequence[str] = ("state", "district"),
                   order: Sequence[str] = ("Year", "Month_num", "Day", "row_id"),
                   lags: Sequence[int] = (1, 7), means: Sequence[int] = (3, 6),
                   exclude_current: bool = False,
                   lag_names: Sequence[str] | None = None,
                   mean_names: Sequence[str] | None = None,
                   dedupe: bool = False, pieces: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``lag_k`` and ``rolling_w`` (min 1 non-null value) per panel.

    * lags count rows, not days (gaps are not filled);
    * ``rolling_w`` includes the current row unless ``exclude_current``;
    * rows whose key is null get null features (pandas drops null groups), and
      are spread by hash;
    * order is ascending, nulls last; rows of equal order are one piece.

    A panel of more than two pieces' share of the rows (``pieces``: the shuffle
    partitions, unless given) is cut; see the module text.

    ``dedupe=True`` drops exact duplicate rows first, clustered on the same
    keys as the window, so dedupe and window share one shuffle.
    """
    keys, order = list(keys), list(order)
    lag_names = list(lag_names or [f"lag_{k}" for k in lags])
    mean_names = list(mean_names or [f"rolling_{w}" for w in means])
    lo = 1 if exclude_current else 0
    frames = {w: (lo, w - 1 + lo) for w in means}           # rows back: [lo, hi]
    K = max([*lags, *[hi for _, hi in frames.values()], 1])
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(k).isNotNull()
    data = df.withColumn("_key_ok", key_ok)
    spread = F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int")
    cuts = _panel_cuts(data.where("_key_ok").select(*keys, *order), keys, order, pieces, samples)
    if cuts is None:
        data = data.withColumn("_piece", F.when(F.col("_key_ok"), F.lit(0)).otherwise(spread))
    else:
        data = _with_piece(data, cuts, keys, order)
        data = data.withColumn("_cut", F.col("_piece").isNotNull()).withColumn(
            "_piece", F.when(~F.col("_key_ok"), spread).otherwise(F.coalesce("_piece", F.lit(0))))
        halo = _halo(data.where("_cut").drop("_cut"), value, keys, order, K, dedupe)
        data = data.drop("_cut").withColumn("_halo", F.lit(0)).unionByName(halo, allowMissingColumns=True)
    part = [*keys, "_piece"]
    if dedupe:
        data = data.repartition(*part).dropDuplicates()
    w = Window.partitionBy(*part).orderBy(*[_asc_nl(c) for c in order])
    v = F.col(value).cast("double")
    ok = F.col("_key_ok")
    feats = [F.when(ok, F.lag(v, k).over(w)).alias(n) for k, n in zip(lags, lag_names)]
    feats += [F.when(ok, F.avg(v).over(w.rowsBetween(-b, -a))).alias(n)
              for (wdw, (a, b)), n in zip(frames.items(), mean_names)]
    if cuts is None:
        return data.select(*df.columns, *feats)
    return data.select(*df.columns, *feats, "_halo").where("_halo = 0").drop("_halo")


def _panel_cuts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int, samples: int) -> DataFrame | None:
    """Per panel to cut: the sorted order keys at which its pieces begin (``_cuts``), from
    ``samples * pieces`` rows taken by hash.  None if no panel holds two pieces' share of the sample."""
    taken = sample_rows(rows, samples * pieces).collect()                  # a bound of rows, whatever the table
    by_panel: dict = {}
    for r in taken:
        by_panel.setdefault(tuple(r[k] for k in keys), []).append(tuple(r[c] for c in order))
    found = []
    for panel, at in by_panel.items():
        if len(at) < 2 * samples:
            continue
        at = sorted(set(at), key=lambda row: tuple((x is None, x) for x in row))
        found += [(*panel, *row) for row in at[samples:len(at) - samples + 1:samples]]
    if not found:
        return None
    table = rows.sparkSession.createDataFrame(found, rows.schema)
    return materialize(table.groupBy(*keys).agg(F.sort_array(F.collect_list(order_key(order))).alias("_cuts")))    # at most ``pieces``


def _with_piece(data: DataFrame, cuts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``data`` with the number of each row's piece (null: its panel is not cut).

    Pieces are intervals of the order, joined by key and bounds: first the group of
    pieces that holds the row, as many as a group has pieces, then the piece in it.
    A row meets some sqrt(pieces) bounds twice and carries none of them."""
    every = F.ceil(F.sqrt(F.size("_cuts") + 1)).cast("int")
    first = F.get("_cuts", F.lit(-1))                                # null: no bound before the first piece
    pieces = cuts.select(*keys, "_cuts", every.alias("_every"), F.posexplode(F.concat(F.array(first), "_cuts")).alias("_piece", "_from"))
    pieces = pieces.withColumn("_group", F.floor(F.col("_piece") / F.col("_every")).cast("int"))
    groups = pieces.where("_piece % _every = 0").select(*keys, "_group", "_from", F.get("_cuts", F.col("_piece") + F.col("_every") - 1).alias("_to"))
    pieces = pieces.select(*keys, "_group", "_piece", "_from", F.get("_cuts", F.col("_piece")).alias("_to"))
    data = data.withColumn("_own", order_key(order))
    for bounds, out in ((groups, "_group"), (pieces, "_piece")):
        on = [*keys] if out == "_group" else [*keys, "_group"]
        bounds = bounds.select(*[F.col(c).alias(f"_of_{c}") for c in on], F.col(out).alias(f"_is_{out}"), "_from", "_to")
        inside = (F.col("_from").isNull() | (F.col("_from") <= F.col("_own"))) & (F.col("_to").isNull() | (F.col("_own") < F.col("_to")))
        for c in on:
            inside = inside & (F.col(c) == F.col(f"_of_{c}"))
        data = data.join(F.broadcast(bounds), inside, "left").withColumnRenamed(f"_is_{out}", out).drop(*[f"_of_{c}" for c in on], "_from", "_to")
    return data.drop("_own", "_group")


def _halo(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], K: int, dedupe: bool) -> DataFrame:
    """The last ``K`` rows of a panel before each of its pieces (but the first), as rows of that
    piece: keys, order, value, ``_piece`` and ``_halo`` from 1."""
    if dedupe:
        rows = rows.dropDuplicates()
    columns = list(dict.fromkeys([*keys, *order, value]))
    last = Window.partitionBy(*keys, "_piece").orderBy(*[F.col(c).desc_nulls_first() for c in order])
    tails = rows.select(*columns, "_piece").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= K).drop("_n")
    # K rows of each piece: the rows before a piece are among those before its own first here
    tails = materialize(tails.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_piece", *[_asc_nl(c) for c in order]))))
    first = tails.groupBy(*keys, "_piece").agg(F.min("_at").alias("_first")).where("_piece > 0")
    wanted = first.select(*keys, "_piece", F.explode(F.sequence(F.lit(1), F.lit(K))).alias("_halo"), "_first")
    wanted = wanted.withColumn("_at", F.col("_first") - F.col("_halo")).drop("_first")
    return materialize(wanted.join(tails.drop("_piece"), [*keys, "_at"]).drop("_at").withColumn("_key_ok", F.lit(True)))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if fewer) chosen by the hash of their values and a seed: the
    least hashes, kept by each task and merged, so the choice does not depend on
    partitions and a sample of a part is part of the sample."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def global_rank(df: DataFrame, order: Sequence, out: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Ordinal rank 1..n over a total order (ties must be broken by the
    order columns themselves).  Order columns are ascending, nulls last, unless
    Column sort expressions are given."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_exprs = [(_asc_nl(c) if isinstance(c, str) else c) for c in order]
    sorted_df = (df.repartitionByRange(n_parts, *sort_exprs)
                   .sortWithinPartitions(*sort_exprs)
                   .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = materialize(sorted_df)
    tagged = (sorted_df.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
                       .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"))
    # one row per partition: a single small window is fine here
    offs = counts.select("_pid", F.coalesce(F.sum("_pc").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offs), "_pid", "inner")
                  .withColumn(out, (F.col("_off") + F.col("_pos") + 1).cast("long"))
                  .drop("_mid", "_pid", "_pos", "_off"))


def order_key(cols: Sequence[str]) -> Column:
    """A single orderable struct for an ascending, nulls-last total order."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"k{i}")
                      for i, c in enumerate(cols)])


def kth_keys(df: DataFrame, key: Column, ks: Sequence[Column]) -> list[Column]:
    """The k-th smallest ``key`` for each k (scalar subqueries; null when k is
    outside 1..n).  Only the narrow key column is ranked, by the
    range-partitioned, written ``global_rank``."""
    ranked = global_rank(df.select(key.alias("_key")), ["_key"], out="_r")
    # one subquery (one sort) returns every requested key
    both = ranked.where(F.col("_r").isin(*ks)).agg(F.struct(*[
        F.max(F.when(F.col("_r") == k, F.col("_key"))).alias(f"t{i}") for i, k in enumerate(ks)]))
    row = materialize(both).scalar()          # found once; every later use reads one row
    return [row[f"t{i}"] for i in range(len(ks))]


def tercile_class(df: DataFrame, value: str, tiebreak: Sequence[str], out: str = "moisture_class",
                  labels: Sequence[str] = ("Low", "Medium", "High")) -> DataFrame:
    """Quantile cut of the 'first' rank of ``value`` into three labels.

    With n non-null values and rank r: Low iff 3(r-1) < n-1, i.e. r <= k1 =
    ceil((n-1)/3); Medium iff r <= k2 = ceil(2(n-1)/3); else High (the
    quantile edges of the ranks, as computed in floating point).  Only the
    k1-th and k2-th keys of the order (value, tie-break…) are needed: they
    are found on the narrow key column, and every row is classified by
    comparing its own key with them — no join back to the wide table.
    Null values get a null class.
    """
    key = order_key([value, *tiebreak])
    present = df.where(F.col(value).isNotNull())
    n = present.select(F.count(F.lit(1))).scalar()
    k1 = F.ceil((n - 1) / F.lit(3.0))
    k2 = F.ceil((n - 1) * F.lit(2.0) / F.lit(3.0))
    t1, t2 = kth_keys(present, key, [k1, k2])
    cls = (F.when(F.col(value).isNull(), F.lit(None).cast("string"))
            .when((k1 >= 1) & (key <= t1), F.lit(labels[0]))
            .when((k2 >= 1) & (key <= t2), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))
    return df.withColumn(out, cls)


def rank_within(df: DataFrame, group: Sequence[str], score: str, tiebreak: Sequence[str],
                out: str = "rank") -> DataFrame:
    """1.. rank inside each group by score descending, nulls last.

    Intended for per-district result tables (one row per district and month),
    whose groups are bounded by the number of districts in a state.
    """
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(),
                                           *[_asc_nl(c) for c in tiebreak])
    return df.withColumn(out, F.row_number().over(w))

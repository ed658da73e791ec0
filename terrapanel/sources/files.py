"""File sources and sinks for reading panels.

Reading files are CSVs whose columns are found by each file's own header line,
whatever their order; all files are read in one distributed scan
(``recursiveFileLookup`` + ``pathGlobFilter``), types are never inferred, and
missing cells are nulls that the null policy sees.  Lines that do not fit their
header go to a table of rejects.  The canonical schema after ``standardize`` is::

    state, district, date_text, reading_date, Year, Month, Day, Month_num,
    moisture (average level), volume, agg_pct, vol_pct, source_file, row_id
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.calendar import clean_text, month_abbr_upper, numeric_coerce, parse_date

MEASURES = ["moisture", "volume", "agg_pct", "vol_pct"]

# Header aliases for name-based resolution (S3): first match wins.
ALIASES = {
    "state": ["state_name", "state name", "state"],
    "district": ["districtname", "district_name", "district name", "district"],
    "date_text": ["date"],
    "moisture": ["average_soilmoisture_level_(at_15cm)", "average soilmoisture level (at 15cm)"],
    "volume": ["average_soilmoisture_volume_(at_15cm)", "average soilmoisture volume (at 15cm)"],
    "agg_pct": ["aggregate_soilmoisture_percentage_(at_15cm)",
                "aggregate soilmoisture percentage (at 15cm)"],
    "vol_pct": ["volume_soilmoisture_percentage_(at_15cm)",
                "volume soilmoisture percentage (at 15cm)"],
}
# substring fallbacks used when no alias matches
SUBSTRINGS = {"date_text": "date", "moisture": "moist"}


def normalize_header(name: str) -> str:
    """strip, lower case, spaces -> '_' (the normalised layout's rule)."""
    return name.strip().lower().replace(" ", "_")


def resolve_column(columns: Sequence[str], candidates: Iterable[str],
                   substring: str | None = None) -> str | None:
    """S3: pick a column by alias (compared after normalisation), else the
    first column whose normalised name contains ``substring``.  Metadata only."""
    norm = {normalize_header(c): c for c in columns}
    for cand in candidates:
        hit = norm.get(normalize_header(cand))
        if hit is not None:
            return hit
    if substring:
        for c in columns:
            if substring in normalize_header(c):
                return c
    return None


def text_lines(reader, paths) -> DataFrame:
    """(line, source_file) of the files that a reader (batch or stream) finds: every
    line that is not blank, its bytes one by one as ISO-8859-1."""
    lines = reader.text(paths).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
                                      F.col("_metadata.file_path").alias("source_file"))
    return lines.where(F.trim("line") != "")


def _cells(line: Column) -> Column:
    """The cells of a CSV line, as many as there are: quotes hold commas, a doubled quote is one.
    A cell whose bytes are valid UTF-8 is that text, so each has its encoding without a
    second read of its file; an empty one is null."""
    def text(c):
        quoted = c.startswith('"') & (F.length(c) > 1)
        plain = F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(F.when(c != "", c))
        utf8 = F.encode(plain, "ISO-8859-1").cast("string")
        return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^\ufeff", "")).otherwise(plain)

    return F.transform(_raw_cells(line), text)


def _raw_cells(line: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"(?=,|$)|[^,]*+)'), F.lit(1))


def _open_quote(line: Column) -> Column:
    """Whether a cell begins with a quote that does not end it."""
    return F.contains(line, F.lit('"')) & F.exists(_raw_cells(line), lambda c: c.startswith('"') & ~c.rlike(r'^"[^"]*+(?:""[^"]*+)*+"$'))


def read_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV lines (line, source_file).

    A file's header is the line that names both the state and the district
    column; its columns are found by it (any order, any of the known names, any
    number).  ``rows`` has the canonical names that some file has (null where a
    file or a line lacks them) plus ``source_file``.  ``rejects`` has
    (source_file, reason, line): ``cells`` for more cells than the header has,
    ``quote`` for a quote that is never closed, ``header`` for every line of a
    file without a header.  A line is in one of both, or a header.

    One table with a row per file carries the columns' places; nothing of the
    files comes to the driver but which columns exist."""
    tagged, placed = _headers(lines)
    return _rows_and_rejects(tagged, placed)


def _headers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with ``_is_head``, and a row per file: where its header has each column."""
    from terrapanel.operators.lookup import small_side

    # every known name of the two columns holds its canonical one: only such lines are cut to look for a header
    low = F.lower("line")
    plain = F.transform(_cells(F.col("line")), lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "_"))
    tagged = lines.withColumn("_names", F.when(F.contains(low, F.lit("state")) & F.contains(low, F.lit("district")), plain))

    def names(canon):
        wanted = F.array(*[F.lit(normalize_header(c)) for c in ALIASES[canon]])
        return F.coalesce(F.arrays_overlap(F.filter("_names", lambda c: c.isNotNull()), wanted), F.lit(False))

    def place(canon):
        """1-based place of a column in the header: by alias, else by substring; null if absent."""
        found = [F.array_position("_head", normalize_header(c)) for c in ALIASES[canon]]
        if canon in SUBSTRINGS:
            found.append(F.array_position(F.transform("_head", lambda c: F.coalesce(F.contains(c, F.lit(SUBSTRINGS[canon])), F.lit(False))), True))
        return F.coalesce(*[F.when(x > 0, x) for x in found]).cast("int")

    tagged = tagged.withColumn("_is_head", names("state") & names("district"))
    files = tagged.groupBy("source_file").agg(F.min(F.when(F.col("_is_head"), F.col("_names"))).alias("_head"))
    placed = files.select("source_file", F.size("_head").alias("_width"), F.col("_head").isNull().alias("_no_head"),
                          *[place(c).alias(f"_at_{c}") for c in ALIASES])
    return tagged.drop("_names"), small_side(placed)


def _rows_and_rejects(tagged: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    there = placed.agg(*[F.count(f"_at_{c}").alias(c) for c in ALIASES]).first()
    found = [c for c in ALIASES if there[c]]
    data = tagged.where(~F.col("_is_head")).withColumn("cells", _cells(F.col("line"))).join(placed, "source_file")
    reason = (F.when(F.col("_no_head"), "header").when(_open_quote(F.col("line")), "quote")
               .when(F.size("cells") > F.col("_width"), "cells"))
    data = data.withColumn("reason", reason)
    rows = data.where("reason is null").select(
        *[F.when(F.col(f"_at_{c}").isNotNull(), F.try_element_at("cells", F.col(f"_at_{c}"))).alias(c) for c in found], "source_file")
    rejects = data.where("reason is not null").select("source_file", "reason", "line")
    return rows, rejects


def _files(spark: SparkSession, paths, glob: str, recursive: bool) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return text_lines(reader, list(paths) if not isinstance(paths, str) else paths)


def scan_readings(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv",
                  recursive: bool = True) -> DataFrame:
    """The rows of ``read_lines`` for every reading file below ``paths``, as text.
    A file without a header is an error; rejected lines are left to ``scan_rejects``."""
    tagged, placed = _headers(_files(spark, paths, glob, recursive))
    rows, _ = _rows_and_rejects(tagged, placed)
    without = placed.where("_no_head").count()
    if without:
        raise ValueError(f"{without} files have no header line that names a state and a district column")
    return rows


def scan_rejects(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv",
                 recursive: bool = True) -> DataFrame:
    """(source_file, reason, line) of the lines that ``scan_readings`` skips."""
    return read_lines(_files(spark, paths, glob, recursive))[1]


def standardize(df: DataFrame, year_from_path: bool = False, year: int | None = None,
                required: Sequence[str] = ("state", "district", "date_text", "moisture")) -> DataFrame:
    """S3 + P1/P2/P3/P8: canonical schema, strict date parse, date parts
    re-derived from the date (source Year/Month/Day are dropped first, so no
    two columns differ only by case), measures coerced to double.  A measure
    that the input lacks is left out, not added as nulls."""
    cols = df.columns
    picked = {}
    for canon, cands in ALIASES.items():
        if canon in cols:
            picked[canon] = canon
        else:
            picked[canon] = resolve_column(cols, cands, SUBSTRINGS.get(canon))
    missing = [c for c in required if picked.get(c) is None]
    if missing:
        raise KeyError(f"required columns not found: {missing}; available: {cols}")

    def pick(canon: str, dtype: str = "string") -> Column:
        src = picked.get(canon)
        if src is None:
            return F.lit(None).cast(dtype).alias(canon)
        c = F.col(f"`{src}`")
        return (numeric_coerce(c) if dtype == "double" else c.cast(dtype)).alias(canon)

    d = parse_date(F.col(f"`{picked['date_text']}`"))
    out = df.select(
        F.upper(F.trim(pick("state"))).alias("state"),
        F.upper(F.trim(pick("district"))).alias("district"),
        pick("date_text"),
        d.alias("reading_date"),
        *[pick(m, "double") for m in MEASURES if picked.get(m)],
        (F.col("source_file") if "source_file" in cols else F.lit(None).cast("string")).alias("source_file"),
    )
    if year is not None:
        yr = F.lit(int(year))
    elif year_from_path:
        yr = F.regexp_extract("source_file", r"/((?:19|20)\d{2})/", 1).try_cast("int")
    else:
        yr = F.year("reading_date")
    return (out.withColumn("Year", yr.cast("int"))
               .withColumn("Month", month_abbr_upper("reading_date"))
               .withColumn("Day", F.dayofmonth("reading_date"))
               .withColumn("Month_num", F.month("reading_date"))
               .withColumn("state", clean_text("state"))
               .withColumn("district", clean_text("district")))


def with_row_id(df: DataFrame) -> DataFrame:
    """Explicit tie-break for rows of the same day (ledger L18): a hash of the
    row's values (not of its file), the same on every run however files were
    split.  Rows that differ get different ids but for clashes of 64-bit
    hashes; Q1 has removed exact copies."""
    return df.withColumn("row_id", F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c != "source_file"]))


def rejected_dates(df: DataFrame) -> DataFrame:
    """How many rows of a standardised frame have date text that no known format reads."""
    bad = F.col("date_text").isNotNull() & F.col("reading_date").isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_rejected"))


# ---------------------------------------------------------------- sinks

def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = ("Year",),
                mode: str = "overwrite", fmt: str = "parquet",
                sort_within: Sequence[str] | None = None) -> None:
    """S5/S6 (+T1): partitioned Parquet sink.  ``mode='ignore'`` is
    write-if-absent; overwrite is dynamic per partition when configured so.
    ``sort_within`` orders rows inside each file (e.g. the panel order
    state, district, Year, Month_num, Day) without a global sort."""
    if sort_within:              # the writer wants rows by partition value; it keeps an order that begins so
        df = df.sortWithinPartitions(*(partition_by or ()), *sort_within)
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


EXPORT_ROWS = 1_000_000


def export_csv(df: DataFrame, path: str, order_by: Sequence[str] | None = None) -> None:
    """CSV export.  A table counted at most ``EXPORT_ROWS`` rows (rankings,
    projections, monthly means, pivots) becomes one file; a larger one a file
    per task, in order from file to file."""
    out = df.orderBy(*order_by) if order_by else df
    if df.limit(EXPORT_ROWS + 1).count() <= EXPORT_ROWS:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """None when the path is missing or the table is empty."""
    try:
        df = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if df.isEmpty() else df

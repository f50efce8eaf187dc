"""CSV scan and header handling.

Uploads are read with an all-string schema (no inference pass over the data),
NA tokens are normalised to null once, and typing happens in one projection
with coercing casts, so a bad cell becomes null instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.expr import numeric, parse_date, ustrip


def require_columns(df: DataFrame, required: Iterable[str], what: str = "frame") -> None:
    """Raise before any job runs when required columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Header CSV as all-string columns with NA tokens turned into null.

    Line breaks inside quoted fields belong to the field (:func:`csv_records`).
    """
    return normalise_na(csv_records(spark, path, columns))


# States of a CSV reader within a line.
_IN_FIELD, _AT_FIELD, _QUOTED, _QUOTE_SEEN = range(4)


def _after_line(line: Column, start: int) -> Column:
    """Does a quoted field stay open at the end of a line that is read from state ``start``?

    A quote opens a field only at its beginning, two of them inside stand for
    one, any other closes it; elsewhere it is a character.
    """
    def text(state, t):
        moved = F.when(F.endswith(t, F.lit(",")), _AT_FIELD).otherwise(_IN_FIELD)
        return F.when((state == _QUOTED) | (t == ""), state).otherwise(moved)

    def quote(state):
        return F.when(state == _AT_FIELD, _QUOTED).when(state == _QUOTED, _QUOTE_SEEN) \
            .when(state == _QUOTE_SEEN, _QUOTED).otherwise(_IN_FIELD)

    # text between the quotes of the line
    parts = F.split(F.concat(F.lit("" if start == _AT_FIELD else '"'), line), '"')
    begun = F.aggregate(parts, F.lit(-1), lambda s, t: F.when(s < 0, text(F.lit(_AT_FIELD), t)).otherwise(text(quote(s), t)))
    return (begun == _QUOTED).cast("int")


def _line_states(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``_base`` and ``_turns``: the state after a row is ``coalesce(_base, state at the start) ^ (_turns & 1)``.

    A row (``_out``, ``_in``: the state after it, from either state before it)
    sets the state, keeps it or turns it over; what a run of rows does is told
    by the last one that sets it and by the turns.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = lines.withColumn("_turns", F.sum((F.col("_out") > F.col("_in")).cast("int")).over(upto))
    sets = F.when(F.col("_out") == F.col("_in"), F.col("_out").bitwiseXOR(F.col("_turns").bitwiseAND(F.lit(1))))
    return turned.withColumn("_base", F.last(sets, ignorenulls=True).over(upto))


def _state(base: Column, turns: Column, at_start: Column) -> Column:
    return F.coalesce(base, at_start).bitwiseXOR(turns.bitwiseAND(F.lit(1)))


def csv_records(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Header CSV as all-string columns; quoted fields may hold line breaks, and files are still split.

    Every file split is read as lines. Whether a line begins inside a quoted
    field depends on all lines before it, but only through one bit: each split
    tells what it does to that bit (one row a split), a running composition over
    the splits of a file gives the bit each split begins with. Lines that are a
    record of their own are parsed where they are; only the lines of broken
    records are brought together, also across splits. A quote that is never
    closed makes the rest of its file one record.

    Each file's first line is its header (without line breaks). Blank lines are
    skipped, a line break is ``\\n`` or ``\\r\\n``, short records are filled
    with null. An empty file gives no rows.
    """
    if not columns:
        columns = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"))
    quoted = F.contains("value", F.lit('"'))
    effects = lines.withColumns({"_out": F.when(quoted, _after_line(F.col("value"), _AT_FIELD)).otherwise(0),
                                 "_in": F.when(quoted, _after_line(F.col("value"), _QUOTED)).otherwise(1)})
    split, order = ["_file", "_split"], Window.partitionBy("_file", "_split").orderBy("_line")
    lines = _line_states(effects, split, "_line").withColumns({
        "_base_before": F.lag("_base").over(order), "_turns_before": F.coalesce(F.lag("_turns").over(order), F.lit(0))})

    def opens(at_start):
        return _state(F.col("_base_before"), F.col("_turns_before"), at_start) == 0

    splits = lines.groupBy(*split).agg(
        F.max_by(F.struct("_base", "_turns"), "_line").alias("_end"),
        *(F.count_if(opens(F.lit(s))).alias(f"_records_{s}") for s in (0, 1)))
    splits = _line_states(splits.withColumns({f"_{name}": _state(F.col("_end._base"), F.col("_end._turns"), F.lit(s))
                                              for s, name in ((0, "out"), (1, "in"))}), ["_file"], "_split")
    along = Window.partitionBy("_file").orderBy("_split")
    splits = splits.withColumn("_begins", F.coalesce(F.lag(_state(F.col("_base"), F.col("_turns"), F.lit(0))).over(along), F.lit(0)))
    splits = splits.withColumn("_records", F.when(F.col("_begins") == 0, F.col("_records_0")).otherwise(F.col("_records_1")))
    last_open = F.last(F.when(F.col("_records") > 0, F.struct("_split", "_records")), ignorenulls=True)
    splits = splits.select(*split, "_begins", last_open.over(
        along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))

    placed = lines.join(splits, split).withColumn("_opens", opens(F.col("_begins")))
    placed = placed.withColumn("_n", F.count_if("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    header = (F.col("_split") == 0) & (F.col("_n") == 1)
    whole = F.col("_opens") & (F.col("_out") == 0)
    single = placed.where(whole & ~header).select("value")
    own = F.struct(F.col("_split"), F.col("_n").alias("_records"))
    pieces = placed.where(~whole & ~header).withColumn("_record", F.when(F.col("_n") > 0, own).otherwise(F.col("_carried")))
    joined = pieces.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_split", "_line", "value"))).alias("_parts")) \
        .select(F.array_join("_parts.value", "\n").alias("value"))
    fields = ", ".join("`{}` string".format(c.replace("`", "``")) for c in columns)
    text = F.regexp_replace("value", r"\r$", "")
    parsed = single.unionAll(joined).select(text.alias("value")).where(F.trim("value") != "")
    return parsed.select(F.from_csv("value", fields, {"mode": "PERMISSIVE", "escape": '"'}).alias("r")).select("r.*")


def normalise_na(df: DataFrame, tokens: list[str] = C.NA_TOKENS) -> DataFrame:
    """The usual missing-value spellings become SQL null (string columns only)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(ustrip(c).isin(tokens) | c.isNull(), F.lit(None).cast("string"))
                        .otherwise(c).alias(f.name))
        else:
            cols.append(c.alias(f.name))
    return df.select(*cols)


def normalise_columns(df: DataFrame, aliases: Mapping[str, str] = C.COLUMN_ALIASES) -> DataFrame:
    """Known aliases -> canonical names; other headers stripped and lower-cased."""
    canonical = set(aliases.values())
    renames = {}
    for c in df.columns:
        if c in aliases:
            renames[c] = aliases[c]
        elif c not in canonical:
            renames[c] = c.strip().lower()
    return df.withColumnsRenamed(renames) if renames else df


def parse_dates(df: DataFrame, date_cols: Iterable[str] = C.DATE_COLUMNS) -> DataFrame:
    """Known date columns parsed to DATE; unparsable -> null."""
    repl = {c: parse_date(c, df.schema[c].dataType) for c in date_cols if c in df.columns}
    return df.withColumns(repl) if repl else df


def ensure_break_id(df: DataFrame) -> None:
    if "break_id" not in df.columns:
        raise ValueError(f"no break_id among the columns (aliases included): {df.columns}")


def load_mi_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """MI report: scan, aliases, dates; break_id is mandatory."""
    df = parse_dates(normalise_columns(read_csv(spark, path)))
    ensure_break_id(df)
    return df


def convert_pence(df: DataFrame, amount_cols: Iterable[str] = C.PENCE_COLUMNS) -> DataFrame:
    """For every listed column present, ``x_pence / 100 -> x_gbp`` (original kept)."""
    repl = {c.replace("_pence", "_gbp"): numeric(df, c) / F.lit(100.0)
            for c in amount_cols if c in df.columns}
    return df.withColumns(repl) if repl else df

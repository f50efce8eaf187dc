"""Column-expression helpers. All are built-in Spark expressions (codegen'd);
no Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def col_(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's ``str.strip()`` treats as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
              "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def ustrip(c: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace of any kind (tabs, NBSP, ...).

    A character-set trim, not a regex: codegen'd and allocation-free.
    """
    return F.btrim(col_(c), F.lit(WHITESPACE))


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN compares as true in Spark's ordering; turn it into SQL null first."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def to_number(c: ColumnOrName) -> Column:
    """Coercing numeric parse: unparsable -> null, NaN -> null."""
    return nan_to_null(ustrip(col_(c).cast("string")).try_cast("double"))


def money(c: ColumnOrName) -> Column:
    """An amount as an exact decimal (no number, infinite, too large: null), to be added in any order."""
    return col_(c).try_cast("decimal(28,4)")


def money_sum(c: ColumnOrName) -> Column:
    """Exact total of amounts with up to four decimals."""
    return F.sum(money(c)).cast("double")


def parse_timestamp(c: ColumnOrName, dtype: T.DataType | None = None) -> Column:
    """Coercing date parse.

    ISO text is ISO; ``dd/MM/yyyy`` text is day-first; anything else -> null.
    Date/timestamp input passes through as ``timestamp_ntz``.
    """
    c = col_(c)
    if dtype is not None and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    s = ustrip(c.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(s, F.lit("dd/MM/yyyy HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(s, F.lit("d/M/yyyy")),
    ).cast("timestamp_ntz")


def parse_date(c: ColumnOrName, dtype: T.DataType | None = None) -> Column:
    return parse_timestamp(c, dtype).cast("date")


def lookup(mapping: Mapping, c: ColumnOrName, default=None) -> Column:
    """Literal dictionary lookup; keys absent from the map -> ``default``."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    out = F.try_element_at(m, col_(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def clip(c: ColumnOrName, lo=None, hi=None) -> Column:
    """Null-preserving clip (Spark's greatest/least would skip nulls)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_or_null(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column if present, else a typed null (``df.get(col, NaN)``)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def num_or_null(df: DataFrame, name: str) -> Column:
    """Coercing numeric view of a column if present, else null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return numeric(df, name)


def numeric(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nan_to_null(c)
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    return nan_to_null(c.cast("string").try_cast("double"))


def flag_or_false(df: DataFrame, name: str) -> Column:
    """Boolean view: missing column or null/unparsable -> False."""
    if name not in df.columns:
        return F.lit(False)
    return F.coalesce(numeric(df, name), F.lit(0.0)) != F.lit(0.0)


def days_between(later: Column, earlier: Column, dates_only: bool = False) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (time parts honoured).

    ``dates_only`` (both sides are DATE) uses plain ``datediff`` - integer
    arithmetic instead of a per-row timestamp difference.
    """
    if dates_only:
        return F.datediff(later, earlier)
    secs = F.timestamp_diff("SECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return F.floor(secs / F.lit(86400)).cast("int")


def is_date(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.DateType)

"""Break lifecycle: chains per trade, rec flow, journal flag, false closure.

Plan shape (what ``explain`` shows): the cash side is one hash aggregate per
(product, trade) - partial aggregation map-side; the MI side is one aggregate
per (trade, rec) followed by one per trade, which yields rec flow, root rec
and journal flag together; the two meet in ONE left join on the trade.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import lookup, money, numeric, parse_timestamp, ustrip
from ..sources.csv import require_columns
from .ranking import dense_ids, running_totals

Dictionary = Mapping | DataFrame | None


def standardize_cash(df: DataFrame, date_col: str = "BREAK_DATE", trade_col: str = "TRADE_ID",
                     product_col: str = "PRODUCT", amount_col: str = "BREAK") -> DataFrame:
    """typed cash breaks with columns Date, TRADE_ID, PRODUCT, BREAK (+ passthrough)."""
    require_columns(df, [date_col, trade_col, product_col, amount_col], "cash_df")
    dt = df.schema[date_col].dataType
    std = {
        "Date": parse_timestamp(date_col, dt),
        "TRADE_ID": ustrip(F.col(trade_col).cast("string")),
        "PRODUCT": ustrip(F.col(product_col).cast("string")),
        "BREAK": F.coalesce(numeric(df, amount_col), F.lit(0.0)),
    }
    rest = [c for c in df.columns if c not in std and c not in (date_col, trade_col, product_col,
                                                                 amount_col)]
    return df.select(*[e.alias(k) for k, e in std.items()], *rest)


def standardize_mi(df: DataFrame, date_col: str = "Date", trade_col: str = "TRADE REF",
                   rec_col: str = C.REC_NAME_COL, journal_col: str | None = "Journals Posted",
                   age_col: str | None = "Age Days") -> DataFrame:
    """typed MI rows with columns Date, TRADE REF, Rec (+ journal / age if present)."""
    require_columns(df, [date_col, trade_col], "mi_df")
    if rec_col not in df.columns:
        raise ValueError(f"no rec name column {rec_col!r} among {df.columns}")
    dt = df.schema[date_col].dataType
    cols = [parse_timestamp(date_col, dt).alias("Date"),
            ustrip(F.col(trade_col).cast("string")).alias("TRADE REF"),
            ustrip(F.col(rec_col).cast("string")).alias("Rec")]
    if journal_col and journal_col in df.columns:
        cols.append(F.col(journal_col).alias("Journals Posted"))
    if age_col and age_col in df.columns:
        cols.append(numeric(df, age_col).alias("Age Days"))
    return df.select(*cols)


def filter_date_range(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """inclusive [start, end]; rows with a null date drop out."""
    c = F.col(date_col)
    return df.where((c >= F.lit(start).cast("timestamp_ntz")) & (c <= F.lit(end).cast("timestamp_ntz")))


def cap_age(df: DataFrame, max_age: int = C.MAX_AGE_DAYS, age_col: str = "Age Days") -> DataFrame:
    """keep ``age <= max_age`` when the age column exists (null ages drop out)."""
    if age_col not in df.columns:
        return df
    return df.where(F.col(age_col) <= F.lit(max_age))


def trade_key(product: Column | str = "PRODUCT", trade: Column | str = "TRADE_ID") -> Column:
    """display key ``PRODUCT|TRADE_ID`` (grouping uses the pair, not this string)."""
    return F.concat(F.col(product) if isinstance(product, str) else product,
                    F.lit(C.TRADE_KEY_SEPARATOR),
                    F.col(trade) if isinstance(trade, str) else trade)


def chain_ids(cash: DataFrame) -> DataFrame:
    """BreakChainID = 0-based position of the trade key in sorted order.

    Distinct keys are numbered with the range-bucketed ranking (no single-task
    window); ties on the display key fall back to the (product, trade) pair.
    """
    keys = cash.select("PRODUCT", "TRADE_ID").distinct().withColumn("TradeKey", trade_key())
    ids = dense_ids(keys, ["TradeKey", "PRODUCT", "TRADE_ID"], id_col="BreakChainID")
    return ids


def build_break_chains(cash: DataFrame) -> DataFrame:
    """Cash rows with TradeKey and BreakChainID attached."""
    ids = chain_ids(cash).drop("TradeKey").withColumnsRenamed(
        {"PRODUCT": "__id_p", "TRADE_ID": "__id_t"})
    j = cash.join(ids, F.col("PRODUCT").eqNullSafe(F.col("__id_p"))
                  & F.col("TRADE_ID").eqNullSafe(F.col("__id_t")), "left")
    return j.select(*cash.columns, trade_key().alias("TradeKey"), "BreakChainID")


def build_chain_summary(cash: DataFrame, with_ids: bool = True) -> DataFrame:
    """A01 (+ W01): one row per chain (product, trade).

    The chain id is assigned on the aggregated rows (one per chain), so the
    numbering never touches the raw breaks.
    """
    # per (trade, product, day) first - hot trades fold to their few days - then
    # hash-partition by trade only: that partitioning serves the chain aggregate
    # (its keys include the trade) AND the join to the per-trade info, so the
    # chains are not shuffled again for the join; distinct days need no Expand.
    daily = cash.groupBy("TRADE_ID", "PRODUCT", "Date").agg(
        F.count("BREAK").alias("__n"), F.sum(money("BREAK")).alias("__p"))
    agg = daily.repartition("TRADE_ID").groupBy("TRADE_ID", "PRODUCT").agg(
        F.min("Date").alias("Start_Date"),
        F.max("Date").alias("End_Date"),
        F.count("Date").alias("Days_Active"),
        F.sum("__n").alias("Total_Breaks"),
        F.sum("__p").cast("double").alias("Total_Amount"),
    )
    out = agg.select(F.col("TRADE_ID").alias("Trade"), F.col("PRODUCT").alias("Product"),
                     "Start_Date", "End_Date", "Days_Active", "Total_Breaks", "Total_Amount",
                     (F.col("Days_Active") > F.lit(C.RECURRING_MIN_DAYS)).alias("Is_Recurring"))
    if not with_ids:
        return out
    keyed = out.withColumn("__tk", trade_key("Product", "Trade"))
    r = running_totals(keyed, ["__tk", "Product", "Trade"])
    return r.select((F.col("pos") - 1).cast("long").alias("BreakChainID"), *out.columns)


def _rank_expr(mi: DataFrame, rec_order: Dictionary) -> tuple[DataFrame, Column]:
    if rec_order is None:
        rec_order = C.REC_ORDER
    if isinstance(rec_order, DataFrame):
        dim = rec_order.select(F.col(rec_order.columns[0]).alias("__rec"),
                               F.col(rec_order.columns[1]).alias("__rank"))
        j = mi.join(dim, mi["Rec"] == dim["__rec"], "left").drop("__rec")
        return j, F.coalesce(F.col("__rank").cast("int"), F.lit(C.UNKNOWN_REC_RANK))
    return mi, lookup(rec_order, "Rec", C.UNKNOWN_REC_RANK).cast("int")


def build_trade_info(mi: DataFrame, rec_order: Dictionary = None) -> DataFrame:
    """A02 + A03 + A04 (+ U01, W09, J06) in one pass per trade.

    Returns TRADE REF, Rec_Flow, Root_Rec, Journal_Used. The per-trade state is
    bounded by the distinct recs of the trade (rows are first folded per
    (trade, rec), which also removes hot keys before the second shuffle).
    """
    has_j = "Journals Posted" in mi.columns
    per_rec = mi.groupBy("TRADE REF", "Rec").agg(
        F.min("Date").alias("__first"),
        (F.bool_or(F.col("Journals Posted").isNotNull()) if has_j else F.lit(False)).alias("__j"))
    per_rec, rank = _rank_expr(per_rec, rec_order)
    step = per_rec.select("TRADE REF", "__j",
                          F.struct(F.col("__first").alias("d"), rank.alias("r"),
                                   F.col("Rec").alias("rec")).alias("__s"))
    return step.groupBy("TRADE REF").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__s")), lambda s: s["rec"]),
                     C.REC_FLOW_SEPARATOR).alias("Rec_Flow"),
        F.min("__s")["rec"].alias("Root_Rec"),
        F.bool_or("__j").alias("Journal_Used"),
    )


def root_system(root_rec: Column, root_map: Mapping | None = None,
                mapped: Column | None = None) -> Column:
    """Dictionary lookup, else the text before the first whitespace."""
    fallback = F.when(root_rec.isNull(), F.lit(None)).otherwise(
        F.regexp_extract(root_rec, r"(?U)^(\S*)", 1))
    if mapped is None:
        mapped = lookup(root_map if root_map is not None else C.ROOT_SYSTEM_MAP, root_rec)
    return F.coalesce(mapped, fallback)


def build_final_summary(chain_summary: DataFrame, trade_info: DataFrame,
                        root_map: Dictionary = None) -> DataFrame:
    """Chains LEFT JOIN per-trade info (one join), False_Closure, Root_System."""
    t = trade_info
    j = chain_summary.join(t, chain_summary["Trade"] == t["TRADE REF"], "left")
    journal = F.coalesce(t["Journal_Used"], F.lit(False))
    cols = [chain_summary[c] for c in chain_summary.columns] + [
        t["Rec_Flow"], t["Root_Rec"], journal.alias("Journal_Used"),
        (journal & chain_summary["Is_Recurring"]).alias("False_Closure")]
    if isinstance(root_map, DataFrame):
        dim = root_map.select(F.col(root_map.columns[0]).alias("__rr"),
                              F.col(root_map.columns[1]).alias("__rs"))
        out = j.select(*cols)
        out = out.join(dim, out["Root_Rec"] == dim["__rr"], "left")
        return out.select(*[out[c] for c in out.columns if c not in ("__rr", "__rs")],
                          root_system(F.col("Root_Rec"), mapped=F.col("__rs")).alias("Root_System"))
    return j.select(*cols, root_system(t["Root_Rec"], root_map).alias("Root_System"))


def run_lifecycle(cash_raw: DataFrame, mi_raw: DataFrame, start=C.DEFAULT_START, end=C.DEFAULT_END,
                  rec_order: Dictionary = None, root_map: Dictionary = None,
                  cash_cols: dict | None = None, mi_cols: dict | None = None) -> DataFrame:
    """Standardise -> filter -> chains -> trade info -> final summary."""
    cash = standardize_cash(cash_raw, **(cash_cols or {}))
    mi = standardize_mi(mi_raw, **(mi_cols or {}))
    cash = filter_date_range(cash, "Date", start, end)
    mi = cap_age(filter_date_range(mi, "Date", start, end))
    chains = build_chain_summary(cash)
    info = build_trade_info(mi, rec_order)
    return build_final_summary(chains, info, root_map)

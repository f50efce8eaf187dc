"""Reports over the final lifecycle summary.

All are single aggregates or ``orderBy().limit()`` (TakeOrderedAndProject:
each task keeps its own top-k, only k rows per task reach the final merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import money_sum

DISPLAY_COLUMNS = ["Trade", "Product", "Start_Date", "End_Date", "Days_Active", "Total_Breaks",
                   "Total_Amount", "Is_Recurring", "Root_System", "Root_Rec", "Rec_Flow",
                   "Journal_Used", "False_Closure", "BreakChainID"]
CLI_TOP_COLUMNS = ["Trade", "Product", "Days_Active", "Rec_Flow", "Root_Rec"]
UI_TOP_COLUMNS = ["Trade", "Product", "Days_Active", "Total_Breaks", "Total_Amount",
                  "Root_System", "Root_Rec", "Rec_Flow"]


def pct(part, total, digits: int = 1):
    """``round(100 * part / total, digits)`` half-even; null when total is 0."""
    return F.bround(F.try_divide(part * F.lit(100.0), total), digits)


def p1_kpis(summary: DataFrame) -> DataFrame:
    """One row - totals, recurring, journal, false closure, their % and amount."""
    cnt = lambda c: F.count_if(F.col(c)).alias(c.lower())
    a = summary.agg(F.count(F.lit(1)).alias("total_chains"), cnt("Is_Recurring"),
                    cnt("Journal_Used"), cnt("False_Closure"),
                    money_sum("Total_Amount").alias("total_amount"))
    return a.select("*", *[pct(F.col(c), F.col("total_chains")).alias(f"{c}_pct")
                           for c in ("is_recurring", "journal_used", "false_closure")])


def root_system_top(summary: DataFrame, n: int = 10) -> DataFrame:
    """Per root system (nulls dropped) chains + false closures, top n."""
    return (summary.where(F.col("Root_System").isNotNull())
            .groupBy("Root_System")
            .agg(F.count(F.lit(1)).alias("Total_Chains"),
                 F.count_if("False_Closure").alias("False_Closures"))
            .orderBy(F.desc("Total_Chains"), F.asc("Root_System")).limit(n))


def root_system_full(summary: DataFrame) -> DataFrame:
    """Per root system, null kept as 'Unknown', with FC_Rate."""
    g = summary.groupBy("Root_System").agg(
        F.count(F.lit(1)).alias("Total_Chains"),
        F.count_if("False_Closure").alias("False_Closures"),
        F.count_if("Is_Recurring").alias("Recurring"),
        F.count_if("Journal_Used").alias("Journal_Used"),
        money_sum("Total_Amount").alias("Total_Amount"))
    return g.select(F.coalesce("Root_System", F.lit("Unknown")).alias("Root_System"),
                    "Total_Chains", "False_Closures", "Recurring", "Journal_Used", "Total_Amount",
                    F.bround(F.col("False_Closures") * F.lit(100.0)
                             / F.greatest(F.col("Total_Chains"), F.lit(1)), 1).alias("FC_Rate"))


def days_active_hist(summary: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of Days_Active over false closures (non-empty bins).

    Bin edges come from one bounded aggregate (min, max); the binning itself is
    a codegen'd projection + hash aggregate.
    """
    fc = summary.where(F.col("False_Closure"))
    lo, hi = fc.agg(F.min("Days_Active"), F.max("Days_Active")).first()
    if lo is None:
        return fc.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"),
                         F.lit(0.0).alias("bin_end"), F.lit(0).cast("long").alias("chains")).limit(0)
    width = float(hi - lo)
    x = F.col("Days_Active")
    if width > 0:
        b = F.least(F.floor((x - F.lit(lo)) * F.lit(bins) / F.lit(width)), F.lit(bins - 1))
    else:
        b = F.lit(0)
    g = fc.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("chains"))
    step = width / bins if width > 0 else 0.0
    return g.select("bin", (F.lit(float(lo)) + F.col("bin") * F.lit(step)).alias("bin_start"),
                    (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(step)).alias("bin_end"),
                    "chains")


def top_false_closures(summary: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """T01 (n=10, 5 columns) / T02 (n=20, 8 columns): longest-running false closures."""
    cols = columns or CLI_TOP_COLUMNS
    return (summary.where(F.col("False_Closure"))
            .orderBy(F.desc("Days_Active"), F.asc("BreakChainID")).limit(n).select(*cols))


def flag_filter(summary: DataFrame, recurring_only: bool = False,
                false_closure_only: bool = False) -> DataFrame:
    """recurring-only / false-closure-only views."""
    out = summary
    if recurring_only:
        out = out.where(F.col("Is_Recurring"))
    if false_closure_only:
        out = out.where(F.col("False_Closure"))
    return out


def display_projection(summary: DataFrame, columns: list[str] = DISPLAY_COLUMNS) -> DataFrame:
    """ordered subset of the columns that exist."""
    return summary.select(*[c for c in columns if c in summary.columns])

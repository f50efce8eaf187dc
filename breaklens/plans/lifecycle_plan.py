"""E1 - lifecycle plan over the fixture views, and its DuckDB oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import lifecycle as L
from ..sources.fixtures import Fixtures

# Whole-table window for the registered queries (covers every ship date);
# F03 gets its own narrower window, where the filter is the feature.
FULL_START, FULL_END = "1990-01-01", "2030-12-31"
WINDOW_START, WINDOW_END = "1996-01-01", "1997-06-30"

CASH_COLS = dict(date_col="break_date", trade_col="trade_id", product_col="product",
                 amount_col="break_amt")
MI_COLS = dict(date_col="mi_date", trade_col="trade_ref", rec_col="rec",
               journal_col="journals_posted", age_col="age_days")


def std_cash(fx: Fixtures) -> DataFrame:
    return L.standardize_cash(fx["cash"], **CASH_COLS)


def std_mi(fx: Fixtures) -> DataFrame:
    return L.standardize_mi(fx["mi"], **MI_COLS)


def rec_order(fx: Fixtures) -> DataFrame:
    return fx["rec_dim"].select("rec", "rec_rank")


def root_map(fx: Fixtures) -> DataFrame:
    return fx["rec_dim"].select("rec", "root_system")


def filtered_inputs(fx: Fixtures, start=FULL_START, end=FULL_END):
    cash = L.filter_date_range(std_cash(fx), "Date", start, end)
    mi = L.cap_age(L.filter_date_range(std_mi(fx), "Date", start, end))
    return cash, mi


def chain_summary(fx: Fixtures, start=FULL_START, end=FULL_END, with_ids: bool = True) -> DataFrame:
    cash, _ = filtered_inputs(fx, start, end)
    return L.build_chain_summary(cash, with_ids)


def trade_info(fx: Fixtures, start=FULL_START, end=FULL_END) -> DataFrame:
    _, mi = filtered_inputs(fx, start, end)
    return L.build_trade_info(mi, rec_order(fx))


def final_summary(fx: Fixtures, start=FULL_START, end=FULL_END, with_ids: bool = True) -> DataFrame:
    """J01 final summary; ``with_ids=False`` skips chain numbering for reports
    that never read BreakChainID (its value cannot change their result)."""
    cash, mi = filtered_inputs(fx, start, end)
    chains = L.build_chain_summary(cash, with_ids)
    info = L.build_trade_info(mi, rec_order(fx))
    return L.build_final_summary(chains, info, root_map(fx))


# ───────────────────────────── oracle text ─────────────────────────────
_STRIP = "regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c=c)


def cash_std_sql() -> str:
    return (f"SELECT CAST(break_date AS TIMESTAMP) AS \"Date\", {_strip('trade_id')} AS \"TRADE_ID\", "
            f"{_strip('product')} AS \"PRODUCT\", COALESCE(CAST(break_amt AS DOUBLE), 0.0) AS \"BREAK\" "
            f"FROM cash")


def mi_std_sql() -> str:
    return (f"SELECT CAST(mi_date AS TIMESTAMP) AS \"Date\", {_strip('trade_ref')} AS \"TRADE REF\", "
            f"{_strip('rec')} AS \"Rec\", journals_posted AS \"Journals Posted\", "
            f"CAST(age_days AS DOUBLE) AS \"Age Days\" FROM mi")


def summary_ctes(start=FULL_START, end=FULL_END) -> str:
    """CTEs ending in ``summary`` (the J01 final summary), without the leading WITH."""
    return f"""
cash_s AS ({cash_std_sql()}),
cash_f AS (SELECT * FROM cash_s WHERE "Date" >= TIMESTAMP '{start}' AND "Date" <= TIMESTAMP '{end}'),
chains0 AS (
  SELECT "TRADE_ID" AS "Trade", "PRODUCT" AS "Product", MIN("Date") AS "Start_Date",
         MAX("Date") AS "End_Date", COUNT(DISTINCT "Date") AS "Days_Active",
         COUNT("BREAK") AS "Total_Breaks",
         CAST(SUM(CAST("BREAK" AS DECIMAL(28, 4))) AS DOUBLE) AS "Total_Amount",
         COUNT(DISTINCT "Date") > 1 AS "Is_Recurring"
  FROM cash_f GROUP BY "PRODUCT", "TRADE_ID"),
chains AS (
  SELECT ROW_NUMBER() OVER (ORDER BY "Product" || '|' || "Trade", "Product", "Trade") - 1
           AS "BreakChainID", * FROM chains0),
mi_s AS ({mi_std_sql()}),
mi_f AS (SELECT * FROM mi_s WHERE "Date" >= TIMESTAMP '{start}' AND "Date" <= TIMESTAMP '{end}'
         AND "Age Days" <= 90),
per_rec AS (
  SELECT p."TRADE REF", p."Rec", p.first_d, p.j, COALESCE(CAST(d.rec_rank AS INTEGER), 999) AS rk
  FROM (SELECT "TRADE REF", "Rec", MIN("Date") AS first_d,
               BOOL_OR("Journals Posted" IS NOT NULL) AS j
        FROM mi_f GROUP BY "TRADE REF", "Rec") p
  LEFT JOIN (SELECT rec, rec_rank FROM rec_dim) d ON p."Rec" = d.rec),
info AS (
  SELECT "TRADE REF",
         string_agg("Rec", ' → ' ORDER BY first_d, rk, "Rec") AS "Rec_Flow",
         first("Rec" ORDER BY first_d, rk, "Rec") AS "Root_Rec",
         BOOL_OR(j) AS "Journal_Used"
  FROM per_rec GROUP BY "TRADE REF"),
summary AS (
  SELECT c.*, i."Rec_Flow", i."Root_Rec", COALESCE(i."Journal_Used", false) AS "Journal_Used",
         COALESCE(i."Journal_Used", false) AND c."Is_Recurring" AS "False_Closure",
         COALESCE(rm.root_system, CASE WHEN i."Root_Rec" IS NOT NULL
                  THEN regexp_extract(i."Root_Rec", '^(\\S*)', 1) END) AS "Root_System"
  FROM chains c LEFT JOIN info i ON c."Trade" = i."TRADE REF"
  LEFT JOIN (SELECT rec, root_system FROM rec_dim) rm ON i."Root_Rec" = rm.rec)
"""

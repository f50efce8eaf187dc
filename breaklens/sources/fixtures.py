"""Views over the driver tables that stand in for the MI / cash / report inputs.

The same SQL text runs in Spark (``spark.sql`` with DataFrame arguments) and
in the DuckDB oracle (as CTEs), so both engines see row-for-row equal inputs.
Rec names, ranks and root systems here are synthetic; in the library both
dictionaries are parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

VIEW_SQL: dict[str, str] = {}

VIEW_SQL["rec_dim"] = """\
SELECT rec_no,
 CASE WHEN rec_no < 20 THEN 'SYS' || CAST(rec_no % 8 AS STRING) || ' vs Ledger - ' || CAST(rec_no AS STRING) ELSE 'Legacy' || CAST(rec_no AS STRING) || ' - Cash' END AS rec,
 CASE WHEN rec_no < 20 THEN rec_no % 10 + 1 END AS rec_rank,
 CASE WHEN rec_no < 20 THEN 'ROOT' || CAST(rec_no % 5 AS STRING) END AS root_system
FROM (SELECT DISTINCT (l_partkey + l_suppkey) % 24 AS rec_no FROM lineitem) r
"""

VIEW_SQL["cash"] = """\
SELECT l_shipdate AS break_date, 'T' || CAST(l_orderkey AS STRING) AS trade_id, p_type AS product,
 CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS break_amt
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

VIEW_SQL["mi"] = """\
SELECT l_shipdate AS mi_date, CASE WHEN l_orderkey % 6 = 0 THEN 'U' ELSE 'T' END || CAST(l_orderkey AS STRING) AS trade_ref, rec,
 CASE WHEN l_returnflag = 'R' THEN 'J' END AS journals_posted, CAST(l_quantity * 2 AS INT) AS age_days
FROM lineitem JOIN rec_dim ON rec_no = (l_partkey + l_suppkey) % 24
"""

VIEW_SQL["breaks"] = """\
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || CASE WHEN m.sgn < 0 THEN 'M' ELSE '' END AS break_id,
 CASE WHEN l_partkey % 9 < 2 THEN 'CEQ' WHEN l_partkey % 9 < 4 THEN 'LnD' WHEN l_partkey % 9 < 6 THEN 'MTN' WHEN l_partkey % 9 < 8 THEN 'OTC' ELSE 'XXX' END AS asset_class,
 CASE WHEN l_quantity = 50 THEN NULL ELSE 'ENTITY_' || CAST(l_suppkey % 20 AS STRING) END AS entity_id,
 'TEAM_' || CAST(l_suppkey % 5 AS STRING) AS team_code,
 'REC_' || CAST(l_partkey % 8 AS STRING) AS rec_name,
 CASE l_returnflag WHEN 'A' THEN 'TLM' WHEN 'N' THEN 'DUCO' ELSE 'OTHER' END AS source_system,
 CAST(l_shipdate AS DATE) AS break_open_date,
 CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 130 AS INT) AS report_date,
 CAST(l_shipdate AS DATE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 130 % 11 AS INT) AS last_activity_date,
 CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_orderkey % 37 = 0 THEN 25 ELSE 1 END * CASE WHEN l_linestatus = 'O' THEN m.sgn ELSE -m.sgn END AS break_amount_pence,
 CAST(ROUND(o_totalprice * 100) AS BIGINT) AS net_amount_pence,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(ROUND(o_totalprice * 100) AS BIGINT) + l_partkey END AS gross_amount_pence,
 CASE WHEN l_linestatus = 'O' THEN 'Dr' WHEN l_discount > 0.05 THEN 'Cr' ELSE 'DR' END AS break_direction,
 CASE WHEN l_quantity < 6 THEN NULL WHEN l_quantity < 10 THEN '  ' ELSE 'Owner' END AS owner,
 CASE WHEN l_discount > 0.08 THEN NULL ELSE 'Approver' END AS approver,
 CASE WHEN l_tax > 0.07 THEN NULL ELSE o_orderstatus END AS status,
 CASE WHEN l_orderkey % 50 = 0 THEN 'MIRROR_' || CAST(l_orderkey AS STRING) WHEN l_orderkey % 41 = 0 THEN NULL ELSE 'CPTY_' || CAST(o_custkey AS STRING) END AS counterparty,
 CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS csa_margin_call_flag,
 CASE WHEN l_partkey % 9 IN (4, 5) THEN l_orderkey % 30 END AS coupon_payment_proximity,
 CASE WHEN l_partkey % 9 IN (0, 1) THEN l_orderkey % 30 END AS div_ex_date_proximity,
 CAST(l_orderkey % 20 AS DOUBLE) / 20 AS supplied_autoclose_rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT 0 AS mirrored, 1 AS sgn UNION ALL SELECT 1 AS mirrored, 1 AS sgn UNION ALL SELECT 1 AS mirrored, -1 AS sgn) m
 ON m.mirrored = CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END
"""

VIEW_SQL["scored"] = """\
SELECT break_id, asset_class, break_amount_pence,
 CASE WHEN (rn * 31) % 7 < 2 THEN 1 ELSE 0 END AS label,
 CASE WHEN rn % 97 = 0 THEN NULL ELSE CAST((rn * 37 + (rn % 7) * 113) % 1001 AS DOUBLE) / 1000 END AS false_break_prob
FROM (SELECT l_orderkey * 8 + l_linenumber AS rn, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS break_id,
 CASE WHEN l_partkey % 9 < 2 THEN 'CEQ' WHEN l_partkey % 9 < 4 THEN 'LnD' WHEN l_partkey % 9 < 6 THEN 'MTN' WHEN l_partkey % 9 < 8 THEN 'OTC' ELSE 'XXX' END AS asset_class,
 CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS break_amount_pence FROM lineitem) s
"""

VIEW_SQL["feedback"] = """\
SELECT break_id, CASE WHEN break_amount_pence % 3 = 0 THEN 0 ELSE 1 END AS analyst_label,
 'analyst_' || CAST(break_amount_pence % 5 AS STRING) AS analyst_id, false_break_prob AS model_prediction,
 CASE WHEN asset_class = 'XXX' THEN NULL ELSE asset_class END AS asset_class, k AS pass_no
FROM scored JOIN (SELECT 0 AS again, 1 AS k UNION ALL SELECT 1 AS again, 1 AS k UNION ALL SELECT 1 AS again, 2 AS k) p
 ON p.again = CASE WHEN break_amount_pence % 50 = 0 THEN 1 ELSE 0 END
"""
_IDENT = re.compile(r"\b([a-z_][a-z0-9_]*)\b")


def _deps(name: str) -> list[str]:
    """Tables/views a view reads, in the order they first appear."""
    words = _IDENT.findall(VIEW_SQL[name].split("FROM", 1)[1])
    seen: list[str] = []
    for w in words:
        if (w in VIEW_SQL or w in BASE_TABLES) and w != name and w not in seen:
            seen.append(w)
    return seen


def _order(names: list[str]) -> list[str]:
    """Views needed by ``names`` in dependency order (dependencies first)."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n not in VIEW_SQL:
            return
        for d in _deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def _braced(sql: str, names: list[str]) -> str:
    """Turn bare table names into ``{name}`` placeholders for ``spark.sql`` args."""
    def sub(m: re.Match) -> str:
        w = m.group(1)
        return "{" + w + "}" if w in names else w
    # only replace identifiers that follow FROM / JOIN
    return re.sub(r"(?<=FROM |JOIN )([a-z_][a-z0-9_]*)\b", sub, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Fixtures:
    """Lazily built fixture DataFrames for one (session, data folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        if name in BASE_TABLES:
            df = table(self.spark, self.sf_dir, name)
        else:
            deps = _deps(name)
            args = {d: self[d] for d in deps}
            df = self.spark.sql(_braced(VIEW_SQL[name], deps), **args)
        self._cache[name] = df
        return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Fixtures(spark, sf_dir)[name]


def with_views(sql: str, names: list[str]) -> str:
    """Prefix ``sql`` with the CTEs of the fixture views it needs (DuckDB oracle)."""
    ordered = _order(names)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n].strip()}\n)" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

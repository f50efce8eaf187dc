"""The 42-column feature matrix (X01-X42) and its group features.

Per-row features are one codegen'd projection. Group features never use a
window over raw rows: each is an aggregate over its key (partial aggregation
folds hot keys map-side) joined back on that key. Small dictionaries of the
join side (classes, entities) are written and broadcast for their true size;
the tables with many keys (amounts, counterparties) are joined to row numbers
and keys alone, their results come back to the kept rows bucket by bucket.

Ranks (W02, W08) and exact medians (W04, W05) go through
``ranking.running_totals`` over DISTINCT values with counts, so a value or a
segment holding a third of all rows is a single row there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import days_between, is_date, lookup, money_sum, numeric, num_or_null
from ..session import written
from .ranking import exact_quantile_pair, materialize, running_totals
from .rowstore import PART, ROW, attach, is_kept, keep_rows


def _any_null(keys: Sequence[str]) -> Column:
    c = None
    for k in keys:
        e = F.col(k).isNull()
        c = e if c is None else c | e
    return c if c is not None else F.lit(False)


# ───────────────────────────── inputs ─────────────────────────────

def report_date_col(df: DataFrame, override=None) -> Column:
    if override is not None:
        return F.lit(override).cast("timestamp_ntz")
    if "report_date" in df.columns:
        return F.col("report_date").cast("timestamp_ntz")
    return F.localtimestamp()


def amount_gbp(df: DataFrame) -> Column:
    """Gbp, else pence / 100, else null."""
    if "break_amount_gbp" in df.columns and "break_amount_pence" in df.columns:
        return F.coalesce(numeric(df, "break_amount_gbp"), numeric(df, "break_amount_pence") / 100.0)
    if "break_amount_gbp" in df.columns:
        return numeric(df, "break_amount_gbp")
    if "break_amount_pence" in df.columns:
        return numeric(df, "break_amount_pence") / 100.0
    return F.lit(None).cast("double")


def _raw_amount_name(df: DataFrame) -> str | None:
    if "break_amount_gbp" in df.columns:
        return "break_amount_gbp"
    if "break_amount_pence" in df.columns:
        return "break_amount_pence"
    return None


# ───────────────────────────── group features ─────────────────────────────
# Each function returns a small STATISTICS table keyed by its group; the
# matrix joins them onto the rows with plain equi-joins (a null key never
# matches, which is exactly the "null group -> null" rule).

def entity_recent_table(base: DataFrame, age: str = "break_age_days", scope: Sequence[str] = ()) -> DataFrame:
    """Per entity, rows aged <= 7 days (null age counts as 999)."""
    recent = F.coalesce(F.col(age), F.lit(999.0)) <= F.lit(float(C.RECENT_AGE_DAYS))
    return (base.where(F.col("entity_id").isNotNull() & recent).groupBy(*scope, "entity_id")
            .agg(F.count(F.lit(1)).cast("double").alias("__r7")))


def counterparty_table(base: DataFrame, amount: str | None = "break_amount_gbp",
                       scope: Sequence[str] = ()) -> DataFrame:
    """J03 + W03 in one aggregate: ``__cpty_n`` = rows - 1; ``__offset`` = 1.0 when
    the summed amount is within 1.0 of zero (exact decimal sum, nulls skipped)."""
    aggs = [(F.count(F.lit(1)) - 1).cast("double").alias("__cpty_n")]
    if amount:
        s = F.coalesce(money_sum(amount), F.lit(0.0))
        aggs.append(F.when(F.abs(s) < F.lit(1.0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("__offset"))
    return base.where(F.col("counterparty").isNotNull()).groupBy(*scope, "counterparty").agg(*aggs)


def percentile_table(base: DataFrame, value: str, group: str | Sequence[str] | None) -> DataFrame:
    """(group, value) -> average-method percentile rank within the group.

    pct = (rows below + (ties + 1) / 2) / non-null rows of the group.
    """
    keys = [group] if isinstance(group, str) else list(group or ())
    vals = (base.where(F.col(value).isNotNull() & ~_any_null(keys))
            .groupBy(*keys, F.col(value).alias("__pv")).agg(F.count(F.lit(1)).alias("__pc")))
    r = running_totals(vals, ["__pv"], sums=["__pc"], group_cols=keys)
    pct = (F.col("cum___pc") - F.col("__pc") + (F.col("__pc") + 1) / 2.0) / F.col("group___pc")
    return r.select(*keys, "__pv", pct.alias("amount_percentile"))


def amount_percentile(df: DataFrame, value: Column, group: str | None) -> DataFrame:
    """W02 on any frame: adds ``amount_percentile`` (null value or group -> null)."""
    base = df.withColumn("__pval", value)
    t = percentile_table(base, "__pval", group)
    keys = [group] if group else []
    return _equi_join(base, t, keys + ["__pval"], keys + ["__pv"]).drop("__pval")


def segment_medians(base: DataFrame, values: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Exact medians of several columns per segment, all by the same rounds of counting.

    ``values`` maps output name -> column. Rows with a null key are excluded;
    returns ``keys + list(values)``.
    """
    names = list(values)
    stacked = base.where(~_any_null(keys)).select(
        *keys, F.explode(F.array(*[F.struct(F.lit(n).alias("__name"),
                                             F.col(c).cast("double").alias("__val"))
                                   for n, c in values.items()])).alias("__s"))
    long = stacked.select(*keys, F.col("__s.__name").alias("__name"), F.col("__s.__val").alias("__val"))
    med = exact_quantile_pair(long, "__val", list(keys) + ["__name"])
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("median"))).alias(n)
                                    for n in names])
    return wide


def segment_median(df: DataFrame, value: Column, keys: Sequence[str], out_col: str) -> DataFrame:
    """W04 on any frame: exact per-segment median joined back (no key -> global)."""
    base = df.withColumn("__mv", value)
    if not keys:
        med = exact_quantile_pair(base, "__mv").select(F.col("median").alias(out_col))
        return _attach_scalar(base, med, out_col).drop("__mv")
    t = segment_medians(base, {out_col: "__mv"}, keys)
    return _equi_join(base, t, keys, keys).drop("__mv")


def _attach_scalar(base: DataFrame, one_row: DataFrame, col: str) -> DataFrame:
    """Attach a one-row result as a literal (its size is one row by construction)."""
    row = one_row.first()
    v = row[0] if row is not None else None
    return base.withColumn(col, F.lit(v).cast("double"))


def _equi_join(left: DataFrame, right: DataFrame, lkeys: Sequence[str], rkeys: Sequence[str]) -> DataFrame:
    """Left equi-join with right keys renamed (no lineage ambiguity); null keys never match."""
    r = right.withColumnsRenamed({k: f"__jr_{i}" for i, k in enumerate(rkeys)})
    cond = None
    for i, k in enumerate(lkeys):
        e = F.col(k) == F.col(f"__jr_{i}")
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left").drop(*[f"__jr_{i}" for i in range(len(rkeys))])


def mad_table(base: DataFrame, amount: str, keys: Sequence[str],
              extra: dict[str, str] | None = None) -> DataFrame:
    """W05 statistics per segment: ``__med`` = median |x|, ``__mdev`` = median of
    ``||x| - med|``, plus any ``extra`` medians sharing the same keys (one pass)."""
    vals = {"__med": "__ax", **(extra or {})}
    b = base.withColumn("__ax", F.abs(F.col(amount)))
    # one row per segment, read twice below: written once
    first = materialize(segment_medians(b, vals, keys), "segment-medians")
    dev = _equi_join(b.select(*keys, "__ax"), first.select(*keys, "__med"), keys, keys) \
        .withColumn("__dev", F.abs(F.col("__ax") - F.col("__med")))
    second = segment_medians(dev, {"__mdev": "__dev"}, keys)
    return materialize(_equi_join(first, second, keys, keys), "segment-stats")


def category_values(df: DataFrame, cols: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Distinct (scope..., feature, value) of several columns; null is '__MISSING__'."""
    return df.select(*scope, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CATEGORY)).alias("value"))
        for c in cols])).alias("__s")).select(*scope, "__s.feature", "__s.value").distinct()


def category_dictionaries(df: DataFrame, cols: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """W08 for several columns in ONE ranking pass: (scope..., feature, value, code)."""
    r = running_totals(category_values(df, cols, scope), ["value"], group_cols=[*scope, "feature"])
    return r.select(*scope, "feature", "value", (F.col("pos") - 1).cast("long").alias("code"))


def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values (null -> '__MISSING__') numbered 0..n-1 -> (value, code).

    The persisted encoder of J05 uses the same table.
    """
    return category_dictionaries(df, [col]).select("value", "code")


def apply_dictionary(df: DataFrame, col: str, dictionary: DataFrame, out_col: str,
                     unseen=-1) -> DataFrame:
    """Value -> code via the dictionary; unseen values -> ``unseen``."""
    key = F.coalesce(F.col(col).cast("string"), F.lit(C.MISSING_CATEGORY))
    base = df.withColumn("__cat", key)
    d = dictionary.select(F.col("value").alias("__cat"), F.col("code").alias("__code"))
    out = base.join(d, "__cat", "left")
    return out.withColumn(out_col, F.coalesce(F.col("__code"), F.lit(unseen)).cast("double")) \
        .drop("__cat", "__code")


# ───────────────────────────── the matrix ─────────────────────────────

#: Group statistics and the per-row features that each reads. One table a
#: statistic, shared by all features that name it.
STATISTICS = {
    "entity_recent": ("break_age_days",),
    "percentile": ("break_amount_gbp",),
    "codes": (),
    "counterparty": ("break_amount_gbp",),
    "mad": ("break_amount_gbp",),
    "segment_age": ("break_age_days",),
}

#: What a feature is made of besides the input columns: statistics and other
#: features. A feature that isn't listed is a per-row expression.
DEPENDS = {
    "rolling_7d_break_count": ("entity_recent",),
    "amount_percentile": ("percentile",),
    "entity_id_enc": ("codes",),
    "team_code_enc": ("codes",),
    "rec_name_enc": ("codes",),
    "offsetting_break_exists": ("counterparty",),
    "prior_break_same_cpty": ("counterparty",),
    "mad_score": ("mad",),
    "segment_median_age": ("segment_age",),
    "is_statistical_outlier": ("mad_score",),
    "governance_completeness_score": ("owner_populated", "approver_populated", "status_populated"),
}

_AGE = ("break_age_days", "report_date", "break_open_date")
_AMOUNT = ("break_amount_gbp", "break_amount_pence")
#: Input columns that a feature reads besides one of its own name.
READS = {
    "break_age_days": _AGE,
    "days_since_last_move": ("report_date", "last_activity_date"),
    "is_month_end_week": ("report_date",),
    "is_quarter_end": ("report_date",),
    "rolling_7d_autoclose_rate": _AGE,
    "break_amount_gbp": _AMOUNT,
    "abs_amount_log": _AMOUNT,
    "amount_vs_threshold_ratio": _AMOUNT,
    "net_vs_gross_diff": ("net_amount_gbp", "net_amount_pence", "gross_amount_gbp", "gross_amount_pence"),
    "break_direction_enc": ("break_direction",),
    "source_system_enc": ("source_system",),
    "owner_populated": ("owner",),
    "approver_populated": ("approver",),
    "status_populated": ("status",),
    "days_overdue_vs_sla": (*_AGE, "sla_days"),
    "collateral_type_enc": ("collateral_type",),
    "trade_lifecycle_event_enc": ("trade_lifecycle_event",),
}


def needed(wanted: Sequence[str]) -> tuple[set[str], set[str]]:
    """(features, statistics) that the ``wanted`` features are made of, themselves included."""
    unknown = set(wanted) - set(C.ALL_FEATURES)
    if unknown:
        raise ValueError(f"no such features: {sorted(unknown)}")
    features: set[str] = set()
    statistics: set[str] = set()
    open_ = list(wanted)
    while open_:
        name = open_.pop()
        if name in STATISTICS:
            if name not in statistics:
                statistics.add(name)
                open_ += STATISTICS[name]
        elif name not in features:
            features.add(name)
            open_ += DEPENDS.get(name, ())
    return features, statistics


def build_feature_matrix(df: DataFrame, asset_class: str | None = None, report_date_override=None,
                         keep_input: bool | Sequence[str] = True, only: Sequence[str] | None = None,
                         scope: Sequence[str] = ()) -> DataFrame:
    """X01-X42. Returns the input columns (all, none, or those that ``keep_input`` names) plus the features.

    ``only`` names the features to return (default: all 42). Just these, what
    they are made of and the statistics behind them are computed
    (:func:`needed`). The base is kept (:mod:`rowstore`: written once, its rows numbered) if several statistics
    read it, or medians, which read it once a round; any other single one reads the input
    itself, pruned to its columns. Input that is kept already is not written again, the features
    of a row are made of it when it is read.

    ``scope`` names input columns that split the report: every group statistic
    is then taken within equal values of them (``["asset_class"]``: as if each
    class were a report of its own), in the same passes. Rows with a null in
    the scope are in no group.

    Where the input already carries a feature column with a value it is used,
    otherwise the feature is derived (``coalesce(input, derived)``).
    """
    cols = set(df.columns)
    scope = [c for c in scope if c in cols]
    wanted = [c for c in C.ALL_FEATURES if only is None or c in set(only)]
    features, stats = needed(wanted if only is None else only)
    kept = [c for c in (df.columns if keep_input is True else keep_input or ()) if c not in (ROW, PART)]
    several = len(stats) > 1 or bool(stats & {"mad", "segment_age"})
    if several and report_date_override is None and "report_date" not in cols:
        report_date_override = df.sparkSession.sql("SELECT localtimestamp()").first()[0]  # the same in each pass
    rd = report_date_col(df, report_date_override)
    open_dt = F.col("break_open_date") if "break_open_date" in cols else F.lit(None).cast("timestamp_ntz")
    last_dt = F.col("last_activity_date") if "last_activity_date" in cols else None
    inp = lambda n: num_or_null(df, n)

    rd_is_date = report_date_override is None and is_date(df, "report_date")
    age_derived = days_between(rd if not rd_is_date else F.col("report_date"), open_dt,
                               rd_is_date and is_date(df, "break_open_date")).cast("double")
    age = F.coalesce(inp("break_age_days"), age_derived)
    dslm = (F.coalesce(inp("days_since_last_move"),
                       days_between(rd if not rd_is_date else F.col("report_date"), last_dt,
                                    rd_is_date and is_date(df, "last_activity_date")).cast("double"))
            if last_dt is not None else inp("days_since_last_move"))
    dom, month = F.dayofmonth(rd), F.month(rd)
    amt = amount_gbp(df)
    ac = F.col("asset_class") if "asset_class" in cols else F.lit(None).cast("string")

    def pick(gbp: str, pence: str) -> Column:
        if gbp in cols:
            return numeric(df, gbp)
        if pence in cols:
            return numeric(df, pence)
        return F.lit(None).cast("double")

    proxy_age = F.coalesce(age, F.lit(999.0))
    autoclose_proxy = (F.when(proxy_age <= 2, F.lit(0.85)).when(proxy_age <= 7, F.lit(0.40))
                       .otherwise(F.lit(0.10)))

    def populated(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)) if c in cols else F.lit(0.0)

    if "asset_class" in cols:
        sla = lookup(C.SLA_DAYS_BY_AC, "asset_class", C.DEFAULT_SLA_DAYS).cast("double")
    elif "sla_days" in cols:
        sla = F.coalesce(inp("sla_days"), F.lit(float(C.DEFAULT_SLA_DAYS)))
    else:
        sla = F.lit(float(C.DEFAULT_SLA_DAYS))
    overdue = F.coalesce(age, F.lit(0.0)) - sla

    def only(cls: str, value: Column) -> Column:
        return F.when(ac == F.lit(cls), value).otherwise(F.lit(None).cast("double"))

    def text_or(c: str, default: str) -> Column:
        return F.col(c).cast("string") if c in cols else F.lit(default)

    row_feats = {
        "break_age_days": age,
        "days_since_last_move": dslm,
        "is_month_end_week": F.when(F.coalesce(dom >= C.MONTH_END_DAY, F.lit(False)), 1.0).otherwise(0.0),
        "is_quarter_end": F.when(F.coalesce(month.isin(C.QUARTER_END_MONTHS) & (dom >= C.MONTH_END_DAY),
                                            F.lit(False)), 1.0).otherwise(0.0),
        "rolling_7d_autoclose_rate": F.coalesce(inp("rolling_7d_autoclose_rate"), autoclose_proxy),
        "time_to_coupon": inp("time_to_coupon"),
        "time_to_ex_div": inp("time_to_ex_div"),
        "break_amount_gbp": amt,
        "abs_amount_log": F.log1p(F.abs(amt)),
        "amount_vs_threshold_ratio": amt / F.lit(C.AMOUNT_THRESHOLD_GBP),
        "net_vs_gross_diff": F.abs(pick("net_amount_gbp", "net_amount_pence")
                                   - pick("gross_amount_gbp", "gross_amount_pence")),
        "break_direction_enc": (lookup(C.BREAK_DIRECTION_MAP, "break_direction", 0).cast("double")
                                if "break_direction" in cols else F.lit(0.0)),
        "asset_class_enc": lookup(C.ASSET_CLASS_MAP, ac).cast("double"),
        "entity_hist_fp_rate": F.coalesce(inp("entity_hist_fp_rate"), F.lit(0.0)),
        "rec_hist_fp_rate": F.coalesce(inp("rec_hist_fp_rate"), F.lit(0.0)),
        "source_system_enc": (lookup(C.SOURCE_SYSTEM_MAP, "source_system", -1).cast("double")
                              if "source_system" in cols else F.lit(-1.0)),
        "rolling_repeat_break_flag": F.coalesce(inp("rolling_repeat_break_flag"), F.lit(0.0)),
        "owner_populated": populated("owner"),
        "approver_populated": populated("approver"),
        "status_populated": populated("status"),
        "days_overdue_vs_sla": F.when(overdue < 0, F.lit(0.0)).otherwise(overdue),
        "dq_score": inp("dq_score"),
        "div_ex_date_proximity": only("CEQ", inp("div_ex_date_proximity")),
        "corporate_action_flag": only("CEQ", F.coalesce(inp("corporate_action_flag"), F.lit(0.0))),
        "collateral_type_enc": only("LnD", lookup(C.COLLATERAL_TYPE_MAP, text_or("collateral_type", ""),
                                                   -1).cast("double")),
        "rate_reset_proximity": only("LnD", inp("rate_reset_proximity")),
        "coupon_payment_proximity": only("MTN", inp("coupon_payment_proximity")),
        "maturity_proximity": only("MTN", inp("maturity_proximity")),
        "trade_lifecycle_event_enc": only("OTC", lookup(C.TRADE_LIFECYCLE_MAP,
                                                        text_or("trade_lifecycle_event", "None"),
                                                        0).cast("double")),
        "csa_margin_call_flag": only("OTC", F.coalesce(inp("csa_margin_call_flag"), F.lit(0.0))),
        "netting_agreement_flag": only("OTC", F.coalesce(inp("netting_agreement_flag"), F.lit(0.0))),
    }
    # One projection: per-row features from the original columns; input
    # feature columns are kept as ``__in_<name>`` for coalesce(input, derived).
    own = {k: v for k, v in row_feats.items() if k in features}
    inputs = {*kept, "asset_class", "break_amount_gbp", "break_amount_pence", *C.SEGMENT_KEYS, *scope, ROW, PART} & cols
    grouped_by = {"counterparty"} & cols if "counterparty" in stats else set()
    if several:
        read = inputs | {c for f in features for c in (f, *READS.get(f, ()))} & cols
        if not is_kept(df):
            df = keep_rows(df.select(_columns(df, read | grouped_by, kept)), "feature-input")
    base = _with_row_features(df, own, {*inputs, *grouped_by, ROW, PART}, features)
    # read by each later pass over the matrix, and small as a rule: written, joined for its true size
    small = (lambda table: written(table, "statistic")) if several else (lambda table: table)

    # group features: statistics tables from the base, joined back (``joins``: table, left keys, its keys) - those
    # with many keys to kept rows by their numbers (``lookups``, from ``keyed``)
    joins: list[tuple[DataFrame, list[str], list[str]]] = []
    lookups: list[tuple[DataFrame, list[str], list[str]]] = []
    keyed, before = base, {}  # columns that the joins need
    derived: dict[str, Column] = {}
    raw_amt = _raw_amount_name(df)
    if "entity_recent" in stats:
        r7 = F.lit(1.0)
        if "entity_id" in cols:
            joins.append((small(entity_recent_table(base, scope=scope)), [*scope, "entity_id"], [*scope, "entity_id"]))
            r7 = F.coalesce(F.col("__r7"), F.lit(1.0))
        derived["rolling_7d_break_count"] = r7
    if "counterparty" in stats:
        offset, others = F.lit(0.0), F.lit(0.0)
        if "counterparty" in cols:
            netted = "break_amount_gbp" in cols and "offsetting_break_exists" in features
            cpt = counterparty_table(base, "break_amount_gbp" if netted else None, scope)
            (lookups if several else joins).append((cpt, [*scope, "counterparty"], [*scope, "counterparty"]))
            others = F.col("__cpty_n")
            offset = F.coalesce(F.col("__offset"), F.lit(0.0)) if netted else offset
        given = F.col("__in_offsetting_break_exists").cast("double") if "offsetting_break_exists" in cols else F.lit(None)
        derived["offsetting_break_exists"] = F.coalesce(given, offset)
        derived["prior_break_same_cpty"] = others
    if "percentile" in stats:
        pv = "break_amount_gbp"  # resolved amount (equals the raw column whenever it is present)
        group = ["asset_class"] if "asset_class" in cols else []
        group += [c for c in scope if c not in group]
        if raw_amt == "break_amount_pence" and group:
            pv = "__pv_src"
            before[pv] = numeric(df, "break_amount_pence")
            keyed = keyed.withColumn(pv, before[pv])
        (lookups if several else joins).append((percentile_table(keyed, pv, group), group + [pv], group + ["__pv"]))
    if "codes" in stats:
        told = [c for c in ("entity_id", "team_code", "rec_name") if f"{c}_enc" in features]
        cats = [c for c in told if c in cols]
        dicts = small(category_dictionaries(base, cats, scope)) if cats else None
        for c in told:
            if c not in cats:
                derived[f"{c}_enc"] = F.lit(None).cast("double")
                continue
            d = dicts.where(F.col("feature") == c).select(
                *scope, F.col("value").alias(f"__v_{c}"), F.col("code").cast("double").alias(f"{c}_enc"))
            before[f"__k_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_CATEGORY))
            joins.append((d, [*scope, f"__k_{c}"], [*scope, f"__v_{c}"]))
    keys = [k for k in C.SEGMENT_KEYS if k in cols]
    seg_keys = keys if len(keys) >= 2 else []
    keys = keys + [c for c in scope if c not in keys]
    seg_keys = seg_keys + [c for c in scope if c not in seg_keys]
    aged = False  # segment ages known beside the deviations
    if "mad" in stats:
        mad = F.lit(0.0)
        if raw_amt is not None:
            amt_src, source = raw_amt, base
            if raw_amt == "break_amount_pence":
                amt_src = "__mad_src"
                before[amt_src] = numeric(df, "break_amount_pence")
                source = base.withColumn(amt_src, before[amt_src])
            if keys:
                aged = "segment_age" in stats and seg_keys == keys
                joins.append((mad_table(source, amt_src, keys, {"__seg_age": "break_age_days"} if aged else None), keys, keys))
            else:
                mt = mad_table(source.withColumn("__all", F.lit(1)), amt_src, ["__all"])
                row = mt.select("__med", "__mdev").first()
                before |= {"__med": F.lit(row[0] if row else None).cast("double"),
                           "__mdev": F.lit(row[1] if row else None).cast("double")}
            mad = F.abs((F.abs(F.col(amt_src)) - F.col("__med")) / (F.col("__mdev") + F.lit(C.MAD_EPS)))
        derived["mad_score"] = F.coalesce(F.col("__in_mad_score").cast("double") if "mad_score" in cols
                                          else F.lit(None).cast("double"), mad)
    if "segment_age" in stats:
        if not aged and seg_keys:
            joins.append((small(segment_medians(base, {"__seg_age": "break_age_days"}, seg_keys)), seg_keys, seg_keys))
        derived["segment_median_age"] = F.coalesce(
            F.col("__in_segment_median_age").cast("double") if "segment_median_age" in cols
            else F.lit(None).cast("double"), F.col("__seg_age"))

    g = base
    if lookups:
        found = _looked_up(keyed, lookups)
        of_found = {c: f"__found_{c}" for c in found.columns if c != ROW}  # no input feature's name
        rows = attach(df.select(*_columns(df, read, kept), ROW, PART), found.withColumnsRenamed(of_found), "feature-rows")
        g = _with_row_features(rows, own, {*inputs, *of_found.values()}, features) \
            .withColumnsRenamed({v: k for k, v in of_found.items()})
    g = g.withColumns(before) if before else g
    for table, on, of in joins:
        g = _equi_join(g, table, on, of)
    if "segment_age" in stats and not aged and not seg_keys:
        g = segment_median(g, F.col("break_age_days"), seg_keys, "__seg_age")

    g = g.withColumns({k: v for k, v in derived.items() if k in features})
    last = {
        "is_statistical_outlier": lambda: F.when(
            F.coalesce(F.col("mad_score"), F.lit(0.0)) > C.OUTLIER_CUT, 1.0).otherwise(0.0),
        "governance_completeness_score": lambda: (
            F.col("owner_populated") + F.col("approver_populated") + F.col("status_populated")) / 3.0,
    }
    g = g.withColumns({k: make() for k, make in last.items() if k in features})
    passthrough = [c for c in df.columns if c in set(kept) and c not in C.ALL_FEATURES]
    return g.select(*passthrough, *[F.col(c).cast("double").alias(c) for c in wanted])


def _looked_up(rows: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Values of tables (with left keys and their own) by the number of the kept ``rows``: only numbers and keys
    are joined with them, one table after the other, and a key goes once no later table needs it."""
    keys = list(dict.fromkeys(k for _, on, _ in tables for k in on))
    found, values = rows.select(ROW, *keys), []
    for i, (table, on, of) in enumerate(tables):
        # written, so that its true size decides how it is joined
        found = _equi_join(found, written(table, "statistic"), on, of)
        values += [c for c in table.columns if c not in of]
        found = found.select(ROW, *[k for k in keys if any(k in later for _, later, _ in tables[i + 1:])], *values)
    return found


def _columns(df: DataFrame, read: set[str], kept: Sequence[str]) -> list[Column]:
    """Those columns of ``df`` to write; pence that only stand in for a missing amount are left out elsewhere."""
    both = {"break_amount_gbp", "break_amount_pence"} <= read and "break_amount_pence" not in kept
    spare = F.when(numeric(df, "break_amount_gbp").isNull(), F.col("break_amount_pence")).alias("break_amount_pence") if both else None
    return [spare if both and c == "break_amount_pence" else F.col(c) for c in df.columns if c in read and c not in (ROW, PART)]


def _with_row_features(df: DataFrame, row_feats: dict, inputs: set[str], features: set[str]) -> DataFrame:
    """Evaluate the per-row features against the ORIGINAL input columns in one
    projection; input feature columns are kept under ``__in_<name>``."""
    cols = set(df.columns)
    keep = [F.col(c) for c in df.columns if c in inputs and c not in C.ALL_FEATURES]
    saved = [F.col(c).alias("__in_" + c) for c in C.ALL_FEATURES if c in cols and c in features]
    return df.select(*keep, *saved, *[v.alias(k) for k, v in row_feats.items()])

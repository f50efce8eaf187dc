"""Top contributing features per break (T06), out of a given long table of contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_features(contributions: DataFrame, n: int = 5, key: str = "break_id") -> DataFrame:
    """The ``n`` largest absolute contributions per break, in order, as
    ``array<struct<feature, contribution>>`` (one row per break)."""
    s = F.struct(F.abs("contribution").alias("a"), F.col("feature"), F.col("contribution"))
    g = contributions.groupBy(key).agg(F.collect_list(s).alias("__c"))
    ranked = F.slice(F.sort_array(F.col("__c"), asc=False), 1, n)
    return g.select(key, F.transform(ranked, lambda e: F.struct(e["feature"].alias("feature"),
                                                                 e["contribution"].alias("contribution")))
                    .alias("top_features"))


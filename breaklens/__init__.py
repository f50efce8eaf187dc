"""breaklens — reconciliation-break analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function built on
Spark SQL / MLlib. Sub-packages:

* ``sources``   – CSV scan, header aliases, uploads/cache, snapshot store, fixture views
* ``functions`` – column-expression helpers (coercing parses, literal maps, null rules)
* ``operators`` – lifecycle, reports, DQ, features, labels, tiers, metrics, ML
* ``plans``     – end-to-end compositions (lifecycle, ingest->score, retrain) and
                  the query registry behind ``__spark_entry__``
* ``streaming`` – incremental upload ingestion with Structured Streaming
"""

__version__ = "0.1.0"

"""Session construction and shared-folder helpers.

The library never relies on session globals for correctness. ``build_session``
is what tests and ``bench.py`` use; a cluster job passes its own session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Conf keys owned by this library (read with defaults; never required).
MATERIALIZE_CONF = "breaklens.rank.materialize"


def build_session(master: str | None = None, app: str = "breaklens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session with AQE (incl. skew-join splitting) switched on."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("BREAKLENS_DRIVER_MEM", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    Uses the cluster's ``spark.checkpoint.dir`` when it is set. Only a local
    master (tests) may go without: it gets a private scratch folder. On a
    cluster a machine-local folder would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="breaklens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/breaklens-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def scratch_table(path: str) -> str:
    """Name in this session's catalog of a bucketed table under :func:`scratch_path`."""
    return path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage
    ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {scratch_table(path)}")
            _delete(df.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that
    functions run in Python workers need no installation there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="breaklens-pkg-"), "breaklens_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("breaklens", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def cleanup_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote. Call only once every
    DataFrame built on them has been consumed."""
    n = 0
    while _SCRATCH:
        path = _SCRATCH.pop()
        spark.sql(f"DROP TABLE IF EXISTS {scratch_table(path)}")
        n += bool(_delete(spark, path))
    return n


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except Exception:
        return default


def conf_str(spark: SparkSession, key: str, default: str) -> str:
    try:
        return spark.conf.get(key, default)
    except Exception:
        return default

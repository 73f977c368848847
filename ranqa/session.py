"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Row bound under which a derived (not literal) dimension is broadcast.  Above
# it the join stays a shuffle join and AQE decides at runtime.
BROADCAST_ROW_LIMIT = 200_000
# ... and the bytes of its strings and arrays up to which it counts as small
BROADCAST_BYTE_LIMIT = 64 << 20
# Bytes of one Arrow batch on its way to or from a Python worker: whole texts are long, and a batch is held on both sides
ARROW_BATCH_BYTES = 8 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ranqa") -> SparkSession:
    """Return the active session or build a local one for tests and benches.

    On a cluster the session already exists and its settings win; this only
    fills in what is missing.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return prepare(active)
    # what spark-submit hands over is in a SparkConf made after the JVM's start; only missing keys get a default
    if "PYSPARK_GATEWAY_PORT" in os.environ or "PYSPARK_SUBMIT_ARGS" in os.environ:
        SparkContext._ensure_initialized()
        given = SparkConf()
    else:
        given = SparkConf(loadDefaults=False)
    wanted = {
        "spark.master": master or os.environ.get("RANQA_MASTER", "local[8]"),
        "spark.app.name": app_name,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    parts = shuffle_partitions or os.environ.get("RANQA_SHUFFLE_PARTITIONS")
    if parts or not given.contains("spark.master"):
        wanted["spark.sql.shuffle.partitions"] = str(parts or 8)
    if not given.contains("spark.master"):
        wanted["spark.driver.memory"] = os.environ.get("RANQA_DRIVER_MEMORY", "8g")
    missing = {k: v for k, v in wanted.items() if not given.contains(k)}
    spark = SparkSession.builder.config(map=missing).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ranqa`` importable in Python workers (what ``--py-files`` does).

    Arrow UDFs and ``mapInPandas`` functions are pickled by reference to this
    package; the package is zipped once per SparkContext and added with
    ``addPyFile`` so every executor (and a local worker started from any
    working directory) can import it.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ranqa-pkg-"), "ranqa.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(root, fn)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package shipping, bounded Arrow batches: call before running any query."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(bound):  # a submitted setting wins
        spark.conf.set(bound, str(ARROW_BATCH_BYTES))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    A cluster names a shared folder there; a local test run has none, so a
    fresh temporary folder stands in for it.
    """
    sc = spark.sparkContext
    present = sc._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return str(present.get())
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # only reached on a local session built without one (tests, notebooks)
        current = tempfile.mkdtemp(prefix="ranqa-ckpt-")
    sc.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    cluster names one, otherwise the checkpoint folder the session has."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def write_shared(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage,
    prunes columns on re-reads and survives lost executors.  The folder's clean-up
    is the cluster's (results that are still lazy may read it)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ranqa-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT, known_rows: int | None = None,
                      max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when a count proves it small in rows and in bytes; otherwise leave it to AQE.

    The count is one cheap job over an already-reduced side (a per-group
    table) that stops after ``max_rows``; above a bound the join stays a shuffle join and AQE's runtime
    statistics may still convert it.  Bytes are those of strings, as JSON for nested columns.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if known_rows is not None and known_rows > max_rows:
        return df
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if known_rows is not None and not wide:
        return F.broadcast(df)

    def size(f: T.StructField):
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (T.StringType, T.BinaryType))
        return F.coalesce(F.octet_length(c if plain else F.to_json(F.struct(c))), F.lit(0))

    total = F.coalesce(F.sum(sum((size(f) for f in wide), F.lit(0))), F.lit(0)).alias("bytes")
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), total).first()
    return F.broadcast(df) if seen["n"] <= max_rows and seen["bytes"] <= max_bytes else df

"""Session set-up, the shared scratch folder, and the input size check."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES_KEY = "spark.tidewatch.smallBytes"
SMALL_BYTES_DEFAULT = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-process local master without the setting gets a folder of its
    own (one per application, removed when the process ends): on a cluster a
    machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_root(spark)}/tidewatch/{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once under the scratch folder (to ``path`` of it, with the writer's options) and return the written table.

    Cuts the lineage, freezes values that a second evaluation could change
    (range cuts, sketches), and survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> float:
    """Bytes in all the files and relations ``df`` reads; infinite when unknown."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        return float(sum(int(str(leaves.apply(i).stats().sizeInBytes()))
                         for i in range(leaves.size())))
    except Exception:
        return float("inf")


def is_small(df: DataFrame) -> bool:
    """True when everything ``df`` reads is known to be small enough for one task."""
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_KEY, str(SMALL_BYTES_DEFAULT)))
    return input_bytes(df) <= limit

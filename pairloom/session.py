"""Session defaults, the shared scratch folder, and shipping the package to workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def build_session(app: str = "pairloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch on its way to or from a Python worker: rows of any width then need the same memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that functions defined in it can be unpickled on any machine.

    Arrow batches are bounded by BATCH_BYTES in this session, unless the application has set a bound of its own.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    if getattr(sc, "_pairloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="pairloom-")) / "pairloom_src.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(_ROOT.rglob("*.py")):
            out.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    sc.addPyFile(str(target))
    sc._pairloom_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder URI below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests, a local session) a folder of this machine is
    made and set as the checkpoint folder; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="pairloom-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    elif "://" not in base:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and keeps what lost executors had."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session defaults and the shared scratch folder.

Every setting here is a default: a value the cluster already carries wins, so the same
code runs under ``local[8]`` in tests and under a resource manager unchanged.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "haplolake", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benches; production code receives its session from outside."""
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in {**DEFAULTS, "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: temporary folders of applications whose cluster names no shared one; tables written so far
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) that names none gets a temporary folder, which goes when the process ends;
    on a cluster each executor would write to its own machine, so there the setting is required.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="haplolake-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application's operators wrote; call it once their results are stored. How many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Unlike ``localCheckpoint`` the copy outlives a lost executor; unlike ``checkpoint``
    it is columnar, compressed and carries exact sizes for the planner. Extra rules:
    column names must be unique, an empty input gives an empty table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than the session has cores out over them, before work that is heavy per row.

    A single small file would else be one task. Tables of as many splits stay as they are read, without a shuffle;
    select the columns needed first.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of any executor, once per application.

    The archive is laid into Spark's own file folder on the driver, from where Spark serves it.
    """
    root = Path(SparkFiles.getRootDirectory())
    archive = root / "haplolake_package.zip"
    if not archive.exists():
        package = Path(__file__).parent
        partial = archive.with_suffix(f".{uuid.uuid4().hex}")
        with zipfile.ZipFile(partial, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, f"{package.name}/{p.relative_to(package)}")
        partial.rename(archive)
        spark.sparkContext.addPyFile(str(archive))
    return spark

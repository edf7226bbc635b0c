"""Session helpers: shared scratch tables and shipping this package to executors.

Every iterative operator cuts its lineage by writing a table under the folder that
``spark.checkpoint.dir`` names.  That folder is shared by driver and executors, so a
lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(name: str = "treeloom", cpus: str = "8", partitions: str = "8", memory: str = "6g") -> SparkSession:
    """A local session for tests, benchmarks and notebooks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage; a temporary one only where master and executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="treeloom-")
    return _LOCAL_DIRS[app]


class Scratch:
    """Tables written to the shared folder and dropped when they have served.

    ``cut`` materialises a frame as Parquet and reads it back, which ends its lineage.
    ``drop`` deletes a table as soon as nothing reads it, ``drop_part`` a part of one; what is left goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/treeloom/{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.base)

    def cut(self, df: DataFrame, *by: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._remove(frame.scratch_path)

    def drop_part(self, frame: DataFrame, part: str) -> None:
        """One folder of a table that is cut by columns, such as ``day=3``."""
        self._remove(f"{frame.scratch_path}/{part}")

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files that no live frame needs any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  a session that has ended cannot delete; nothing depends on it
            pass


def few_rows(spark: SparkSession, rows: int) -> SparkSession:
    """A session with the settings of this one, but for the rows of an Arrow batch."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return own


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="treeloom-code-"), "treeloom_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt over them; any other as it is.

    One file of one row group is one task, however costly the expressions above it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= most_bytes and len(df.inputFiles()) < cores else df

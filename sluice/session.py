"""Session helper and the shared folder stage tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "sluice", memory: str = "12g") -> SparkSession:
    """Session for tests and the bench. On a cluster, spark-submit sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that
    names none gets a temporary folder; on a cluster that is an error, because
    executors could not reach it."""
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    if context.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="sluice-")
        context.setCheckpointDir(folder)
        _local_dirs[context.applicationId] = folder
    return _local_dirs[context.applicationId]


class StageStore:
    """Stage tables of one run, as Parquet in the shared folder. Reading one
    back cuts the lineage, keeps column pruning, survives lost executors and
    stops two consumers from computing the stage twice."""

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark = spark
        self.base = f"{base or shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        self._written: Counter[str] = Counter()
        self.rows: dict[str, int] = {}  # of the tables that were watched

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame, watch: bool = False) -> DataFrame:
        """Each call writes a table of its own, so a step may run again. watch:
        the job that writes also counts the rows, into `rows` under `name`."""
        self._written[name] += 1
        turn = self._written[name]
        own = name if turn == 1 else f"{name}-{turn}"
        if watch:
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(self.path(own))
            self.rows[name] = seen.get["rows"]
        else:
            df.write.mode("errorifexists").parquet(self.path(own))
        return self.get(own, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self) -> None:
        """Remove the stage tables of this run, and only those. Call it once
        everything read from them has been written elsewhere."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.base)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)

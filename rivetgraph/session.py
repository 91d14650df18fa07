"""Session set-up and the place where intermediate state is made durable."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "rivetgraph", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for what starts inside; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, may fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rivetgraph-"))
        current = sc.getCheckpointDir()
    return current


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table another step reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _write_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["rows"])


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder, read it back, and tell its row count.

    The lineage ends here, so a lost executor costs no more than reading files again.
    Compared with ``checkpoint()`` the columns stay compressed and the reader knows the
    real size, so joins on a small result need no shuffle. The count comes with the
    write; no second pass.
    """
    return _write_counted(df, table_path(df.sparkSession, "cut"))


def cut(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


class Rounds:
    """A table in the shared folder that grows by one part per round of a loop."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = table_path(spark, "rounds")
        self.schema = None
        self.n = 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write one round; gives it back with its row count."""
        self.schema = df.schema
        part, found = _write_counted(df, f"{self.path}/round={self.n}")
        self.n += 1
        return part, found

    def all(self) -> DataFrame:
        """Everything written so far, as one scan."""
        read = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        return read.parquet(self.path)

"""Session defaults and the place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # cell expressions are heavy for their bytes: keep small shuffles parallel
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # tables between steps are several times larger in memory than in their files: the planner broadcasts by the latter
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what an executor and its Python workers hold of a batch, whatever the length of rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tablemend") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on (time zone) and, where the session is silent, our defaults."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key, value in DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablemend-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame that several later steps read, as a table in the shared folder.

    Unlike a row checkpoint, a columnar table keeps column pruning, filter
    pushdown and size statistics for the steps that read it, and it survives
    the loss of any executor.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """The application's own folder for tables between steps; it goes when the application ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def drop_table(df: DataFrame) -> None:
    """Delete the files that a frame from ``cut`` was read from, once nothing reads them any more."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

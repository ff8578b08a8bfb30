"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Partition counts are left to AQE: it coalesces small
# shuffles and splits skewed ones, so the initial number may be generous.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # fold readings into spells before the shuffle by place
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def apply_runtime(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "hydrolake", memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter's session is used as is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where the setting is absent."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="hydrolake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def reliable(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike cached blocks."""
    reliable(df.sparkSession)
    return df.checkpoint(eager=True)

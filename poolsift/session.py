"""Session defaults and the shared folder for data that must outlive an executor."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", shuffle_partitions=8, memory="8g", checkpoint_dir=None) -> SparkSession:
    """A session for tests and the benchmark. On a cluster the submitter brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("poolsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    if checkpoint_dir:  # a setting of the session's start, not of a running one
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where that is unset, as in tests, the warehouse is used; but only if driver and executors are
    one process, as another machine's executors need not reach it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/poolsift_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/poolsift/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application wrote to the shared folder; results must have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, short lineage, safe against lost executors.

    The files stay until ``clear``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

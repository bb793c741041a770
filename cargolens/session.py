"""Session helpers: building a local session and materialising intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster, bring your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cargolens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used to cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="cargolens-checkpoint-")
    sc.setCheckpointDir(fallback)
    return fallback


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, survives lost executors.

    A parquet table is used rather than an RDD checkpoint because the planner then knows the
    true size of the result and can still prune its columns. ``by`` lays the table out in one
    folder per value, so that a job on one value reads only its rows; the rebalance hint keeps
    the files even when one value owns most rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cargolens-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def fit_all(spark: SparkSession, jobs: dict, threads: int = 8) -> dict:
    """Run independent fits at the same time; each thread submits its own Spark jobs.

    Slow fits do not hold up the others when the cluster schedules jobs fairly.
    """
    with ThreadPoolExecutor(max_workers=threads) as pool:
        running = {key: pool.submit(inheritable_thread_target(spark)(job)) for key, job in jobs.items()}
        return {key: r.result() for key, r in running.items()}


def sized(df: DataFrame) -> DataFrame:
    """Materialise a summary table once so that joins on it are planned from its true size.

    After this a join is broadcast only while the summary stays below
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one gets a shuffle join that the adaptive
    planner can split on hot keys. Without it the planner would guess from the size of the
    rows behind the aggregate and shuffle those rows by the summary's key.
    """
    df = df.persist()
    df.count()
    return df


def num_shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

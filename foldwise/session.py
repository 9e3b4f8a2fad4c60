"""Session helpers: local session for tests/bench, shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on; all are runtime-settable SQL confs, so they
# are applied to a session handed in by a cluster driver as well.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "foldwise",
                  extra_conf: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in {**SQL_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses what the cluster names in ``spark.checkpoint.dir``; only a local
    session that names none (tests) gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/foldwise/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Used for intermediate tables that several branches of a plan read (a
    multi-pass operator would otherwise recompute the whole upstream per
    branch). The files survive the loss of executors, unlike cached blocks.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_scalars(df, one_row):
    """Attach the columns of a one-row aggregate to every row (broadcast of one row).

    ``one_row`` must be a global aggregate (no grouping), so the join emits
    exactly one partner per row.
    """
    from pyspark.sql import functions as F

    return df.crossJoin(F.broadcast(one_row))

"""Session helpers.

The library never creates a session on its own inside operators; these
helpers are for entry points, tests and the bench. On a cluster the
checkpoint directory must be a shared folder named in
``spark.checkpoint.dir``; a local one is only set when none is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Night plans are wide projections (dozens of aliased message and feature
    # expressions) under explicit filters; inferring constraints over them
    # costs minutes of planning and adds nothing.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "nightjar",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("NIGHTJAR_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


RUNTIME_CONF = {
    "spark.sql.constraintPropagation.enabled": "false",
    # The JVM never compiles a method of more than 8000 bytes, which the night plans' generated stages
    # are; beyond this limit Spark evaluates operator by operator, in methods that it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the night plans rely on (idempotent)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Bytes of an Arrow batch on its way to Python. Spark's 64 MB (or 10,000 rows) are held several times over, in the executor's
#: native memory and in each worker; this much is two blocks of text of the near-duplicate join.
BATCH_BYTES = 5_900_000


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of operators whose rows hold whole texts or long lists (idempotent)."""
    key, value = "spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b"
    if spark.conf.get(key, None) != value:
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the configured checkpoint dir; set a scratch one only if unset."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder; lineage is cut there.")
    scratch = tempfile.mkdtemp(prefix="nightjar-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch

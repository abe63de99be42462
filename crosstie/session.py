"""Session helpers: local sessions for tests and bench, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: broadcast only what is proven smaller than this
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
LISTING_TASKS_PER_CORE = 4


def local_session(cpus: int | str = 8, app: str = "crosstie") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CROSSTIE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new empty folder name every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  A local
    master may fall back to a temporary folder; a cluster may not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="crosstie-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcasts a caller's table only when the optimizer's size estimate is
    below the limit; otherwise the join strategy is left to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks per core while a reader is made.

    Spark's own choice is a task per folder, up to 10,000 in a job; where a folder
    holds a file, starting the tasks costs more than all that they do."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: str, buckets: int = 16,
                  how: str = "left") -> DataFrame:
    """Join per-key summaries back to their rows without gathering a hot key.

    ``small`` holds one row per key.  It is repeated once per salt bucket and
    ``big`` is salted by a hash of ``spread``, so a key holding a third of all
    rows is dealt over ``buckets`` tasks whatever the join strategy.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "furlong", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared scratch location.

    The location is what the session names in spark.checkpoint.dir. Only a
    local session without one gets a temporary folder of this machine.
    """
    base = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a shared folder on a cluster")
        base = _local_base()
    return f"{base.rstrip('/')}/furlong-{purpose}-{uuid.uuid4().hex[:12]}"


_LOCAL: list[str] = []


def _local_base() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="furlong-"))
    return _LOCAL[0]

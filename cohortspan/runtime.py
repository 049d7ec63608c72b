"""Session-level helpers: lineage cuts and sizing."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from the session's settings.

    A machine-local folder is only ever chosen in local mode, where driver and executors
    share one machine. On a cluster ``spark.checkpoint.dir`` has to name a shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="cohortspan-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that losing executors loses nothing.

    With ``by`` the table is laid out in folders by those columns, evenly sized files each, so that
    reading one of their values skips the rest.

    A written table rather than ``df.checkpoint()``: the latter keeps the constraints inferred from
    the old plan, and over many rounds those make planning slower than the work itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    if by:
        df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def parts_for(n_rows: int, rows_per_part: int) -> int:
    return max(1, math.ceil(n_rows / rows_per_part))

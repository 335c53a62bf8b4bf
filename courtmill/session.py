"""Session helpers: a tuned local session, checkpointing and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join is left to shuffle.
BROADCAST_ROWS = 100_000


def get_spark(app: str = "courtmill", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir.

    Only where that setting is absent and the session runs in one machine, as in tests, a folder of this
    machine is set; on a cluster without the setting this raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "courtmill-checkpoints"))
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads one column and stops at ``rows + 1``."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else ``df`` itself."""
    return F.broadcast(df) if fits(df, rows) else df


def named(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run on machines without it; once per application."""
    context = spark.sparkContext
    if _shipped.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="courtmill-")) / "courtmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))  # the driver serves it; nothing else is read from this folder
    _shipped["application"] = context.applicationId


_shipped: dict[str, str] = {}

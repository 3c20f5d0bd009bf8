"""Session defaults and what executors need to run the package."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: How tables are written that queries keep for themselves.
PACKED = {"compression": "zstd"}


def session(name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and later-wins map merging."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's code to the executors once, unless their PYTHONPATH has it already."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", False):
        return spark
    at = Path(tempfile.mkdtemp(prefix="factloom-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(at))
    sys.path[:] = [p for p in sys.path if p != str(at)]
    sc._factloom_shipped = True
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the folder that driver and executors share (spark.checkpoint.dir; a new local one where it is unset, as in tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    at = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return at if "://" in at else f"file://{at}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a table in the shared folder. Unlike a checkpoint, a table read again brings no
    constraints of the plan that made it, which loops would pile up."""
    at = new_folder(df.sparkSession, "kept")
    df.write.options(**PACKED).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """df, kept in the shared folder, with a broadcast hint if it has at most `most` rows; otherwise for a shuffle join."""
    own = checkpointed(df)
    return F.broadcast(own) if own.count() <= most else own


def in_blocks(side: DataFrame, key: str, most: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of job's rows over blocks of about `most` rows of side, by a hash of key (ids may share a factor with the number of blocks)."""
    blocks = -(-side.count() // most)
    if blocks <= 1:
        return job(side)
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, (job(side.where(block == i)) for i in range(blocks)))

"""Sessions, and the package on the executors of the session that it runs in."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    own = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    return builder.config(map=own | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._lodestone_shipped = True


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in checkpoint files: for what several branches of a plan read. The folder is the one that
    the session names; a session in this process that names none gets one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()

"""Session settings and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects anywhere: UTC, AQE on."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("quarry")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in local mode
    without that setting, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_scratch:
            _own_scratch.append(tempfile.mkdtemp(prefix="quarry-"))
            atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
        root = f"file://{_own_scratch[0]}"
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a new path of the shared folder and read it again: what several
    branches of a plan need is computed once, and a lost executor repeats little."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application.

    It goes out through Spark's own file server, so executors need neither a shared
    folder nor an installation.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder_of_zip = tempfile.mkdtemp(prefix="quarry-code-")  # code, not data; the file server reads it until the end
    atexit.register(shutil.rmtree, folder_of_zip, ignore_errors=True)
    target = os.path.join(folder_of_zip, "quarry_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)

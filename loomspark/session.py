"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_made: list[DataFrame] = []


def _sweep() -> None:
    """At the end of the process the tables that are left are deleted, if the session still runs."""
    for df in _made:
        try:
            discard(df)
        except Exception:
            return


atexit.register(_sweep)


def get_session(app: str = "loomspark", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent (a local session, as in tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    _made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later plan reads."""
    path = getattr(df, "_loom_path", None)
    if path is None:
        return
    df._loom_path = None
    _made[:] = [x for x in _made if x is not df]
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context: they may not have it on their path."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_loom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("loomspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._loom_shipped = True

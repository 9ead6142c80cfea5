"""Sources and sinks of the stages' artefacts (SRC5-14, SNK1-15). Writers create parent folders, as Spark's do."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.ranker import TreeRanker
from loomspark.operators.requirement import Requirement

log = logging.getLogger(__name__)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """SRC5."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_text(spark: SparkSession, path: str) -> str:
    """SRC6: one whole text, trimmed."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one text is expected at {path}")
    return rows[0][0].strip()


def read_requirement(spark: SparkSession, path: str) -> Requirement:
    """SRC7: a requirement profile; ValueError if it has another shape."""
    return Requirement.from_json(read_text(spark, path))


VECTOR_CACHE = T.StructType([T.StructField("model", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
SCORE_CACHE = T.StructType([T.StructField("model", T.StringType()), T.StructField("need_digest", T.StringType()), T.StructField("text_digest", T.StringType()), T.StructField("score", T.DoubleType())])


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC8, SRC9: a cache table; an absent one is empty, so that everything is computed again.

    A cache that is there but can't be read is reported and taken as empty; what keeps the file system from answering is
    raised.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df
    except PySparkException as e:
        log.warning("the cache at %s can't be read and is computed again: %s", path, e)
        return spark.createDataFrame([], schema)


def read_legacy_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: a JSON object of ids and scores as rows (candidate_id, score); read only."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return m.select(F.explode("m").alias("candidate_id", "score"))


def append_cache(new: DataFrame, path: str) -> bool:
    """SNK9, SNK10: new rows are appended; a failure is logged and costs the cache only. Returns whether they were."""
    try:
        new.write.mode("append").parquet(path)
        return True
    except (PySparkException, Py4JJavaError) as e:
        log.warning("the cache at %s can't be written: %s", path, str(e).splitlines()[0])
        return False


def read_csv(spark: SparkSession, path: str, schema: str = "candidate_id string, rank int, score double, reasoning string") -> DataFrame:
    """SRC10."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_csv_raw(spark: SparkSession, path: str, columns: int = 4) -> tuple[DataFrame, DataFrame]:
    """SRC11: (rows as text under trimmed header names, malformed rows with their number of fields).

    Rows whose cells are all blank are left out.
    """
    wide = [f"c{i}" for i in range(columns + 1)]
    rows = spark.read.csv(path, header=False, schema=", ".join(f"{c} string" for c in wide), multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True)
    head = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    names = [h.strip() for h in head]
    body = rows.where(~F.coalesce(*[F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.lit(False)) for c in wide], F.lit(True)))
    is_head = F.lit(True)
    for c, h in zip(wide, head, strict=False):
        is_head = is_head & (F.coalesce(F.trim(c), F.lit("")) == h.strip())
    body = body.where(~is_head)
    n = sum((F.col(c).isNotNull().cast("int") for c in wide), F.lit(0))
    good = body.where(F.col(wide[-1]).isNull() & F.col(wide[columns - 1]).isNotNull()).select(*[F.col(c).alias(h) for c, h in zip(wide[:columns], names, strict=False)])
    return good, body.where(F.col(wide[-1]).isNotNull() | F.col(wide[columns - 1]).isNull()).select(n.alias("fields"), *wide)


def read_ids(spark: SparkSession, path: str, key: str = "candidate_id") -> DataFrame:
    """SRC12: the ids of JSON lines; lines that are no JSON or have none are left out."""
    return spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias(key)).where(F.col(key).isNotNull())


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "overwrite") -> int:
    """SNK1-7, SNK15: Snappy Parquet; returns the number of rows, counted while writing."""
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("compression", "snappy")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.parquet(path)
    return int(seen.get["n"])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """SNK8, SNK12: one text through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_requirement(spark: SparkSession, need: Requirement, path: str) -> None:
    write_text(spark, need.to_json(), path)


def write_model(spark: SparkSession, model: TreeRanker, path: str) -> None:
    write_text(spark, model.to_json(), path)


def read_model(spark: SparkSession, path: str) -> TreeRanker:
    """SRC14: FileNotFoundError if the model isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return TreeRanker.from_json(read_text(spark, path))


def write_result_csv(df: DataFrame, path: str) -> None:
    """SNK11: one CSV part with header, UTF-8, quotes doubled."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str) -> None:
    """ADM9: FileNotFoundError for the first path that a stage lacks."""
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(f"{p} is missing: run the stage that writes it first")


def print_report(report: DataFrame) -> str:
    """SNK14: the validation report as text, grouped by category."""
    out, category = [], None
    for r in report.orderBy("seq").collect():
        if r["category"] != category:
            category = r["category"]
            out.append(f"{category}:")
        out.append(f"  {r['status']}: {r['check']} ({r['message']})")
    return "\n".join(out)

"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_no, file_name, modified, content)`` of files, by Spark's binary source.

    Files are numbered in the order of ``paths``, which must name files; a path that is given twice is two files. An empty list, or a path that
    isn't there, is an error. The list is numbered on the driver and joined by path, so contents stay where they are read.
    """
    if not paths:
        raise ValueError("no files")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()

    def whole(path: str) -> str:
        p = hadoop.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toString()

    numbered = spark.createDataFrame([(i, whole(p)) for i, p in enumerate(paths)], "file_no bigint, path string")
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    return found.join(F.broadcast(numbered), "path").select("file_no", name.alias("file_name"), F.col("modificationTime").alias("modified"), "content")


def table_files(df: DataFrame, id_: str, text: str, prefix: str) -> DataFrame:
    """``(file_no, file_name, modified, content)`` of a table's texts, each a file ``prefix<id>.txt``."""
    name = F.concat(F.lit(prefix), F.col(id_).cast("string"), F.lit(".txt"))
    return df.select(F.col(id_).alias("file_no"), name.alias("file_name"), F.lit(None).cast("timestamp").alias("modified"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))

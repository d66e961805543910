"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB regular expression of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: One run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage. The copy survives the loss of executors.

    Spark deletes it once nothing refers to it, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, from ``spark.checkpoint.dir``. Only a local session that names none gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="bytewright-checkpoint-"))
    return context.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def named(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with its columns as ``c0, c1, ..`` and those called ``used`` (by default the documents' own) under their names too.

    So no column of a caller's table meets one of an operator's, whatever it is called.
    """
    used = [c for c in used or ("doc_id", "text") if c in df.columns]
    return df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *used)


def renamed(df: DataFrame, like: DataFrame, *changed: str, into: list[str] | None = None) -> DataFrame:
    """The columns of ``like`` out of ``named(like)``; those called ``changed`` from their own names, and the next ones of ``c0, c1, ..`` as ``into``."""
    return df.select(*[F.col(c if c in changed else f"c{i}").alias(c) for i, c in enumerate([*like.columns, *(into or [])])])


#: A key is heavy if more than one row in so many has it; so there are fewer heavy keys than that, whatever the input's size.
HEAVY = 2000


def meet(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key, with the number ``n`` of its rows), no task getting all rows of a heavy key.

    Facts of heavy keys are broadcast, fewer than ``HEAVY`` rows; the other rows meet theirs by shuffle. ``rows`` is read twice.
    """
    facts = cut(facts)
    total = facts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(facts.filter(F.col("n") * HEAVY > total))
    light = facts.filter(F.col("n") * HEAVY <= total)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return rows.join(heavy, keys).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes not to clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once: a lambda over a one-element array, so that it isn't recomputed per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null. Splitting at one plain character spares the regular expression engine."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def running(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array<bigint>, in two levels so that the copying of accumulators stays linear."""

    def fold(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            part,
            start,
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def blocks_of(all_: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")),
            lambda b: F.slice(all_, b * block + 1, block),
        )

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, fold(sums, F.lit(0).cast("bigint")), fold))

    none = F.array().cast("array<bigint>")
    return let(lengths, lambda all_: F.when(F.size(all_) < 1, none).otherwise(let(blocks_of(all_), whole)))

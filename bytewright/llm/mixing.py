"""Mixing sources to target weights by pivotal dependent rounding, as a distributed reduction tree.

A document of a source with target t and size s is wanted t / s times: the whole part is certain, the fraction is rounded.
Pivotal rounding takes two documents of a source with fractions left and shifts words between them at random, fairly, until
one of the fractions is 0 or 1; what they weigh together stays the same. So at the end of a source one document at most
has a fraction left, and the source's words miss its target by less than that document's size.

The tree: documents are dealt into leaves of about ``LEAF`` by a hash within their source, so that a source with a third of
all documents is many leaves; each leaf, its large documents first, leaves one open document, a small one as a rule. ``FAN`` leaves' open documents meet in the next level,
and so on; only these are shuffled again. All random numbers are hashes of ids, so reruns agree.

Defined cases: null or empty texts have size 0 and are taken as often as their whole part says, and once more by a hash with
the fraction as its probability; a null source comes last; texts of any length are counted whole; documents that tie in
size go by id and hash; repeated rows are documents of their own; an empty table gives an empty result; extra columns pass through
``mix`` under any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, named, renamed
from .shingles import mix as scramble

LEAF, FAN = 4096, 1024
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
#: Fractions this near to 0 or 1 are taken as such.
EPS = 1e-12
#: Sources that are broadcast at most; beyond, their targets are joined by shuffle.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank by code point, null last, counted without moving them to one task."""
    placed = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = dict(placed.groupBy("part").count().collect())  # one row a partition
    before, at = [], 0
    for part in sorted(counts):
        before.append(F.struct(F.lit(part).alias("part"), F.lit(at).cast("bigint").alias("before")))
        at += counts[part]
    if not before:
        return placed.withColumn("rank", F.lit(0).cast("bigint")).drop("part")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    offsets = placed.sparkSession.range(1).select(F.inline(F.array(*before)))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + inside).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, sid, n)`` from ``(source, size)`` rows: sid is the source's rank, n its rows.

    Targets share ``total`` times all sizes by weight. A target above ``most`` times its source's size stops there, and the
    excess is shared again by weight among the rest, until none is above: a few sums over the sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("n"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(_ranked(sources).select("source", "source_size", "n", F.col("rank").alias("sid"), w.alias("weight")))
    size, weight = F.col("source_size"), F.col("weight")
    row = sources.agg(F.sum(size).alias("n"), F.sum(weight).alias("w")).first()
    wanted = total * (row["n"] or 0)
    share = wanted / row["w"] if row["w"] else 0.0
    while row["w"]:
        above = share * weight > most * size
        left = sources.agg(F.sum(F.when(above, most * size)).alias("stopped"), F.sum(F.when(~above, weight)).alias("w")).first()
        if not left["w"]:
            break
        share, before = (wanted - (left["stopped"] or 0.0)) / left["w"], share
        if share <= before:
            share = before
            break
    return sources.select("source", size, F.least(share * weight, most * size).alias("target"), "sid", "n")


def _uniform(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = scramble(x * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p, np.int64).view(np.uint64))
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def _fold(held: tuple | None, docs: Iterator[tuple[tuple, float, float, float]]) -> tuple[tuple | None, list[tuple[tuple, int]]]:
    """Meets the open document ``(row, size, p)`` with others ``(row, size, p, u)`` in turn.

    Either words move to the open document until it is whole or the other one empty, or the other way round; the chances
    are such that no fraction changes on average. Returns who is open now, and the decided rows with 0 or 1.
    """
    done = []
    for row, s, q, u in docs:
        if q <= EPS or q >= 1 - EPS:
            done.append((row, int(q > 0.5)))
            continue
        if held is None:
            held = (row, s, q)
            continue
        row0, s0, q0 = held
        fill, drain = s0 * (1 - q0), s * q
        empty, top = s0 * q0, s * (1 - q)
        up, down = min(fill, drain), min(empty, top)
        if u * (up + down) < down:  # the open one gains
            if fill <= drain:
                done.append((row0, 1))
                held = (row, s, (drain - fill) / s)
            else:
                done.append((row, 0))
                held = (row0, s0, q0 + drain / s0)
        elif empty <= top:
            done.append((row0, 0))
            held = (row, s, q + empty / s)
        else:
            done.append((row, 1))
            held = (row0, s0, q0 - top / s0)
        if held[2] <= EPS or held[2] >= 1 - EPS:
            done.append((held[0], int(held[2] > 0.5)))
            held = None
    return held, done


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("sid", "node", "key", "tie", "size")] + [("p", pa.float64())])


def _round(final: bool):
    """Folds nodes, whose rows come sorted by node. In the rows out, p is 0 or 1 but for one row a node, unless ``final``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None

        def made(done: list[tuple[tuple, float]]) -> pa.RecordBatch:
            columns = list(zip(*[(*row, float(p)) for row, p in done], strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        def closed() -> list[tuple[tuple, float]]:
            if held is None:
                return []
            row, _, q = held
            return [(row, float(_uniform([3], [row[2]], [row[3]])[0] < q) if final else q)]

        for batch in batches:
            sid, at, key, tie, size, p = (batch.column(c).to_numpy() for c in _SCHEMA.names)
            u = _uniform([1], key, tie)
            p = np.where(size == 0, u < p, p)
            rows_ = list(zip(sid.tolist(), at.tolist(), key.tolist(), tie.tolist(), size.tolist(), strict=True))
            docs = list(zip(rows_, size.tolist(), p.tolist(), u.tolist(), strict=True))
            change = np.flatnonzero((sid[1:] != sid[:-1]) | (at[1:] != at[:-1])) + 1
            out: list[tuple[tuple, float]] = []
            for s, e in zip(np.append(0, change), np.append(change, len(sid)), strict=True):
                if s == e:
                    continue
                if node != (sid[s], at[s]):
                    out += closed()
                    node, held = (sid[s], at[s]), None
                held, done = _fold(held, docs[s:e])
                out += done
            yield made(out)
        yield made(closed())

    return rows


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key`` and ``tie``, which tell its rows apart: the id, and a hash of the text and of the row's place among equals."""
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["doc_id"].isNull())
    key = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1).cast("bigint"))
    nth = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(F.col("_source").asc_nulls_last()))
    named = docs.withColumns({"_key": key, "_hash": h, "_source": docs["source"]}).withColumn("_nth", nth)
    return named.withColumn("_tie", F.xxhash64("_hash", "_nth")).drop("_nth", "_source")


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, hash, tie, size, source_size, target, copies)`` of every row of ``docs (doc_id, text, source)``.

    ``hash`` is the text's, and ``tie`` tells rows of one key and hash apart.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("text"))
    sized = cut(_rows(cut(sized)).select("doc_id", "source", "size", F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("_tie").alias("tie")))
    aims = targets(sized)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    leaves = F.ceil(F.col("n") / LEAF).cast("bigint")
    aims = cut(aims.select(F.col("source").alias("s"), "source_size", "target", "sid", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"), leaves.alias("leaves")))
    told = aims.agg(F.count("*").alias("n"), F.max("leaves").alias("leaves")).first()
    few = told["n"] <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(aims) if few else aims, sized["source"].eqNullSafe(aims["s"]))
    joined = cut(joined.select("doc_id", "key", "hash", "tie", "size", "source_size", "target", "whole", "sid", "leaves", "p"))

    width, decided = max(1, told["leaves"] or 1), []
    level = joined.select("sid", F.pmod(F.xxhash64("key", "tie"), "leaves").alias("node"), "key", "tie", "size", "p")
    while True:
        dealt = level.repartition("sid", "node").sortWithinPartitions("sid", "node", F.desc("size"), "key", "tie")
        out = cut(dealt.mapInArrow(_round(width == 1), "sid bigint, node bigint, key bigint, tie bigint, size bigint, p double"))
        decided.append(out.filter("p = 0 or p = 1").select("key", "tie", "p"))
        if width == 1:
            break
        width = -(-width // FAN)
        level = out.filter("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN))
    rounded = reduce(DataFrame.unionByName, decided)
    n = F.least(F.col("whole") + F.col("p"), F.lit(MOST)).cast("bigint")
    return joined.drop("p").join(rounded, ["key", "tie"]).select("doc_id", "key", "hash", "tie", "size", "source_size", "target", n.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as it is taken. Texts are shuffled once: telling rows apart and meeting their copies go by one key."""
    taken = copies(docs.select("doc_id", "text", "source")).filter("copies > 0").groupBy("key", "hash")
    taken = taken.agg(F.collect_list("tie").alias("ties"), F.collect_list("copies").alias("numbers"))
    whole = named(docs, "doc_id", "text", "source")
    keyed = _rows(whole.withColumn("text", F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")))
    out = keyed.join(taken, (F.col("_key") == F.col("key")) & (F.col("_hash") == F.col("hash")))
    n = F.try_element_at("numbers", F.array_position("ties", F.col("_tie")).cast("int"))
    return renamed(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.array_contains("ties", F.col("_tie")), n).cast("int")))), docs, "")

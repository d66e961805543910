"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

1. Vectors are dealt into strips by range of length, longest first, and stay there. A rotation by the eigenvectors of their Gram
   matrix (a sum of d x d numbers) moves most of every inner product into the first coordinates.
2. Every query gets a first lower bound of its k-th score from the ``SEEDS`` longest vectors.
3. A query goes to a strip only if length times length can reach its bound; strips go by descending length, so these are the first
   ones. A strip's vectors meet its queries in blocks, in descending length. The product of the first ``HEAD`` rotated coordinates
   plus the product of the residual lengths bounds the score; survivors get their exact integer product, and raise the
   bound. A strip is left once length times length is too little.
4. Each strip yields at most k rows a query; the best k of these stay.

What moves are queries, not vectors: each goes to ``n / STRIP`` strips at most. No task holds more than one strip, one block of queries
and their best rows.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; rows that
repeat an id count once, by their smallest vector; vectors of any number of components are compared, shorter ones as ended by zeros, and empty
ones score 0; ties go to the smaller id; a scaled component or a score that doesn't fit 64 bits is an error; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEEDS, HEAD, QUERIES = 4096, 16, 1024
#: Vectors of a strip at most, on average, and at least where that gives all cores work.
STRIP, LEAST = 65536, 2048
#: Beyond this many components' product sums, scores are computed in Python integers.
EXACT = 1 << 62


def integers(vector: Column, scale: int) -> Column:
    """The components' ``floor(scale * x)``; one that doesn't fit 64 bits is an error, so that none is cut off silently."""

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 63), F.floor(y)).otherwise(F.raise_error(F.concat(F.lit("scaled component beyond 64 bits: "), y.cast("string"))).cast("bigint"))

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers, ended by zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == d).all():
        return flat.reshape(-1, d).astype(np.int64)
    out = np.zeros((len(n), d), np.int64)
    out[np.arange(d) < n[:, None]] = flat
    return out


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, exact; OverflowError for one beyond 64 bits."""
    big = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if big < EXACT:
        return (x * y).sum(1)
    return np.array([sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x, y, strict=True)], np.int64)


def _gram(d: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d).astype(float)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(g.ravel())], ["i", "g"])

    return rows


def _bounds(d: int, k: int, seed_ids: np.ndarray, seeds: np.ndarray, longest: np.ndarray):
    """Adds to each query the k-th best score among the seeds, or the least number if there are fewer, and how many strips can reach it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.astype(float)
        for batch in batches:
            x, ids = _matrix(batch.column("v"), d), batch.column("vec_id").to_numpy()
            tau = np.full(len(ids), -np.inf)
            for at in range(0, len(ids), 1024):
                p = x[at : at + 1024].astype(float) @ s.T
                p[ids[at : at + 1024, None] == seed_ids[None]] = -np.inf
                if p.shape[1] >= k:
                    tau[at : at + 1024] = np.partition(p, -k, axis=1)[:, -k]
            slack = 1e-9 * np.sqrt((x.astype(float) ** 2).sum(1)) * (np.sqrt((s**2).sum(1)).max() if len(s) else 0) + 0.5
            tau, norm = tau - slack, batch.column("norm").to_numpy()
            need = np.where(norm > 0, tau / np.where(norm > 0, norm, 1), np.where(tau > 0, np.inf, -np.inf))
            strips = np.searchsorted(-longest * (1 + 1e-9) - 1e-6, -need, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "norm")), pa.array(tau), pa.array(strips)], ["vec_id", "v", "norm", "tau", "strips"])

    return rows


class _Block:
    """A query block and its best rows so far."""

    def __init__(self, batch: pa.RecordBatch, d: int, k: int, rotation: np.ndarray):
        self.ids, self.k, self.rotation = batch.column("vec_id").to_numpy(), k, rotation
        self.x = _matrix(batch.column("v"), d)
        self.y = self.x @ rotation
        self.norm, self.tau = batch.column("norm").to_numpy(), batch.column("tau").to_numpy().copy()
        self.rest = np.sqrt((self.y[:, HEAD:] ** 2).sum(1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        y = x @ self.rotation
        norm = np.sqrt((y**2).sum(1))
        rest = np.sqrt((y[:, HEAD:] ** 2).sum(1))
        slack = 1e-9 * self.norm * norm.max(initial=0) + 1e-6
        go = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.tau)
        if not len(go):
            return
        bound = self.y[go, :HEAD] @ y[:, :HEAD].T + self.rest[go, None] * rest[None]
        at, j = np.nonzero(bound + slack[go, None] >= self.tau[go, None])
        i = go[at]
        if float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53:  # doubles hold all sums exactly
            score = (self.x[go].astype(float) @ x.T.astype(float))[at, j].astype(np.int64)
        else:
            score = np.concatenate([_dot(self.x[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        good = (score >= self.tau[i]) & (self.ids[i] != ids[j])
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(starts, np.append(starts[1:], len(i)) if len(i) else [], strict=True):
            q, e = i[s], min(e, s + self.k)
            a, b = np.append(self.best[q][0], score[s:e]), np.append(self.best[q][1], ids[j[s:e]])
            top = np.lexsort((b, -a))[: self.k]
            self.best[q] = (a[top], b[top])
            if len(top) == self.k:
                self.tau[q] = max(self.tau[q], a[top[-1]] - 0.5)

    def rows(self) -> pa.RecordBatch:
        n = [len(a) for a, _ in self.best]
        score, ids = (np.concatenate([b[c] for b in self.best] or [np.zeros(0, np.int64)]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _meet(d: int, k: int, rotation: np.ndarray):
    """Rows come sorted by strip: a strip's vectors first, longest first, then its queries, of which a block at a time meets them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, parts, ids, vectors = None, [], None, None

        def met(queries: pa.RecordBatch) -> pa.RecordBatch:
            block = _Block(queries, d, k, rotation)
            for at in range(0, len(ids), 2048):
                block.meet(ids[at : at + 2048], vectors[at : at + 2048])
            return block.rows()

        for batch in batches:
            key, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("strip", "is_query"))
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (is_query[1:] != is_query[:-1])) + 1, [batch.num_rows]])
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if strip != key[s]:
                    strip, parts, vectors = key[s], [], None
                part = batch.slice(s, e - s)
                if not is_query[s]:
                    parts.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), d)))
                    continue
                if vectors is None:
                    ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = []
                for at in range(0, part.num_rows, QUERIES):
                    yield met(part.slice(at, QUERIES))

    return rows


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows of ``vectors (vec_id, embedding)``.

    ``is_query`` is a condition on ``vec_id``. Scores are inner products of the components' ``floor(scale * x)``.
    """
    v = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint"), integers(F.col("embedding"), scale).alias("v"))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    v = cut(v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))))
    told = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = told["n"], max(1, told["d"] or 1)

    gram = np.zeros(d * d)
    for row in v.select("v").mapInArrow(_gram(d), "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():  # d * d numbers
        gram[row["i"]] = row["g"]
    rotation = np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1].copy()

    first = v.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()  # SEEDS rows at most
    seeds = np.zeros((len(first), d), np.int64)
    for i, row in enumerate(first):
        seeds[i, : len(row["v"])] = row["v"]

    cores = v.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // STRIP), min(-(-n // LEAST), cores))
    strips = cut(v.repartitionByRange(parts, F.desc("norm"), F.asc("vec_id")).withColumn("strip", F.spark_partition_id()))
    tops = {r["strip"]: r["top"] for r in strips.groupBy("strip").agg(F.max("norm").alias("top")).collect()}  # a number a strip: n / STRIP
    tops = [tops.get(i, 0.0) for i in range(max(tops, default=-1) + 1)]
    longest = np.maximum.accumulate(np.array(tops, float)[::-1])[::-1]  # an empty strip is as long as the next one
    schema = "vec_id bigint, v array<bigint>, norm double, tau double, strips int"
    queries = v.filter(is_query).select("vec_id", "v", "norm").mapInArrow(_bounds(d, k, np.array([r["vec_id"] for r in first], np.int64), seeds, longest), schema)
    sent = queries.filter("strips > 0").withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).drop("strips").withColumn("is_query", F.lit(True))
    held = strips.select("vec_id", "v", "norm", F.lit(None).cast("double").alias("tau"), "strip", F.lit(False).alias("is_query"))
    met = held.unionByName(sent).repartition(4 * parts, "strip").sortWithinPartitions("strip", "is_query", F.desc("norm"), "vec_id")
    found = met.mapInArrow(_meet(d, k, rotation), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

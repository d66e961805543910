"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of the set, a MinHash signature and band keys,
   in one narrow pass. Texts with one digest form a class; everything below is on class representatives, so that a
   group of exact copies, however large, is one node.
2. Star round: in each band bucket every member is paired with one representative (by a hash, another in each band).
   Pairs are compared signature batch by signature batch and dropped once the posterior probability that their
   similarity reaches the threshold is below ``MISS``. Survivors are confirmed on full shingle sets.
3. Rest round: a bucket whose members are still in several components is compared in blocks, members outside its
   largest component against all, skipping pairs already connected; survivors are confirmed on full sets there and then,
   and nothing but links leaves a block. So no candidate pair of different components is left out, and no bucket is capped.
4. Components of the confirmed links, by stars over the edge list.

Sets are of 64-bit hashes of shingles, so two shingles of a pair may be taken as one with a chance of 1e-19 each. A link is
missed only if no band matches (for similarity 0.8: 3e-6, less above) or by the posterior bound (1e-6).

Defined cases: null or empty texts, and texts without a word, have the empty set and are linked with nothing; texts of
fewer words than a shingle are one shingle; rows that repeat a doc_id count as one document with all their texts'
links; rows with a null doc_id take their text's component, or null, and are kept only in the latter case; texts of any length are
hashed whole; similarities that equal the threshold are links; an empty table gives an empty result; other columns are ignored, and pass
through ``keep_one`` under any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
#: Chosen probability of dropping a pair that reaches the threshold.
MISS = 1e-6
#: Ids that are broadcast at most (16 MB); beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a block on either side in the rest round.
LEFT, RIGHT = 256, 1024


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def least_matches(percent: int) -> list[tuple[int, int]]:
    """``(n, m)``: after n hashes, a pair of fewer than m equal ones has a posterior under ``MISS``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail at t is P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def _digest_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in batches:
            for at, h, count in shingle_sets(_texts(batch, "text"), width):
                n, some = len(count), count > 0
                edges = (np.cumsum(count) - count)[some]
                sig = np.zeros((HASHES, n), np.uint32)
                if len(edges):
                    for k in range(HASHES):
                        sig[k, some] = np.minimum.reduceat(h * a[k] + b[k], edges) >> np.uint64(32)
                sig = np.ascontiguousarray(sig.T)
                ends = np.cumsum(count)
                digests = [hashlib.blake2b(h[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(ends, count, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + n], pa.array(count, pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )

    return rows


def _set_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, h, count in shingle_sets(_texts(batch, "text"), width):
                offsets = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + len(count)], pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], ["id", "set"])

    return rows


def _survivors(bounds: list[tuple[int, int]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the row pairs of two signature matrices, the indices of those that no batch drops."""
    left = np.arange(len(x))
    equal = np.zeros(len(x), np.int32)
    done = 0
    for n, m in bounds:
        equal += (x[left, done:n] == y[left, done:n]).sum(1, dtype=np.int32)
        keep = equal >= m
        left, equal, done = left[keep], equal[keep], n
    return left


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _sequential(bounds: list[tuple[int, int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = pa.array(_survivors(bounds, _sigs(part.column("su")), _sigs(part.column("sv"))))
                yield pa.RecordBatch.from_arrays([part.column("u").take(keep), part.column("v").take(keep)], ["u", "v"])

    return rows


def _shared_with(one: np.ndarray, flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with some of the sets that ``offsets`` cut ``flat`` into."""
    sizes = offsets[which + 1] - offsets[which]
    edges = np.cumsum(sizes) - sizes
    at = np.repeat(offsets[which] - edges, sizes) + np.arange(sizes.sum())
    x = flat[at]
    hit = one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x
    return np.add.reduceat(hit, edges, dtype=np.int64)


def _blocks(bounds: list[tuple[int, int]], percent: int):
    """Confirmed links of blocks, whose rows come sorted by block: rows outside the bucket's largest component against all.

    A link joins its two components within the block, so a block yields fewer links than it has rows.
    """

    def block(ids: np.ndarray, comp: np.ndarray, out: np.ndarray, band: int, sig: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        root = np.unique(comp, return_inverse=True)[1]
        inside, links = np.flatnonzero(~out), []
        for x in np.flatnonzero(out):
            y = inside[root[inside] != root[x]]
            y = y[_survivors(bounds, np.broadcast_to(sig[x], (len(y), HASHES)), sig[y])]
            if len(y):  # each pair counts in the first band that it shares
                y = y[(sig[x] == sig[y]).reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band]
            for at in range(0, len(y), 512):
                some = y[at : at + 512]
                mine = flat[offsets[x] : offsets[x + 1]]
                shared = _shared_with(mine, flat, offsets, some)
                union = len(mine) + offsets[some + 1] - offsets[some] - shared
                for z in some[100 * shared >= percent * union]:
                    if root[z] != root[x]:
                        links.append((ids[x], ids[z]))
                        root[root == root[z]] = root[x]
        return links

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("block").to_numpy()
            cuts = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key))
            whole = len(cuts) - 1 if last else len(cuts) - 2
            held.clear()
            if not last:
                held.extend(t.slice(int(cuts[whole])).to_batches())
            if whole < 1:
                return
            ids, comp, out = (t.column(c).to_numpy() for c in ("id", "comp", "outside"))
            band, sig = t.column("band").to_numpy(), _sigs(t.column("sig").slice(0, int(cuts[whole])))
            sets = t.column("set").combine_chunks()
            flat, offsets, found = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy(), []
            for s, e in zip(cuts[:whole], cuts[1 : whole + 1], strict=True):
                found += block(ids[s:e], comp[s:e], out[s:e], band[s], sig[s:e], flat, offsets[s : e + 1])
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append(batch)
            yield from flush(False)
        yield from flush(True)

    return rows


def _sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(id, set)`` of the documents with these ``doc_id``: their sorted shingle hashes, from their whole texts."""
    ids = cut(ids.distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return texts.mapInArrow(_set_rows(width), "id bigint, set array<bigint>")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs ``(u, v)`` of doc_ids, those whose full shingle sets reach the threshold."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id")))
    sets = cut(_sets(ids, docs, width))
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    both = both.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    rows = both.select("u", "v", (F.size("su") + F.size("sv")).alias("sizes"), shared.alias("shared"))
    return rows.filter(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text, ...)``."""
    bounds = least_matches(percent)
    schema = "doc_id bigint, n_shingles bigint, digest binary, sig binary"
    rows = cut(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_digest_rows(width), schema))

    reps = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    nodes = cut(reps.select("digest", F.col("r.doc_id").alias("id"), "r.sig"))
    part = lambda k: F.substring(F.col("sig"), k * ROWS * 4 + 1, F.lit(ROWS * 4))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, part(k)))
    members = nodes.select("id", F.posexplode(keys).alias("band", "bucket"))

    heads = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), "id")).alias("m"))
    heads = heads.filter("n > 1").select("bucket", F.col("m.id").alias("v"))
    shared = cut(members.join(heads, "bucket"))  # members of buckets with two or more
    sig = nodes.select("id", "sig")
    stars = shared.filter("id != v").select(F.col("id").alias("u"), "v").distinct()
    stars = stars.join(sig.withColumnsRenamed({"id": "u", "sig": "su"}), "u").join(sig.withColumnsRenamed({"id": "v", "sig": "sv"}), "v")
    stars = cut(stars.select("u", "v", "su", "sv").mapInArrow(_sequential(bounds), "u bigint, v bigint"))
    links = cut(_confirmed(stars, docs, width, percent))
    first = components(links)

    placed = shared.join(first, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("comp"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    largest = largest.filter("comps > 1").select("bucket", F.col("top.comp").alias("top"), F.col("n").alias("n_all"), (F.col("n") - F.col("top.n")).alias("n_out"))
    open_ = cut(placed.join(largest, "bucket"))
    left = F.ceil(F.col("n_out") / LEFT).cast("int")
    right = F.ceil(F.col("n_all") / RIGHT).cast("int")
    seat = F.xxhash64(F.lit(7), "id")
    sides = open_.withColumn("outside", F.lit(False)).withColumn("i", F.explode(F.sequence(F.lit(0), left - 1))).withColumn("j", F.pmod(seat, right).cast("int"))
    outs = open_.filter("comp != top").withColumn("outside", F.lit(True)).withColumn("j", F.explode(F.sequence(F.lit(0), right - 1))).withColumn("i", F.pmod(seat, left).cast("int"))
    seats = sides.unionByName(outs).select(F.xxhash64("bucket", "band", "i", "j").alias("block"), "band", "id", "comp", "outside")
    known = cut(_sets(open_.select(F.col("id").alias("doc_id")), docs, width)).join(sig, "id")
    dealt = seats.join(known, "id").repartition("block").sortWithinPartitions("block", "outside")
    more = dealt.mapInArrow(_blocks(bounds, percent), "u bigint, v bigint")
    tied = components(first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))

    found = nodes.select("digest", F.col("id").alias("rep")).join(tied.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each group; rows that repeat a kept doc_id are kept as they are."""
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")

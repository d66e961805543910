"""Best-fit packing of tokenized documents, by vector best-fit over a histogram of lengths.

A document longer than a sequence is cut so that its first piece is the short one; all others fill a sequence. What is
left to pack has integer lengths below the sequence's, so the packing is planned on counts by length: fewer than ``C``
numbers, whatever the corpus' size. Lengths go by descending order. Bins of one history form a group; each step puts a piece into
every bin of the group that fits best, or opens new bins. A bin has three residuals, each a share of its capacity: tokens,
documents, and attention cost (the sum of squared lengths). A piece goes where all three admit it, to the least
weighted norm of the residuals left, or to the largest weighted dot product of demand and residual.

The plan is a table of ranges: pieces of one length with ranks ``lo .. lo + n - 1`` go to bins ``bin ..`` at one offset. Ranks
come from window counts by length and hash bucket, so that a length that very many documents share is many windows.

Defined cases: a null or empty text is the end token alone; documents are cut only if longer than a sequence; texts of any length are
encoded whole, white space and single words of megabytes included; pieces that tie in length are ranked by a hash, then id and
piece, and equal rows take their ranks in any order; rows that repeat a doc_id are packed each; a null doc_id stays null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

CAPACITY, END = 1024, 2
#: Pieces of one length that are ranked together, on average, and their least share of all: a length has as many hash buckets as it takes.
RANKED, SHARE = 1 << 16, 1 / 1024
#: Rows of the bucket table that are broadcast at most; beyond, it is joined by shuffle.
BROADCAST_BUCKETS = 1 << 17


#: Where a text may be cut: before white space behind anything that is none, and before punctuation behind a letter.
_CUT = re.compile(r"(?<=[!-~\w])(?=[ \t\r\n])|(?<=[A-Za-z])(?=[.,;:!?)#$%&*])")
#: A part that is one word, with one white-space character before it at most. These letters are letters to every version of Unicode.
_WORD = re.compile(r"([ \t\r\n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)")
#: A byte-level model's characters for bytes: printable ones stand for themselves, the others for 256 and on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Parts of so many characters at most are kept, and so many of them in each Python worker; others are encoded each time.
PART, PARTS = 48, 1_000_000


class Encoder(dict):
    """Ids of whole texts by ``tokenizers``, as little-endian 32-bit numbers. What stands between two cuts is encoded once and then looked up.

    A byte-level pre-tokenizer splits at its fixed pattern: white space only opens a token or stands among other white space, and a
    token of letters ends at punctuation. So a token ends at every cut and the next one begins there, whatever stands on the other
    side; merges don't cross tokens, and no special token holds a cut. So the ids of the parts are those of the whole. A part that is
    one word is one token of the pre-tokenizer, and goes to the tokenizer's model as it is. A tokenizer of another build, for
    which this isn't known to hold, takes whole texts.
    """

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        first = told["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not told["normalizer"]
        apart = all(not _CUT.search(f"a{t['content']}a") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in told["added_tokens"])
        self.by_parts = bool(plain and apart and told["model"].get("type") == "BPE")

    def __missing__(self, part: str) -> bytes:
        word = _WORD.fullmatch(part) if self.by_parts else None
        if word and word[1] not in ("", " "):
            ids = self[word[1]] + self[word[2]]
        elif word:
            ids = np.array([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_SPELLED))], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= PART:
            if len(self) >= PARTS:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, _CUT.split(text) if self.by_parts else [text])), "<u4")


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece of every document, and its ``ids`` on request."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                owner, piece, start, length, crc, all_ids = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = np.append(encoder.ids(text), np.array([end], "<u4"))
                    first = len(ids) % capacity or capacity
                    for n, a in enumerate(range(first - capacity, len(ids), capacity)):
                        a, b = max(a, 0), a + capacity
                        owner.append(i)
                        piece.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            all_ids.append(ids[a:b].astype(np.int32))
                out = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
                out += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(length, first rank, pieces, first bin, offset)`` that place all pieces of ``counts`` by length.

    ``documents`` and ``attention`` bound a bin's pieces and their squared lengths' sum; by default neither binds before the
    tokens do. ``by`` is ``norm`` (least residual norm after) or ``dot`` (largest dot product of demand and residual).
    """
    documents, attention = documents or capacity, attention or capacity * capacity
    wt, wd, wa = weights
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals -> ranges of bins (first, number)
    states: list[tuple[int, int, int]] = []  # the keys of groups, sorted
    out, opened = [], 0

    def put(state: tuple[int, int, int], first: int, n: int) -> None:
        if state[0] > 0 and state[1] > 0 and n:
            if state not in groups:
                insort(states, state)
            groups.setdefault(state, []).append((first, n))

    def score(state: tuple[int, int, int], size: int) -> float:
        t, d, a = state[0], state[1], state[2]
        if by == "dot":
            return -(wt * size * t / capacity**2 + wd * d / documents**2 + wa * size * size * a / attention**2)
        return wt * ((t - size) / capacity) ** 2 + wd * ((d - 1) / documents) ** 2 + wa * ((a - size * size) / attention) ** 2

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        if size > capacity or size * size > attention:
            raise ValueError(f"no bin holds a piece of {size} tokens")
        while left:
            fits = (s for s in states[bisect_left(states, (size,)) :] if s[2] >= size * size)
            best = min(fits, key=lambda s: (score(s, size), s), default=None)
            if best is None:
                state, first, n = (capacity, documents, attention), opened, left
                # open as many bins as the pieces need when each takes as many of them as it can
                each = min(capacity // size, documents, attention // (size * size))
                n = -(-left // each)
                opened += n
            else:
                state = best
                first, n = groups[state].pop()
                if not groups[state]:
                    del groups[state]
                    states.pop(bisect_left(states, state))
            some = min(n, left)
            out.append((size, rank, some, first, capacity - state[0]))
            put((state[0] - size, state[1] - 1, state[2] - size * size), first, some)
            put(state, first + some, n - some)
            rank, left = rank + some, left - some
    return out


def pack(pieced: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """``pieced`` with ``sequence_id`` and ``offset``. A full piece has a sequence of its own, with a negative number, and needs no rank."""
    held = cut(pieced)
    full = held.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    short = held.filter(F.col("length") != capacity)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than ``capacity`` rows
    if not counts:
        return full
    together = max(1, min(RANKED, int(SHARE * sum(counts.values()))))
    dealt = {k: -(-n // together) for k, n in counts.items()}
    buckets = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for k, n in dealt.items() for x in (k, n)]), F.col("length"))
    short = short.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets))
    sizes = short.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")))
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    for length, lo, _, first, offset in plan(counts, capacity, **limits):
        ranges.setdefault(length, []).append((lo, first, offset))
    tables = {k: np.array(v, np.int64).T for k, v in ranges.items()}  # its size depends on the lengths, not on the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                lo, first, off = tables[int(k)]
                at = np.searchsorted(lo, rank[rows], "right") - 1
                sequence[rows], offset[rows] = first[at] + rank[rows] - lo[at], off[at]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    few = sum(dealt.values()) <= BROADCAST_BUCKETS
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = short.withColumn("_in", inside).join(F.broadcast(starts) if few else starts, ["length", "_bucket"])
    ranked = ranked.select(*pieced.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias("_rank"))
    placed = ranked.mapInArrow(place, T.StructType([*pieced.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return full.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

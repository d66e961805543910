"""Burrows-Wheeler and recency-rank transforms of blocks.

Two forms each: expressions and windows for short content, which SQL can check, and Arrow batches with numpy for real blocks.
Blocks are independent rows, so the transforms are narrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bytes import byte_rows


#: Bytes whose suffixes are sorted as they stand.
SHORT = 2048


def suffix_order(data: bytes) -> np.ndarray:
    """Starts of the suffixes in order, the empty one at the end of ``data`` first: short data by plain sorting, other by prefix doubling."""
    if len(data) <= SHORT:
        return np.array(sorted(range(len(data) + 1), key=lambda i: data[i:]))
    x = np.append(np.frombuffer(data, np.uint8).astype(np.int64) + 1, 0)
    n, step = len(x), 1
    rank = x
    while True:
        other = np.zeros(n, np.int64)
        other[: n - step] = rank[step:] + 1 if step < n else 0
        order = np.lexsort((other, rank))
        a, b = rank[order], other[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


def bwt(data: bytes) -> tuple[bytes, int]:
    """The transform without its end mark, and the row of the whole text, counted from 1 without the empty suffix' row."""
    if not data:
        return b"", 0
    order = suffix_order(data)
    row = int(np.flatnonzero(order == 0)[0])
    last = np.frombuffer(data, np.uint8)[np.delete(order, row) - 1]
    return last.tobytes(), row


def unbwt(data: bytes, primary: int) -> bytes:
    """What ``bwt`` was given; ValueError for a row that no text has."""
    if not data:
        return b""
    if not 0 < primary <= len(data):
        raise ValueError("no such row")
    x = np.frombuffer(data, np.uint8)
    with_mark = np.insert(x.astype(np.int64) + 1, primary, 0)
    step = np.argsort(with_mark, kind="stable").tolist()  # from a row to the row of the next suffix
    first = np.sort(with_mark).tolist()
    out, at = bytearray(len(data)), primary
    for i in range(len(data)):
        out[i] = (first[at] - 1) & 255
        at = step[at]
    return bytes(out)


#: Bytes of blocks that are sorted together.
TOGETHER = 1 << 18
#: Blocks below which they are undone one by one.
FEW = 12


def _sorted_together(blocks: list[bytes]) -> list[tuple[bytes, int]]:
    """``bwt`` of some blocks, none of them empty. Suffixes are sorted block by block on their first seven bytes; those that are alike then all
    together, by the ranks of what follows, over twice the length each time."""
    sizes = np.array([len(b) + 1 for b in blocks])
    ends = np.cumsum(sizes)
    begins, n = ends - sizes, int(ends[-1])
    text = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8)
    x = np.zeros(n + 6, np.uint64)
    x[:n] = text
    x[:n] += 1
    x[ends - 1] = 0
    key = x[:n].copy()
    for i in range(1, 7):
        key = key << np.uint64(9) | x[i : n + i]
    order = np.concatenate([np.argsort(key[b:e]) + b for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    new[begins] = True
    slot, rank, step = np.arange(n), np.empty(n, np.int64), 7
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes that others equal
    while len(open_):
        suffix = order[open_]
        both = rank[suffix] * n + rank[suffix + step]
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[open_] = suffix
        new = np.append(True, both[1:] != both[:-1])
        rank[suffix] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    whole = np.empty(n, np.int64)
    whole[order] = slot
    rows = whole[begins]
    last = np.delete(text[order - 1], rows).tobytes()
    at = (begins - np.arange(len(blocks))).tolist()
    return [(last[i : i + len(b)], int(r)) for i, b, r in zip(at, blocks, (rows - begins).tolist(), strict=True)]


def bwt_all(blocks: list[bytes]) -> list[tuple[bytes, int]]:
    """``bwt`` of each block."""
    out: list[tuple[bytes, int]] = [(b"", 0)] * len(blocks)
    some, total = [], 0
    for i, b in enumerate(blocks):
        if b:
            some.append(i)
            total += len(b)
        if some and (total >= TOGETHER or i == len(blocks) - 1):
            for j, x in zip(some, _sorted_together([blocks[j] for j in some]), strict=True):
                out[j] = x
            some, total = [], 0
    if some:
        for j, x in zip(some, _sorted_together([blocks[j] for j in some]), strict=True):
            out[j] = x
    return out


def unbwt_all(pairs: list[tuple[bytes, int]]) -> list[bytes | None]:
    """``unbwt`` of each pair, None for a row that no text has; blocks of like sizes go step by step together."""
    out: list[bytes | None] = [b"" if not data else None for data, _ in pairs]
    fit = sorted((i for i, (data, row) in enumerate(pairs) if 0 < row <= len(data)), key=lambda i: -len(pairs[i][0]))
    while fit:
        longest = len(pairs[fit[0]][0])
        some = fit[: max(1, min(4096, (16 << 20) // longest))]
        fit = fit[len(some) :]
        sizes = np.array([len(pairs[i][0]) for i in some])
        begins = np.append(0, np.cumsum(sizes + 1))
        step, first = np.empty(begins[-1], np.int64), np.empty(begins[-1], np.uint8)
        for b, i in zip(begins.tolist(), some, strict=False):
            marked = np.insert(np.frombuffer(pairs[i][0], np.uint8).astype(np.uint16) + 1, pairs[i][1], 0)
            step[b : b + len(marked)] = (order := np.argsort(marked, kind="stable")) + b
            first[b : b + len(marked)] = marked[order] - 1 & 255
        at = begins[:-1] + [pairs[i][1] for i in some]
        rows = np.empty((longest, len(some)), np.int64 if begins[-1] >> 31 else np.int32)
        lanes = np.searchsorted(-sizes, -np.arange(longest))
        t = 0
        while t < longest and lanes[t] >= FEW:
            k = lanes[t]
            rows[t, :k] = at[:k]
            at[:k] = step.take(at[:k])
            t += 1
        for j, i in enumerate(some):
            n = int(sizes[j])
            head = first[rows[: min(t, n), j]].tobytes()
            if n > t:
                b = int(begins[j])
                chain, letters, place, tail = (step[b : b + n + 1] - b).tolist(), first[b : b + n + 1].tobytes(), int(at[j]) - b, bytearray(n - t)
                for r in range(n - t):
                    tail[r] = letters[place]
                    place = chain[place]
                head += bytes(tail)
            out[i] = head
    return out


_SYMBOLS = list(range(256))


def mtf(data: bytes) -> bytes:
    """Recency ranks: a symbol at rank 0 stays, at rank 1 comes to the front, from further back to rank 1."""
    x = np.frombuffer(data, np.uint8)
    out = np.zeros(len(x), np.uint8)
    same = x[1:] == x[:-1]
    seen = np.append([True, True], ~(same[1:] & same[:-1]))[: len(x)]  # what comes the third time in a row is at the front
    table, ranks = _SYMBOLS.copy(), []
    find, add = table.index, ranks.append
    for s in x[seen].tolist():
        z = find(s)
        add(z)
        if z > 1:
            del table[z]
            table.insert(1, s)
        elif z:
            table[1] = table[0]
            table[0] = s
    out[seen] = ranks
    return out.tobytes()


def unmtf(ranks: bytes) -> bytes:
    x = np.frombuffer(ranks, np.uint8)
    moved = np.flatnonzero(x)
    table, symbols, fronts = _SYMBOLS.copy(), [], [0]
    add, front = symbols.append, fronts.append
    for z in x[moved].tolist():
        s = table[z]
        add(s)
        if z > 1:
            del table[z]
            table.insert(1, s)
        else:
            table[1] = table[0]
            table[0] = s
        front(table[0])
    out = np.array(fronts, np.uint8)[np.cumsum(x > 0)]  # rank 0 repeats the front
    out[moved] = symbols
    return out.tobytes()


#: Bytes of a column that are worked on at a time; a row alone may have more.
SLICE = 4 << 20


def _mapped(df: DataFrame, columns: str, f) -> DataFrame:
    """``df`` with the columns of ``f(lists of the columns named first)``, by Arrow batches of bounded bytes. What isn't named goes through as it is."""
    takes, gives = (part.strip() for part in columns.split("->"))
    names = [c.strip() for c in takes.split(",")]
    extra = df.sparkSession.createDataFrame([], gives).schema
    types = [pa.binary() if x.dataType.simpleString() == "binary" else pa.int32() for x in extra]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(names[0])), 0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows or at == 0:
                end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE, "right")))
                part = batch.slice(at, end - at)
                made = f(*[part.column(c).to_pylist() for c in names])
                more = [pa.array(c, t) for c, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*batch.schema.names, *extra.names])
                at = end

    return df.mapInArrow(rows, StructType([*df.schema.fields, *extra.fields]))


def _plain(pairs: list[tuple[bytes, int]]) -> list[bytes]:
    out = unbwt_all(pairs)
    if None in out:
        raise ValueError("no such row")
    return out


def bwt_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks (.., block)`` with ``bwt`` and ``bwt_primary``."""
    return _mapped(blocks, "block -> bwt binary, bwt_primary int", lambda b: tuple(zip(*bwt_all(b), strict=True)) or ((), ()))


def unbwt_blocks(df: DataFrame) -> DataFrame:
    """``df (.., bwt, bwt_primary)`` with ``plain``."""
    return _mapped(df, "bwt, bwt_primary -> plain binary", lambda b, p: (_plain(list(zip(b, p, strict=True))),))


def mtf_blocks(df: DataFrame, column: str = "bwt") -> DataFrame:
    """``df`` with the recency ranks of ``column`` as ``ranks``."""
    return _mapped(df, f"{column} -> ranks binary", lambda b: ([mtf(x) for x in b],))


def unmtf_blocks(df: DataFrame, column: str = "ranks") -> DataFrame:
    """``df`` with the bytes whose ranks ``column`` holds, as ``symbols``."""
    return _mapped(df, f"{column} -> symbols binary", lambda b: ([unmtf(x) for x in b],))


def ranked_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks (.., block)`` with ``ranks`` and ``bwt_primary`` in place of the block: both transforms in one pass."""

    def f(b: list[bytes]):
        moved = bwt_all(b)
        return [mtf(x) for x, _ in moved], [row for _, row in moved]

    return _mapped(blocks, "block -> ranks binary, bwt_primary int", f).drop("block")


def plain_blocks(df: DataFrame) -> DataFrame:
    """``df (.., ranks, bwt_primary)`` with ``plain`` in their place: both transforms undone in one pass."""
    return _mapped(df, "ranks, bwt_primary -> plain binary", lambda r, p: (_plain([(unmtf(x), row) for x, row in zip(r, p, strict=True)]),)).drop("ranks", "bwt_primary")


def bwt_by_window(df: DataFrame) -> DataFrame:
    """``(doc_id, primary, bwt_hex)`` of short content, by sorting suffixes in a window: quadratic in the content's size."""
    n = F.octet_length("content")
    suffixes = df.filter(n > 0).select("doc_id", "content", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    rows = suffixes.select("doc_id", "i", F.substring("content", F.col("i"), n - F.col("i") + 1).alias("s"), F.hex(F.substring("content", F.col("i") - 1, F.lit(1))).alias("before"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("s")))
    # the empty suffix comes first and has the last byte before it
    last = df.filter(n > 0).select("doc_id", F.lit(0).alias("i"), F.lit(b"").alias("s"), F.hex(F.substring("content", n, F.lit(1))).alias("before"), F.lit(0).alias("row"))
    rows = rows.withColumn("before", F.when(F.col("i") > 1, F.col("before"))).unionByName(last)
    parts = F.sort_array(F.collect_list(F.when(F.col("before").isNotNull(), F.struct("row", "before"))))
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("i") == 1, F.col("row"))).alias("primary"), F.array_join(F.transform(parts, lambda x: x["before"]), "").alias("bwt_hex"))


def mtf_ranks(bytes_: Column) -> Column:
    """Recency ranks of an array of byte values, by a fold over it."""

    def step(a: Column, s: Column) -> Column:
        z = (F.array_position(a["table"], s) - 1).cast("int")
        others = F.filter(a["table"], lambda x: x != s)
        moved = F.when(z == 0, a["table"]).when(z == 1, F.concat(F.array(s), others)).otherwise(F.concat(F.slice(others, 1, 1), F.array(s), F.slice(others, 2, 255)))
        return F.struct(moved.alias("table"), F.concat(a["out"], F.array(z)).alias("out"))

    start = F.struct(F.sequence(F.lit(0), F.lit(255)).alias("table"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(bytes_, start, step, lambda a: a["out"])


def byte_arrays(df: DataFrame) -> DataFrame:
    """``(doc_id, bytes)``: content as an array of byte values."""
    rows = byte_rows(df)
    return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]).alias("bytes"))

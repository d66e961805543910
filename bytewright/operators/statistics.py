"""Frequency statistics and code lengths: one narrow pass over the documents, no shuffle.

Counts never cross a document, so each Arrow batch is counted where it is: bytes with their contexts are packed into integers and
sorted, and only counts, or one number a document, leave the task. Every row is a document of its own, whatever its id.

An adaptive model codes a symbol with its weight before the update. Over a whole sequence the weights of one symbol run
through 1, 2, .., n whatever the order, and the totals through 256, 257, ..; so the cost of an order-N model is a sum of log
factorials of the counts by context. A table whose total exceeds ``MAX_FREQ`` is halved; the sum then holds between halvings, and a context
that comes to one is taken piece by piece, each piece as a whole.

Defined cases: empty content has no bytes, so no row where rows are counts or costs, and 256 weights of 1 in ``cumulative``; null
content is as empty; a text of any length is one piece of work, in memory of some dozen times its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Weights are halved when their sum exceeds this.
MAX_FREQ = 65536
#: Bytes counted at a time, longer documents alone.
STEP = 1 << 21

Counted = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, ...]]


def _narrow(df: DataFrame, columns: str, count: Counted) -> DataFrame:
    """``(doc_id, columns)`` rows of ``df (doc_id, content)``.

    ``count`` gets the bytes of some documents, each byte's document and place, and the number of documents; it returns each
    row's document and the columns.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = pc.fill_null(batch.column("content").cast(pa.large_binary()), b"")
            offsets = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
            data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(content):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
                size = np.diff(offsets[at : end + 1])
                doc = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(doc)) - np.repeat(offsets[at:end] - offsets[at], size)
                owner, *values = count(data[offsets[at] : offsets[end]], doc, place, len(size))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at:end].take(pa.array(owner)), *map(pa.array, values)], ["doc_id", *names])
                at = end

    return df.mapInArrow(rows, f"doc_id bigint, {columns}")


def _table(data: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Counts by document and byte."""
    return np.bincount(doc << 8 | data, minlength=256 * n).reshape(n, 256)


def histogram(df: DataFrame) -> DataFrame:
    """``(doc_id, b, cnt)`` of ``df (doc_id, content)``."""

    def count(data, doc, place, n):
        table = _table(data, doc, n)
        owner, b = np.nonzero(table)
        return owner, b.astype(np.int32), table[owner, b]

    return _narrow(df, "b int, cnt bigint", count)


def cumulative(df: DataFrame) -> DataFrame:
    """``(doc_id, b, weight, cum_freq, total)`` for all 256 symbols: counts plus one, and the weights of all smaller symbols."""

    def count(data, doc, place, n):
        weight = _table(data, doc, n) + 1
        sums = weight.cumsum(1)
        return np.repeat(np.arange(n), 256), np.tile(np.arange(256, dtype=np.int32), n), weight.ravel(), (sums - weight).ravel(), np.repeat(sums[:, -1], 256)

    return _narrow(df, "b int, weight bigint, cum_freq bigint, total bigint", count)


def entropy(df: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, bits_per_byte)``: the order-0 entropy of each document."""

    def count(data, doc, place, n):
        table = _table(data, doc, n)
        size = table.sum(1)
        some = np.flatnonzero(size)
        table, size = table[some], size[some]
        return some, size, np.log2(size) - (table * np.log2(np.maximum(table, 1))).sum(1) / size

    return _narrow(df, "n_bytes bigint, bits_per_byte double", count)


def rescaled(weights: np.ndarray, limit: int) -> np.ndarray:
    """Weights halved upwards as often as it takes for their sum to be below ``limit``."""
    while weights.sum() >= limit:
        weights = weights - (weights >> 1)
    return weights


def fixed_bits(df: DataFrame, halve: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, bits)`` under the static order-0 model: counts plus one, halved while too large if ``halve`` says so; without its table."""

    def count(data, doc, place, n):
        table = _table(data, doc, n)
        size = table.sum(1)
        some = np.flatnonzero(size)
        weights = np.array([rescaled(table[i] + 1, MAX_FREQ) if halve else table[i] + 1 for i in some]).reshape(len(some), 256)
        return some, size[some], (table[some] * np.log2(weights.sum(1, keepdims=True) / weights)).sum(1)

    return _narrow(df, "n_bytes bigint, bits double", count)


def contexts(data: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """At every byte the ``order`` bytes before it, the newest lowest, zeros before the start."""
    out = np.zeros(len(data), np.int64)
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        out |= np.where(place >= k, before, 0) << (8 * (k - 1))
    return out


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their counts."""
    key = np.sort(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def context_counts(df: DataFrame, order: int) -> DataFrame:
    """``(doc_id, c1 .., b, cnt)``: how often each byte follows each context of ``order`` bytes, up to 3."""

    def count(data, doc, place, n):
        key, counts = _counted(doc << 32 | contexts(data, place, order) << 8 | data)
        parts = [(key >> (8 * (k + 1)) & 255).astype(np.int32) for k in range(order)]
        return key >> 32, *parts, (key & 255).astype(np.int32), counts

    return _narrow(df, "".join(f"c{k} int, " for k in range(1, order + 1)) + "b int, cnt bigint", count)


def _log2_factorials(most: int) -> np.ndarray:
    """log2(n!) for n up to ``most``."""
    return np.append(0, np.cumsum(np.log2(np.arange(1, most + 1, dtype=float))))


#: For all counts of a table that is halved, and the sums of such weights.
_LOG2_FACTORIAL = _log2_factorials(MAX_FREQ + 1)


def _halved_cost(symbols: np.ndarray) -> float:
    """Bits of one context's symbols, a piece between two halvings of its table at a time."""
    weights, at, bits = np.ones(256, np.int64), 0, 0.0
    while at < len(symbols):
        total = int(weights.sum())
        piece = np.bincount(symbols[at : at + MAX_FREQ + 1 - total], minlength=256)
        n = int(piece.sum())
        bits += _LOG2_FACTORIAL[total + n - 1] - _LOG2_FACTORIAL[total - 1] - (_LOG2_FACTORIAL[weights + piece - 1] - _LOG2_FACTORIAL[weights - 1]).sum()
        weights = weights + piece
        if weights.sum() > MAX_FREQ:
            weights = weights - (weights >> 1)
        at += n
    return float(bits)


def adaptive_bits(df: DataFrame, order: int, halve: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, bits)``: the code length of each document of ``df (doc_id, content)`` under the adaptive order-N model.

    Tables are halved as the coder's are, unless ``halve`` is false: then every byte counts in full, however long the document.
    """

    def count(data, doc, place, n):
        context = doc << 24 | contexts(data, place, order)
        key, own = _counted(context << 8 | data)
        first = np.flatnonzero(np.append(True, key[1:] >> 8 != key[:-1] >> 8)) if len(key) else np.zeros(0, np.int64)
        which, total = key[first] >> 8, np.add.reduceat(own, first) if len(first) else own
        halved = (total > MAX_FREQ - 255) & halve
        bits = np.zeros(n)
        some = ~halved
        most = int(total.max(initial=0)) + 255
        factorial = _LOG2_FACTORIAL if most < len(_LOG2_FACTORIAL) or halve else _log2_factorials(most)
        np.add.at(bits, which[some] >> 24, factorial[total[some] + 255] - factorial[255])
        kept = ~np.repeat(halved, np.diff(np.append(first, len(key))))
        np.subtract.at(bits, key[kept] >> 32, factorial[own[kept]])
        for c in which[halved]:
            bits[c >> 24] += _halved_cost(data[context == c])
        size = np.bincount(doc, minlength=n)
        some = np.flatnonzero(size)
        return some, size[some], bits[some]

    return _narrow(df, "n_bytes bigint, bits double", count)


def _before(key: np.ndarray) -> np.ndarray:
    """How often each element's key came before it."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), np.arange(len(key)), 0)) if len(key) else order
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - first
    return out


def _halved_weights(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Before each of one context's symbols its weight and the table's total; all weights are ``base`` at first, and halved beyond MAX_FREQ."""
    weight, total = np.empty(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    table, at = np.full(256, base, np.int64), 0
    while at < len(symbols):
        sum_ = int(table.sum())
        piece = symbols[at : at + MAX_FREQ + 1 - sum_]
        weight[at : at + len(piece)] = table[piece] + _before(piece.astype(np.int64))
        total[at : at + len(piece)] = sum_ + np.arange(len(piece))
        table = table + np.bincount(piece, minlength=256)
        if table.sum() > MAX_FREQ:
            table = table - (table >> 1)
        at += len(piece)
    return weight, total


def mixed_bits(df: DataFrame, halve: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, bits)``: each byte at the cost of the longest context of up to three bytes that has seen it before.

    An estimate, as no escape is paid. Tables are halved as the adaptive model's are, unless ``halve`` is false.
    """

    def count(data, doc, place, n):
        cost = np.zeros(len(data))
        for order in range(4):
            context, base = doc << 24 | contexts(data, place, order), int(order == 0)
            weight, total = _before(context << 8 | data) + base, (_before(context) if order else place) + 256 * base
            for c in np.unique(context[(total > MAX_FREQ) & halve]):
                at = np.flatnonzero(context == c)
                weight[at], total[at] = _halved_weights(data[at], base)
            seen = weight > 0
            cost[seen] = np.log2(total[seen] / weight[seen])
        size = np.bincount(doc, minlength=n)
        some = np.flatnonzero(size)
        return some, size[some], np.bincount(doc, cost, minlength=n)[some]

    return _narrow(df, "n_bytes bigint, bits double", count)

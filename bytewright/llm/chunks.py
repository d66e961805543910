"""Substring deduplication by content-defined chunks: a gear rolling hash, digests of runs of chunks, and whole copies.

A chunk ends with a word where the gear hash of the last eight bytes is a multiple of ``RATE``, each run of white space taken as
one space. So boundaries hang on the text around them alone, and an insertion shifts none but its own. A stretch with few distinct
words may have no such word. So where ``HELD`` words repeat those up to ``PERIOD`` words before, the chunk also ends once a period,
with the word of the least hash. Longer periods hang on the gear hash.

What is compared are runs of chunks with ``MIN_WORDS`` words or more that are shortest from their first or to their last chunk; any
longer run of chunks is covered by them. A run is its words in order, by a 128-bit digest of two polynomial hashes, wherever the chunks
inside it end. A run that a document of smaller id holds is a repeat. Neighbouring repeats join to a span only if one earlier
document holds them side by side, in the same order; so every span stands whole in one earlier document, ``first_doc_id``. Spans
of one document overlap where different documents hold them.

One pass over the texts and one shuffle by digest. Each group of texts of ``STEP`` bytes first settles its own repeats, against
the smallest id within it, and sends one row a digest; so a passage that a third of all documents share is a row a group of
texts, not a row a document. Which of several earlier documents a span names, and so where a stretch that only several hold together
is cut, hangs on how texts are grouped; which words are repeats doesn't.

Defined cases: null or empty texts have no chunks; rows without a doc_id take no part; rows that repeat a doc_id are one
document, so that nothing in them repeats the others, and are told apart by their text's hash; white space is not compared; a text of any
length is hashed whole; ties go to the smallest id, and within a document to the first place; an empty table gives an empty result; other
columns are ignored, and pass through ``remove`` under any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, named, renamed
from .shingles import STEP, mix, word_hashes

#: One word in so many ends a chunk.
RATE = 5
MIN_WORDS = 16
#: Periods of so many words at most, held for so many words, end chunks too.
PERIOD, HELD = 12, 8
_U = np.uint64
_GEAR = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
#: Odd numbers, the bases of the two hashes of a run of words.
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03))
#: Bytes between joined texts; the hash's memory is shorter.
_GAP = b"\n" * 8


def _gear(b: np.ndarray) -> np.ndarray:
    """At every byte the gear hash of the last eight: the sum of ``G[b[i - j]] << j``, by doubling."""
    h = _GEAR[b]
    for k in (1, 2, 4):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << _U(k)
        h = h + shifted
    return h


def _closes(joined: np.ndarray, space: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the gear hash ends a chunk at each of ``ends``. Of a run of white space one space counts; the gaps stay whole."""
    kept = ~space
    kept[1:] |= ~space[:-1]
    for k in range(1, len(_GAP) + 1):
        kept[begins - k] = True
    gear = _gear(np.where(space, np.uint8(32), joined)[kept])
    return (gear[np.cumsum(kept)[ends] - 1] >> _U(24)) % _U(RATE) == 0


def _periods(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word is the least of a period in a periodic stretch of its text."""
    out, least = np.zeros(len(words), bool), words.copy()
    for p in range(1, min(PERIOD, len(words) - HELD) + 1):
        same = np.append(0, np.cumsum(words[p:] == words[:-p]))
        held = (same[HELD:] - same[:-HELD] == HELD) & (text[p + HELD - 1 :] == text[: len(text) - p - HELD + 1])
        out[p + HELD - 1 :] |= held & (words[p + HELD - 1 :] == least[p + HELD - 1 :])
        least[p:] = np.minimum(least[p:], words[:-p])
    return out


def _prefixes(words: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``word * base ** place`` before each word and at the end, and the powers that undo a place."""
    power = np.full(len(words) + 1, base, _U)
    back = np.full(len(words) + 1, _U(pow(int(base), -1, 1 << 64)), _U)
    power[0] = back[0] = 1
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * np.cumprod(power, dtype=_U)[:-1], dtype=_U, out=sums[1:])
    return sums, np.cumprod(back, dtype=_U)


def _runs(first: np.ndarray, last: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks of the words ``first .. last - 1`` the runs within a text, as pairs of chunks, that are shortest from one end."""
    k = np.arange(len(first))
    end = np.searchsorted(last, first + least)  # the chunk with which the run from k has enough words
    begin = np.searchsorted(first, last - least, "right") - 1  # from which the run to k has
    from_first = (end < len(last)) & (text[np.minimum(end, len(last) - 1)] == text)
    to_last = (begin >= 0) & (text[np.maximum(begin, 0)] == text)
    to_last &= end[np.maximum(begin, 0)] != k  # the others are there already
    return np.append(k[from_first], begin[to_last]), np.append(end[from_first], k[to_last])


def _windows(texts: list[bytes | None], least: int) -> tuple[np.ndarray, ...]:
    """Of all texts' runs: text, both hashes, start and end in code points (white space after the run left out), first word and words."""
    joined = np.frombuffer(_GAP + b"".join((t or b"") + _GAP for t in texts), np.uint8)
    begins = len(_GAP) + np.cumsum([0] + [len(t or b"") + len(_GAP) for t in texts[:-1]])
    words, starts = word_hashes(joined)
    if not len(words):
        return (np.zeros(0, np.int64),) * 7
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    ends = np.flatnonzero(space[1:] & ~space[:-1])  # the last byte of every word
    text = np.searchsorted(begins, starts, "right") - 1
    closes = _closes(joined, space, begins, ends) | _periods(words, text)
    first = np.flatnonzero(np.append(True, closes[:-1] | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(words))
    a, b = _runs(first, last, text[first], least)
    one, end = first[a], last[b]
    hashes = []
    for base in _BASES:
        sums, back = _prefixes(mix(words ^ base), base)
        hashes.append(mix((sums[end] - sums[one]) * back[one] + (end - one).astype(_U)).view(np.int64))
    point = np.append(0, np.cumsum((joined & 0xC0) != 0x80))  # code points before each byte
    owner = text[one]
    origin = point[begins[owner]]
    start_word = np.searchsorted(text, owner)  # a text's first word
    return owner, *hashes, point[starts[one]] - origin, point[ends[end - 1] + 1] - origin, one - start_word, end - one


#: Rows of runs, packed as they are most of what is shuffled: ``one`` and ``two`` are the digest; ``place`` holds the run's first code point
#: and first word, ``size`` its code points and words. ``owner`` and ``at`` are the document that holds the run and the run's first
#: word there, if the group of texts has settled that.
_ROW = "doc_id bigint, hash bigint, one bigint, two bigint, place bigint, size bigint, owner bigint, at bigint"
_LOW = 0xFFFFFFFF


def _rows(least: int):
    def settled(ids: np.ndarray, text_hash: np.ndarray, texts: list[bytes | None]) -> pa.RecordBatch:
        owner, one, two, start, end, word, n = _windows(texts, least)
        doc, h = ids[owner], text_hash[owner]
        order = np.lexsort((word, doc, two, one))
        one, two, doc, word = one[order], two[order], doc[order], word[order]
        opens = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0)) if len(one) else np.zeros(0, np.int64)
        later = doc != doc[head]
        # rows of the smallest id are all sent: each of them may be a repeat of a document elsewhere
        one[later] = mix(doc[later].view(_U) * _U(3) + word[later].view(_U)).view(np.int64)  # a settled row has any place in the shuffle
        back = np.lexsort((word, owner[order]))  # in the texts' order neighbours are alike, and so take less room
        columns = [doc, h[order], one, two, start[order] << 32 | word, ((end - start) << 32 | n)[order]]
        out = [pa.array(c[back]) for c in columns] + [pa.array(c[head][back], mask=~later[back]) for c in (doc, word)]
        return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _ROW.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = (batch.column(c).to_numpy() for c in ("doc_id", "hash"))
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or b"") <= STEP):
                    held += len(texts[end] or b"")
                    end += 1
                yield settled(ids[at:end], text_hash[at:end], texts[at:end])
                at = end

    return rows


_SPAN = ["doc_id", "hash", "start", "end", "n_words", "first_doc_id"]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each document's repeats, of which ``found`` has ``(word, size, start, owner, at)``, to spans."""
    for batch in batches:
        found = batch.column("found")
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
        word, size, start, owner, at = (x.to_numpy() for x in found.flatten().flatten())
        n, end = size & _LOW, start + (size >> 32)
        shift = at - word  # the same for all runs that the owner holds side by side
        order = np.lexsort((word + n, word, shift, owner, row))
        row, word, n, start, end, owner, shift = (x[order] for x in (row, word, n, start, end, owner, shift))
        if not len(row):
            continue
        apart = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1]) | (word[1:] > (word + n)[:-1])
        opens = np.flatnonzero(np.append(True, apart))
        closes = np.append(opens[1:], len(row)) - 1
        take = pa.array(row[opens])
        numbers = [start[opens], end[closes], (word + n)[closes] - word[opens], owner[opens]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("hash").take(take), *map(pa.array, numbers)], _SPAN)


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, hash, start, end, n_words, first_doc_id)`` of every span that an earlier document holds whole.

    Places are code points, the end exclusive; ``hash`` is the text's, which tells rows of one doc_id apart.
    """
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("hash"), "text")
    rows = source.mapInArrow(_rows(least), _ROW)
    # places are unpacked behind the shuffle, which goes by the digest's first half
    rows = rows.repartition("one").withColumns({"start": F.shiftright("place", 32), "word": F.col("place").bitwiseAND(F.lit(_LOW))})
    first = F.first(F.struct("doc_id", "word")).over(Window.partitionBy("one", "two").orderBy("doc_id", "word"))
    rows = rows.withColumn("first", first)
    at = F.when(F.col("owner").isNotNull(), F.col("at")).otherwise(F.col("first.word"))
    rows = rows.withColumns({"owner": F.coalesce("owner", "first.doc_id"), "at": at}).filter(F.col("owner") < F.col("doc_id"))
    found = rows.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("word", "size", "start", "owner", "at")).alias("found"))
    return found.mapInArrow(_spans, "doc_id bigint, hash bigint, start bigint, end bigint, n_words bigint, first_doc_id bigint")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without spans, which come in order and may overlap."""

    def left(t: str, a: np.ndarray, b: np.ndarray) -> str:
        froms = np.maximum.accumulate(np.append(0, b))
        return "".join(t[i:j] for i, j in zip(froms, np.append(a, len(t)), strict=True) if i < j)

    return pd.Series([t if a is None else left(t, a, b) for t, a, b in zip(text, starts, ends, strict=True)], dtype=object)


def remove(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated spans in their texts."""
    spans = repeated_spans(docs.select("doc_id", "text"), least).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    spans = spans.select(F.col("doc_id").alias("id"), "hash", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    plain = named(docs).select("*", F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))
    both = plain.join(spans, ["id", "hash"], "left").withColumn("text", F.when(F.col("starts").isNull(), F.col("text")).otherwise(_without("text", "starts", "ends")))
    return cut(renamed(both, docs, "text"))

"""The compression plans: files to coded blocks and back.

Block mode: blocks are cut, transformed and ranked, and the model runs through a file's blocks in order; many files go through it side by side
(``operators/lanes.py``). ``independent_blocks`` makes each block a row of its own, so that one file's blocks are coded in parallel. Stream mode codes
whole files. Files are rows of ``(file_no, content)``, dealt over all cores by number; a task takes them in chunks of bounded bytes. How a file
was coded is told by the rows themselves (``HOW``), so that decoding needs no parameters.

In block mode a block whose code would be no shorter is stored: its payload is its ranks, so payload and block have one size, which tells it. The
model learns from it all the same.

Defined cases: an empty file has no blocks; null content is as empty; files that share a number are mixed up, so numbers must differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import blocks
from ..operators import lanes
from ..operators.codec import CorruptError, codec_of
from ..operators.transforms import bwt_all, mtf, unbwt, unbwt_all, unmtf
from .parameters import Parameters

#: Columns that tell how a file was coded.
HOW = ["model", "block_mode", "independent_blocks"]
CODED = "file_no bigint, block_no int, c_size int, u_size int, bwt_primary int, flags int, payload binary"
#: Bytes that are coded side by side; a file alone may have more.
CHUNK = 16 << 20
#: Tasks a core, at most: many small ones leave few files to go side by side.
TASKS = 4


def _chunks(batches: Iterator[pa.RecordBatch], size: str, whole: str | None = None) -> Iterator[list[dict]]:
    """Rows in chunks of at least ``CHUNK`` bytes of the column ``size``; rows that agree on ``whole`` and follow each other stay together."""
    rows, total = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if total >= CHUNK and (whole is None or row[whole] != rows[-1][whole]):
                yield rows
                rows, total = [], 0
            rows.append(row)
            total += len(row[size] or b"")
    if rows:
        yield rows


def _coded(p: Parameters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, "content"):
            contents = [r["content"] or b"" for r in chunk]
            cut = [[c[i : i + p.block_size] for i in range(0, len(c), p.block_size)] if p.block_mode else [c] if c else [] for c in contents]
            moved = iter(bwt_all([b for file in cut for b in file]) if p.block_mode else [])
            primaries = [[0] * len(file) for file in cut]
            if p.block_mode:
                for file, rows_ in zip(cut, primaries, strict=True):
                    for i in range(len(file)):
                        last, rows_[i] = next(moved)
                        file[i] = mtf(last)
            out = []
            for r, file, rows_, payloads in zip(chunk, cut, primaries, lanes.encode(p.model, cut), strict=True):
                for i, (ranks, row, payload) in enumerate(zip(file, rows_, payloads, strict=True)):
                    payload = ranks if p.block_mode and len(payload) >= len(ranks) else payload
                    out.append((r["file_no"], r.get("block_no", i), len(payload), len(ranks), row, 0, payload))
            names = [c.split()[0] for c in CODED.split(", ")]
            types = [pa.int64(), *[pa.int32()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    return rows


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by key. The work per byte is so heavy that small partitions mustn't be joined."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism), *keys)


def encode_files(files: DataFrame, p: Parameters) -> DataFrame:
    """Coded blocks of ``files (file_no, content)``; an empty file has none."""
    if p.block_mode and p.independent_blocks:
        cut = _dealt(blocks(files, p.block_size, "file_no").withColumnRenamed("block", "content"), "file_no", "block_no")
    else:
        cut = _dealt(files.select("file_no", "content"), "file_no")
    return cut.mapInArrow(_coded(p), CODED)


def told(df: DataFrame, p: Parameters) -> DataFrame:
    """``df`` with the columns ``HOW``."""
    return df.withColumns({c: F.lit(getattr(p, c)) for c in HOW})


def _stored(r: dict) -> bool:
    return r["block_mode"] and len(r["payload"]) == r["u_size"]


def _decoded_plainly(file: list[dict]) -> tuple[bytes | None, str | None]:
    """A file's content, or what is wrong with its blocks."""
    codec, parts = None, []
    for expected, r in enumerate(file):
        if codec is None or r["independent_blocks"]:
            codec = codec_of(r["model"])
        try:
            if r["block_no"] != expected:
                raise CorruptError("not the next block")
            if _stored(r):
                data = r["payload"]
                codec.encode(data)  # learns it
            else:
                data = codec.decode(r["payload"], r["u_size"])
            parts.append(unbwt(unmtf(data), r["bwt_primary"]) if r["block_mode"] else data)
        except (CorruptError, ValueError, IndexError) as e:
            return None, f"block {r['block_no']}: {e}"
    return b"".join(parts), None


def _decoded_together(files: list[list[dict]]) -> list[tuple[bytes | None, str | None]]:
    """As ``_decoded_plainly``, many files side by side; those that don't come out go the plain way, for what is wrong with them."""
    out: list = [None] * len(files)
    #: of each lane its model and its blocks' places; blocks that are independent have a lane each, stored ones then none
    groups: dict[str, list[list[tuple[int, int]]]] = {}
    ranks: dict[tuple[int, int], bytes] = {}
    for i, file in enumerate(files):
        first = file[0]
        if any(r["block_no"] != k or r["u_size"] < 1 for k, r in enumerate(file)):
            continue
        if first["independent_blocks"]:
            ranks |= {(i, k): r["payload"] for k, r in enumerate(file) if _stored(r)}
            groups.setdefault(first["model"], []).extend([(i, k)] for k, r in enumerate(file) if not _stored(r))
        elif not any(map(_stored, file)):
            groups.setdefault(first["model"], []).append([(i, k) for k in range(len(file))])
    for model, lanes_ in groups.items():
        found = lanes.decode(model, [[(files[i][k]["payload"], files[i][k]["u_size"]) for i, k in lane] for lane in lanes_])
        for lane, blocks_ in zip(lanes_, found, strict=True):
            ranks |= dict(zip(lane, blocks_ or [], strict=False))
    moved = [at for at in ranks if files[at[0]][0]["block_mode"]]
    plain = ranks | dict(zip(moved, unbwt_all([(unmtf(ranks[i, k]), files[i][k]["bwt_primary"]) for i, k in moved]), strict=True))
    for i, file in enumerate(files):
        parts = [plain.get((i, k)) for k in range(len(file))]
        out[i] = _decoded_plainly(file) if None in parts else (b"".join(parts), None)
    return out


def decode_files(coded: DataFrame) -> DataFrame:
    """``(file_no, content, error)`` of coded blocks with the columns ``HOW``: the bytes, or what is wrong with them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, "payload", "file_no"):
            files: list[list[dict]] = []
            for r in chunk:
                if files and files[-1][0]["file_no"] == r["file_no"]:
                    files[-1].append(r)
                else:
                    files.append([r])
            out = _decoded_together(files)
            arrays = [pa.array([f[0]["file_no"] for f in files], pa.int64()), pa.array([c for c, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["file_no", "content", "error"])

    blocks_ = coded.select("file_no", "block_no", "u_size", "bwt_primary", "payload", *HOW)
    return _dealt(blocks_, "file_no").sortWithinPartitions("file_no", "block_no").mapInArrow(rows, "file_no bigint, content binary, error string")

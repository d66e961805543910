"""Texts as bytes: one row a byte, and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 65536


def content(text: Column) -> Column:
    """The UTF-8 bytes of a text."""
    return F.encode(text, "UTF-8")


def decoded(binary: Column, charset: str = "UTF-8") -> Column:
    """The text of bytes in one of Spark's charsets (UTF-8, UTF-16, UTF-16LE, UTF-16BE, ISO-8859-1) or a one-byte code page like ``cp866``."""
    if charset.upper().startswith(("UTF", "ISO", "US")):
        return F.decode(binary, charset)
    upper = bytes(range(128, 256))
    return F.translate(F.decode(binary, "ISO-8859-1"), upper.decode("latin-1"), upper.decode(charset))


def encoded(text: Column, charset: str = "UTF-8") -> Column:
    """The bytes of a text in such a charset. A code page has them only for its own characters."""
    if charset.upper().startswith(("UTF", "ISO", "US")):
        return F.encode(text, charset)
    upper = bytes(range(128, 256))
    return F.encode(F.translate(text, upper.decode(charset), upper.decode("latin-1")), "ISO-8859-1")


def _characters(binary: Column) -> Column:
    """Bytes as an array of one-character strings with the bytes' values as code points."""
    return F.array_remove(F.split(F.decode(binary, "ISO-8859-1"), ""), "")


def byte_characters(df: DataFrame, id_: str = "doc_id", binary: str = "content") -> DataFrame:
    """``(id, pos, c)``: every byte as a character, for grouping before ``F.ascii`` makes it a number."""
    return df.select(id_, F.posexplode(_characters(F.col(binary))).alias("pos", "c"))


def byte_rows(df: DataFrame, id_: str = "doc_id", binary: str = "content") -> DataFrame:
    """``(id, pos, b)``: every byte with its place and value 0..255."""
    return byte_characters(df, id_, binary).select(id_, "pos", F.ascii("c").alias("b"))


def blocks(df: DataFrame, size: int = BLOCK, id_: str = "doc_id", binary: str = "content") -> DataFrame:
    """``(id, block_no, block)``: the bytes in blocks of ``size``, the last one short; none for empty content."""
    n = F.octet_length(binary)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    rows = df.select(id_, binary, F.explode(numbers).alias("block_no"))
    return rows.select(id_, "block_no", F.substring(F.col(binary), F.col("block_no") * size + 1, F.lit(size)).alias("block"))

"""Archives: a catalog and coded blocks, and the operations on them, on DataFrames or on a folder.

The catalog's sizes and block counts are aggregates of the blocks, and each of its rows tells how the file was coded, so an archive
is opened without parameters. Names may repeat: extraction takes the file with the lowest number, deletion all of them. Listing reads
no payload, extraction only the chosen files' blocks, deletion recodes nothing.

In a folder an archive is a numbered version ``v<number>`` of two Parquet tables. The catalog is written last, and a version counts
once its catalog is whole; so every change is one commit, a reader keeps what it opened, and a change may replace the archive that
it reads. ``vacuum`` removes all versions but the last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ellipsis, ratio, thousands, timestamp_text
from ..plans.compress import HOW, decode_files, encode_files, told
from ..plans.parameters import Parameters


def catalog_of(files: DataFrame, coded: DataFrame, p: Parameters) -> DataFrame:
    """One row a file: its name, sizes, checksum, and how it was coded."""
    sizes = coded.groupBy("file_no").agg(F.sum("c_size").cast("bigint").alias("compressed_size"), F.count("*").cast("int").alias("block_count"))
    rows = files.select("file_no", "file_name", F.octet_length("content").cast("bigint").alias("file_size"), F.crc32("content").alias("crc32"), "modified")
    rows = rows.join(sizes, "file_no", "left").fillna({"compressed_size": 0, "block_count": 0})
    return told(rows.withColumns({"coder": F.lit(p.coder), "block_size": F.lit(p.block_size)}), p)


def listing(catalog: DataFrame) -> DataFrame:
    """The catalog as text columns."""
    text = lambda c: thousands(F.col(c))
    return catalog.select(
        "file_no", ellipsis(F.col("file_name")).alias("name"), text("file_size").alias("size"), text("compressed_size").alias("compressed"), text("block_count").alias("blocks"),
        text("block_size").alias("block_size"), "coder", "model", F.round(ratio(F.col("file_size"), F.col("compressed_size")), 2).alias("ratio"),
        timestamp_text(F.col("modified")).alias("modified"), "crc32",
    )


def block_listing(coded: DataFrame) -> DataFrame:
    """Sizes and ratio of every block."""
    return coded.select("file_no", "block_no", "c_size", "u_size", F.round(ratio(F.col("u_size"), F.col("c_size")), 2).alias("ratio"), "bwt_primary", "flags")


def chosen(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Of each of the names ``(file_name)`` the catalog's first file."""
    rows = catalog.join(names.distinct(), "file_name", "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("file_name").orderBy("file_no"))).filter("_n = 1").drop("_n")


def missing(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The names that the catalog lacks."""
    return names.distinct().join(catalog, "file_name", "left_anti")


def without(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The catalog without all files of these names; names it lacks are passed over."""
    return catalog.join(names, "file_name", "left_anti")


@dataclass(frozen=True)
class Archive:
    """A catalog and its blocks. ``file_no`` tells files apart; a file's blocks are those of its number."""

    catalog: DataFrame
    blocks: DataFrame

    @classmethod
    def of(cls, files: DataFrame, p: Parameters = Parameters()) -> Archive:
        """The archive of ``files (file_no, file_name, modified, content)``, coded when it is used."""
        coded = encode_files(files.select("file_no", "content"), p)
        return cls(catalog_of(files, coded, p), coded)

    def names(self, names: list[str]) -> DataFrame:
        return self.catalog.sparkSession.createDataFrame([(n,) for n in names], "file_name string")

    def list_files(self) -> DataFrame:
        return listing(self.catalog)

    def list_blocks(self) -> DataFrame:
        return block_listing(self.blocks)

    def unpack(self) -> DataFrame:
        """The catalog with each file's ``content``, null with an ``error``."""
        plain = decode_files(self.blocks.join(self.catalog.select("file_no", *HOW), "file_no"))
        content = F.when(F.col("block_count") == 0, F.lit(b"")).otherwise(F.col("content"))
        return self.catalog.join(plain, "file_no", "left").withColumn("content", content)

    def extract(self, names: list[str]) -> DataFrame:
        """Files by name, the first of each; a name that isn't there is an error."""
        wanted = self.names(names)
        if lacking := [r["file_name"] for r in missing(self.catalog, wanted).collect()]:  # as many as names were given
            raise FileNotFoundError(", ".join(sorted(lacking)))
        return Archive(chosen(self.catalog, wanted), self.blocks).unpack()

    def verify(self) -> DataFrame:
        """``(file_no, file_name, ok, error)``: whether each file decodes to its checksum."""
        rows = self.unpack()
        ok: Column = F.coalesce(F.crc32("content") == F.col("crc32"), F.lit(False))
        return rows.select("file_no", "file_name", ok.alias("ok"), "error")

    def delete(self, names: list[str]) -> Archive:
        """The archive without the named files; names that it lacks are passed over, and payloads stay as they are."""
        left = without(self.catalog, self.names(names))
        return Archive(left, self.blocks.join(left.select("file_no"), "file_no", "left_semi"))

    def delete_one(self, name: str) -> Archive:
        """As ``delete``, but a name that isn't there is an error."""
        if self.catalog.filter(F.col("file_name") == name).isEmpty():
            raise FileNotFoundError(name)
        return self.delete([name])


class ArchiveFolder:
    """Archives in a folder: the last whole version, and changes to it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[int]:
        """Numbers of all versions, whole or not."""
        root = self._path(self.path)
        found = [s.getPath().getName() for s in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(int(n[1:]) for n in found if re.fullmatch(r"v[0-9]+", n))

    def _whole(self) -> list[int]:
        return [n for n in self._versions() if self._files.exists(self._path(f"{self.path}/v{n}/catalog/_SUCCESS"))]

    def open(self) -> Archive:
        """The archive as it is now; FileNotFoundError if there is none."""
        if not (whole := self._whole()):
            raise FileNotFoundError(self.path)
        at = f"{self.path}/v{whole[-1]}"
        return Archive(self.spark.read.parquet(f"{at}/catalog"), self.spark.read.parquet(f"{at}/blocks"))

    def _commit(self, blocks: DataFrame, catalog) -> Archive:
        at = f"{self.path}/v{max(self._versions(), default=0) + 1}"
        blocks.write.parquet(f"{at}/blocks")
        catalog(self.spark.read.parquet(f"{at}/blocks")).write.parquet(f"{at}/catalog")
        return self.open()

    def pack(self, files: DataFrame, p: Parameters = Parameters()) -> Archive:
        """Code ``files (file_no, file_name, modified, content)`` into the next version. The catalog's sums come from the blocks as written."""
        return self._commit(encode_files(files.select("file_no", "content"), p), lambda blocks: catalog_of(files, blocks, p))

    def write(self, archive: Archive) -> Archive:
        """Make ``archive`` the next version, for instance what ``delete`` left of this one."""
        return self._commit(archive.blocks, lambda _: archive.catalog)

    def vacuum(self) -> None:
        """Remove all versions before the last whole one."""
        for n in self._versions():
            if n < max(self._whole(), default=0):
                self._files.delete(self._path(f"{self.path}/v{n}"), True)

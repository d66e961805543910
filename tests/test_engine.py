"""Queries against their SQL, archives end to end, edge cases."""

import datetime
import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__
from bytewright import queries as engine
from bytewright.functions import scalars as S
from bytewright.operators import codec
from bytewright.operators import statistics as M
from bytewright.operators import transforms as T
from bytewright.operators.codec import Adaptive, Fixed
from bytewright.plans.parameters import Parameters
from bytewright.sources.archive import Archive, ArchiveFolder
from bytewright.sources.files import scan_files, table_files
from bytewright.streaming.histogram import windowed_histogram

DATA = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(tuple(tuple(x) if hasattr(x, "__iter__") and not isinstance(x, str) else x for x in r) for r in plain)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(engine.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(engine.ORACLES[name]).fetchdf())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


def sequential_mixed(data):
    """The mixed estimate symbol by symbol, with tables that halve."""
    tables, bits = {}, 0.0
    for i, s in enumerate(data):
        cost = None
        for order in (3, 2, 1, 0):
            key = (order, bytes(max(0, order - i)) + data[max(0, i - order) : i])
            t = tables.setdefault(key, [1] * 256 if order == 0 else [0] * 256)
            if cost is None and t[s]:
                cost = math.log2(sum(t) / t[s])
        for order in range(4):
            t = tables[(order, bytes(max(0, order - i)) + data[max(0, i - order) : i])]
            t[s] += 1
            if sum(t) > M.MAX_FREQ:
                t[:] = [w - (w >> 1) for w in t]
        bits += cost
    return bits


def test_halving(spark, monkeypatch):
    """Documents whose tables are halved many times, against the sequential models. A low limit makes them short."""
    rng = random.Random(3)
    monkeypatch.setattr(M, "MAX_FREQ", 600)
    monkeypatch.setattr(codec, "MAX_FREQ", 600)
    data = [bytes(rng.choices(range(97, 101), [8, 4, 2, 1], k=n)) for n in (0, 344, 345, 346, 900, 4000)] + [b"a" * 2000, b"ab" * 1500]
    frame = pa.record_batch([pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], ["doc_id", "content"])

    class Local:
        """Stands for a DataFrame, so that the limits set above hold where the batches are counted."""

        def mapInArrow(self, rows, schema):
            return pa.Table.from_batches(list(rows(iter([frame])))).to_pylist()

    for order in range(4):
        got = {r["doc_id"]: r["bits"] for r in M.adaptive_bits(Local(), order)}
        for i, d in enumerate(data):
            m = Adaptive(order)
            assert got.get(i, 0) == pytest.approx(sum(m.cost(s) for s in d))
    got = {r["doc_id"]: r["bits"] for r in M.mixed_bits(Local())}
    assert all(got.get(i, 0) == pytest.approx(sequential_mixed(d)) for i, d in enumerate(data))
    assert {r["doc_id"]: r["bits"] for r in M.fixed_bits(Local())}[5] == pytest.approx(sum(math.log2(sum(w) / w[s]) for w in [Fixed.of(data[5]).w] for s in data[5]))


def test_halving_of_long_text(spark):
    data = b"ab" * 80_000
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    for order in (0, 1):
        m = Adaptive(order)
        assert M.adaptive_bits(df, order).first()["bits"] == pytest.approx(sum(m.cost(s) for s in data))


def test_rescale_halves_at_equality():
    assert M.rescaled(np.array([3, 5]), 8).tolist() == [2, 3]


def test_small_steps_count_alike(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content")).limit(30)
    whole = rows(M.context_counts(df, 2).toPandas())
    monkeypatch.setattr(M, "STEP", 5000)
    assert rows(M.context_counts(df, 2).toPandas()) == whole


def test_rank_histogram(spark):
    from collections import Counter

    from bytewright.operators import transforms

    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        for at in range(0, len(data), 65536):
            want[r["doc_id"]] = want.get(r["doc_id"], Counter()) + Counter(transforms.mtf(transforms.bwt(data[at : at + 65536])[0]))
    got = {}
    for r in engine.QUERIES["bwt_mtf_histogram"](spark, DATA).collect():
        got.setdefault(r["doc_id"], Counter())[r["rank"]] = r["cnt"]
    assert got == want


@pytest.mark.parametrize("p", [Parameters(block_size=1000), Parameters(model="O1", block_mode=False), Parameters(independent_blocks=True, block_size=1000), Parameters(model="O0FIX", block_mode=False)])
def test_archive(spark, tmp_path, p):
    """Every archive is opened again without its parameters, and changed where it stands."""
    texts = [(0, "a" * 2500), (1, ""), (2, "é x"), (3, "b" * 1000)]
    files = table_files(spark.createDataFrame(texts, "id long, text string"), "id", "text", "f").withColumn("file_name", F.when(F.col("file_no") == 3, "f0.txt").otherwise(F.col("file_name")))
    folder = ArchiveFolder(spark, f"{tmp_path}/a")
    with pytest.raises(FileNotFoundError):
        folder.open()
    folder.pack(files, p)
    a = ArchiveFolder(spark, f"{tmp_path}/a").open()
    assert {r["file_no"]: bytes(r["content"]).decode() for r in a.unpack().collect()} == dict(texts)
    assert all(r["ok"] for r in a.verify().collect())
    assert {r["file_no"]: r["crc32"] for r in a.catalog.collect()} == {i: zlib.crc32(t.encode()) for i, t in texts}
    assert {r["file_no"]: r["block_count"] for r in a.catalog.collect()} == ({0: 3, 1: 0, 2: 1, 3: 1} if p.block_mode else {0: 1, 1: 0, 2: 1, 3: 1})
    assert {r["file_no"]: r["compressed_size"] for r in a.catalog.collect()} == {1: 0} | {r["file_no"]: r["n"] for r in a.blocks.groupBy("file_no").agg(F.sum(F.octet_length("payload")).alias("n")).collect()}
    assert [(r["file_no"], bytes(r["content"])) for r in a.extract(["f0.txt"]).collect()] == [(0, b"a" * 2500)]
    with pytest.raises(FileNotFoundError):
        a.extract(["f0.txt", "none"])
    with pytest.raises(FileNotFoundError):
        a.delete_one("none")
    folder.write(a.delete(["f0.txt", "none"]))
    b = folder.open()
    assert sorted(r["file_no"] for r in b.list_files().collect()) == [1, 2] and b.list_blocks().count() == 1
    assert a.list_files().count() == 4  # what was opened before stays
    (tmp_path / "a" / "v3" / "blocks").mkdir(parents=True)  # a pack that died
    assert folder.open().list_files().count() == 2
    folder.write(folder.open().delete_one("f2.txt"))
    folder.vacuum()
    assert sorted(x.name for x in (tmp_path / "a").iterdir()) == ["v4"] and [r["file_no"] for r in folder.open().unpack().collect()] == [1]


def test_corrupt_block_is_reported(spark):
    files = table_files(spark.createDataFrame([(0, "some text to spoil " * 20)], "id long, text string"), "id", "text", "f")
    a = Archive.of(files)
    row = Archive(a.catalog, a.blocks.withColumn("payload", F.substring("payload", 1, 9))).verify().first()
    assert not row["ok"] and "block 0" in row["error"]
    files = table_files(spark.createDataFrame([(0, "x y z " * 900)], "id long, text string"), "id", "text", "f")
    a = Archive.of(files, Parameters(block_size=1000))
    row = Archive(a.catalog, a.blocks.filter("block_no != 2")).verify().first()
    assert not row["ok"] and "not the next block" in row["error"]


def test_scan_files(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "a.txt").write_bytes(b"hi")
    got = scan_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.bin")]).orderBy("file_no").collect()
    assert [(r["file_no"], r["file_name"], bytes(r["content"])) for r in got] == [(0, "a.txt", b"hi"), (1, "b.bin", b"\x00\xff")]
    again = scan_files(spark, [str(tmp_path / n) for n in ("b.bin", "a.txt", "b.bin")]).orderBy("file_no").collect()
    assert [(r["file_no"], r["file_name"]) for r in again] == [(0, "b.bin"), (1, "a.txt"), (2, "b.bin")]
    with pytest.raises(ValueError):
        scan_files(spark, [])
    with pytest.raises(AnalysisException):
        scan_files(spark, [str(tmp_path / "none")])


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(S.split_prefixes(F.lit("a;b;;c"), ";")) == ["a", "a;b", "a;b;", "a;b;;c"]
    assert value(S.delete_list(F.lit("a\x00b\x00\x00c"))) == ["a", "b"]
    assert value(S.parse_size(F.lit("x"))) is None
    assert value(S.parse_model(F.lit(" o3mix "))) == 8
    assert value(S.ratio(F.lit(1), F.lit(0))) is None
    assert value(S.symbol_bits(F.lit(5))) == [False] * 5 + [True, False, True]
    with pytest.raises(Exception, match="unknown coder"):
        value(S.parse_coder(F.lit("zip")))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, content binary")
    for df in (M.histogram(none), M.entropy(none), M.adaptive_bits(none, 2), M.fixed_bits(none), M.mixed_bits(none)):
        assert df.count() == 0


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "aab"), (t, "b")], "ts timestamp, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    q = windowed_histogram(stream, "ts", "text").writeStream.outputMode("complete").format("memory").queryName("bytes_by_window").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["b"], r["cnt"]) for r in spark.table("bytes_by_window").collect()} == {(97, 2), (98, 2)}


def test_plan_of_a_huge_total_is_short(spark):
    """a plan's size doesn't grow with the number of its parts."""
    n = F.col("id")
    got = spark.createDataFrame([(t,) for t in (0, 2, 999, 1000, 5432, 10**15 + 5)], "id long").select(n, S.plan_runs(n, 1000, 3).alias("p")).collect()
    assert all(sum(r["size"] * r["parts"] for r in row["p"]) == row["id"] and len(row["p"]) <= 3 for row in got)
    assert sum(r["parts"] for r in got[-1]["p"]) == 10**12 + 1 + 3
    parts = spark.range(5432, 5433).select(S.plan_parts(n, 1000, 3).alias("p")).first()["p"]
    assert [tuple(x) for x in parts] == [*((i * 1000, 1000) for i in range(5)), (5000, 144), (5144, 144), (5288, 144)]


@pytest.mark.parametrize("name", ["fixed_model_bits", "order0_estimate", "adaptive_bits_o0", "adaptive_bits_o1", "mixed_model_bits"])
def test_long_text_equals_sql(spark, tmp_path, name):
    """texts beyond 65,281 bytes, whose tables the coder halves and SQL doesn't."""
    spark.createDataFrame([(1, "a" * 70_000 + "b" * 20_000), (2, "short"), (3, "ab" * 40_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(engine.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.execute(engine.ORACLES[name]).fetchdf())


def test_transforms_take_bounded_slices(monkeypatch):
    """a batch of many blocks isn't held in Python as a whole."""
    blocks = [bytes([i]) * 1000 for i in range(100)]
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array(blocks, pa.binary())], ["doc_id", "block"])
    monkeypatch.setattr(T, "SLICE", 10_000)

    class Local:
        """Stands for a DataFrame."""

        schema = StructType().add("doc_id", "long").add("block", "binary")

        class sparkSession:
            createDataFrame = staticmethod(lambda rows, schema: type("Frame", (), {"schema": StructType().add("ranks", "binary").add("bwt_primary", "integer")}))

        def mapInArrow(self, rows, schema):
            self.out = list(rows(iter([batch])))
            return self

        def drop(self, *names):
            return self.out

    out = T.ranked_blocks(Local())
    assert [b.num_rows for b in out] == [10] * 10
    assert [r["bwt_primary"] for b in out for r in b.to_pylist()] == [1000] * 100


@pytest.mark.parametrize("p", [Parameters(model="O1", block_size=4096), Parameters(model="O1", block_size=4096, independent_blocks=True)])
def test_no_block_grows(spark, p):
    """a short last block of symbols that the model thinks rare is stored, and what follows still decodes."""
    texts = [(0, "a" * 40_960 + "q7~"), (1, "z"), (2, "ab" * 5000), (3, "a" * 8192 + "q")]
    a = Archive.of(table_files(spark.createDataFrame(texts, "id long, text string"), "id", "text", "f"), p)
    assert all(r["c_size"] <= r["u_size"] for r in a.blocks.collect())
    assert {r["file_no"]: bytes(r["content"]).decode() for r in a.unpack().collect()} == dict(texts)

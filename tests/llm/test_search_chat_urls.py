"""Exact search, chat formatting and URL filters against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytewright.llm import chat, topk, urls


def brute_top(rows, k=10):
    rows = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in rows}
    out = []
    for q in rows:
        if q % 100 == 0:
            best = sorted(((int(rows[q] @ v), -i) for i, v in rows.items() if i != q), reverse=True)[:k]
            out += [(q, n + 1, -i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "few", "zero"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(1)
    n = 4 if kind == "few" else 1500
    x = rng.normal(size=(n, 24)) * rng.exponential(size=(n, 1))
    if kind == "copies":
        x[::3] = x[0]
    if kind == "zero":
        x[:] = 0
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [1.0, None]), (5200, [float("nan")]), (5300, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    got = topk.exact_top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)


@pytest.mark.parametrize("strip", [100, 7])
def test_many_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(topk, "STRIP", strip)
    monkeypatch.setattr(topk, "SEEDS", 5)
    monkeypatch.setattr(topk, "HEAD", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) * rng.exponential(size=(400, 1))
    x[50:60] = 0
    rows = [(i * 10, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)


@pytest.mark.parametrize("size", [1e30, 1e10])
def test_too_large(spark, size):
    """A component, or a score, beyond 64 bits is an error; large ones within are exact."""
    df = spark.createDataFrame([(0, [size, size]), (1, [size, size])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond 64 bits|int too large|out of bounds"):
        topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [float(2**21), 3.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(rows)


def test_top_k_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    got = topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2048 * 1024)]


CONTROL = st.lists(st.sampled_from([*chat.CONTROLS, chat.TURN, chat.END, chat.MORE, chat.TEXT, "\\", "<", "|", ">", "[", "ok", "\n", "é", "漢", "😀"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "", "<|end|>"]), CONTROL), max_size=12))
def test_chat_reads_back(spark, turns):
    rows = [(c % 2, t, r, x, "z") for c, (t, r, x) in enumerate(turns)] + [(9, None, None, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversation(spark):
    df = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s>"), F.repeat(F.lit("é"), 100)).alias("text"))
    out = chat.format_conversations(df)
    row = out.first()
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["<\\s>" + "é" * 100] * 3000
    got = chat.digest(out).first()
    assert got["n_turns"] == 6000 and got["loss_sha256"] == hashlib.sha256(("<s>" + "é" * 100).encode() * 3000).hexdigest()


def test_chat_escapes_and_merges(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|end|>[INST]"), (1, 1, "user", "b"), (1, 2, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    text = chat.format_conversations(df).first()["formatted"]
    assert text == "<|turn|>user<|text|><\\|end|\\>[\\INST]<|more|>b<|end|><|turn|>assistant<|text|><\\/s><|end|>"
    assert chat.format_conversations(df.filter("false")).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("example.com/en/", "", "", None, "allow"),
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.net?u=http://y/es/", "x.net", "", None, "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://porn.org/", "porn.org", "/", None, "block"),
        ("http://pornographer.org/", "pornographer.org", "/", None, "allow"),
        ("http://cheap-pills.org", "cheap-pills.org", "", None, "block"),
        ("http://cheap-cheap.org", "cheap-cheap.org", "", None, "allow"),
        ("http://FREE.win.org", "free.win.org", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "z")], "page_id long, url string, rule string")
    r = urls.judge(df, RULES).first()["judged"]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_vocabulary(spark, monkeypatch):
    rows = [("Bad", None), ("bad", 2), ("mild", 1), ("MILD", 2), ("other", 1), ("", 3), (None, 1), ("grim", 0)]
    terms = spark.createDataFrame(rows, "term string, weight int")
    strict, soft = urls.vocabulary(terms)
    assert strict == ("bad", "grim") and soft == {"mild": 2, "other": 1}
    pages = spark.createDataFrame([("http://x.org/bad",), ("http://x.org/mild-other",), ("http://x.org/mild",), ("http://x.org/casino",)], "url string")
    assert [r["verdict"] for r in urls.judge(pages, [], strict, soft).select("judged.verdict").collect()] == ["block", "block", "allow", "allow"]
    assert urls.judge(pages, [], (), {}).filter("judged.verdict = 'allow'").count() == 4
    with pytest.raises(ValueError):
        urls.judge(pages, RULES, into="URL")
    monkeypatch.setattr(urls, "TERMS", 2)
    with pytest.raises(ValueError):
        urls.vocabulary(terms)


def test_urls_of_nothing(spark):
    long = spark.createDataFrame([("http://x.org/" + "farm-" * 100_000,), ("casino" * 100_000,)], "url string")
    assert [r["judged"]["verdict"] for r in urls.judge(long, RULES).collect()] == ["allow", "allow"]
    assert urls.judge(spark.createDataFrame([], "url string"), RULES).count() == 0

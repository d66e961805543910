"""Quality rules, line dedup and secret scans against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bytewright.llm import line_dedup, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\x0dq", "a b\na b\n\na b", "é ü ß 漢 #$ 1 A.", "w " * 400, "a b c d " * 3 + "e a b c", "\x1c  x"]


def test_base_counts(docs):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200))) for _ in range(20)]
    df = docs(*enumerate(texts), (0, None))
    got = quality.features(df, "q").select("doc_id", "q.*").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert sum(r["classes"]) == len(texts[r["doc_id"]] or "")


def test_js_distance(spark):
    import math

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def prose(rng, n=300):
    return " ".join(rng.choice(["the", "of", "and", "to", "in", "house", "water", "green", "walking", "thinker", "tables", "often"]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def labels(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_keeps_prose_and_rejects_junk(spark, docs):
    rng = random.Random(1)
    good = [(i, prose(rng)) for i in range(30)]
    bad = [(100 + i, " ".join(f"{rng.randrange(10**9)}$$" for _ in range(300))) for i in range(90)] + [(99, " ".join("QWZX%s!!" % rng.randrange(999) for _ in range(300)))]
    told = labels(spark, *((i, 1, 0) for i in range(20)), (3, 1, 0), (None, 1, 0), (40, None, None), (100, 0, 0), (777, 1, 1))
    kept = quality.keep_good(docs(*good, *bad), told)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    assert kept.columns == docs((1, "")).columns
    assert quality.labelled(docs(*good), told, 5).count() == 5


def test_quality_of_nothing(spark, docs):
    none = labels(spark).filter("false")
    assert quality.keep_good(docs((1, "x")).filter("false"), none).count() == 0
    assert quality.keep_good(docs((1, None), (2, "")), labels(spark, (1, 1, 0))).count() == 0
    assert quality.keep_good(docs((1, "w%d " * 60)), none).count() == 0 and quality.keep_good(docs((1, " ".join(map(str, range(60))))), none).count() == 1


def test_quality_equals_sql(spark, docs):
    """Odd texts, null and unknown languages, repeated rows and ids, judged by the SQL as well."""
    import duckdb

    rng = random.Random(21)
    texts = TEXTS + [prose(rng, rng.randrange(40, 400)) for _ in range(40)] + [" ".join(rng.choice(["Der", "UND", "für", "FÜR", "x1", "$", "maß"]) for _ in range(rng.randrange(40, 120))) for _ in range(20)]
    df = docs(*enumerate(texts), (0, None), (20, prose(rng))).withColumn("lang", F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("xx"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")))
    told = labels(spark, *((i, i % 3 and 1, 0) for i in range(0, len(texts), 2)))
    got = quality.judge(df, quality.references(df, told), "q").select("doc_id", "q.*").withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    c.register("labels", told.toPandas())
    assert table_rows(got.toPandas()) == table_rows(c.execute(quality.SQL).fetchdf())


def brute_lines(rows, span=line_dedup.WINDOW):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        full = [i for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        lines = text.split("\n")
        gone = set()
        for p in range(len(full) - span + 1):
            key = tuple(lines[i] for i in full[p : p + span])
            if seen.setdefault(key, (doc, p)) != (doc, p):
                gone |= set(full[p : p + span])
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_runs(docs):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "", " ", "e"]) for _ in range(rng.randrange(30)))) for i in range(40)]
    block = "one line\ntwo line\n\nthree line\nfour line"
    rows += [(50, f"x\n{block}\ny"), (51, f"{block}\nz"), (52, f"z\n{block}"), (53, "two line\nthree line"), (54, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(*rows), None).collect()}
    assert got == brute_lines(rows)
    assert got[51] == "\nz" and got[53] == "two line\nthree line"


def brute_long_lines(rows, words):
    """Later repeats of runs of three lines, and of runs of one or two with so many words."""
    gone = {doc: set() for doc, _ in rows}
    for size in (1, 2, 3):
        seen = {}
        for doc, text in sorted(rows):
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if WORD.search(x)]
            for p in range(len(full) - size + 1):
                key = tuple(lines[i] for i in full[p : p + size])
                if (size == 3 or sum(len(WORD.findall(x)) for x in key) >= words) and seen.setdefault(key, (doc, p)) != (doc, p):
                    gone[doc] |= set(full[p : p + size])
    left = {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc]) for doc, text in rows}
    return {doc: text for doc, text in left.items() if not gone[doc] or WORD.search(text)}


def test_long_lines(spark, docs):
    import corpus_pipeline

    rng = random.Random(9)
    lines = ["", " ", "a", "b", *(" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate([20, 25, 25, 30, 49, 50, 60]))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(60)]
    long, half, rest = (" ".join(f"{c}{j}" for j in range(n)) for c, n in (("p", 60), ("q", 25), ("r", 25)))
    rows += [(100, f"one\n{long}\ntwo"), (101, f"three\n{long}\nfour"), (102, f"five\n{half}\n\n{rest}"), (103, f"{half}\n{rest}\nsix"), (104, long), (105, half)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_runs(spark, docs(*rows), "").collect()}
    assert got == brute_long_lines(rows, line_dedup.LONG)
    assert got[101] == "three\nfour" and got[103] == "six" and 104 not in got and got[105] == half


def test_line_edges(docs):
    df = docs((1, None), (2, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (2, "q\na\nb\nc"), (None, "a\nb\nc\nz"), (None, "long\n" * 3000))
    out = line_dedup.dedup_lines(df).collect()
    assert len(out) == 6
    assert sorted((r["text"] or "-") for r in out if r["doc_id"] == 1) == ["-"]
    assert line_dedup.dedup_lines(df.filter("false")).count() == 0


def test_hot_lines_and_clashing_columns(docs, monkeypatch):
    from bytewright.llm import common

    rng = random.Random(19)
    rows = [(i, "\n".join(["hot", "hotter", "hottest"] if rng.random() < 0.4 else [rng.choice("abcde") for _ in range(rng.randrange(6))])) for i in range(300)]
    df = docs(*rows).withColumns({"_gone": F.lit(1), "a.b": F.lit(2), "n_removed": F.lit(3), "hash": F.lit(4), "c1": F.lit(5), "gone": F.lit(6)})
    for heavy in (1, 20, 2000):
        monkeypatch.setattr(common, "HEAVY", heavy)
        out = line_dedup.dedup_lines(df, None)
        assert out.columns == [*df.columns, "n_removed_"]
        assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)


def test_selected_lines(spark):
    """Every window selects one line, the last of the least, and only selected lines are rows."""
    rng = random.Random(20)
    text = "\n".join(rng.choice("abcdefgh") for _ in range(400))
    rows = spark.range(1).select(F.inline(line_dedup._places(F.lit(text), None))).collect()
    h = [r["h"] for r in spark.createDataFrame([(c,) for c in text.split("\n")], "c string").select(F.xxhash64("c").alias("h")).collect()]
    got = {w["p"]: r["fingerprint"] for r in rows for w in r["windows"]}
    assert sorted(got) == list(range(398)) and all(got[q] == min(h[q : q + 3]) for q in got)
    assert len(rows) < 300


PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= n)
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found]


def test_secrets(docs):
    rng = random.Random(4)
    parts = ["token=", "secret=token", "PassWord : 'abc123.x'", "api_key=\"zz\"", "apikey=abcdef", "AKIA" + "Q7" * 8, "AKIAAKIA" + "B" * 11, "0123abcdef" * 3, "ab" * 11, "é", " ", "\n", "x", ": ", "Hello", "AKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(150)] + [None, "", "deadbeef" * 3 + " " * 5000 + "token: abcdef", "token=abcdef " * 700]
    got = {r["doc_id"]: r for r in secrets.digest(docs(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k, *_ in PATTERNS] == [sum(x.startswith(k) for x in want) for k, *_ in PATTERNS]
        assert set(want) <= set(got[i]["spans"].split(","))
    assert secrets.digest(docs((1, "")).filter("false")).count() == 0


def table_rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).values.tolist()))


def test_entropy(spark, docs):
    import math
    from collections import Counter

    import duckdb

    rng = random.Random(6)
    s = "".join(rng.choice("abcdXYZ0189+/") for _ in range(60))
    best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(41))
    assert spark.range(1).select(secrets.window_entropy(F.lit(s)).alias("h")).first()["h"] == pytest.approx(best)
    key = "q7Zp2LxV9mKc4Rt8WbYs3NfD6hJg"
    letters = "qHZpeLxVbmKcdRtyWbYsINfDuhJg"
    rows = [(1, f"see {key} here"), (2, "123e4567-e89b-12d3-a456-426614174000"), (3, "x" * 40 + "1"), (4, "a-long-path/with-words/and-more-2"), (5, f"token={key}")]
    rows += [(6, f"example/{key}"), (7, f"example{key}"), (8, letters), (9, "getElementsByTagNameAndClassName"), (10, "a" * 19 + "1"), (10, key), (11, None)]
    got = sorted((r["doc_id"], r["spans"]) for r in secrets.digest(docs(*rows)).collect())
    want = {1: f"entropy:4:{4 + len(key)}", 5: f"assign:0:{6 + len(key)}", 6: f"entropy:0:{8 + len(key)}", 8: f"entropy:0:{len(letters)}"}
    assert got == sorted([*((i, want.get(i, "")) for i, _ in rows if i != 10), (10, ""), (10, f"entropy:0:{len(key)}")])

    # the SQL takes the entropy of every window anew
    symbols = ["abc", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEF0123456789", "aZ9bY8cX7dW6/+=_-", "word/", "Word", "-", "aaaaaaa", " ", "é", "\n", "token: ", "AKIA"]
    more = [(100 + i, "".join("".join(rng.choice(c) for _ in range(rng.randrange(1, 30))) if len(c := rng.choice(symbols)) > 4 else c for _ in range(rng.randrange(12)))) for i in range(300)]
    df = docs(*more, *rows[:9]).select("doc_id", "text")
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert table_rows(secrets.digest(df).toPandas()) == table_rows(c.execute(secrets.SQL).fetchdf())
    assert c.execute("select count(*) from documents d, (" + secrets.SQL + ") s where d.doc_id = s.doc_id and spans like '%entropy%'").fetchone()[0] > 20


@pytest.mark.parametrize(("text", "spans"), [("a1-" * 350_000, 0), ("token=abcdef " * 20_000, 20_000), ("zb1" * 20_000, 0), ("base64", 1)])
def test_long_candidates(docs, text, spans):
    """Nothing recurses by length, and the work is linear."""
    rng = random.Random(8)
    if text == "base64":
        text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    row = secrets.digest(docs((1, text))).first()
    assert len([x for x in row["spans"].split(",") if x]) == spans

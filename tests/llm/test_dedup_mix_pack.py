"""Near-duplicates, chunks, mixing, packing and the pipeline against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from bytewright.llm import chunks, components, minhash, mixing, packing, shingles
from bytewright.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, percent=80):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t, width))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed=1):
    """Groups of near copies of all degrees, exact copies, short and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for size in (1, 1, 2, 5, 60):
        text = [rng.choice(words) for _ in range(rng.choice([30, 90, 200]))]
        for _ in range(size):
            copy = list(text)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [rows[-1]] * 5 + [rows[0].upper(), rows[0].replace(" ", "\n\t ")] + ["", None, " ", "a", "A", "a b c", "a b c d", "é É", "é é"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("width", "left"), [(4, 256), (5, 4)])
def test_near_duplicates(docs, monkeypatch, width, left):
    monkeypatch.setattr(minhash, "LEFT", left)
    monkeypatch.setattr(minhash, "RIGHT", 4 * left)
    rows = near_rows() + [(7, None), (7, "x y z u v w")]
    got = minhash.near_duplicates(docs(*rows), width).collect()
    want = brute_components(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] in {len(shingle_set(t, width)) for i, t in rows if i == r["doc_id"]}


def test_near_duplicate_edges(docs):
    got = minhash.near_duplicates(docs((None, "a b c d e f"), (3, "a b c d e f"), (None, None)))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got.collect()) == [(0, 0, True), (0, 3, False), (3, 3, True)]
    assert minhash.near_duplicates(docs((1, "x")).filter("false")).count() == 0
    kept = minhash.keep_one(docs(*near_rows()))
    want = brute_components(near_rows(), 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_posterior_bounds_hardly_lose_a_pair():
    from math import comb

    for n, m in minhash.least_matches(80):
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-5


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(200) if find(i) != i}


def test_long_texts_hash_as_short_ones(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40))) for _ in range(50)).encode() for _ in range(4)] + [b"x" * 900 + b" y", b"", None, b"x" * 900]
    whole = [s.tolist() for t in texts for _, s, _ in shingles.shingle_sets([t], 3)]
    monkeypatch.setattr(shingles, "STEP", 128)
    parts = [s.tolist() for t in texts for _, s, _ in shingles.shingle_sets([t], 3)]
    assert [len(x) for x in whole] == [len(x) for x in parts] == [len(shingle_set(t.decode() if t else None, 3)) for t in texts]
    assert whole[:4] == parts[:4]


def brute_chunk_ends(words):
    """Places behind the last word of every chunk, by the rule's own words."""
    joined, ends = b" " * 8, []
    for i, w in enumerate(words):
        joined += w.encode()
        gear = sum(int(chunks._GEAR[joined[-1 - j]]) << j for j in range(8)) % (1 << 64)
        periods = [p for p in range(1, chunks.PERIOD + 1) if i - p - chunks.HELD + 1 >= 0 and all(words[i - k] == words[i - k - p] for k in range(chunks.HELD))]
        h = lambda k: int(shingles.word_hashes(np.frombuffer(words[k].encode(), np.uint8))[0][0])
        if (gear >> 24) % chunks.RATE == 0 or any(h(i) == min(h(k) for k in range(i - p + 1, i + 1)) for p in periods) or i + 1 == len(words):
            ends.append(i + 1)
        joined += b" "
    return ends


def brute_repeats(rows, least):
    """By row the words that a run of chunks covers whose words, as a run, a document of smaller id holds."""
    held, runs = defaultdict(set), []
    for i, text in rows:
        words = WORD.findall(text or "") if i is not None else []
        ends = brute_chunk_ends(words)
        opens = [0, *ends[:-1]]
        mine = set()
        for a in opens:
            mine |= {(a, b) for b in ends if b - a >= least and (all(e - a < least for e in ends if e < b) or all(b - o < least for o in opens if o > a))}
        runs.append([(a, b, tuple(words[a:b])) for a, b in mine])
        for *_, w in runs[-1]:
            held[w].add(i)
    return [{k for a, b, w in mine for k in range(a, b) if min(held[w]) < i} for (i, _), mine in zip(rows, runs, strict=True)]


@pytest.mark.parametrize("step", [1 << 20, 600])
def test_chunk_spans(docs, monkeypatch, step):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [fill(60) for _ in range(12)]
    rows = [(i, f"{fill(rng.randrange(40))} {p}\n{fill(30)} é {fill(9)}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{fill(rng.randrange(50))}  {p} {fill(rng.randrange(60))}") for i, p in enumerate(passages)]
    parts = [passages[i].split()[j : j + 25] for i in range(6) for j in (0, 30)]
    rows += [(150 + i, " ".join(sum(rng.sample(parts, 4), []))) for i in range(20)]  # neighbours from several documents
    rows += [(200 + i, fill(100)) for i in range(8)] + [(300, rows[0][1]), (300, rows[0][1]), (300, fill(20) + " " + rows[3][1]), (None, rows[1][1]), (301, None), (302, "")]
    rows += [(400, "x y z " * 40), (401, "w " + "y z x " * 50), (402, "\n".join(passages[0].split()) + "\x0b" + passages[1].replace(" ", "\t \n"))]
    monkeypatch.setattr(chunks, "STEP", step)
    spans = chunks.repeated_spans(docs(*rows), 16).collect()
    want = brute_repeats(rows, 16)
    got = defaultdict(set)
    for s in spans:
        here = [t for i, t in rows if i == s["doc_id"] and t and places(t, s)]
        assert here and s["end"] > s["start"]
        for t in here:
            part = t[s["start"] : s["end"]]
            assert len(WORD.findall(part)) == s["n_words"] >= 16 and s["first_doc_id"] < s["doc_id"]
            first = [WORD.findall(x) for i, x in rows if i == s["first_doc_id"]]
            assert any(WORD.findall(part) == f[k : k + s["n_words"]] for f in first for k in range(len(f)))
            got[(s["doc_id"], t)] |= places(t, s)
    for (i, t), covered in zip(rows, want, strict=True):
        assert got[(i, t)] == covered, i
    assert all(len(got[rows[12 + k]]) > 30 for k in range(12)) and not any(got[(200 + i, t)] for i, t in enumerate([t for i, t in rows if 200 <= (i or 0) < 300]))


def places(text, span):
    """The numbers of the words of a span, if it lies between words of this text."""
    found = list(WORD.finditer(text))
    starts, ends = {m.start(): k for k, m in enumerate(found)}, {m.end(): k for k, m in enumerate(found)}
    if span["start"] not in starts or span["end"] not in ends or ends[span["end"]] - starts[span["start"]] + 1 != span["n_words"]:
        return set()
    return set(range(starts[span["start"]], ends[span["end"]] + 1))


def test_chunk_removal(docs):
    rng = random.Random(15)
    fill = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    p, q = fill(60), fill(60)
    rows = [(1, p), (2, q), (3, f"é {p} x"), (3, f"{fill(9)} {q}"), (4, f"{p} {q}"), (5, None), (None, p), (6, fill(80))]
    df = docs(*rows).withColumns({"_spans": F.lit(1), "a.b": F.lit(2), "hash": F.lit(3), "starts": F.lit(4), "c0": F.lit(5)})
    out = chunks.remove(df)
    assert out.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    for i in (1, 2, 6):
        assert (i, dict(rows)[i]) in left
    assert (5, None) in left and (None, p) in left and len(left) == len(rows)
    for i, t in left:
        if i in (3, 4):
            assert all(x in [t for k, t in rows if k == i][0] + [t for k, t in rows if k == i][-1] for x in t.split()) and len(t.split()) < 60
    assert sum("é" in (t or "") for _, t in left) == 1
    assert chunks.remove(df.filter("false")).count() == 0 and chunks.repeated_spans(df.filter("false")).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else share * weight[s] for s in names}
        capped |= above


@pytest.mark.parametrize("leaf", [4096, 8])
def test_mixing(docs, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["a", "a", "a", "b", "é", "Z", "z", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, "x y", "a"), (1002, "x y", "a"), (None, "p q r", "b")]
    df = docs(*rows)
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 2
        assert abs(r["copies"] - want[s] / max(1, sizes[s])) < 1 or r["size"] == 0
        taken[s] += r["copies"] * r["size"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    again = mixing.copies(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i in source if (n := sum(r["copies"] for r in got if r["doc_id"] == i))})


def test_mixing_is_fair(docs):
    """Over many hash seeds, here ids, a document is taken as often as its fraction says."""
    n = 6000
    got = mixing.copies(docs(*[(i, "w " * (1 + i % 5), "a" if i % 2 else "b") for i in range(n)])).collect()
    by = defaultdict(list)
    for r in got:
        by[(r["size"], r["target"])].append(r["copies"] - r["target"] / r["source_size"])
    assert all(abs(np.mean(v)) < 0.1 for v in by.values())


def test_mixing_nothing(docs):
    assert mixing.copies(docs((1, "a")).filter("false")).count() == 0
    assert mixing.mix(docs((1, None), (2, ""))).count() >= 0
    assert mixing.copies(docs((1, "w " * 500_000))).first()["size"] == 500_000
    clash = docs((1, "a b"), (2, "c")).withColumns({"a.b": F.lit(1), "key": F.lit(2), "ties": F.lit(3), "_tie": F.lit(4), "_copy": F.lit(5), "c0": F.lit(6)})
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() >= 1
    kept = minhash.keep_one(clash.withColumn("gone_id", F.lit(7)))
    assert kept.columns == [*clash.columns, "gone_id"] and kept.count() == 2


@cache
def reference_tokenizer():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path())


def reference_ids(text):
    t = reference_tokenizer()
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_packing(rows, got, capacity=1024):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, text in rows:
        ids = reference_ids(text)
        mine = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // capacity)))
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine[:-1]])) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == capacity for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "βeta", "it's", "12", "  x", "\n", "q!"]) for _ in range(int(rng.expovariate(1 / 250))))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "<|endoftext|> a <|endoftext|>"), (903, "a  \n b\n\n c\t"), (904, "word " * 5000)]
    got = packing.pack(packing.pieces(docs(*rows), tokenizer_path(), with_ids=True)).collect()
    used = check_packing(rows, got)
    total = sum(r["length"] for r in got)
    assert used <= -(-total // 1024) * 1.02 + 1
    assert all(len(r["ids"]) == r["length"] for r in got)


ODD = ["a", "Zé", "ǅ", "ß", "×", "ª", "\n\n", "#", "naïve", "Ġ", "é", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "'s", "'", "12", "²", "_", "-", ".", "<|endoftext|>", "<|", ",", "?)", "|>", "endoftext", "\r", "漢", "e\u0301", "\u200d", "😀", " the", " of"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=30).map("".join))
def test_parts_encode_as_the_whole(text):
    encoder = packing._encoder(tokenizer_path())
    assert encoder.by_parts
    assert [*encoder.ids(text), packing.END] == reference_ids(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 3)
    encoder = packing.Encoder(tokenizer_path())
    for text in ["one two three four five", "five six seven eight", "", "one" * 40 + " two"] * 2:
        assert [*encoder.ids(text), packing.END] == reference_ids(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, " \n" * 300_000 + "x"])
def test_long_runs(docs, text):
    got = packing.pack(packing.pieces(docs((1, text), (2, "x"), (2, "x"), (None, "y")), tokenizer_path())).collect()
    check_packing([(1, text)], [r for r in got if r["doc_id"] == 1])
    assert sum(r["doc_id"] == 2 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1


def test_other_tokenizers_take_whole_texts(docs):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    assert not packing._encoder(path).by_parts
    assert packing.pieces(docs((1, "hello world")), path).first()["length"] == 3


def test_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(i, "x " * (i % 5)) for i in range(200)] + [(i, "x " * 3000) for i in range(300, 303)]
    for few in (packing.BROADCAST_BUCKETS, 0):
        monkeypatch.setattr(packing, "BROADCAST_BUCKETS", few)
        check_packing(rows, packing.pack(packing.pieces(docs(*rows), tokenizer_path())).collect())


@pytest.mark.parametrize(("documents", "attention", "by"), [(None, None, "norm"), (3, None, "dot"), (None, 300_000, "norm"), (4, 300_000, "dot")])
def test_plan_keeps_all_capacities(documents, attention, by):
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 500, 4000).tolist())
    tokens, pieces, squares, ranks = Counter(), Counter(), Counter(), defaultdict(list)
    for size, lo, n, first, offset in packing.plan(counts, documents=documents, attention=attention, by=by):
        ranks[size] += range(lo, lo + n)
        for b in range(first, first + n):
            assert tokens[b] == offset
            tokens[b] += size
            pieces[b] += 1
            squares[b] += size * size
    assert {k: len(v) for k, v in ranks.items()} == counts and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert max(tokens.values()) <= 1024 and max(pieces.values()) <= (documents or 1024) and max(squares.values()) <= (attention or 1 << 20)
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def test_packing_nothing(docs):
    assert packing.pack(packing.pieces(docs((1, "a")).filter("false"), tokenizer_path())).count() == 0


def test_chunk_space():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 10))) for _ in range(2000)]
    texts = [words[i : i + 50] for i in range(0, 2000, 50)]
    spaces = [" ", "\n", "\t\n  ", "\n" * 9, "\x0b"]
    loose = [rng.choice(["", "\n"]) + "".join(w + rng.choice(spaces) for w in t) for t in texts]
    one, two = (chunks._windows([t.encode() for t in x], 16) for x in ([" ".join(t) for t in texts], loose))
    for k in (0, 1, 2, 5, 6):
        assert one[k].tolist() == two[k].tolist()
    for text, start, end, word, n in zip(*(two[k].tolist() for k in (0, 3, 4, 5, 6)), strict=True):
        assert loose[text][start:end].split() == texts[text][word : word + n]
    alone = [chunks._windows([" ".join(t).encode()], 16)[1].tolist() for t in texts]
    assert sorted(sum(alone, [])) == sorted(one[1].tolist())


def test_long_chunk_text():
    """A text of several steps gives the runs that its words give."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(300_000)]
    one = chunks._windows([" ".join(words).encode()], 16)
    part = chunks._windows([" ".join(words[200_000:200_500]).encode()], 16)
    assert len(set(part[1].tolist()) & set(one[1].tolist())) > 0.9 * len(part[1])


def test_chunk_periods(docs):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(9))
    rows, want = [], []
    for k in range(120):
        period = [word() for _ in range(k % chunks.PERIOD + 1)]
        for j in (0, 1):
            shift, n = rng.randrange(len(period)), rng.randrange(51, 90)
            rows.append((2 * k + j, " ".join([*(word() for _ in range(30)), *(period[(shift + i) % len(period)] for i in range(n)), *(word() for _ in range(30))])))
        want.append(2 * k + 1)
    assert sorted({s["doc_id"] for s in chunks.repeated_spans(docs(*rows)).collect()}) == want


def test_periods():
    rng = np.random.default_rng(13)
    for _ in range(30):
        n = int(rng.integers(0, 80))
        words, text = rng.integers(1, 3, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
        want = []
        for i in range(n):
            near = [p for p in range(1, chunks.PERIOD + 1) if i - p - chunks.HELD + 1 >= 0 and text[i - p - chunks.HELD + 1] == text[i]]
            near = [p for p in near if all(words[i - k] == words[i - k - p] for k in range(chunks.HELD))]
            want.append(any(words[i] == min(words[i - p + 1 : i + 1]) for p in near))
        assert chunks._periods(words, text).tolist() == want


def test_pipeline(spark):
    """Every stage over all documents of sf0.001, against SQL or brute force."""
    import duckdb
    from test_quality_lines_secrets import brute_long_lines

    from bytewright.llm import line_dedup, quality

    sf_dir = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, source = docs.columns, {r["doc_id"]: r["source"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    good = stages["quality rules"](spark, docs, sf_dir).persist()
    assert good.columns == columns and sorted(texts(good)) == [r[0] for r in c.execute(f"select doc_id from ({quality.SQL}) where kept order by 1").fetchall()]
    lines = stages["line dedup"](spark, good, sf_dir).persist()
    assert lines.columns == columns and texts(lines) == brute_long_lines(list(texts(good).items()), line_dedup.LONG)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = stages["MinHash near-dedup"](spark, lines, sf_dir).persist()
    groups = brute_components(list(texts(lines).items()), 5)
    assert near.columns == columns and sorted(texts(near)) == sorted(i for i, g in groups.items() if i == g) and 0 < near.count() < good.count()
    mixed = stages["mixing sources to target weights"](spark, near, sf_dir).persist()
    assert mixed.columns == columns
    sizes, most, taken = Counter(), Counter(), Counter()
    for i, t in texts(near).items():
        sizes[source[i]] += len(WORD.findall(t))
        most[source[i]] = max(most[source[i]], len(WORD.findall(t)))
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - t) <= most[s] for s, t in brute_targets(sizes).items())
    got = stages["best-fit packing"](spark, mixed, sf_dir).collect()
    want = Counter(r["doc_id"] for r in mixed.collect() for _ in range(-(-len(reference_ids(r["text"])) // 1024)))
    assert Counter(r["doc_id"] for r in got) == want
    run = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run)) == sorted(map(key, got))


def test_pipeline_odd_tables(spark, docs, tmp_path):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in", "house", "water", "green", f"w{rng.randrange(99)}"]) for _ in range(120))
    one = prose()
    rows = [(1, one), (1, one), (2, one), (3, None), (None, prose()), (None, None), (4, ""), (5, prose(), None), (6, prose(), "é")]
    for name, table in (("odd", docs(*rows).withColumns({"a.b": F.lit(1), "c0": F.lit(None).cast("string"), "gone": F.lit(2)})), ("none", docs((1, "x")).filter("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        held = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, f"{tmp_path}/{name}")
            assert held.columns == table.columns
            held.count()
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {1, 5, 6, None} and bool(out) == (name == "odd")

"""Quality rules by distribution divergence, in DataFrame expressions only.

Every document gets a histogram over character classes and one over the common words of its language. References are fitted
once on documents that are labelled good: the mean histograms of each language over at most ``SAMPLE`` of them, so that no amount of
junk among the documents judged moves them. A document's verdict compares its histograms with its language's reference by
Jensen-Shannon distance; both distances count together. Short texts scatter, so the limit widens as a text gets shorter, and texts
of fewer than ``MIN_WORDS`` words fail before.

No row is shuffled: the features are a narrow projection; the references one aggregate of a few rows over the labelled documents,
which a broadcast of at most ``SAMPLE`` ids picks out.

Defined cases: a null or empty text has no words and fails the base rules; a language without a word list, or null, is
judged by the reference ``*`` of all such languages; a language without labelled documents by the base rules alone; labels that are null or
repeat an id count once or not at all; repeated rows are judged alike, each on its own; a text of any length is measured whole; distances
that equal the limit pass; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words_of

#: Common words by language, the bins of the word histogram.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
#: Word list of all other languages.
POOLED = ["de", "la", "en", "un", "the", "of", "and", "to", "der", "die", "und", "den", "que", "el", "le", "et"]
#: Character classes; further classes are all beyond ASCII, white space and the rest.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:!?", "symbol": "#*$%&|<>"}
#: Lower-case ASCII letters and white space, in none of the classes above.
PLAIN = r"[a-z\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled documents that the references are fitted on at most.
SAMPLE = 20_000
#: Limit on the sum of both distances, widened by ``NOISE / sqrt(words)`` for the scatter of short texts; settled on the labels at sf0.1,
#: where it rejects all documents labelled bad that pass the base rules, and 3 of 3243 labelled good.
MAX_DISTANCE = 0.33
NOISE = 0.8


def _class_counts(text: Column) -> Column:
    """The size of every class; most characters are plain ones that go before the passes over what is left."""

    def counts(rest: Column) -> Column:
        n = F.length(rest)
        each = [(n - F.length(F.translate(rest, chars, ""))).cast("bigint").alias(k) for k, chars in CLASSES.items()]
        return F.struct(*each, F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", "")).cast("bigint").alias("wide"))

    return let(F.regexp_replace(text, PLAIN, ""), counts)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only a text with a repeated window pays for a sort.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(
                F.sequence(F.lit(0), last),
                lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"]))
                | ((j < last) & (s[F.least(j + 1, last)]["h"] == s[j]["h"])),
            )
            return F.sort_array(F.transform(twin, lambda j: s[j]["i"]))

        return F.aggregate(
            let(pairs, starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def by_hash(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    def windows(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(h, F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(pairs, F.slice(h, 3, n), lambda p, c: F.xxhash64(p, c)), 1, n - 2)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, 0).otherwise(let(let(hashes, windows), by_hash)).cast("bigint")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise("*")


def _common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words."""

    def counts(vocabulary: list[str]) -> Column:
        forms = sorted({f for w in vocabulary for f in (w, w.capitalize(), w.upper())})
        found = F.transform(F.filter(words, lambda w: w.isin(*forms)), lambda w: F.lower(w))

        def count(f: Column, word: str) -> Column:
            return F.size(F.filter(f, lambda x: x == word)).cast("bigint")

        return let(found, lambda f: F.array(*[count(f, v) for v in vocabulary], (F.size(words) - F.size(f)).cast("bigint")))

    out = reduce(lambda c, k: c.when(lang == k, counts(COMMON_WORDS[k])), list(COMMON_WORDS)[1:], F.when(lang == next(iter(COMMON_WORDS)), counts(next(iter(COMMON_WORDS.values())))))
    return out.otherwise(counts(POOLED))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> Column:
    """A struct over the columns of ``docs``: the base counts, both histograms and the base verdict."""
    t = F.coalesce(docs[text], F.lit(""))
    language = _language(docs[lang])

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            _common_counts(words, language).alias("common"),
        )

    def whole(x: Column) -> Column:
        w, r = x["w"], x["r"]
        known = [r[k] for k in (*CLASSES, "wide")]
        space = x["chars"] - w["word_chars"]
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            r["symbol"].alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            ((w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])).alias("base_failed"),
            language.alias("language"),
            F.array(*known, space, w["word_chars"] - reduce(lambda a, b: a + b, known)).alias("classes"),
            w["common"].alias("common"),
        )

    parts = F.struct(
        let(words_of(docs[text]), of_words).alias("w"),
        _class_counts(t).alias("r"),
        F.length(t).cast("bigint").alias("chars"),
        _dup_lines(t).alias("n_dup_lines"),
    )
    return let(parts, whole)


def features(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with the struct column ``into``."""
    return docs.withColumn(into, measured(docs))


def _shares(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def labelled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Of ``docs`` those that ``labels (doc_id, quality)`` calls good (1); of more than ``bound``, that many by a scrambled order of ids."""
    scrambled = F.col("label_id") % 1_000_003 * 7919 % 1_000_003
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("label_id")).distinct()
    good = good.orderBy(scrambled, "label_id").limit(bound)
    return docs.join(F.broadcast(good), docs["doc_id"] == good["label_id"], "left_semi")


def references(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict[str, tuple[list[float], list[float]]]:
    """By language the mean class and common-word shares of labelled documents that pass the base rules: ``len(COMMON_WORDS) + 1`` rows at most."""
    n_class, n_word = len(CLASSES) + 3, len(POOLED) + 1
    f = labelled(docs.select("doc_id", "lang", "text"), labels, bound)
    f = f.select(measured(f).alias("f")).select(F.when(~F.col("f.base_failed"), F.col("f.language")).alias("language"), _shares(F.col("f.classes")).alias("c"), _shares(F.col("f.common")).alias("w"))
    rows = f.groupBy("language").agg(*[F.avg(F.col("c")[i]).alias(f"c{i}") for i in range(n_class)], *[F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(n_word)]).collect()
    return {r["language"]: ([r[f"c{i}"] for i in range(n_class)], [r[f"w{i}"] for i in range(n_word)]) for r in rows if r["language"] is not None}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of one length: 0 (alike) to 1."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def verdict(f: Column, refs: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The counts of a measured struct with the distances and ``kept``."""

    def pick(i: int) -> Column:
        none = F.lit(None).cast("array<double>")
        return reduce(lambda c, k: F.when(f["language"] == k, F.array(*map(F.lit, refs[k][i]))).otherwise(c), refs, none)

    def judged(x: Column) -> Column:
        limit = MAX_DISTANCE + NOISE / F.sqrt(F.greatest(f["n_words"], F.lit(1)).cast("double"))
        fields = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
        kept = ~f["base_failed"] & (x["class_distance"] + x["word_distance"] <= limit)
        return F.struct(*fields, x["class_distance"].alias("class_distance"), x["word_distance"].alias("word_distance"), kept.alias("kept"))

    distances = [F.coalesce(js_distance(_shares(f[c]), pick(i)), F.lit(0.0)).alias(n) for i, (c, n) in enumerate([("classes", "class_distance"), ("common", "word_distance")])]
    return let(F.struct(*distances), judged)


def judge(docs: DataFrame, refs: dict[str, tuple[list[float], list[float]]], into: str) -> DataFrame:
    """``docs`` with the struct ``into``: base counts, distances and ``kept``, in one narrow pass that binds the features once."""
    return docs.withColumn(into, let(measured(docs), lambda f: verdict(f, refs)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Features are taken of the labelled documents once more, for the references."""
    refs = references(docs, labels)
    return docs.filter(let(measured(docs), lambda f: verdict(f, refs)["kept"]))


def _sql() -> str:
    """``judge`` as DuckDB SQL, distances to six places; for as many labels as the sample takes."""
    languages = {**COMMON_WORDS, "*": POOLED}
    space = r"[\x20\x09-\x0D]"

    def common(vocabulary: list[str]) -> str:
        forms = [", ".join(f"'{x}'" for x in sorted({v, v.capitalize(), v.upper()})) for v in vocabulary]
        return "[" + ", ".join(f"len(list_filter(w, lambda x: x in ({x})))" for x in forms) + "]"

    of = " ".join(f"when '{k}' then {common(v)}" for k, v in languages.items())
    listed = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    counted = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    classes = [counted("A-Z"), counted("0-9"), counted(CLASSES["stop"]), counted(CLASSES["symbol"]), r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"]
    n_class, n_word = len(CLASSES) + 3, len(POOLED) + 1
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{i + 1}])" for i in range(n)) + "]"
    half = lambda x, y: f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"

    def distance(p: str, q: str, n: int) -> str:
        a, b = f"{p}[i]", f"{q}[i]"
        return f"coalesce(sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {half(a, b)} + {half(b, a)})) / 2, 0)), 0)"

    return f"""
with a as (select row_number() over () as row, doc_id, case when lang in ({listed}) then lang else '*' end as language, coalesce(text, '') as t from documents),
b as (select *, regexp_extract_all(t, '[^{space[1:]}+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space[1:]}')) as l from a),
r as (select row, i, count(*) over (partition by row, x) as n from (select row, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as x from b where len(w) > 2)),
k as (select row, count(distinct i + j) as n_repeat_words from r, range(3) s(j) where n > 1 group by row),
c as (select row, doc_id, language, len(w) as n_words, length(regexp_replace(t, '{space}+', '', 'g')) as word_chars, {classes[3]} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, length(t) as chars, [{", ".join(classes)}] as known, case language {of} end as found from b left join k using (row)),
d as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  known || [chars - word_chars, word_chars - list_sum(known)::bigint] as classes, found || [n_words - list_sum(found)::bigint] as common from c),
e as (select *, list_transform(classes, lambda x: case when chars > 0 then x / chars else 0 end) as p, list_transform(common, lambda x: case when n_words > 0 then x / n_words else 0 end) as q from d),
f as (select language, {mean("p", n_class)} as rp, {mean("q", n_word)} as rq from e where not base_failed and doc_id in (select doc_id from labels where quality = 1) group by language),
g as (select e.*, {distance("p", "rp", n_class)} as class_distance, {distance("q", "rq", n_word)} as word_distance from e left join f using (language))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance,
  not base_failed and class_distance + word_distance <= {MAX_DISTANCE} + {NOISE} / sqrt(greatest(n_words, 1)) as kept from g
"""


SQL = _sql()

"""Secret scans in DataFrame expressions only: patterns, and sliding-window entropy over candidate strings.

Spans count code points, the end exclusive. Spark has no function for the places of matches, so they come from the text's
pieces between the matches: a match starts after all earlier pieces and matches.

Entropy: a candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that no pattern has taken and that holds a
letter. A window of ``WINDOW`` characters slides over it; the counts of its characters are held in a map, and as one character
enters and one leaves, only their counts and their shares of the sum of ``c * log2(c)`` change. The largest window entropy is held
against the limit of the candidate's character class. The allow-list passes over UUIDs, and candidates whose parts between
``/ + _ = -`` are all plain: words, words with up to four digits, or holding a placeholder or a plain sequence.

Everything is computed within the row: no shuffle, and work in proportion to the text. No expression repeats a group, as Java
matches such groups by recursion, whose depth a long text would set.

Defined cases: null is as empty, and has no spans; spans of different kinds may overlap, and those that tie are ordered by kind;
texts and candidates of any length are scanned whole; repeated rows are scanned each; an empty table gives an empty result; extra
columns pass through, and ``into`` must be none of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, running

#: Kind, pattern, and the group that must have at least so many characters.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # runs are taken whole, so that short ones can be left out here
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character class and least window entropy in bits, the first that fits.
ENTROPY = [(r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Za-z]+$", 3.7), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.7)]
#: The allow-list: whole candidates, separators of parts, and what makes a part plain.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SEPARATOR = r"[/+_=-]+"
PLACEHOLDERS = ["example", "sample", "placeholder", "changeme", "dummy", "redacted", "xxxx", "0123456", "1234567", "abcdefg"]
SAME = r"(.)\1{5}"
#: A part of letters is of words if taking them away leaves at most one character in so many.
REST = 4
KINDS = [k for k, *_ in PATTERNS] + ["entropy"]
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def _span(start: Column, kind: int, text: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(text)).alias("end"), text.alias("text"))


def _found(text: Column, pattern: str, group: int, kind: int, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has at least ``least`` characters."""

    def spans(x: Column) -> Column:
        def placed(starts: Column) -> Column:
            at = lambda i: starts[i] + F.length(x["pieces"][i])
            # a match's group comes from the match alone: it starts where the match does, and nothing behind it is looked at
            part = lambda m: m if group == 0 else F.regexp_extract(m, pattern, group)
            made = F.transform(x["whole"], lambda m, i: F.struct(F.length(part(m)).alias("n"), _span(at(i), kind, m).alias("s")))
            return F.transform(F.filter(made, lambda m: m["n"] >= least), lambda m: m["s"])

        steps = F.zip_with(F.slice(x["pieces"], 1, F.size(x["whole"])), x["whole"], lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        return let(running(steps), placed)

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array()).cast(_SPANS)


def _f(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(s: Column, enough: Column | None = None) -> Column:
    """The largest Shannon entropy in bits of ``WINDOW`` neighbouring characters of ``s``, which has so many or more.

    With ``enough`` the windows behind the first one that has so much are passed over: the result is then at least that.
    """
    most = F.log2(F.lit(float(WINDOW)))
    stop = F.lit(-1.0) if enough is None else (most - enough) * WINDOW

    def over(chars: Column) -> Column:
        head = F.slice(chars, 1, WINDOW)
        counts = F.map_from_entries(F.transform(F.array_distinct(head), lambda c: F.struct(c, F.size(F.filter(head, lambda x: x == c)))))

        def moved(a: Column, left: Column, came: Column) -> Column:
            fewer, more = a["counts"][left] - 1, F.coalesce(F.try_element_at(a["counts"], came), F.lit(0)) + 1
            total = a["sum"] - _f(fewer + 1) + _f(fewer) + _f(more) - _f(more - 1)
            rest = F.map_filter(a["counts"], lambda k, n: (k != left) & (k != came) & (n > 0))
            held = F.map_concat(rest, F.create_map(left, fewer), F.create_map(came, more))
            return F.struct(total.alias("sum"), F.least(a["least"], total).alias("least"), held.alias("counts"))

        def step(a: Column, i: Column) -> Column:
            """The window moves on to the one that ends with the i-th character, counted from 0."""
            left, came = chars[i - WINDOW], chars[i]
            return F.when((left == came) | (a["least"] <= stop), a).otherwise(moved(a, left, came))

        def run(c: Column) -> Column:
            first = F.aggregate(F.map_values(c), F.lit(0.0), lambda a, n: a + _f(n))
            start = let(first, lambda x: F.struct(x.alias("sum"), x.alias("least"), c.alias("counts")))
            moves = F.filter(F.sequence(F.lit(WINDOW), F.greatest(F.length(s), F.lit(WINDOW))), lambda i: i < F.length(s))
            return F.aggregate(moves, start, step, lambda a: a["least"])

        return let(counts, run)

    return most - let(F.split(s, ""), over) / WINDOW


def _plain(part: Column) -> Column:
    """Whether a part of a candidate is of words and at most four digits, or holds a placeholder."""
    one_case = part.rlike("^[a-z]*[0-9]{0,4}$") | part.rlike("^[A-Z]*[0-9]{0,4}$")
    words = part.rlike("^[A-Za-z]*[0-9]{0,4}$") & (REST * F.length(F.regexp_replace(part, "[A-Z]?[a-z]{2,}|[0-9]", "")) <= F.length(part))
    return one_case | words | part.rlike(f"(?i){'|'.join(PLACEHOLDERS)}|{SAME}")


def _allowed(s: Column) -> Column:
    """A single part with digits must hold a placeholder to be allowed."""

    def of(parts: Column) -> Column:
        return F.when((F.size(parts) > 1) | ~s.rlike("[0-9]"), F.forall(parts, _plain)).otherwise(s.rlike(f"(?i){'|'.join(PLACEHOLDERS)}|{SAME}"))

    return s.rlike(UUID) | let(F.split(s, SEPARATOR), of)


def _secretive(s: Column) -> Column:
    limit = F.lit(ENTROPY[-1][1])
    for pattern, bits in ENTROPY[-2::-1]:
        limit = F.when(s.rlike(pattern), F.lit(bits)).otherwise(limit)
    return F.when(s.rlike("[A-Za-z]") & ~_allowed(s), let(limit, lambda x: window_entropy(s, x) >= x)).otherwise(F.lit(False))


def _entropic(text: Column) -> Column:
    """High-entropy candidates. The patterns come first in one alternation, so that what they match is no candidate."""
    taken = "|".join(f"(?:{p.replace('(password', '(?:password').replace('([', '(?:[')})" for _, p, _, _ in PATTERNS)
    found = _found(text, f"{taken}|({CANDIDATE})", 1, len(PATTERNS), WINDOW)
    return F.when(text.rlike(CANDIDATE), F.filter(found, lambda s: _secretive(s["text"]))).otherwise(F.array()).cast(_SPANS)


def scan(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``into`` of ``base`` and ``all``: sorted spans ``(start, kind, end, text)``, kind an index of KINDS."""
    t = F.coalesce(docs[text], F.lit(""))
    base = F.concat(*[_found(t, p, g, i, n) for i, (_, p, g, n) in enumerate(PATTERNS)])
    parts = F.struct(F.sort_array(base).alias("base"), _entropic(t).alias("more"))
    return docs.withColumn(into, let(parts, lambda x: F.struct(x["base"].alias("base"), F.sort_array(F.concat(x["base"], x["more"])).alias("all"))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans of every document."""
    column = fresh(docs, "_secrets")
    s = scan(docs.select("doc_id", "text"), column).select("doc_id", F.col(f"{column}.base").alias("base"), F.col(f"{column}.all").alias("all"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(PATTERNS)]
    return s.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def _sql() -> str:
    """``digest`` as DuckDB SQL: the same rules, the entropy of every window taken anew."""
    patterns = [(k, p.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ["password", "passwd", "secret", "token", "api_?key"]) + ")"), g, n) for k, p, g, n in PATTERNS]
    quoted = lambda p: p.replace("'", "''")
    taken = "|".join(f"(?:{p.replace('(', '(?:')})" for _, p, _, _ in patterns)
    same = "|".join(f"{re.escape(c)}{{6}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    holder = f"(?i){'|'.join(PLACEHOLDERS)}|(?-i:{same})"
    rows = [*((i, p, g, n) for i, (_, p, g, n) in enumerate(patterns)), (len(patterns), f"{taken}|({CANDIDATE})", 1, WINDOW)]
    found = " union all ".join(
        f"select doc_id, t, {i} as kind, {n} as least, regexp_split_to_array(t, '{quoted(p)}') as pieces, regexp_extract_all(t, '{quoted(p)}') as whole, regexp_extract_all(t, '{quoted(p)}', {g}) as part from r"
        for i, p, g, n in rows
    )
    limit = " ".join(f"when regexp_matches(s, '{p}') then {bits}" for p, bits in ENTROPY[:-1])
    names = "['" + "', '".join(KINDS) + "']"
    return f"""
with d as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents), r as (select row as doc_id, t from d),
f as ({found}),
u as (select doc_id, kind, least, unnest(pieces[:len(whole)]) as piece, unnest(whole) as s, unnest(part) as part, generate_subscripts(whole, 1) as i from f where len(whole) > 0),
p as (select *, (sum(length(piece) + length(s)) over (partition by doc_id, kind order by i) - length(s))::bigint as start from u),
e as (select *, start + length(s) as stop from p where length(part) >= least),
x as (select *, regexp_split_to_array(s, '{SEPARATOR}') as parts from e where kind = {len(patterns)}),
y as (select *, regexp_matches(s, '{UUID}') or case when len(parts) > 1 or not regexp_matches(s, '[0-9]') then len(list_filter(parts, lambda a: not (
    regexp_matches(a, '^[a-z]*[0-9]{{0,4}}$') or regexp_matches(a, '^[A-Z]*[0-9]{{0,4}}$')
    or regexp_matches(a, '^[A-Za-z]*[0-9]{{0,4}}$') and {REST} * length(regexp_replace(a, '[A-Z]?[a-z]{{2,}}|[0-9]', '', 'g')) <= length(a) or regexp_matches(a, '{holder}')))) = 0
  else regexp_matches(s, '{holder}') end as allowed, case {limit} else {ENTROPY[-1][1]} end as bits from x),
z as (select doc_id, kind, start, stop from y where regexp_matches(s, '[A-Za-z]') and not allowed
  and list_max(list_transform(range(1, length(s) - {WINDOW - 2}), lambda i: list_entropy(string_split(substr(s, i, {WINDOW}), '')))) >= bits),
a as (select doc_id, kind, start, stop from e where kind < {len(patterns)} union all select * from z),
l as (select doc_id, string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as spans,
  string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < {len(patterns)}) as base,
  {", ".join(f"count(*) filter (kind = {i}) as n_{k}" for i, (k, *_) in enumerate(patterns))} from a group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k, *_ in patterns)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join l on l.doc_id = d.row
"""


SQL = _sql()

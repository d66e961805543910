"""Line deduplication by winnowing, in DataFrame expressions only.

Lines with a word are hashed. Of every ``WINDOW`` neighbouring lines the least hash is selected, the last one of equals. What a
window selects hangs on its lines alone: two equal windows anywhere select the same line at the same place. So every repeated
run of that many lines shares a fingerprint, and only selected lines, about half of all, are moved.

A run of one or two lines is shorter than a window. Where it has ``words`` words or more it is a window and a fingerprint of its
own; so every repeated run of whole lines with that many words is found, however few they are. With ``words=None`` there are
windows of three lines only.

1. Fingerprints are counted over all selected places; those at one place only are dropped, and most places with them.
2. A place that is left is extended both ways, line by line, to each window that selected it; equal windows around equal
   fingerprints are matches. The first place of each, in order of document and line, is a minimum.
3. Windows that are later repeats mark their lines; overlapping ones join to the whole run. Marked lines are deleted.

Counts and minima combine on the map side, and the few keys that very many places share are met by broadcast (``common.meet``), so a line
that a third of all documents hold is no hot task; no pairs are made. Texts are shuffled once, to meet the marks.

Defined cases: a null text stays null; lines without a word neither match nor stop a match, and stay; rows with one doc_id
and one text are one document; rows that share only the id are told apart by their text's hash, which also settles which of them is the
first; a text of any length, or of one line, is taken whole; an empty table gives an empty result; extra columns pass through under any
names, and the number of removed lines takes another name if ``n_removed`` is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, let, meet, named, renamed

WINDOW = 3
#: So many words make a window of fewer lines than ``WINDOW``.
LONG = 50


def _places(text: Column, words: int | None) -> Column:
    """``(fingerprint, windows)`` of every selected line; a window is the hash of its lines, its place among the lines with
    words, and these lines' places in the text."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def line(s: Column) -> Column:
        n = [] if words is None else [F.regexp_count(s["x"], F.lit(WORD)).alias("n")]
        return F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), *n)

    full = F.transform(F.filter(lines, lambda s: s["x"].rlike(WORD)), line)

    def window(l: Column, q: Column, size: int) -> Column:
        return F.struct(F.xxhash64(F.lit(size), *[l[q + k]["h"] for k in range(size)]).alias("lines"), q.alias("p"), F.array(*[l[q + k]["i"] for k in range(size)]).alias("at"))

    def selects(l: Column, p: Column, before: int) -> Column:
        """Whether the window that begins so many lines before the p-th selects that one."""
        q = p - before
        least = [l[q + k]["h"] >= l[p]["h"] if k < before else l[q + k]["h"] > l[p]["h"] for k in range(WINDOW) if k != before]
        inside = (q >= 0) & (q + WINDOW <= F.size(l))
        return F.when(inside, least[0] & least[1]).otherwise(F.lit(False))

    def selected(l: Column) -> Column:
        def row(p: Column) -> Column:
            around = F.array(*[F.when(selects(l, p, k), window(l, p - k, WINDOW)) for k in range(WINDOW)])
            return F.struct(l[p]["h"].alias("fingerprint"), F.array_compact(around).alias("windows"))

        rows = F.transform(F.sequence(F.lit(0), F.size(l) - 1), row)
        return F.when(F.size(l) >= WINDOW, F.filter(rows, lambda r: F.size(r["windows"]) > 0))

    def short(l: Column, size: int) -> Column:
        """Windows of ``size`` lines with enough words, each its own fingerprint. The size is hashed too, so that none meets a line."""

        def row(p: Column) -> Column:
            return let(window(l, p, size), lambda w: F.struct(w["lines"].alias("fingerprint"), F.array(w).alias("windows")))

        def enough(p: Column) -> Column:
            return sum((l[p + k]["n"] for k in range(1, size)), l[p]["n"]) >= words

        return F.when(F.size(l) >= size, F.transform(F.filter(F.sequence(F.lit(0), F.size(l) - size), enough), row))

    def every(l: Column) -> Column:
        none = F.array().cast("array<struct<fingerprint:bigint,windows:array<struct<lines:bigint,p:int,at:array<int>>>>>")
        return F.concat(*[F.coalesce(w, none) for w in (selected(l), *(short(l, size) for size in range(1, WINDOW)))])

    return let(full, selected if words is None else every)


def repeated_lines(docs: DataFrame, words: int | None = LONG) -> DataFrame:
    """``(doc_id, hash, gone)``: the places (from 0) of later repeated lines in each text that has any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").filter(F.col("text").isNotNull())
    rows = cut(keyed.select("doc_id", "hash", F.inline(_places(F.col("text"), words))))
    counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = cut(meet(rows, counts, ["fingerprint"]).select("doc_id", "hash", "fingerprint", F.inline("windows")))
    place = F.struct("doc_id", "hash", "p")
    first = open_.groupBy("fingerprint", "lines").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = meet(open_, first, ["fingerprint", "lines"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "hash", F.explode("at").alias("at")).groupBy("doc_id", "hash").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, words: int | None = LONG) -> DataFrame:
    """``docs`` with later repeated runs of lines taken out of ``text``, and their number as the last column, ``n_removed``."""
    marks = repeated_lines(docs.select("doc_id", "text"), words).select(F.col("doc_id").alias("id"), "hash", "gone")
    plain = named(docs).withColumn("own", F.xxhash64("text"))
    both = plain.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(F.sort_array(left), lambda i: lines[i]), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), kept))
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    both = both.withColumns({"text": text, f"c{len(docs.columns)}": n})
    return renamed(both, docs, "text", into=[fresh(docs, "n_removed")])


SQL = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
c as (select *, row_number() over (partition by doc_id order by i) as k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
v as (select *, lead(line) over w as two, lead(line, 2) over w as three, lead(n) over w as n_two from c window w as (partition by doc_id order by k)),
w as (select doc_id, k, 1 as size, [line] as lines from v where n >= {LONG}
  union all select doc_id, k, 2, [line, two] from v where two is not null and n + n_two >= {LONG}
  union all select doc_id, k, 3, [line, two, three] from v where three is not null),
d as (select doc_id, k, size from (select *, row_number() over (partition by lines order by doc_id, k) as r from w) where r > 1),
gone as (select distinct c.doc_id, c.i from c join d on c.doc_id = d.doc_id and c.k between d.k and d.k + d.size - 1)
select l.doc_id, count(gone.i) as n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (gone.i is null), '') as text
from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id
"""

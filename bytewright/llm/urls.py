"""URL filters: host and path rules first, then a weighted vocabulary by Aho-Corasick.

Terms count only between boundaries (no letter or digit beside them). One strict term rejects a URL; soft terms do if at
least two different ones are found and their weights reach ``SOFT_LIMIT``. The automaton is built once per Python worker. A small vocabulary
is built in; ``vocabulary`` loads another one from a table.

Narrow: no shuffle. Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule, but a
URL without ``://`` is still searched for terms; of rules that fit and are as long, the one with the longer host wins, then the later in order
of text; a URL of any length is searched whole, at a time that grows with it and with the terms found; repeated rows are judged
each; an empty table gives an empty result; extra columns pass through, and ``into`` must be none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = (
    "bestiality", "blackjack", "bukkake", "camgirl", "camgirls", "casino", "casinos", "cialis", "creampie", "escort", "escorts", "fentanyl", "gambling", "gangbang", "hentai", "hookup", "hookups",
    "hookers", "keygen", "malware", "milf", "milfs", "nudes", "phishing", "porn", "porno", "pornstar", "roulette", "sexcam", "sexcams", "slots", "sportsbook", "stripclub", "stripper", "viagra", "warez", "webcamsex", "xxx",
)
SOFT = {
    "adult": 2, "affiliate": 1, "bet": 1, "bets": 1, "betting": 2, "bonus": 1, "casual": 1, "cheap": 2, "clickbait": 2, "coupon": 1, "coupons": 1, "crack": 2, "cracked": 2, "dating": 1, "deals": 1, "discount": 1,
    "erotic": 2, "fake": 1, "farm": 1, "fetish": 2, "free": 1, "girls": 1, "hack": 1, "hot": 1, "jackpot": 2, "loan": 1, "loans": 1, "lottery": 2, "mature": 1, "nude": 2, "payday": 2, "pharmacy": 1, "pills": 2,
    "poker": 2, "prize": 1, "proxy": 1, "replica": 2, "sex": 2, "sexy": 2, "singles": 1, "spam": 2, "steroids": 2, "teen": 1, "torrent": 2, "torrents": 2, "trial": 1, "unblocked": 2, "weed": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT = 3
#: Terms of a vocabulary at most: it is sent to every worker.
TERMS = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in soft:
        out.add_word(term, (term, weight))
    for term in strict or ("\0",):  # an empty automaton can't be searched
        out.add_word(term, (term, 0))
    out.make_automaton()
    return out


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and soft ones with their weights, for ``judge``, of a table ``(term, weight)``: a null weight, or one of 0 or less, is strict.

    Terms are lower-cased (A-Z); null and empty ones are left out; of repeated ones a strict row wins, then the largest weight. More than
    ``TERMS`` terms are an error.
    """
    term = F.translate("term", UPPER, UPPER.lower())
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("int"))
    rows = terms.select(term.alias("term"), weight.alias("weight")).filter("term <> ''")
    rows = rows.groupBy("term").agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("strict")).limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"more than {TERMS} terms")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: r["weight"] for r in rows if not r["strict"]}


def vocabulary_verdict(url: str, automaton) -> str:
    """``allow`` or ``block`` by the terms in a lower-cased URL."""
    soft: dict[str, int] = {}
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start and url[start - 1].isalnum()) or (end + 1 < len(url) and url[end + 1].isalnum()):
            continue
        if not weight:
            return "block"
        soft[term] = weight
    return "block" if len(soft) > 1 and sum(soft.values()) >= SOFT_LIMIT else "allow"


def located(url: Column) -> Column:
    """``(host, path)`` of a URL, the host in lower case; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substring(u, F.locate("://", u) + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(u)), "^[^?#]*", 0)
    return F.struct(F.translate(host, UPPER, UPPER.lower()).alias("host"), path.alias("path"))


def best_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest ``(rule, verdict)`` whose host is ``host`` or above it and whose path begins ``path``."""
    found, parent = [], host
    while parent:
        found += [(len(parent) + len(p), len(parent), parent + p, verdict) for p, verdict in rules.get(parent, ()) if path.startswith(p)]
        parent = parent.partition(".")[2]
    return max(found)[2:] if found else None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], strict: tuple[str, ...] = STRICT, soft: dict[str, int] = SOFT, into: str = "judged") -> DataFrame:
    """``pages`` with a struct ``into`` of ``(host, path, rule, verdict)``; rules are ``(verdict, host, path)``."""
    if into.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"there is a column {into}")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host.translate(str.maketrans(UPPER, UPPER.lower())), []).append((path, verdict))
    terms = tuple(sorted(soft.items()))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(strict, terms)
        for batch in batches:
            rows = [best_rule(host, path, by_host) or (None, vocabulary_verdict(url, automaton)) for url, host, path in zip(*batch, strict=True)]
            yield pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    lowered = F.translate(F.coalesce(pages["url"], F.lit("")), UPPER, UPPER.lower())
    host, path = F.col(f"{into}.host"), F.col(f"{into}.path")
    out = pages.withColumn(into, located(pages["url"])).withColumn(into, F.struct(host, path, judged(lowered, host, path).alias("found")))
    return out.withColumn(into, F.struct(host, path, F.col(f"{into}.found.rule"), F.col(f"{into}.found.verdict")))


def sql(rules: list[tuple[str, str, str]]) -> str:
    """``judge`` with the default vocabulary as DuckDB SQL."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)

    def found(term: str) -> str:
        return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')::int"

    strict, soft = " + ".join(map(found, STRICT)), list(SOFT.items())
    return f"""
with rules(verdict, rule_host, rule_path) as (values {values}),
a as (select page_id, coalesce(url, '') as url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as h, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as u from a),
c as (select *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
r as (select page_id, rule_host || rule_path as rule, verdict, row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc, rule_host || rule_path desc, verdict desc) as k
  from c join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
t as (select *, {strict} as strict, {" + ".join(found(x) for x, _ in soft)} as softs, {" + ".join(f"{n} * {found(x)}" for x, n in soft)} as weight from c)
select page_id, host, path, rule, coalesce(verdict, case when strict > 0 or (softs > 1 and weight >= {SOFT_LIMIT}) then 'block' else 'allow' end) as verdict
from t left join (select page_id, rule, verdict from r where k = 1) using (page_id)
"""

"""The operN queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, line_dedup, minhash, mixing, packing, quality, secrets, topk, urls
from .common import table


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document; distances to six places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, quality.references(docs, table(spark, sf_dir, "labels")), "q").select("doc_id", "q.*")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeated runs of three lines or more, or of 50 words or more."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces with their places in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path()))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted conversations and one that holds control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(trial)))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    taken = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that documents of smaller id hold too."""
    return chunks.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and entropy."""
    return secrets.digest(table(spark, sf_dir, "documents"))


#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "judged.*")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates: 4-word shingles, similarity 0.8 or more, of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_winnow_lines": op2_winnow_lines,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_chat_format": op5_chat_format,
    "op6_mix_sources": op6_mix_sources,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLES: dict[str, str] = {
    "op1_quality_divergence": quality.SQL,
    "op2_winnow_lines": line_dedup.SQL,
    "op4_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.v, v.v)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from k where rank <= 10
""",
    "op5_chat_format": chat.SQL,
    "op8_secret_scan": secrets.SQL,
    "op9_url_filter": urls.sql(URL_RULES),
    "op10_minhash_near_dedup": """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as a from documents),
s as (select distinct doc_id, unnest(case when len(a) = 0 then []::varchar[] when len(a) < 4 then [array_to_string(a, ' ')]
  else list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select u, v from i join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
e as (select u, v from l union all select v, u from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.v from r join e on r.other = e.u)
select r.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
""",
}

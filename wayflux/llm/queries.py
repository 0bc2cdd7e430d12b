"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflux.llm import bpe, chat, langid, multisethash, quality, toxicity
from wayflux.llm.common import crc_bucket, small_batches, table
from wayflux.llm.exactdup import exact_dedup
from wayflux.llm.labelled import labelled_sample
from wayflux.llm.mixing import mix
from wayflux.llm.neardup import near_duplicates
from wayflux.llm.packing import pack
from wayflux.llm.phrases import collocations
from wayflux.llm.urlfilter import judge_urls
from wayflux.llm.whitening import whiten

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Vocabulary of the tokenising queries: a file of the public tokenizers on the box.
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    found = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), model.column(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisethash.edited_fingerprints(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", crc_bucket(F.col("doc_id"), 3) != 1, toxicity.LABEL_ROWS))
    found = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), model.column(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Discriminant:
    return quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", crc_bucket(F.col("doc_id"), 5) != 0, quality.LABEL_ROWS))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), quality_model(spark, docs, sf_dir).column(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_bpe": op6_bpe,
    "op7_cube_mixing": op7_cube_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
with rows_ as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as content from documents
), groups_ as (select content, max(doc_id) as keep_id, count(*) as group_size from rows_ group by content)
select r.doc_id, g.keep_id, g.group_size, r.doc_id is not distinct from g.keep_id as kept, sha256(r.content) as text_sha256
from rows_ r join groups_ g on r.content = g.content
""",
    "op9_url_filters": r"""
with rules(verdict, host, path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), split_ as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    row_number() over () as row_
  from pages
), fits as (
  select s.row_, r.host || r.path as rule, r.verdict,
    row_number() over (partition by s.row_ order by length(r.host || r.path) desc, r.verdict desc, r.host || r.path desc) as place
  from split_ s join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split_ s left join (select * from fits where place = 1) f on s.row_ = f.row_
""",
    "op12_phrases": r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts
), words as (
  select lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] as w from pieces
), sizes as (select lang, sum(len(w))::bigint as n from words group by lang
), counts as (
  select lang, phrase, width, count(*) as f from (
    select lang, width, unnest([array_to_string(w[i : i + width - 1], ' ') for i in range(1, len(w) - width + 2)]) as phrase
    from words, (values (1), (2), (3)) as widths(width) where len(w) >= width
  ) group by lang, phrase, width having count(*) >= 10
), candidates as (select lang, phrase, width, f as a, string_split(phrase, ' ') as w from counts where width > 1
), parts as (
  select lang, phrase, width, a, k, array_to_string(w[1:k], ' ') as first_part, array_to_string(w[k + 1 : width], ' ') as last_part
  from (select *, unnest(range(1, width)) as k from candidates)
), cuts as (
  select p.lang, p.phrase, p.a, p.k, l.f as l, r.f as r, ((1000000::hugeint * p.a * p.a) // (l.f::hugeint * r.f))::bigint as score
  from parts p join counts l on l.lang = p.lang and l.phrase = p.first_part join counts r on r.lang = p.lang and r.phrase = p.last_part
), least_ as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts
), inner_ as (
  select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidates where width = 3
), shadowed as (
  select distinct b.lang, b.phrase from inner_ t join candidates b on t.lang = b.lang and t.phrase = b.phrase where b.width = 2 and 100 * t.a >= 50 * b.a
), ranked as (
  select l.lang, row_number() over (partition by l.lang order by score desc, a desc, encode(l.phrase)) as rank, l.phrase, a, l, r, score
  from least_ l anti join shadowed s on l.lang = s.lang and l.phrase = s.phrase where place = 1
)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
""",
}

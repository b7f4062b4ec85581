"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.llm import base, bpe, fim, htmltext, langid, linededup, negatives, packing, quality, sharding, simjoin, tokencount, topk, warc


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(base.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out() -> Column:
    """The fold that language profiles are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    rows = langid.predict(docs.select("doc_id", "text"), langid.learn(docs, ~held_out()))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.kept_texts(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.components(base.table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = htmltext.extract(base.table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_both", "n_vetoed", "n_marked")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(base.table(spark, sf_dir, "documents")))
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failed_bits")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(base.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(base.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = base.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode(docs, path, bpe.build_lexicon(docs, path))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(listed).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of packed documents with a checksum in place of their ids."""
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(base.table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{base.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.read(warc.write(base.table(spark, sf_dir, "pages"), folder)).drop("payload")
    # what was just written has no gaps; one would be pages lost
    lost = F.concat(F.lit("unreadable bytes in "), "path", F.lit(": "), "reason")
    kind = F.when(F.col("reason").isNotNull(), F.raise_error(lost)).otherwise(F.col("type"))
    rows = rows.withColumn("record_type", kind).filter(F.col("record_type") != "warcinfo")
    key = lambda c: warc.page_id(F.col(c)).try_cast("long")
    return rows.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(base.table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    chars = lambda part: F.length(part).cast("long").alias(f"{part}_chars")
    restored = fim.restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(base.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, noisy)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_text": op5_html_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_top_k": op8_top_k,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "op11_warc": op11_warc,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}
_SPACE = r"[\x20\x09-\x0D]"

ORACLE: dict[str, str] = {
    "op3_line_dedup": rf"""
with lines as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), firsts as (
  select key, min(doc_id) as first_id from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), marked as (
  select k.doc_id, k.text, k.line, k.pos, f.first_id is not null and f.first_id <> k.doc_id as gone from keyed k left join firsts f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id, text
""",
    "op8_top_k": """
with x as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) as bigint) as score
  from x q join x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
""",
    "op11_warc": """
with x as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select *, case when n >= 1000 then max(page_id) over (partition by html) end as first from x)
select page_id, n as payload_bytes, sha1(html) as payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end as record_type,
  case when first is distinct from page_id then first end as refers_to
from f
""",
    "op12_fill_in_middle": r"""
with h as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as d from documents
), drawn as (
  select *, len(units) as n, list_transform([1, 9, 17, 25], lambda k: cast('0x' || substr(d, k, 8) as bigint)) as h from h
), cut as (
  select doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m, coalesce(array_to_string(units[b + 1:n], ''), '') as s from cut
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts
""",
    "op13_hard_negatives": """
with x as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as anchor_id, x.vec_id, q.label = x.label as same, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) as bigint) as score
  from x q join x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), ranked as (
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select * from ranked where rank <= 10
""",
}

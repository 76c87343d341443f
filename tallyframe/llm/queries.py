"""The named queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The default place of the public byte-level vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_multi_index_hashing")
def multi_index_hashing(spark, folder):
    from tallyframe.llm.ann import nearest

    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_packing")
def packing(spark, folder):
    from tallyframe.llm.packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_path(), with_ids=False)


DEDUP_SQL = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws
  from documents),
starts as (
  select doc_id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) as h
  from (select doc_id, ws, unnest(range(greatest(len(ws) - 49, 0))) as p from w)),
lows as (select h, min(doc_id) as low from starts group by h having min(doc_id) < max(doc_id)),
gone as (
  select doc_id, list(distinct p + k) as positions
  from starts join lows using (h), range(50) as r(k) where doc_id > low group by doc_id),
kept as (
  select w.doc_id, len(ws) as n, coalesce(len(positions), 0) as removed,
    case when positions is null then ws else
      [x for x, i in ws if not list_contains(positions, i - 1)] end as left_words
  from w left join gone using (doc_id))
select doc_id, n::bigint as n_words, removed::bigint as n_removed,
  sha256(array_to_string(left_words, ' ')) as kept_sha256
from kept
"""


@query("op4_substring_dedup", DEDUP_SQL)
def substring_dedup(spark, folder):
    from tallyframe.llm.substring_dedup import substring_dedup as dedup

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_rank_order_language")
def rank_order_language(spark, folder):
    from tallyframe.llm.common import crc32_mod
    from tallyframe.llm.language_id import identify, learn_profiles

    docs = table(spark, folder, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    profiles = learn_profiles(docs.filter(~held_out).select("text", "lang"), "text", "lang")
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


WARC_SQL = """
with hashed as (
  select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
firsts as (select h, min(page_id) as first_id from hashed group by h)
select page_id, octet_length(encode(hashed.h))::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, (x // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (x % 4))) & 31)::int + 1, 1)
    for x in range(32)], '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from hashed join firsts using (h)
"""


@query("op5_warc_assembly", WARC_SQL)
def warc_assembly(spark, folder):
    from tallyframe.llm.warc import assemble, read_records, write_archives
    from tallyframe.session import cut_lineage, shared_path

    path = shared_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    captures = assemble(cut_lineage(read_records(spark, path, with_payload=False), "records"))
    return captures.select(
        "page_id",
        "payload_bytes",
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


@query("op6_jaccard_join")
def jaccard_join(spark, folder):
    from tallyframe.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_quality_rules")
def quality_rules(spark, folder):
    from tallyframe.llm.quality import BASE
    from tallyframe.llm.quality import quality_rules as rules

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = rules(docs, with_text=False)
    return found.select("doc_id", *BASE, "log_perplexity", "low", "high", "kept")


@query("op7_trie_toxicity")
def trie_toxicity(spark, folder):
    from tallyframe.llm.common import crc32_mod
    from tallyframe.llm.toxicity import (
        fit_weights,
        labelled_texts,
        learn_lexicon,
        score_toxicity,
    )

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc32_mod("doc_id", 5) == 0
    labels = table(spark, folder, "labels").filter(~held_out)
    terms = learn_lexicon(labelled_texts(docs, labels))
    # five weights need no more rows than that
    weights = fit_weights(labelled_texts(docs, labels, bound=50_000), terms)
    found = score_toxicity(docs, terms, weights)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_log_bilinear_scores")
def log_bilinear_scores(spark, folder):
    from tallyframe.llm.common import crc32_mod
    from tallyframe.llm.lm_scoring import score_texts

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc32_mod("doc_id", 7) == 2
    found = score_texts(docs, ~held_out)
    return found.withColumn("held_out", held_out)


MIX_SQL = """
with sized as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from documents),
bits as (select *, bin(size) as b from sized),
placed as (
  select doc_id, source, size,
    (length(b) * 8 + ascii(substr(rpad(b, 4, '0'), 2, 1)) * 4 + ascii(substr(rpad(b, 4, '0'), 3, 1)) * 2
      + ascii(substr(rpad(b, 4, '0'), 4, 1)) - 48 * 7) * 64
      + ('0x' || substr(digest, 1, 2))::bigint % 64 as chunk
  from bits),
ranked as (
  select doc_id, source, size, row_number() over (
    partition by source order by chunk, size, doc_id) - 1 as place from placed),
totals as (
  select source, sum(size)::bigint as source_size,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as w
  from sized group by source),
filled as (
  select *, source_size * 3 as cap,
    sum(source_size) over () - coalesce(sum(source_size * 3) over f, 0) as left_size,
    sum(w) over () - coalesce(sum(w) over f, 0) as left_weight
  from totals window f as (order by source_size * 3 / w, source nulls last
    rows between unbounded preceding and 1 preceding)),
stopped as (select *, cap * left_weight <= left_size * w as stops from filled),
targets as (
  select source, source_size, case when stops then cap::double else
    (sum(source_size) over () - sum(case when stops then cap else 0 end) over ())::double * w
      / sum(case when stops then 0 else w end) over () end as target
  from stopped),
drawn as (
  select doc_id, size, source_size, target, place,
    ('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 6))::bigint / 16777216.0::double as u,
    case when source_size > 0 then target / source_size else 0.0 end as f
  from ranked r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * least(floor(u + f * (place + 1)) - floor(u + f * place), ceil(f)))::bigint as taken
from drawn
"""


@query("op10_systematic_mix", MIX_SQL)
def systematic_mix(spark, folder):
    from tallyframe.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


MAIN_TEXT_SQL = """
with cut as (
  select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') as body
  from pages),
blocks as (
  select page_id, url, list_filter(list_transform(
    regexp_split_to_array(replace(regexp_replace(body, '</?b>', '', 'g'), '<br>', ' '), '</?(p|h1)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(b, '&quot;', '"'), '&amp;?', '&', 'g'),
      '\\s+', ' ', 'g'))), lambda b: b <> '') as kept
  from cut)
select page_id, url, coalesce(array_to_string(kept, chr(10)), '') as text,
  length(coalesce(array_to_string(kept, chr(10)), ''))::bigint as n_chars
from blocks
"""


@query("op11_main_text", MAIN_TEXT_SQL)
def main_text(spark, folder):
    from tallyframe.llm.main_text import extract_main_text

    found = extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


@query("op12_whitening")
def whitening(spark, folder):
    from tallyframe.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


HARD_NEGATIVES_SQL = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, s.vec_id as negative_id,
  positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not same
  and 80 * positive_score <= 100 * s.score and s.score <= positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)
qualify rank <= 5
"""


@query("op13_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negatives(spark, folder):
    from tallyframe.llm.hard_negatives import mine_hard_negatives

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    return dict(SQL)

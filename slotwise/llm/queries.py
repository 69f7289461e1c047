"""Registered queries of the operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import bpe, dedup, jaccard, language, lm, mixing, packing, quality, token_files, top_k, turns, variants, wrappers
from slotwise.llm.vocabulary import vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_table(spark, sf_dir, "documents"), dedup.fresh_index(spark))


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), digests=True)


def op4_log_frequency_filter_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(_table(spark, sf_dir, "pages"))


def op11_gram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(_table(spark, sf_dir, "conversations"))
    return turns.digests(turns.repaired(rows, F.col("times")))


def op13_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).drop("source")


_OP1 = """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from e as q join e as c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
       vec_id, score
from s
qualify rank <= 10
"""

_OP2 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), w as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w
"""


_OP13 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('13:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as digest
  from documents
), n as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) as place
  from d group by source
), w as (
  select source, source_size, 3 * source_size as cap, case place % 3 when 1 then 5 when 2 then 2 else 1 end as weight from n
), o as (
  select *, sum(source_size) over () as total,
         coalesce(sum(cap) over before, 0) as caps, sum(weight) over () - coalesce(sum(weight) over before, 0) as free
  from w
  window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (
  select *, cap * free < (total - caps) * weight as above from o
), l as (
  select any_value(total) - coalesce(sum(cap) filter (where above), 0) as share,
         sum(weight) filter (where not above) as free
  from c
), t as (
  select source, source_size,
         case when above then cast(cap as double)
              else cast(cast(l.share * weight as bigint) as double) / cast(l.free as double) end as target
  from c, l
), r as (
  select source, cast(source_size as bigint) as source_size, target,
         case when source_size > 0 then cast(floor(target + 0.5) as bigint) // cast(source_size as bigint) else 0 end as whole
  from t
), x as (
  select d.doc_id, d.size, r.source_size, r.target, r.whole,
         cast(floor(r.target + 0.5) as bigint) - r.whole * r.source_size
           - coalesce(sum(d.size) over (partition by d.source order by d.digest rows between unbounded preceding and 1 preceding), 0) as room
  from d join r on d.source is not distinct from r.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(whole * size + greatest(0, least(size, room)) as bigint) as taken
from x
"""


def queries() -> dict[str, Query]:
    return {
        "op1_norm_sorted_top_k": op1_norm_sorted_top_k,
        "op2_digest_index_dedup": op2_digest_index_dedup,
        "op3_trie_bpe": op3_trie_bpe,
        "op4_log_frequency_filter_lm": op4_log_frequency_filter_lm,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_token_files": op6_token_files,
        "op7_byte_cnn_quality": op7_byte_cnn_quality,
        "op8_cross_parsing_language": op8_cross_parsing_language,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_wrapper_induction": op10_wrapper_induction,
        "op11_gram_spelling_variants": op11_gram_spelling_variants,
        "op12_turn_alignment": op12_turn_alignment,
        "op13_water_filled_mix": op13_water_filled_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_norm_sorted_top_k": _OP1, "op2_digest_index_dedup": _OP2, "op13_water_filled_mix": _OP13}

"""The registered queries of this subpackage, over the whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import table
from tagloom.llm.licenses import license_sql


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op8_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tagloom.llm.packing import pack_documents

    file = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), file, public_tokenizers.PATTERN)


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.suffix import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), words=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_run_words")


def op10_interpolated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.lm import interpolated_scores

    return interpolated_scores(table(spark, sf_dir, "documents"), folds=7, left_out=2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.negatives import hard_negatives

    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=turned)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tagloom.llm.alignment import align_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(table(spark, sf_dir, "documents"), *files)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_source_mix": op4_source_mix,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_simhash_classes": op6_simhash_classes,
    "op7_byte_shards": op7_byte_shards,
    "op8_packed_sequences": op8_packed_sequences,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_interpolated_scores": op10_interpolated_scores,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

OP1_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as ints
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.ints, c.ints)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP4_SQL = r"""
with d as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           case when length(coalesce(text, '')) > 0 then
               greatest(0.25::double, 1::double - 2::double
                   * (length(text) - length(translate(text, '%$#&*|!<>{}[]=_~^@+\/', ''))) / length(text))
           else 1::double end as quality
    from documents
), keyed as (
    select *, -ln((('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || size), 1, 13))::bigint + 0.5::double)
                  / 4503599627370496::double) / quality as sort_key
    from d
), sources as (
    select source, sum(size)::bigint as source_size,
           ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
    from d group by source
), levels as (
    select *, 3::double * source_size as cap_size,
           ((sum(source_size) over ())::double
            - coalesce(sum(3::double * source_size) over (
                order by 3::double * source_size / weight, source nulls last
                rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (
                order by 3::double * source_size / weight, source nulls last
                rows between current row and unbounded following) as level
    from sources
), targets as (
    select source, source_size, least(cap_size, weight * max(level) over ()) as target from levels
), placed as (
    select k.doc_id, k.size, t.source_size, t.target,
           case when t.source_size > 0 then least(3, floor(t.target / t.source_size)) else 0 end as epochs,
           coalesce(sum(k.size) over (
               partition by k.source order by k.sort_key, k.doc_id, k.size
               rows between unbounded preceding and 1 preceding), 0) as before
    from keyed k join targets t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (size * (epochs + case when epochs < 3 and before + size / 2::double <= target - epochs * source_size
                              then 1 else 0 end))::bigint as taken
from placed
"""

OP11_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as ints
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.ints, c.ints)::bigint as score
    from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score,
           row_number() over (partition by anchor_id order by score desc, vec_id) as turn
    from scored where same
), windows as (
    select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
           row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::integer as rank
    from positives p join scored s
      on p.anchor_id = s.anchor_id and not s.same
         and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
    where turn <= 5
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from windows where rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op4_source_mix": OP4_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_license_scan": license_sql(),
}

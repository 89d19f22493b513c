"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sharding import shard_documents
    return shard_documents(_table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


OP4_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as c from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 75 * (x.c + y.c - p.c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select m.doc_id, coalesce(n.c, 0) as n_shingles, component_id, m.doc_id = component_id as kept
from m left join n on n.doc_id = m.doc_id
"""


@query("op4_near_dedup", OP4_SQL)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.minhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
           from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.exact import exact_dedup
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("member", "text_hash")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line,
             unnest(range(len(string_split(text, chr(10))))) as pos from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, bad.key is not null and k.doc_id <> bad.top as gone from k left join bad on k.key = bad.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lines import dedup_lines
    return dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import toxicity_scores
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import encode_digests
    return encode_digests(_table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import quality_scores
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP6_SQL = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b
      on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings
      union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from c left join n using (vec_id)
"""


@query("op6_embedding_dedup", OP6_SQL)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.embed import embedding_duplicates
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def _op2_sql() -> str:
    from quillspark.llm.licenses import canonical_sql, plain_digests
    marked, done = canonical_sql("text")
    known = ", ".join(f"('{digest}', '{license_id}')" for digest, license_id in sorted(plain_digests().items()))
    return f"""
with known as (select digest, license_id from (values {known}) as v(digest, license_id)),
m as (select doc_id, {marked} as m from (select doc_id, coalesce(text, '') as text from documents)),
t as (select doc_id, sha256({done.format("m")}) as text_digest from m),
l as (select doc_id, sha256({done.format("line")}) as digest
      from (select doc_id, unnest(string_split(m, chr(10))) as line from m)),
f as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as line_licenses
      from l join known using (digest) group by doc_id)
select t.doc_id, text_digest, known.license_id, f.line_licenses
from t left join known on known.digest = t.text_digest left join f on f.doc_id = t.doc_id
"""


@query("op2_licenses", _op2_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.licenses import scan_licenses
    return scan_licenses(_table(spark, sf_dir, "documents"))


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import pii_digests
    return pii_digests(_table(spark, sf_dir, "documents"))


@query("op12_align")
def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.align import alignment_counts
    return alignment_counts(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.e, b.e)::bigint as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not same
       and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.negatives import hard_negatives
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)

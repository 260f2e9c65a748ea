"""Registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import (
    bpe, interpolation, length_buckets, multi_index, order_minhash, pivot_clusters, quality, repeats, simhash,
    token_files, toxicity, url_rules, word_runs,
)
from wirelens.llm.common import WORD, bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def clusters_sql(clusters: int, rounds: int, seed: int) -> str:
    """Centroids in DuckDB, a round after the other; sums and counts give exact floors."""
    steps = [
        """kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as units
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, units as center
  from kept order by cluster limit {clusters})""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""n{k} as materialized (select vec_id, min(struct_pack(d := list_sum(list_transform(list_zip(units, center),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := cluster)) as best, any_value(units) as units from kept, c{k} group by vec_id)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} as materialized (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as center
  from (select cluster, pos, sum(units[pos]) as s, count(*) as n
    from (select best.c as cluster, units, unnest(range(1, 65)) as pos from n{k}) group by cluster, pos) group by cluster)"""
            )
            steps.append(
                f"""c{k + 1} as materialized (select c{k}.cluster, coalesce(m{k}.center, c{k}.center) as center from c{k} left join m{k} using (cluster))"""
            )
    return "with " + ",\n".join(steps) + f"""
select vec_id, cast(best.c as integer) as cluster, cast(best.d as bigint) as distance,
  cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(center, ',')) as centroid_sha256
from n{rounds} join c{rounds} on c{rounds}.cluster = best.c"""


@query
def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level BPE of all documents, there and back."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe.build_lexicon(bpe.frequent_words(docs, path), path)
    found = bpe.round_trip(docs, path, lexicon)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and their likeness to the edited text and the next document."""
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by five nested rules."""
    rules = spark.sql(
        """select * from values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        as rules(host, path, verdict)"""
    )
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


ORACLES["op4_url_rules"] = """
with rules(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts as (select page_id, url,
  case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts)
select page_id, coalesce(s.host, '') as host, coalesce(s.path, '') as path,
  (select arg_max(r.host || r.path, length(r.host || r.path)) from rules r where starts_with(s.path, r.path)
    and (s.host = r.host or ends_with(s.host, '.' || r.host))) as rule,
  coalesce((select arg_max(r.verdict, length(r.host || r.path)) from rules r where starts_with(s.path, r.path)
    and (s.host = r.host or ends_with(s.host, '.' || r.host))), 'allow') as verdict
from split s"""


def n_words(column: str = "text"):
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


@query
def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all documents, each counted as its words and an end."""
    return length_buckets.pack(table(spark, sf_dir, "documents"), n_words() + 1)


@query
def op6_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that an earlier document has too."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in up to three bits."""
    found = simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=3)
    groups = simhash.near_duplicates(found, radius=3)
    return groups.select(
        "doc_id", simhash.hexadecimal().alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by models that learn from six sevenths of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = interpolation.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of all documents through packed files and back."""
    folder, files, n = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    found = token_files.read_token_files(spark, folder, files, n)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from their text and their source and language as host and path."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    return found.select("row.doc_id", "evidence", "site_share", "probability", "accepted")


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, and the documents without the repetitions."""
    return word_runs.digests(word_runs.word_runs(table(spark, sf_dir, "documents"), tails=True))


@query
def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in forty clusters after five rounds."""
    found = pivot_clusters.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2)
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(listed.cast("binary"), 256).alias("centroid_sha256"),
    )


ORACLES["op12_pivot_clusters"] = clusters_sql(clusters=40, rounds=5, seed=2)


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a lexicon that learns from two thirds of the labelled ones."""

    def held_out(doc_id: str):
        return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels.where(~held_out("doc_id")))
    found = toxicity.score(docs, lexicon)
    return found.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )

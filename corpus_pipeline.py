"""The documents' way through the pipeline: quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the
last give rows with the columns of documents; the last gives every document's place in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import length_buckets, quality, repeats, simhash
from wirelens.llm.common import bounded_batches
from wirelens.llm.queries import n_words
from wirelens.session import broadcast_table, measured_table, scratch_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts, sources and languages are empty ones; repeated rows are each judged. Without labels of both kinds
    all stay, an empty table stays empty, and all columns pass as they are, whatever their names.
    """
    labels = bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels, "quality").where("accepted").select("row.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHashes of three-word shingles, up to three bits apart, the smallest id.

    Rows without an id are in no group and stay; rows that repeat an id go or stay together. Texts without words
    are copies of each other. An empty table stays empty; other columns pass as they are.
    """
    bounded_batches(spark)
    groups = simhash.near_duplicates(simhash.fingerprints(docs, shingle=3), radius=3)
    dropped, seen = measured_table(groups.where("doc_id != component").select("doc_id").distinct(), "similar")
    return docs.join(broadcast_table(dropped, seen["n"]), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes that an earlier document has too.

    A character goes when all its bytes do. Documents of which nothing is left go; null and empty texts stay, as
    empty ones. Rows without an id lose nothing, rows that repeat an id don't affect each other. An empty table
    stays empty; other columns pass as they are, but for `n_chars`, which goes with the text.
    """
    bounded_batches(spark)
    found = repeats.remove_repeats(docs, length=50, whole_characters=True)
    text = F.decode("kept", "UTF-8")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    left = found.where((F.size("starts") == 0) | (F.octet_length("kept") > 0))
    return left.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot; it counts as its words and an end.

    Null and empty texts count one. Rows without an id and rows that repeat one are each placed; an empty table
    gives no rows.
    """
    return length_buckets.pack(docs, n_words() + 1)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_similar),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: Logistic regression, signatures, suffix order and dynamic programming are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

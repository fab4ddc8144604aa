"""Stages of the corpus pipeline: each applies one operator to all of its documents.

All but the last return the columns of the documents they get, whatever those
are. Rows with null or empty texts pass unless a stage says otherwise; very long
texts are worked on whole; repeated rows are rows of their own unless a stage
says otherwise; an empty table gives an empty one; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, line_dedup, mixing, simhash
from .common import table, text_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; a text that is null or has no letter goes.

    Prototypes are learned from all rows that have a label; without any, no
    language can be told and every document that has a letter stays.
    """
    labels, prototypes = langid.fit(docs)
    names = [f"_{i}" for i in range(len(docs.columns))]
    found = langid.predict(docs.toDF(*names), labels, prototypes, text=names[docs.columns.index("text")], names_out=("_lang", "_score", "_margin"))
    if labels:
        found = found.filter(F.col("_lang") != langid.UND)
    else:
        found = found.filter(F.col(names[docs.columns.index("text")]).rlike(r"\p{L}"))
    return found.select(*names).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on ten sites or more; a text that loses all lines stays, empty."""
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of its smallest doc_id, null last, and one row of it.

    Null and empty texts are near copies of each other. Of equal ids with
    different texts the one with the smaller hash stays.
    """
    keyed = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), *text_key(docs["text"]))
    marked = simhash.near_duplicates(keyed, ["doc_id", "_k1", "_k2"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2"))
    keepers = marked.groupBy("root").agg(least.alias("r")).select(F.col("r.doc_id").alias("_id"), "r._k1", "r._k2")
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    rows = rows.withColumns(dict(zip(("_a", "_b"), text_key(rows[names[docs.columns.index("text")]]), strict=True)))
    own = rows[names[docs.columns.index("doc_id")]]
    same = own.eqNullSafe(keepers["_id"]) & (rows["_a"] == keepers["_k1"]) & (rows["_b"] == keepers["_k2"])
    kept = rows.join(keepers, same, "left_semi").dropDuplicates([names[docs.columns.index("doc_id")], "_a", "_b"])
    return kept.select(*names).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; those without words never are, and an empty benchmark keeps all."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter(decontaminate.is_contaminated())
    gone = found.select(F.col("doc_id").alias("_id"), F.col("_k1").alias("_a"), F.col("_k2").alias("_b")).distinct()
    first, second = text_key(docs["text"])
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (first == gone["_a"]) & (second == gone["_b"])
    return docs.join(gone, same, "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is drawn, with its shard and place; texts without words are never drawn."""
    return mixing.draw(docs)

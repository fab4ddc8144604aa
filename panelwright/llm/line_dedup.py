"""Removal of lines that spread over many sites; DataFrame functions only.

A HyperLogLog sketch of sites per line hash is built by aggregation. Estimates
well above the threshold decide; lines near it are counted exactly. A line is
removed everywhere if it is on ``min_sites`` sites or more.

Defined cases: a line is compared without the white space around it; lines
without any other character are never removed; a null text has no lines and
stays null; a text that loses all lines becomes empty; a null source is no
site; a line repeated in one site counts once; repeated rows and null doc_ids
are kept as rows of their own; very long texts are split whole; a line on
exactly min_sites sites is removed, so ties need no order; an empty table gives
no row. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key

LG_K = 12
#: Estimates below min_sites * (1 - BAND) or from min_sites * (1 + BAND) up need no exact count; the standard error is 1.6 %.
BAND = 0.15


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2 of the lines on min_sites sites or more, from rows (h1, h2, source)."""
    sites = lines.filter("source is not null").groupBy("h1", "h2").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"))
    guess = sites.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).filter(
        F.col("sites") >= min_sites * (1 - BAND)
    )
    guess = cut(guess, "spread")
    sure = guess.filter(F.col("sites") >= min_sites * (1 + BAND)).select("h1", "h2")
    near = guess.filter(F.col("sites") < min_sites * (1 + BAND)).select("h1", "h2")
    counted = (
        lines.join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "source")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("source").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("h1", "h2")
    )
    return sure.unionByName(counted)


def mark_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """docs with _lines, its lines or null, and _bad, the numbers of those to remove."""
    keyed = docs.select(
        docs["doc_id"].alias("_id"), docs["source"].alias("source"), *text_key(docs["text"]),
        F.posexplode(F.split(docs["text"], "\n")).alias("at", "line"),
    ).withColumn("line", _bare(F.col("line"))).filter("line <> ''")
    lines = cut(
        keyed.select("_id", "_k1", "_k2", "at", "source", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")),
        "lines",
    )
    spread = spread_lines(lines.select("h1", "h2", "source"), min_sites)
    bad = (
        lines.join(spread, ["h1", "h2"], "left_semi")
        .groupBy("_id", "_k1", "_k2")
        .agg(F.collect_set("at").alias("_bad"))
    )
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["doc_id"].alias("_id"), *text_key(docs["text"]))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_id", "_k1", "_k2")]
    return (
        rows.alias("d")
        .join(bad.alias("b"), same, "left")
        .select("_row", F.split("_row.text", "\n").alias("_lines"), F.coalesce("_bad", F.expr("cast(array() as array<int>)")).alias("_bad"))
    )


def kept_lines() -> Column:
    return F.filter("_lines", lambda x, i: ~F.array_contains("_bad", i))


def dedup_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """docs with the spread lines taken out of text; n_chars, where there is one, follows."""
    marked = mark_lines(docs, min_sites)
    text = F.when(F.size("_bad") == 0, F.col("_row.text")).otherwise(F.array_join(kept_lines(), "\n"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.size("_bad") == 0, F.col("_row.n_chars")).otherwise(F.length(text)).cast(kind).alias(c))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return marked.select(*out)

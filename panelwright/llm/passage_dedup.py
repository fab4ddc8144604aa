"""Removal of long passages that an earlier document has, by FM-indexes.

Runs of windows whose anchor stands in more than one document go, with their
words, to shards by that anchor. A shard indexes its distinct passages, streams
each through the index and takes, for every window whose matching statistic
reaches ``LENGTH`` words, the smallest document that has it. A word is removed
if some window over it also starts in a document with a smaller doc_id.

An anchor with more than ``HOT`` distinct passages, some 300 KB of text, is
split: its passages go window by window, dealt by the window's hash.

Defined cases: a null text has no words; a document with a null doc_id is
neither earlier nor later than any other, so it is kept whole and removes
nothing; repeated rows with one doc_id do not remove each other; texts shorter
than a window are kept; very long texts are read whole; an empty table gives no
row. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import cut, map_arrow
from .fm_index import FMIndex
from .repeats import Unit, groups_of, passages, remove_spans, run_rows

LENGTH = 50
GRAM = 16
HOT = 500
SHARD_BYTES = 2 << 20


def earliest(bodies: pa.Array, lows: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each window of each passage, in order, the smallest document number that has its words."""
    data, offsets = nt.column_bytes(bodies)
    chunk = nt.Chunk(slice(0, len(bodies)), data, offsets)
    starts, ends, of = chunk.words()
    kinds, symbols = np.unique(nt.SpanHash(data)(starts, ends), return_inverse=True)
    # A separator, symbol 0, ends every passage.
    n = len(symbols) + len(bodies)
    text = np.zeros(n, np.int64)
    owner = np.repeat(np.arange(len(bodies)), np.diff(of))
    text[np.arange(len(symbols)) + owner] = symbols + 1
    index = FMIndex(text, len(kinds) + 1, length, np.repeat(lows, np.diff(of) + 1))
    size, place = index.matches(symbols + 1, of)
    found = index.least(place)
    found = np.where(size >= length, found, np.iinfo(np.int64).max)
    # A passage has as many windows as it counts; they begin at its first words.
    return found[np.repeat(of[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def _shards(length: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, SHARD_BYTES):
            counts = t["count"].to_numpy().astype(np.int64)
            m = earliest(t["body"].combine_chunks(), t["weight"].to_numpy(), counts, length)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(m))
            yield pa.RecordBatch.from_arrays(
                [t[c].combine_chunks() for c in ("g", "h", "base")] + [lists], names=["g", "h", "base", "m"]
            )

    return search


def _later(length: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m")
            size = np.asarray(m.value_lengths())
            of = np.concatenate([[0], np.cumsum(size)])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            gone = m.flatten().to_numpy(zero_copy_only=False) < np.repeat(ids, size)
            # A gap between rows keeps their runs apart.
            padded = np.zeros(len(gone) + len(size), bool)
            row = nt.owners(of)
            padded[np.arange(len(gone)) + row] = gone
            a, b = nt.runs_of(padded)
            row = np.searchsorted(of + np.arange(len(of)), a, "right") - 1
            shift = (batch.column("first").to_numpy() + batch.column("base").to_numpy())[row] - (of + np.arange(len(of)))[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), batch.column("_k1").take(take),
                    pa.array((a + shift).astype(np.int32)), pa.array((b + shift - 1 + length).astype(np.int32)),
                ],
                names=["doc_id", "_k1", "a", "b"],
            )

    return spans


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, _k1, a, b: spans of words that an earlier document has; they may overlap."""
    unit = Unit(True, length, gram)
    rows = cut(run_rows(docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")), unit), "runs")
    shared = rows.groupBy("g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("g")
    # Written first, so that neither side of the join has to stand whole in a task and hot anchors can be split.
    rows = cut(rows.join(cut(shared, "anchors"), "g", "left_semi"), "shared")
    kinds = rows.groupBy("g", "h").agg(F.min(F.struct("doc_id", "_k1", "first", "count")).alias("r"))
    kinds = cut(kinds.select("g", "h", "r.*"), "kinds")
    crowded = kinds.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("g", F.lit(True).alias("hot"))
    crowded = cut(crowded, "crowded")
    wanted = kinds.join(crowded, "g", "left").select(
        "doc_id", "_k1", "first", "count", "g", "h", F.col("doc_id").alias("weight"), F.coalesce("hot", F.lit(False)).alias("hot")
    )
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bodies = passages(typed, wanted, unit).repartition("g", "salt").sortWithinPartitions("g", "salt")
    found = cut(map_arrow(bodies, _shards(length), "g long, h long, base int, m array<long>"), "earliest")
    joined = rows.join(found, ["g", "h"]).select("doc_id", "_k1", "first", "base", "m")
    return map_arrow(joined, _later(length), "doc_id long, _k1 long, a int, b int")


def dedup_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n (words), n_removed, n_spans and kept: the words left, joined by one space, as UTF-8."""
    spans = repeated_passages(docs, length, gram)
    return remove_spans(docs, spans, Unit(True, length, gram))

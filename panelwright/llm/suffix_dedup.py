"""Removal of long byte strings that occur twice, by distributed prefix doubling.

Rows are positions; their ranks name ever longer strings that begin there, and
a row leaves once its rank is unique or the string is past the threshold.

* Rank of an anchor (``GRAM`` bytes): every window of ``length`` bytes is put
  down to its smallest-hashed gram, so equal windows have equal anchors at equal
  places. Runs of windows with an anchor that occurs once leave.
* Rank of a run, all of whose windows share an anchor: an equal run is past the
  threshold, so all of it is repeated. Each different run goes on once, as
  positions 8 bytes apart, counted from the anchor.
* Rank 2L, from the pair (rank of L bytes here, rank of L bytes at offset L),
  where 2L + 8 is the length. Spark sorts these pairs and drops unique ones. The
  up to eight windows that end at or begin before a position share its string.
* Rank of 2L + 15 bytes: the pair (rank of 2L, the bytes beside it) names all
  eight windows at once; where it repeats they are past the threshold.
* Rank of the threshold: what is left goes on window by window, as pairs of
  rank 2L and the up to eight bytes that a window has besides.

Counts are combined before each shuffle, and rows meet them in joins whose large
side is read from a table, so that the rows of a frequent rank can be split.

Defined cases: a null text is an empty one; matches lie within one text, and
may overlap; repeated rows are repeated texts; null doc_ids take part; all of
several equal strings go, so ties need no order; texts shorter than the length
are kept; very long texts are read whole; an empty table gives no row. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import cut, drop, few, map_arrow, text_key
from .repeats import Unit, remove_spans, run_rows

LENGTH = 200
GRAM = 48
#: Positions on a run are so many bytes apart.
STEP = 8


def steps_of(first: np.ndarray, count: np.ndarray, lean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows, the positions that stand for it: the run, the position, how far before it the last and the first of its windows begin."""
    last = first + count - 1
    n = 1 + np.maximum(0, -(-(count - 1 - lean) // STEP))
    run = np.repeat(np.arange(len(first)), n)
    at = (first + lean)[run] + STEP * (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    return run, at, at - np.minimum(last[run], at), at - np.maximum(first[run], at - STEP + 1)


def _beside(data: np.ndarray, at: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes at[i] .. at[i] + size as one number, the first the highest; zero where out of the document."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = (at + k >= low) & (at + k < high)
        byte = np.where(inside, data[np.clip(at + k, 0, len(data) - 1)], 0)
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out


def positions(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The positions of the wanted runs (doc_id, _k1, first, count, lean, weight), with their ranks.

    doc_id, _k1, p; near, far: the windows that begin between far and near bytes
    before p; weight; a, b: names of L bytes from p and p + L; l, r: the seven
    bytes before and the eight bytes after these strings.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    half = (length - STEP) // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for chunk in nt.chunks(batch.column(2)):
                own = lists.slice(chunk.rows.start, chunk.n)
                flat = own.flatten()
                doc = np.repeat(np.arange(chunk.n), np.asarray(own.value_lengths().fill_null(0)))
                first, count, lean, weight = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                run, at, near, far = steps_of(first, count, lean)
                if not len(run):
                    continue
                doc, base = doc[run], chunk.offsets[doc[run]]
                at = at + base
                spans = nt.SpanHash(chunk.data)
                low, high = base, chunk.offsets[doc + 1]
                take = pa.array(doc + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array((at - base).astype(np.int32)),
                        pa.array(near.astype(np.int8)), pa.array(far.astype(np.int8)), pa.array(weight[run].astype(np.int8)),
                        pa.array(nt.as_long(spans(at, at + half))), pa.array(nt.as_long(spans(at + half, at + 2 * half))),
                        pa.array(nt.as_long(_beside(chunk.data, at - STEP + 1, STEP - 1, low, high))),
                        pa.array(nt.as_long(_beside(chunk.data, at + 2 * half, STEP, low, high))),
                    ],
                    names=["doc_id", "_k1", "p", "near", "far", "weight", "a", "b", "l", "r"],
                )

    by_doc = wanted.groupBy("doc_id", "_k1").agg(F.collect_list(F.struct("first", "count", "lean", "weight")).alias("want"))
    # Repeated rows of documents give one text.
    texts = docs.select("doc_id", text_key(F.col("text"))[0], "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._k1") == F.col("w._k1"))
    found = texts.alias("d").join(by_doc.alias("w"), same).select("d.doc_id", "d._k1", "d.text", "want")
    # Of rows that are equal all runs have weight 2, so it does no harm that they come twice.
    return map_arrow(
        found, read, f"doc_id {kind}, _k1 long, p int, near tinyint, far tinyint, weight tinyint, a long, b long, l long, r long",
    )


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, _k1, a, b: spans of the windows of ``rows`` of weight 1 that repeat in rows; rows: what positions gives, written; it is dropped."""
    rank = ["a", "b"]
    twice = F.col("n") > 1
    # Unique ranks of 2L bytes leave.
    pairs = rows.groupBy(*rank).agg(F.sum("weight").alias("n")).filter(twice)
    pairs = cut(few(pairs.select(*rank)), "pairs")
    left = cut(rows.join(pairs, rank, "left_semi"), "left")
    drop(rows, pairs)
    # Ranks of what all windows of a position cover: past the threshold where they repeat.
    wide = [*rank, "l", "r", "near", "far"]
    least = F.min(F.when(F.col("weight") == 1, F.struct("doc_id", "_k1", "p"))).alias("own")
    names = cut(left.groupBy(*wide).agg(F.sum("weight").alias("n"), least), "names")
    past = left.filter("weight = 1").join(names.filter(twice).select(*wide), wide, "left_semi")
    whole = past.select("doc_id", "_k1", (F.col("p") - F.col("far")).alias("a"), (F.col("p") - F.col("near") + length).alias("b"))
    # Window by window, where some position of the rank is still alone.
    alone = cut(few(names.filter("n = 1").select(*rank).distinct()), "alone")
    window = names.join(alone, rank, "left_semi").select(
        *rank, "n", "own", "l", "r", F.explode(F.sequence(F.col("near").cast("int"), F.col("far").cast("int"))).alias("t")
    )
    # A window that begins t bytes before has t bytes on the left and the others on the right.
    window = cut(
        window.select(
            *rank, "n", "own", "t",
            F.expr("l & (shiftleft(1L, 8 * t) - 1)").alias("x"), F.expr("shiftrightunsigned(r, 8 * t)").alias("y"),
        ),
        "windows",
    )
    key = [*rank, "t", "x", "y"]
    equal = window.groupBy(*key).agg(F.sum("n").alias("n")).filter(twice).select(*key)
    single = window.filter("n = 1").join(equal, key, "left_semi").select("own.*", "t")
    start = F.col("p") - F.col("t")
    return whole.unionByName(single.select("doc_id", "_k1", start.alias("a"), (start + length).alias("b")))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, _k1, a, b: spans of bytes that occur twice or more; they may overlap."""
    runs = cut(run_rows(docs, Unit(False, length, gram)), "runs")
    anchors = cut(few(runs.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")), "anchors")
    # Written first, so that neither side of the join has to stand whole in a task and hot anchors can be split.
    shared = cut(runs.join(anchors, "g", "left_semi"), "shared")
    drop(runs, anchors)
    one = F.min(F.struct("doc_id", "_k1", "first", "count", "lean")).alias("r")
    kinds = cut(shared.groupBy("g", "h").agg(F.count("*").alias("n"), one), "kinds")
    equal = shared.join(kinds.filter("n > 1").select("g", "h"), ["g", "h"], "left_semi")
    whole = equal.select("doc_id", "_k1", F.col("first").alias("a"), (F.col("first") + F.col("count") - 1 + length).alias("b"))
    # An anchor all of whose runs are equal is done; of the others each different run goes on once.
    several = kinds.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    several = cut(few(several), "several")
    wanted = kinds.join(several, "g", "left_semi").select("r.*", F.least("n", F.lit(2)).alias("weight"))
    rows = cut(positions(docs, wanted, length), "positions")
    drop(several)
    return whole.unionByName(repeated_windows(rows, length))


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n (bytes), n_removed, n_spans and kept: the bytes left."""
    return remove_spans(docs, repeated_strings(docs, length, gram), Unit(False, length, gram))

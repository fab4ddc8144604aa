"""SimHash fingerprints and their near-duplicate components.

Two fingerprints that differ in at most four of 64 bits differ in at most one
bit within one of three segments. Each segment is therefore indexed once for
each of its bits, with that bit as a wildcard: 64 keys a fingerprint. Distinct
fingerprints that share a key are compared whole, and each task keeps only a
spanning forest of the links that it finds, so that a large group gives no
more rows than it has members. A bucket of more than ``BUCKET`` fingerprints is
cut into blocks, and every pair of blocks is a unit of work of its own.

Defined cases: a null text, an empty one and one without words have
fingerprint zero, linked like any other; repeated rows share a component;
null doc_ids take part but are never a component's id unless it has no other;
a bit set in exactly half of the shingles is 0; very long texts are read whole;
an empty table gives no row. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import cut, map_arrow

WIDTH = 4
MAX_BITS = 4
#: (lowest bit, number of bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET = 4096
BATCH = 1 << 20


def joined_words(chunk: nt.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each; their starts and ends in it, and where each document's begin."""
    starts, ends, of_doc = chunk.words()
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    filled = np.ones(at[-1], bool)
    filled[at[1:] - 1] = False
    out[filled] = nt.LOWER[chunk.data[nt.WORD[chunk.data]]]
    return out, at[:-1], at[1:] - 1, of_doc


def fingerprints(chunk: nt.Chunk, width: int = WIDTH) -> np.ndarray:
    text, starts, ends, of_doc = joined_words(chunk)
    raw, prints = text.tobytes(), np.zeros(chunk.n, np.uint64)
    n_words = np.diff(of_doc)
    n_grams = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n_grams)])
    doc = nt.owners(first)
    head = of_doc[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    tail = np.minimum(head + width, of_doc[1:][doc]) - 1
    xx = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (xx(raw[a:b], 42) for a, b in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)), np.uint64, len(head)
    )
    full = np.flatnonzero(n_grams)
    if len(full):
        step = max(1, (1 << 19) // max(1, int(n_grams.max())))
        for i in range(0, len(full), step):
            own = full[i : i + step]
            a, b = first[own[0]], first[own[-1] + 1]
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, first[own] - a, axis=0, dtype=np.int32)
            votes = (2 * ones > n_grams[own][:, None]).astype(np.uint8)
            prints[own] = np.packbits(votes, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return prints


def add_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and fp, the fingerprint of text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for chunk in nt.chunks(batch.column(0)):
                fp[chunk.rows] = fingerprints(chunk)
            cols = [batch.column(i) for i in range(1, len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(nt.as_long(fp))], names=[*keep, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(F.col("text").alias("_text"), *keep), run, f"{kinds}, fp long")


def variants() -> list:
    """The 64 keys of column fp: segment, wildcard and the segment without that bit."""
    keys = []
    for low, n in SEGMENTS:
        for b in range(n):
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            masked = part.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << b)).cast("long"))
            keys.append(masked + F.lit((low + b) << 32).cast("long"))
    return keys


def _compress(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; parent stays flat and points to smaller numbers."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
        parent = _compress(parent)
    return parent


def forest(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that span what is within MAX_BITS among rows of equal keys; keys are sorted."""
    nodes, node = np.unique(prints, return_inverse=True)
    parent = np.arange(len(nodes))
    ends = np.searchsorted(keys, keys, "right")
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        close = np.bitwise_count(prints[at] ^ prints[at + step]) <= MAX_BITS
        found = at[close]
        parent = _union(parent, node[found], node[found + step])
        step += 1
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[linked], nodes[parent[linked]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = forest(keys, prints.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(nt.as_long(u)), pa.array(nt.as_long(v))], names=["u", "v"])

    keys, prints, size = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        prints.append(batch.column(1).to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size >= BATCH:  # a key's rows stay together
            k, p = np.concatenate(keys), np.concatenate(prints)
            end = int(np.searchsorted(k, k[-1]))
            if end:
                yield out(k[:end], p[:end])
            keys, prints, size = [k[end:]], [p[end:]], 0
    if size:
        yield out(np.concatenate(keys), np.concatenate(prints))


def links(prints: DataFrame) -> DataFrame:
    """u, v: links that connect whatever of the distinct values of fp is connected, and nothing else."""
    keyed = prints.select("fp", F.explode(F.array(*variants())).alias("key"))
    exact = F.array(
        *[F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1).cast("long")) + F.lit(low << 32).cast("long") for low, n in SEGMENTS]
    )
    crowded = prints.select(F.explode(exact).alias("s")).groupBy("s").count().filter(F.col("count") > BUCKET // 2)
    keyed = keyed.select("key", "fp", F.lit(0).alias("unit"))
    if not crowded.isEmpty():
        # A bucket is two values of a segment, so only now can one exceed BUCKET.
        crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
        blocks = F.ceil(F.col("n") / BUCKET).cast("int")
        hot = crowds.select("key", blocks.alias("n_blocks"))
        both = keyed.join(hot, "key", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
        pair = lambda c: F.least(own, c) * F.col("n_blocks") + F.greatest(own, c)
        keyed = both.select(
            "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), pair)).alias("unit")
        )
    # One number a unit of work keeps the sort and the comparison simple.
    unit = F.when(F.col("unit") == 0, F.col("key")).otherwise(F.xxhash64("key", "unit"))
    dealt = keyed.select(unit.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, _forests, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, root: the smallest node of each component, for every node but that one.

    Large and small stars in turn until nothing changes; rows stay in the order
    of the number of nodes, and only two numbers a round come to the driver.
    """
    edges = cut(edges.filter("u <> v").distinct(), "links")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = sign(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, here and below, so that the links of one hub can be split over tasks when they are joined.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct(), "large")
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(lowest.select("u", F.col("m").alias("v")).unionByName(small).filter("u <> v").distinct(), "small")
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id is one), fp, root (the component's least fp) and component_id, one row a row of docs."""
    keep = keep or ["doc_id"]
    marked = cut(add_fingerprint(docs, keep), "prints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    stars = components(links(prints.select("fp")))
    rooted = cut(prints.join(stars, prints["fp"] == stars["u"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    of = rooted.select("fp", "root").join(lows, "root").select("fp", "root", "component_id")
    return marked.join(of, "fp").select(*keep, "fp", "root", "component_id")

"""Where strings of a fixed length repeat: the part that words and bytes share.

Every window of ``length`` elements is put down to one anchor, the smallest
hash among its runs of ``gram`` elements. Equal windows have equal anchors at
equal places, so windows can be told apart anchor by anchor. Neighbouring
windows with the same anchor are one run; a row stands for a run, not for a
window. Anchors that occur once leave at the first round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import map_arrow, text_key


@dataclass(frozen=True)
class Unit:
    """What a window is made of. By words: runs of anything but white space; else UTF-8 bytes."""

    by_words: bool
    length: int
    gram: int

    def elements(self, chunk: nt.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that stand for the elements, and where documents begin among them."""
        if not self.by_words:
            return chunk.data, chunk.offsets
        starts, ends, of_doc = chunk.words()
        return nt.SpanHash(chunk.data)(starts, ends), of_doc


def runs(elements: np.ndarray, offsets: np.ndarray, unit: Unit):
    """Runs of windows with one anchor: document, first window, number of windows, anchor's place, its hash, hash of the run's elements."""
    n, size = len(elements), unit.length
    if n < size:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = nt.SpanHash(elements)
    at = np.arange(n - unit.gram + 1)
    grams = spans(at, at + unit.gram)
    # A fixed number of bits, so that every chunk orders anchors alike; no text has more bytes.
    place = np.uint64((1 << 32) - 1)
    lowest = nt.window_min((grams & ~place) | at.astype(np.uint64), size - unit.gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(n - size + 1) + size <= ends[: n - size + 1])
    anchor = (lowest[starts] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(starts) else np.zeros(0, np.int64)
    first = starts[new]
    count = np.diff(np.append(new, len(starts)))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first, count, anchor[new], grams[anchor[new]], spans(first, first + count - 1 + size)


def run_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, _k1, first, count, lean, g, h: the runs of all documents, placed within their document.

    lean: how far the first window is from the next place that lies a multiple of eight before the anchor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in nt.chunks(batch.column(2)):
                elements, offsets = unit.elements(chunk)
                doc, first, count, anchor, g, h = runs(elements, offsets, unit)
                take = pa.array(doc + chunk.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take),
                        pa.array((first - offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
                        pa.array(((anchor - first) & 7).astype(np.int8)), pa.array(nt.as_long(g)), pa.array(nt.as_long(h)),
                    ],
                    names=["doc_id", "_k1", "first", "count", "lean", "g", "h"],
                )

    return map_arrow(
        docs.select("doc_id", text_key(F.col("text"))[0], "text"), scan, f"doc_id {kind}, _k1 long, first int, count int, lean tinyint, g long, h long"
    )


def passages(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """g, salt, h, base, count, weight and the bytes of the wanted runs' elements (words joined by one space).

    wanted: doc_id, _k1, first, count, g, h, weight, hot. A run whose anchor is
    hot is cut into its single windows, each dealt by its own hash (salt).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1)
            for chunk in nt.chunks(batch.column(0)):
                elements, offsets = unit.elements(chunk)
                spans = nt.SpanHash(elements)
                raw = chunk.data.tobytes()
                if unit.by_words:
                    starts, ends, _ = chunk.words()
                    starts, ends = starts.tolist(), ends.tolist()
                rows = []
                for d in range(chunk.n):
                    for r in want[chunk.rows.start + d].as_py():
                        a = int(offsets[d]) + r["first"]
                        cuts = [(i, 1) for i in range(r["count"])] if r["hot"] else [(0, r["count"])]
                        for base, count in cuts:
                            x, y = a + base, a + base + count - 1 + unit.length
                            salt = int(spans(np.array([x]), np.array([y])).view(np.int64)[0]) if r["hot"] else 0
                            if unit.by_words:
                                body = b" ".join([raw[s:e] for s, e in zip(starts[x:y], ends[x:y], strict=True)])
                            else:
                                body = raw[x:y]
                            rows.append((r["g"], salt, r["h"], base, count, r["weight"], body))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["g", "salt", "h", "base", "count", "weight", "body"],
                )

    fields = ["first", "count", "g", "h", "weight", "hot"]
    by_doc = wanted.groupBy("doc_id", "_k1").agg(F.collect_list(F.struct(*fields)).alias("want"))
    # Repeated rows of documents give one text.
    texts = docs.select("doc_id", text_key(F.col("text"))[0], "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._k1") == F.col("w._k1"))
    found = texts.alias("d").join(by_doc.alias("w"), same).select("d.text", "want")
    return map_arrow(found, read, "g long, salt long, h long, base int, count int, weight long, body binary")


def groups_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by (g, salt) as tables of about limit bytes of body, each group whole."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("body").nbytes
        if size >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            g, salt = table["g"].to_numpy(), table["salt"].to_numpy()
            end = int(np.flatnonzero((g != g[-1]) | (salt != salt[-1]))[-1]) + 1 if ((g != g[-1]) | (salt != salt[-1])).any() else 0
            if end:
                yield table.slice(0, end).combine_chunks()
                held, size = table.slice(end).to_batches(), table.slice(end)["body"].nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def remove_spans(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept (binary), one row a row of docs; spans: doc_id, _k1, a, b of elements to remove."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for chunk in nt.chunks(batch.column(1)):
                if unit.by_words:
                    starts, ends, offsets = chunk.words()
                else:
                    offsets = chunk.offsets
                n = int(offsets[-1])
                edge = np.zeros(n + 1, np.int64)
                own = lists.slice(chunk.rows.start, chunk.n)
                flat = own.flatten()
                if len(flat):
                    shift = np.repeat(offsets[:-1], np.asarray(own.value_lengths().fill_null(0)))
                    a = flat.field(0).to_numpy(zero_copy_only=False) + shift
                    b = flat.field(1).to_numpy(zero_copy_only=False) + shift
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < offsets[1:]]
                begins[heads] = gone[heads]
                total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])  # noqa: E731, B023
                kept = []
                if unit.by_words:
                    size = ends - starts
                    left = np.flatnonzero(~gone)
                    at = np.concatenate([[0], np.cumsum(size[left] + 1)])
                    keep_byte = np.zeros(len(chunk.data), np.int8)
                    keep_byte[starts[left]] = 1
                    tail = ends[left]
                    drop = tail < len(keep_byte)
                    np.subtract.at(keep_byte, tail[drop], 1)
                    keep_byte = np.cumsum(keep_byte, dtype=np.int8) > 0
                    out = np.full(at[-1], 0x20, np.uint8)
                    fill = np.ones(at[-1], bool)
                    fill[at[1:] - 1] = False
                    out[fill] = chunk.data[keep_byte]
                    raw = out.tobytes()
                    bounds = at[np.searchsorted(left, offsets)].tolist()
                    kept = [raw[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:], strict=False)]
                else:
                    left = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
                    raw = chunk.data[~gone].tobytes()
                    kept = [raw[x:y] for x, y in zip(left, left[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.rows.start, chunk.n), pa.array(np.diff(offsets)),
                        pa.array(total(gone).astype(np.int64)), pa.array(total(begins).astype(np.int64)), pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n", "n_removed", "n_spans", "kept"],
                )

    by_doc = spans.groupBy("doc_id", "_k1").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    texts = docs.select("doc_id", text_key(F.col("text"))[0], "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._k1") == F.col("s._k1"))
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    joined = texts.alias("d").join(by_doc.alias("s"), same, "left").select("d.doc_id", "d.text", F.coalesce("spans", empty).alias("spans"))
    return map_arrow(joined, cut_out, f"doc_id {kind}, n long, n_removed long, n_spans long, kept binary")

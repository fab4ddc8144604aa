"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``width`` words (a shorter item is one
window). Tokens are three-word shingles (of as many words as the window has, if
fewer). A window can occur only where all its tokens do, so one token of each
window, the rarest in the corpus, is the prefix that is enough to join on.
Neighbouring windows with the same rarest token are one segment of the index.
A hit gives the place of the token; the bounds of segment and document limit
how far words are compared to both sides, and a window counts if all its words
are equal.

Tasks pass over the documents with a Bloom filter that grows with the number of
distinct tokens up to a fixed size; its false positives are dropped by the
join. A hit carries the words around it, as far as a window can reach; the
token of an item of fewer words than a shingle is the whole window, so its hits
carry no other word. Of equally rare tokens the one with the smaller hash, then
the earlier one, is the prefix; which it is does not change what is found.

Defined cases: a null or empty text has no words; an item without words
has no window; a null item_id counts as an item named by the empty string;
repeated items and documents are as if alone; an item_id may stand
for many texts, each with its own windows; very long texts are read whole;
an empty table of either side gives no hit. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import cut, map_arrow, text_key

WIDTH = 13
GRAM = 3
#: Bits of the filter for each distinct token, and at most: 32 MB. Beyond that it lets more pass, and the join drops it.
BITS_EACH = 32
MOST_BITS = 1 << 28


def _tokens(chunk: nt.Chunk, gram: int, hashed=None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of gram words within a document; hashed: what _hashed gives."""
    words, of_doc = hashed or _hashed(chunk)
    n = len(words) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = nt.owners(of_doc)
    whole = np.flatnonzero(doc[:n] == doc[gram - 1 :])
    h = np.full(n, gram, np.uint64)
    for k in range(gram):
        h = nt.mix(h * np.uint64(3) + words[k : k + n])
    return h[whole], whole


def _hashed(chunk: nt.Chunk) -> tuple[np.ndarray, np.ndarray]:
    lower = nt.LOWER[chunk.data]
    starts, ends, of_doc = chunk.words(nt.ALNUM)
    return nt.SpanHash(lower)(starts, ends), of_doc


def words_of(text: str | None) -> list[str]:
    """The words of one text, as the chunks have them."""
    data = nt.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    chunk = nt.Chunk(slice(0, 1), data, np.array([0, len(data)]))
    starts, ends, _ = chunk.words(nt.ALNUM)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]


def item_tokens(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, text keys, the item's words, and for each start of a token its hash; length of windows and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"item_id": [], "_k1": [], "_k2": [], "words": [], "hashes": [], "size": [], "gram": []}
            for item, text, k1, k2 in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                words = words_of(text)
                if not words:
                    continue
                data, offs = nt.column_bytes(pa.array([text]))
                gram = min(GRAM, len(words))
                h, _ = _tokens(nt.Chunk(slice(0, 1), data, offs), gram)
                rows["item_id"].append(item)
                rows["_k1"].append(k1)
                rows["_k2"].append(k2)
                rows["words"].append(words)
                rows["hashes"].append(nt.as_long(h).tolist())
                rows["size"].append(min(width, len(words)))
                rows["gram"].append(gram)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["item_id"], pa.string()),
                    pa.array(rows["_k1"], pa.int64()),
                    pa.array(rows["_k2"], pa.int64()),
                    pa.array(rows["words"], pa.list_(pa.string())),
                    pa.array(rows["hashes"], pa.list_(pa.int64())),
                    pa.array(rows["size"], pa.int32()),
                    pa.array(rows["gram"], pa.int32()),
                ],
                names=list(rows),
            )

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").distinct()
    keyed = named.select("*", *text_key(F.col("text")))
    return map_arrow(keyed, run, "item_id string, _k1 long, _k2 long, words array<string>, hashes array<long>, size int, gram int")


def _filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the hashes, two bits each, of at least BITS_EACH bits a hash up to MOST_BITS.

    Spark makes it in blocks of 4 KB; the driver puts these together, so it gets
    no more than the filter itself.
    """
    n = hashes.select(F.approx_count_distinct(column)).first()[0]
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))
    both = [F.pmod(F.col(column), F.lit(bits)), F.pmod(F.shiftright(F.col(column), 32), F.lit(bits))]
    at = hashes.select(F.explode(F.array(*both)).alias("b"))
    # The number of a block and the place within its 32768 bits.
    blocks = at.groupBy(F.shiftright("b", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("v"))
    have = np.zeros(bits // 8, np.uint8)
    for k, v in zip(*[c.to_pylist() for c in blocks.toArrow().columns], strict=True):
        have[k * 4096 : (k + 1) * 4096] = np.frombuffer(v, np.uint8)
    return have


def _passing(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    signed, last = nt.as_long(h), np.int64(8 * len(bitmap) - 1)
    ok = np.ones(len(h), bool)
    for number in (signed, signed >> np.int64(32)):
        bit = number & last
        ok &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
    return ok


def token_counts(docs: DataFrame, tokens: DataFrame, grams: list[int]) -> DataFrame:
    """h, n: how often each token of the benchmark occurs in all documents."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter_of(tokens, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(nt.as_long(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for chunk in nt.chunks(batch.column(0)):
                hashed = _hashed(chunk)
                for gram in grams:
                    h, _ = _tokens(chunk, gram, hashed)
                    kept.append(h[_passing(bitmap.value, h)])
                    size += len(kept[-1])
                if size > 1 << 20:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    counts = map_arrow(docs.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return tokens.select("h").distinct().join(counts, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_index(items: DataFrame, counts: DataFrame) -> DataFrame:
    """h, item_id, at, first, last, size, words: segments of items.

    The token h begins at word ``at`` of the words given, and is the rarest of
    the windows that begin at words first to last.
    """
    own = ["item_id", "_k1", "_k2"]  # an item_id need not have one text only
    token = F.explode(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ranked = (
        items.select(*own, "size", "gram", F.size("words").alias("n_words"), token.alias("t"))
        .select(*own, "size", "gram", "n_words", "t.h", "t.i")
        .join(counts, "h")
    )
    starts = F.sequence(F.greatest(F.lit(0), F.col("i") + F.col("gram") - F.col("size")), F.least("i", F.col("n_words") - F.col("size")))
    window = ranked.select(*own, "size", "h", "i", "n", F.explode(starts).alias("start"))
    chosen = window.groupBy(*own, "start", "size").agg(F.min(F.struct("n", "h", "i")).alias("c"))
    runs = chosen.groupBy(*own, "size", F.col("c.h").alias("h"), F.col("c.i").alias("i")).agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    base = F.col("first")
    return runs.join(items.select(*own, "words", "size"), [*own, "size"]).select(
        "h",
        "item_id",
        (F.col("i") - base).cast("int").alias("at"),
        F.lit(0).alias("first"),
        (F.col("last") - base).cast("int").alias("last"),
        "size",
        F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("size")).alias("words"),
    )


def token_hits(docs: DataFrame, index: DataFrame, grams: list[int], width: int = WIDTH) -> DataFrame:
    """doc_id, text keys, n_words and hits: (h, pos, from, words around) of the tokens that pass the filter."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter_of(index, "h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("base", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in nt.chunks(batch.column(3)):
                starts, ends, of_doc = chunk.words(nt.ALNUM)
                lower = nt.LOWER[chunk.data]
                hashed = (nt.SpanHash(lower)(starts, ends), of_doc)
                raw, hits = lower.tobytes(), [[] for _ in range(chunk.n)]
                doc = nt.owners(of_doc)
                for gram in grams:
                    around = width if gram == GRAM else 0
                    h, at = _tokens(chunk, gram, hashed)
                    ok = _passing(bitmap.value, h)
                    for x, p in zip(nt.as_long(h[ok]).tolist(), at[ok].tolist(), strict=True):
                        d = doc[p]
                        a, b = max(of_doc[d], p - around), min(of_doc[d + 1], p + around + gram)
                        near = b" ".join(raw[starts[j] : ends[j]] for j in range(a, b)).decode("utf-8", "replace")
                        hits[d].append({"h": x, "pos": p - int(of_doc[d]), "base": int(a - of_doc[d]), "words": near})
                ids = [batch.column(i).slice(chunk.rows.start, chunk.n) for i in range(3)]
                counts = pa.array(np.diff(of_doc).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*ids, counts, pa.array(hits, pa.list_(hit))], names=["doc_id", "_k1", "_k2", "n_words", "hits"]
                )

    return map_arrow(
        docs.select("doc_id", *text_key(F.col("text")), "text"),
        run,
        f"doc_id {kind}, _k1 long, _k2 long, n_words long, hits array<struct<h:long,pos:int,base:int,words:string>>",
    )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        near, words = col["near"].to_pylist(), col["words"].to_pylist()
        x = {n: col[n].to_pylist() for n in ("pos", "base", "at", "last", "size")}
        rows, a_s, b_s = [], [], []
        for i, (text, seg) in enumerate(zip(near, words, strict=True)):
            own = text.split(" ")
            shift = x["pos"][i] - x["base"][i] - x["at"][i]  # own[j + shift] stands against seg[j]
            lo = hi = x["at"][i]
            while lo > 0 and lo - 1 + shift >= 0 and own[lo - 1 + shift] == seg[lo - 1]:
                lo -= 1
            while hi < len(seg) and hi + shift < len(own) and own[hi + shift] == seg[hi]:
                hi += 1
            first, last = lo, min(x["last"][i], hi - x["size"][i])
            if first <= last:
                rows.append(i)
                a_s.append(first + shift + x["base"][i])
                b_s.append(last + x["size"][i] + shift + x["base"][i])
        take = pa.array(rows, pa.int64())
        out = [col[n].take(take) for n in ("doc_id", "_k1", "_k2", "item_id")]
        yield pa.RecordBatch.from_arrays(
            [*out, pa.array(a_s, pa.int32()), pa.array(b_s, pa.int32())], names=["doc_id", "_k1", "_k2", "item_id", "a", "b"]
        )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text keys, n_words, n_hit, items (sorted names) and spans of words for every row of docs."""
    items = cut(item_tokens(benchmark, width), "items")
    tokens = items.select(F.explode("hashes").alias("h"), "gram")
    grams = sorted(r[0] for r in tokens.select("gram").distinct().collect())  # at most GRAM numbers
    index = cut(prefix_index(items, token_counts(docs, tokens, grams)), "index")
    found = cut(token_hits(docs, index, grams, width), "hits")
    hits = found.filter(F.size("hits") > 0).select("doc_id", "_k1", "_k2", F.explode("hits").alias("x"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = hits.join(index, F.col("x.h") == index["h"]).select(
        "doc_id", "_k1", "_k2", "item_id", F.col("x.pos").alias("pos"), F.col("x.base").alias("base"),
        F.col("x.words").alias("near"), "at", "last", "size", "words",
    )
    spans = map_arrow(pairs, _verified, f"doc_id {kind}, _k1 long, _k2 long, item_id string, a int, b int")
    by_doc = spans.groupBy("doc_id", "_k1", "_k2").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).cast("long").alias("n"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("doc_id", "_k1", "_k2")]
    return (
        found.drop("hits").alias("d")
        .join(by_doc.withColumn("n_hit", covered).alias("h"), same, "left")
        .select(
            "d.doc_id", "d._k1", "d._k2", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("spans"),
        )
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

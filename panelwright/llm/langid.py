"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound by multiplying
its letters' vectors, each permuted once for each place it stands before the
last; a document is the bundle (sum) of its trigrams, and a language the bundle
of the unit vectors of its documents. A document gets the language whose
prototype has the largest cosine with it.

Prototypes are learned from all rows of the training part, and only text and a
non-null label are read. Defined cases: a text that is null or has no letter is
``und`` with score 0; ties go to the first label in order; with no training row
all are ``und``; repeated rows count as often as they stand; very long texts
are read whole; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import map_arrow

DIM = 1024
SYMBOLS = 128
SEED = 20240229
UND = "und"
_table: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point 0 if it is no letter, else a symbol from 1 up; both cases of a letter share one."""
    if not _table:
        codes = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = ord(s.lower()[0])
                codes[c] = low - 96 if 97 <= low <= 122 else 27 + zlib.crc32(b"%d" % low) % (SYMBOLS - 27)
        _table.append(codes)
    return _table[0]


def letter_vectors(dim: int) -> np.ndarray:
    """(3, SYMBOLS, dim): each symbol's vector permuted twice, once and not at all."""
    v = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dim)).astype(np.float32) * 2 - 1
    return np.stack([np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v])


def profiles(texts: list[str | None], dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the documents, and which have a letter."""
    codes = letter_table()
    joined = "\n".join([" " + (t or "") + " " for t in texts]) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t or "") + 3 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    sym = codes[points]
    keep = sym > 0
    gap = np.ones(len(sym), bool)
    gap[1:] = keep[:-1]  # the first blank after a letter stays
    first = np.zeros(len(sym), bool)
    first[np.concatenate([[0], np.cumsum(lens)[:-1]])] = True
    at = np.flatnonzero(keep | gap | first)
    sym, doc, letter = sym[at].astype(np.int64), doc[at], keep[at]
    tri = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    ok = (doc[:-2] == doc[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    tri, doc3 = tri[ok], doc[:-2][ok]
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    kinds, index = _dense(tri)
    counts = np.bincount(doc3 * np.int64(len(kinds)) + index, minlength=len(texts) * len(kinds))
    counts = counts.reshape(len(texts), len(kinds)).astype(np.float32)
    bound = vectors[0][kinds // SYMBOLS**2] * vectors[1][kinds // SYMBOLS % SYMBOLS] * vectors[2][kinds % SYMBOLS]
    bundle = counts @ bound
    norm = np.linalg.norm(bundle, axis=1, keepdims=True)
    return bundle / np.maximum(norm, 1e-9), has


def _dense(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(SYMBOLS**3, bool)
    seen[tri] = True
    kinds = np.flatnonzero(seen)
    number = np.empty(SYMBOLS**3, np.int32)
    number[kinds] = np.arange(len(kinds))
    return kinds, number[tri]


def _groups(texts: list[str | None], chars: int = 1 << 20, docs: int = 256) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i + 1 - start >= docs:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fit(train: DataFrame, text: str = "text", label: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Labels in order and their unit prototypes.

    Every task bundles its own rows; sums over tasks are made by Spark, so the
    driver gets dim numbers a label.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = letter_vectors(dim)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in _groups(texts):
                unit, has = profiles(texts[a:b], dim, vectors)
                for name in sorted(set(labels[a:b][has])):
                    part = unit[has & (labels[a:b] == name)].sum(axis=0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + part
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"label": [name], "v": [v.tolist()]})

    parts = train.filter(F.col(label).isNotNull()).select(F.col(text), F.col(label).cast("string"))
    parts = map_arrow(parts, bundle, "label string, v array<double>")
    rows = (
        parts.select("label", F.posexplode("v").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("label", "v.x")
        .collect()
    )
    rows.sort(key=lambda r: r[0])
    if not rows:
        return [], np.zeros((0, dim), np.float32)
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [r[0] for r in rows], v.astype(np.float32)


def predict(
    df: DataFrame,
    labels: list[str],
    prototypes: np.ndarray,
    text: str = "text",
    dim: int = DIM,
    center: bool = True,
    names_out: tuple[str, str, str] = ("lang_pred", "score", "margin"),
) -> DataFrame:
    """df with lang_pred, score (the cosine as 0 to 1) and margin over the second language.

    What all languages share, the mean prototype, is taken from both sides
    first (center), as it says nothing about the language.
    """
    mean = prototypes.mean(axis=0) if center and len(labels) > 1 else np.zeros(dim, np.float32)
    own = prototypes - mean
    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    names = pa.array([*labels, UND])
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = letter_vectors(dim)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            best, score, margin = np.full(len(texts), len(labels)), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in _groups(texts) if labels else ():
                unit, has = profiles(texts[a:b], dim, vectors)
                unit = unit - mean
                cos = (unit @ own.T) / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
                top = cos.argmax(axis=1)
                best[a:b][has] = top[has]
                two = np.sort(cos, axis=1)
                score[a:b][has] = np.clip(two[has, -1], 0, 1)
                margin[a:b][has] = two[has, -1] - (two[has, -2] if len(labels) > 1 else 0)
            out = [batch.column(i) for i in range(1, len(kept) + 1)]
            out += [names.take(pa.array(best)), pa.array(score), pa.array(margin)]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    kinds = [f.dataType.simpleString() for f in df.schema] + ["string", "double", "double"]
    src = df.select(df[text].alias("_text"), *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)])
    out = map_arrow(src, run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*kept, *names_out)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part

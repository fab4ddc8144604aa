"""Quality rules as a ledger of failure bits.

``measure`` evaluates every rule once and keeps the measurements and one bit a
failed rule. A policy is a named, versioned mask of rules; ``apply_policy`` and
``ablate`` use bitwise operations on the ledger alone.

Defined cases: a null text has no words and fails what an empty one fails; very
long texts are measured whole; repeated rows and null doc_ids are rows like any
other; an empty table gives an empty ledger. Columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import map_arrow

#: Fixed value: the symbols that count as markup.
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs",
    "n_caps_words", "n_marked",
)

#: Rules by bit: a name and the SQL condition on the measurements that fails it. Comparisons are of integers.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("upper_case", "100 * n_upper > 30 * n_letters"),
    ("capital_words", "100 * n_caps_words > 25 * n_words"),
    ("exclamations", "10 * n_bangs > n_words"),
    ("marked_words", "100 * n_marked > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_phrases"))
STANDARD = Policy("standard", 1, tuple(BIT))


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether Unicode has it as a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _measure(chunk: nt.Chunk) -> list[np.ndarray]:
    data, offs = chunk.data, chunk.offsets
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    starts, ends, of_doc = chunk.words()
    n_words = np.diff(of_doc)
    doc = nt.owners(of_doc)
    per_word = lambda mask: np.bincount(doc[mask], minlength=chunk.n)
    lead = (data & 0xC0) != 0x80
    word_chars = total(lead & nt.WORD[data])
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS.encode())] = True
    is_symbol = symbols[data]
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data >= 0x61) & (data <= 0x7A)
    letters = upper | lower
    if (data >= 0x80).any():
        letters[np.flatnonzero(lead)] = _is_letter()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    seen_upper, seen_lower = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(lower)])
    caps = (seen_upper[ends] - seen_upper[starts] > 1) & (seen_lower[ends] == seen_lower[starts])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    bang = (last == 0x21) & (ends - starts > 1)
    bang &= data[np.maximum(ends - 2, 0)] == 0x21 if len(ends) else False
    marked = symbols[last] | np.isin(data[starts], list(SYMBOLS.encode())) if len(ends) else bang
    spans = nt.SpanHash(data)
    word_hash = spans(starts, ends)
    # Words in 3-word windows found twice or more in the text.
    repeat = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        tri = nt.mix(word_hash[:-2] + np.uint64(3) * nt.mix(word_hash[1:-1]) + np.uint64(5) * nt.mix(nt.mix(word_hash[2:])))
        whole = doc[:-2] == doc[2:]
        at = np.flatnonzero(whole)
        key = nt.mix(tri[at] ^ nt.mix(doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = at[twice]
        repeat[hit] = repeat[hit + 1] = repeat[hit + 2] = True
    # Lines with a word that equal an earlier line of the text.
    is_break = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([offs[:-1], is_break + 1])
    line_doc = np.concatenate([np.arange(chunk.n), np.searchsorted(offs, is_break, "right") - 1])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    final = np.flatnonzero(np.append(line_doc[1:] != line_doc[:-1], True))
    line_end[final] = offs[1:][line_doc[final]]
    full = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    key = nt.mix(spans(line_start, line_end) ^ nt.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(key, return_index=True)
    n_lines = np.bincount(line_doc, minlength=chunk.n)
    n_dup = n_lines - np.bincount(line_doc[firsts], minlength=chunk.n)
    return [
        n_words, word_chars, total(is_symbol), n_dup, per_word(repeat), n_lines, total(upper), total(letters), per_word(bang),
        per_word(caps), per_word(marked),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in nt.chunks(batch.column(1)):
            found = [pa.array(x.astype(np.int64)) for x in _measure(chunk)]
            ids = batch.column(0).slice(chunk.rows.start, chunk.n)
            yield pa.RecordBatch.from_arrays([ids, *found], names=["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = map_arrow(
        docs.select("doc_id", "text"), _measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = " + ".join(f"if({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the bits that the policy counts and its verdict."""
    counted = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return ledger.withColumns(
        {"policy": F.lit(f"{policy.name}-v{policy.version}"), "failed": counted, "passes": counted == 0}
    )


def sole_failure(policy: Policy) -> Column:
    """The bit of the one rule of the policy without which a document would be kept, 0 if there is no such rule."""
    counted = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return F.when(counted.bitwiseAND(counted - 1) == 0, counted).otherwise(F.lit(0).cast("long"))


def ablate(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and that fail nothing else, so would be kept without it."""
    counted = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = ledger.groupBy(counted.alias("bits")).agg(F.count("*").alias("n"))
    of = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    x = patterns.select("bits", "n", of.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )

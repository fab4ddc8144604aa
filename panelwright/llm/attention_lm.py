"""A language model with causal self-attention over subword ids, trained in numpy.

A text is its lower-cased words and one end. Words become subwords by a public
vocabulary. One attention layer over the last ``WINDOW`` subwords gives the
class of the next one; a class gives the subword by its share of all training
text. Within a word, counts of three subwords in a row back off to that
(Witten-Bell). A word's probability is that of its subwords, mixed with the
word's own share of the training tokens; a text's is the mean over a few
weights of that mixture. Long texts are read in overlapping windows: each
has ``CONTEXT`` subwords that the one before has scored, and every subword is
scored once.

Everything that is learned comes from every training document: counts of words
and subwords, the classes, whose counts of neighbours cover all the text, and
the weights, for which every training subword, the ends too, is a target. The
windows are those that a text is scored by; they are cut from the documents
where these lie and are never written. Each of ``FIT_ROUNDS`` rounds takes
another part of the documents, so that all rounds together go once through the
text (small tables several times): every task improves the common weights on
its own windows, and Spark averages what they have found, so the driver holds
one model, whatever the input. Documents meet the counts of
their words and triples in packs of some megabytes: each pack sends its
distinct words and triples once, so no task holds all of either, and counts
come back as blocks, by parts of the numbers.

Defined cases: a null text is an empty one, which is only an end; very long
texts are read whole; repeated rows count as often as they stand; null doc_ids
are rows like any other; with no training row the model is uniform over
classes; an empty table gives no row. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nptext as nt
from .common import cut, drop, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's text is split before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
N_IDS = 50257
END = 50256
CONTEXT, STRIDE = 8, 24
WINDOW = CONTEXT + STRIDE
CLASSES = 96
EMBED, DIM = 32, 16
#: Embeddings: frequent subwords have their own, the others share HASHED by their number.
OWN_IDS, HASHED = 4096, 2048
#: Subwords before a subword that tell its class.
CONTEXTS = 128
FIT_EVERY = 4096
FIT_LEAST = 16384
#: Least steps of a task in a round; a task with more windows makes as many as they take.
FIT_ROUNDS, ROUND_STEPS, BATCH = 8, 60, 128
#: Weights of a word's own share; the text's probability is the mean over them.
SHARES = (0.03, 0.15, 0.5, 0.85)
PACK_BYTES = 6 << 20
#: Entries of all packs' lists that are summed at once.
PART = 1 << 20
#: Words that are scored at once.
SLICE_WORDS = 1 << 16
#: Stands before a word's first subword in triples.
START = 65535
#: Stands behind a text's end in its last window; no target.
NONE = 65535


def squeeze(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueeze(data: pa.Buffer | bytes, kind: type) -> np.ndarray:
    data = memoryview(data)
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class Subwords:
    """Subwords of many words at once."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(N_IDS, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words data[start:end], each read with a blank before it: where each one's subwords begin, and these."""
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        joined = np.full(at[-1], 0x20, np.uint8)
        inside = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at)) > 0
        joined[inside] = data[np.arange(inside.sum()) + np.repeat(starts - (at[:-1] - np.arange(len(starts))), ends - starts)]
        ids = np.array(self.encode(joined.tobytes().decode("utf-8", "replace")), np.int64)
        begin = np.concatenate([[0], np.cumsum(self.size[ids])])
        first = np.minimum(np.searchsorted(begin, at), len(ids))
        if begin[-1] == at[-1] and (begin[first] == at).all():
            return first, ids.astype(np.uint16)
        # Some subword spans two words (rare white space at a word's edge): one by one.
        raw = joined.tobytes()
        each = [self.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), np.array([i for x in each for i in x], np.uint16)


def _streams(words: np.ndarray, offsets: np.ndarray, piece_at: np.ndarray, pieces: np.ndarray):
    """Subwords of documents with their ends: their places in the dictionary, where documents and words begin."""
    n_docs = len(offsets) - 1
    # The end is one more dictionary entry.
    at = np.append(piece_at, len(pieces) + 1).astype(np.int64)
    last = len(at) - 2
    full = np.insert(words, offsets[1:], last)
    of_doc = offsets + np.arange(n_docs + 1)
    size = np.diff(at)[full]
    begin = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(begin[-1]) - np.repeat(begin[:-1] - at[:-1][full], size)
    return index, begin[of_doc], begin, of_doc, full


def triples(piece_at: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """For each subword of a dictionary, the two before it in its word and itself, as one number."""
    x = pieces.astype(np.int64)
    first = np.zeros(len(x) + 1, bool)
    first[piece_at] = True
    first = first[:-1]
    q = np.where(first, START, np.concatenate([[START], x])[: len(x)])
    p = np.where(first, START, np.concatenate([[START], q])[: len(x)])
    return (p << 32) + (q << 16) + x


def _inner(keys: np.ndarray) -> np.ndarray:
    """Which triples end within a word: its first subword is the attention model's alone."""
    return (keys >> 16) & 0xFFFF != START


class Backoff:
    """Counts of triples as weights: a subword's probability is a + b * that of the attention model.

    For triples that fit in memory; gram_weights does the same by joins.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.key3, self.n3 = keys[order], counts[order].astype(np.float64)
        self.key2, self.n2 = self._sums(self.key3 & 0xFFFFFFFF, self.n3)
        self.ctx3 = self._context(self.key3, self.n3)
        self.ctx2 = self._context(self.key2, self.n2)

    @staticmethod
    def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, index = np.unique(keys, return_inverse=True)
        return kinds, np.bincount(index, n, len(kinds))

    @staticmethod
    def _context(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds, index, distinct = np.unique(keys >> 16, return_inverse=True, return_counts=True)
        return kinds, np.bincount(index, n, len(kinds)), distinct.astype(np.float64)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(want))
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], 0.0)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(len(keys)), np.ones(len(keys))
        for want, own, n, (ctx, total, distinct) in (
            (keys & 0xFFFFFFFF, self.key2, self.n2, self.ctx2), (keys, self.key3, self.n3, self.ctx3)
        ):
            seen, d = self._find(ctx, total, want >> 16), self._find(ctx, distinct, want >> 16)
            use = (seen > 0) & ((want >> 16) & 0xFFFF != START)
            whole = np.maximum(seen + d, 1.0)
            a = np.where(use, (self._find(own, n, want) + d * a) / whole, a)
            b = np.where(use, d * b / whole, b)
        return a, b


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, a place of each, and each number's index among them; by a hash table, not by sorting."""
    found = pa.array(nt.as_long(hashes)).dictionary_encode()
    inverse = found.indices.to_numpy()
    one = np.zeros(len(found.dictionary), np.int64)
    one[inverse] = np.arange(len(hashes))
    return hashes[one], one, inverse


def pack(docs: DataFrame, train: Column, vocabulary: bytes) -> DataFrame:
    """Packs of documents: word numbers, each distinct word's hash, training count and subwords."""
    kind = docs.schema["doc_id"].dataType
    sc = docs.sparkSession.sparkContext
    vocab = sc.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(vocab.value)
        task, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            hashes, one, inverse = _distinct(np.concatenate([h[3] for h in held]))
            shift = np.cumsum([0] + [len(h[4]) for h in held])
            data = np.concatenate([h[4] for h in held])
            starts = np.concatenate([h[5] + d for h, d in zip(held, shift, strict=False)])[one]
            ends = np.concatenate([h[6] + d for h, d in zip(held, shift, strict=False)])[one]
            piece_at, pieces = subwords(data, starts, ends)
            counts = np.concatenate([np.diff(h[2]) for h in held])
            offsets = np.concatenate([[0], np.cumsum(counts)])
            training = np.concatenate([h[1] for h in held])
            n_train = np.bincount(inverse[np.repeat(training, counts)], minlength=len(hashes))
            # Frequent words get small numbers, which pack better.
            order = np.argsort(-np.bincount(inverse, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            words = rank[inverse]
            lens = np.diff(piece_at)[order]
            at = np.concatenate([[0], np.cumsum(lens)])
            src = np.arange(at[-1]) - np.repeat(at[:-1] - piece_at[:-1][order], lens)
            pieces, piece_at = pieces[src], at.astype(np.int32)
            hashes, n_train = hashes[order], n_train[order]
            piece_n = np.bincount(pieces, weights=np.repeat(n_train, lens), minlength=N_IDS).astype(np.int64)
            piece_n[END] += training.sum()
            seen = np.flatnonzero(piece_n)
            keys, index = np.unique(triples(piece_at, pieces), return_inverse=True)
            keys_n = np.bincount(index, np.repeat(n_train, lens), len(keys)).astype(np.int64)
            inner = _inner(keys)
            number += 1
            row = {
                "pack": (task << 32) + number,
                "ids": pa.concat_arrays([h[0] for h in held]),
                "offsets": squeeze(offsets.astype(np.int64)),
                "words": squeeze(words.astype(np.int32)),
                "hashes": squeeze(nt.as_long(hashes)),
                "n_train": squeeze(n_train.astype(np.int64)),
                "piece_at": squeeze(piece_at),
                "pieces": squeeze(pieces),
                "piece_ids": squeeze(seen.astype(np.int64)),
                "piece_n": squeeze(piece_n[seen]),
                "grams": squeeze(keys[inner]),
                "gram_n": squeeze(keys_n[inner]),
                "training": squeeze(training.astype(np.uint8)),
                "n_docs": len(training),
                "n_train_docs": int(training.sum()),
                "n_train_words": int(n_train.sum()),
                "n_train_pieces": int(piece_n.sum()),
                "n_kinds": len(hashes),
                "n_grams": int(inner.sum()),
            }
            held, size = [], 0
            ids_list = pa.ListArray.from_arrays(pa.array([0, len(row["ids"])], pa.int32()), row.pop("ids"))
            cols = [pa.array([row["pack"]]), ids_list, *[pa.array([row[k]]) for k in list(row)[1:]]]
            return pa.RecordBatch.from_arrays(cols, names=["pack", "ids", *list(row)[1:]])

        for batch in batches:
            for chunk in nt.chunks(batch.column(2)):
                lower = nt.LOWER[chunk.data]
                starts, ends, of_doc = chunk.words()
                ids = batch.column(0).slice(chunk.rows.start, chunk.n)
                is_train = batch.column(1).slice(chunk.rows.start, chunk.n).to_numpy(zero_copy_only=False)
                held.append((ids, is_train, of_doc, nt.SpanHash(lower)(starts, ends), lower, starts, ends))
                size += len(chunk.data) + chunk.n
                if size >= PACK_BYTES:
                    yield flush()
        if held:
            yield flush()

    binary = "offsets words hashes n_train piece_at pieces piece_ids piece_n grams gram_n training".split()
    return map_arrow(
        docs.select("doc_id", train, "text"),
        run,
        f"pack long, ids array<{kind.simpleString()}>, "
        + ", ".join(f"{b} binary" for b in binary)
        + ", n_docs long, n_train_docs long, n_train_words long, n_train_pieces long, n_kinds long, n_grams long",
    )


def _windows(words, offsets, piece_at, pieces, docs: np.ndarray, chance: float, seed: int) -> np.ndarray:
    """Windows at random subwords of the documents, their ends too: about chance times as many as there are subwords."""
    rng = np.random.default_rng(seed)
    begin = np.concatenate([[0], np.cumsum(np.diff(piece_at)[words], dtype=np.int64)])
    low, high = begin[offsets[docs]], begin[offsets[docs + 1]]
    upto = np.cumsum(high - low + 1)
    want = chance * (upto[-1] if len(docs) else 0)
    pick = rng.integers(0, max(1, upto[-1] if len(docs) else 1), int(want + rng.random()))
    doc = np.searchsorted(upto, pick, "right")
    low, high, start = low[doc], high[doc], pick - upto[doc] + high[doc] + 1
    # A window ends with the text at the latest; what stands before the text counts as ends.
    at = np.minimum(start - CONTEXT, high - WINDOW)[:, None] + np.arange(WINDOW + 1)
    inside = (at >= low[:, None]) & (at < high[:, None])
    word = np.searchsorted(begin, at[inside], "right") - 1
    out = np.full(at.shape, END, np.int32)
    out[inside] = pieces[piece_at[words[word]] + at[inside] - begin[word]]
    return out


def _all_windows(words, offsets, piece_at, pieces, docs: np.ndarray) -> np.ndarray:
    """The windows that the documents are scored by: every subword, the ends too, is a target of one of them."""
    n = np.diff(offsets)[docs]
    own = np.concatenate([[0], np.cumsum(n)])
    src = np.arange(own[-1]) - np.repeat(own[:-1] - offsets[docs], n)
    index, begin, *_ = _streams(words[src], own, piece_at, pieces)
    ids, size = np.append(pieces, END).astype(np.uint16)[index], np.diff(begin)
    n_win = -(-size // STRIDE)
    gap = CONTEXT + 1
    base = np.concatenate([[0], np.cumsum(gap + STRIDE * n_win)])
    padded = np.full(base[-1], NONE, np.uint16)
    padded[base[:-1, None] + np.arange(gap)] = END
    padded[np.arange(len(ids)) + np.repeat(base[:-1] + gap - begin[:-1], size)] = ids
    first = np.repeat(base[:-1] - STRIDE * (np.cumsum(n_win) - n_win), n_win) + STRIDE * np.arange(n_win.sum())
    return padded[first[:, None] + np.arange(WINDOW + 1)]


@dataclass
class Model:
    to_model: np.ndarray  # subword -> model id
    to_class: np.ndarray  # subword -> class
    emit: np.ndarray  # log of the subword's share of its class
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    b: np.ndarray
    bias: np.ndarray  # (STRIDE, WINDOW): by distance, -inf ahead

    def __post_init__(self):
        """Whether exponentials of attention and class scores can overflow; if not, no maximum need be taken off."""
        norm = lambda x: float(np.sqrt((x * x).sum(axis=1).max()))
        seen = self.bias[np.isfinite(self.bias)]
        self.small_a = norm(self.q) * norm(self.k) + float(np.abs(seen).max()) < 60
        self.small_z = float(np.abs(self.v).max() + np.abs(self.b).max()) < 60


def _classes(table: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """A class for each subword: clusters of what stands before it; those without a count share the last.

    table: for each subword how often each of the frequent subwords stands before it.
    """
    flat = np.flatnonzero(counts)
    table = table[flat]
    total = table.sum(axis=1)
    expect = total[:, None] * table.sum(axis=0)[None] / max(1.0, table.sum())
    pmi = np.log((table + 0.5) / (expect + 0.5))
    u, s, _ = np.linalg.svd(pmi * np.sqrt(total)[:, None] ** 0.5, full_matrices=False)
    x = (u * s)[:, :24]
    rng = np.random.default_rng(0)
    weight = total + 0.1
    n_single = n // 3
    frequent = np.argsort(-counts[flat], kind="stable")
    out = np.full(N_IDS, n - 1)
    out[flat[frequent[:n_single]]] = np.arange(min(n_single, len(flat)))
    rest = frequent[n_single:]
    k = min(n - n_single - 1, len(rest))
    if k > 0:
        centers = x[rest[np.argsort(-weight[rest], kind="stable")[:k]]] + rng.normal(0, 1e-6, (k, x.shape[1]))
        for _ in range(20):
            label = ((x[rest] ** 2).sum(1)[:, None] - 2 * x[rest] @ centers.T + (centers**2).sum(1)[None]).argmin(1)
            mass = np.bincount(label, weight[rest], k)
            for j in range(x.shape[1]):
                centers[:, j] = np.where(mass > 0, np.bincount(label, weight[rest] * x[rest, j], k) / np.maximum(mass, 1e-9), centers[:, j])
        out[flat[rest]] = n_single + label
    return out


def frequent(counts: np.ndarray, n: int) -> np.ndarray:
    """The n subwords with the largest counts; ties by number."""
    top = np.argsort(-counts, kind="stable")[:n]
    return top[counts[top] > 0]


def cooccurrence(windows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers next * CONTEXTS + c for each subword of the windows whose predecessor is before[c]."""
    col = np.full(NONE + 1, -1)
    col[before] = np.arange(len(before))
    prev, nxt = col[windows[:, :-1].ravel()], windows[:, 1:].ravel().astype(np.int64)
    ok = (prev >= 0) & (nxt != NONE)
    return nxt[ok] * CONTEXTS + prev[ok]


def shapes() -> dict[str, tuple[int, ...]]:
    n = OWN_IDS + HASHED
    return {"e": (n, EMBED), "wq": (EMBED, DIM), "wk": (EMBED, DIM), "wv": (EMBED, CLASSES), "wb": (EMBED, CLASSES), "c": (CLASSES,), "r": (WINDOW,)}


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of a vector of all weights."""
    at = np.cumsum([0] + [int(np.prod(x)) for x in shapes().values()])
    return {k: flat[at[i] : at[i + 1]].reshape(x) for i, (k, x) in enumerate(shapes().items())}


@dataclass
class Start:
    """What is known before the fit: subword -> embedding and class, log of a subword's share of its class, and weights."""

    to_model: np.ndarray
    to_class: np.ndarray
    emit: np.ndarray
    weights: np.ndarray


def start_of(counts: np.ndarray, to_class: np.ndarray, seed: int = 0) -> Start:
    own = frequent(counts, OWN_IDS)
    to_model = OWN_IDS + np.arange(N_IDS) % HASHED
    to_model[own] = np.arange(len(own))
    mass = counts + 0.02
    emit = np.log(mass / np.bincount(to_class, mass, CLASSES)[to_class])
    rng = np.random.default_rng(seed)
    scale = {"e": 0.3, "wq": 0.2, "wk": 0.2, "wv": 0.2, "wb": 0.2, "c": 0.0, "r": 0.0}
    p = {k: rng.normal(0, 1, x) * scale[k] for k, x in shapes().items()}
    share = np.bincount(to_class, counts + 1e-3, CLASSES) + 1e-3
    p["c"] = np.log(share / share.sum())
    weights = np.concatenate([x.ravel() for x in p.values()]).astype(np.float32)
    return Start(to_model.astype(np.int32), to_class.astype(np.int32), emit.astype(np.float32), weights)


def improve(start: Start, weights: np.ndarray, windows: np.ndarray, steps: int, rate: float, seed: int) -> np.ndarray:
    """All weights after some steps of Adam on batches of the windows, which take turns: none comes again before all have come."""
    rng = np.random.default_rng(seed)
    whole = weights.astype(np.float32)
    # Embeddings of subwords that do not occur have no gradient and stay.
    to_model = np.append(start.to_model, np.zeros(NONE + 1 - N_IDS, np.int32))
    to_class = np.append(start.to_class, np.zeros(NONE + 1 - N_IDS, np.int32))
    occurs = np.zeros(OWN_IDS + HASHED, bool)
    for i in range(0, len(windows), 1 << 14):
        occurs[to_model[windows[i : i + (1 << 14), :-1]]] = True
    to_model = (np.cumsum(occurs) - 1)[to_model].astype(np.int32)
    n_e = int(occurs.sum()) * EMBED
    flat_p = np.concatenate([unpacked(whole)["e"][occurs].ravel(), whole[(OWN_IDS + HASHED) * EMBED :]])
    grad, first, second, step_by = (np.zeros_like(flat_p) for _ in range(4))
    at = n_e + np.cumsum([0, EMBED * DIM, EMBED * DIM, (2 * EMBED + 1) * CLASSES])
    # wv, wb and c stand one after another: one matrix for a row of what attention gives, the subword's embedding and 1.
    views = lambda x: (
        x[:n_e].reshape(-1, EMBED), x[at[0] : at[1]].reshape(EMBED, DIM), x[at[1] : at[2]].reshape(EMBED, DIM),
        x[at[2] : at[3]].reshape(2 * EMBED + 1, CLASSES), x[at[3] :],
    )
    (e, wq, wk, out, r), (ge, gq, gk, g_out, gr) = views(flat_p), views(grad)
    dist = (np.arange(STRIDE)[:, None] + CONTEXT) - np.arange(WINDOW)[None]
    ahead, far = dist < 0, np.maximum(dist, 0)
    # Arrays that every step fills again: new ones cost as much as the work.
    new = lambda *shape: np.empty(shape, np.float32)
    ex, dex, eq, ctx, dctx = new(BATCH, WINDOW, EMBED), new(BATCH, WINDOW, EMBED), new(BATCH, STRIDE, EMBED), new(BATCH, STRIDE, EMBED), new(BATCH, STRIDE, EMBED)
    q, k, dq, dk, a, ds = new(BATCH, STRIDE, DIM), new(BATCH, WINDOW, DIM), new(BATCH, STRIDE, DIM), new(BATCH, WINDOW, DIM), new(BATCH, STRIDE, WINDOW), new(BATCH, STRIDE, WINDOW)
    phi, dphi, z = new(BATCH * STRIDE, 2 * EMBED + 1), new(BATCH * STRIDE, 2 * EMBED + 1), new(BATCH * STRIDE, CLASSES)
    of_k, of_q, rows = new(BATCH * WINDOW, EMBED), new(BATCH * STRIDE, EMBED), np.arange(BATCH * STRIDE)
    one_w, one_c = np.ones(WINDOW, np.float32), np.ones(CLASSES, np.float32)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    phi[:, -1] = 1
    order = np.zeros(0, np.int64)
    for step in range(steps):
        while len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(windows))])
        own, order = windows[order[:BATCH]], order[BATCH:]
        x, y = to_model[own[:, :-1]], to_class[own[:, CONTEXT + 1 :]].ravel()
        w = (own[:, CONTEXT + 1 :] != NONE).ravel().astype(np.float32)
        w /= max(1.0, float(w.sum()))
        np.take(e, x, axis=0, out=ex, mode="clip")
        eq[:] = ex[:, CONTEXT:]
        np.matmul(flat(eq), wq, out=flat(q))
        np.matmul(flat(ex), wk, out=flat(k))
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        large = max(a.max(), -a.min()) + np.abs(r).max() > 60
        a += np.where(ahead, np.float32(-1e9), r[far])
        if large:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= (flat(a) @ one_w).reshape(BATCH, STRIDE, 1)
        np.matmul(a, ex, out=ctx)
        phi[:, :EMBED], phi[:, EMBED:-1] = flat(ctx), flat(eq)
        np.matmul(phi, out, out=z)
        if max(z.max(), -z.min()) > 60:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (w / (z @ one_c))[:, None]
        z[rows, y] -= w
        np.matmul(phi.T, z, out=g_out)
        np.matmul(z, out.T, out=dphi)
        dctx[:] = dphi[:, :EMBED].reshape(dctx.shape)
        np.matmul(dctx, ex.transpose(0, 2, 1), out=ds)
        ds -= np.einsum("nsd,nsd->ns", dctx, ctx)[:, :, None]
        ds *= a
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 2, 1), q, out=dk)
        np.matmul(flat(eq).T, flat(dq), out=gq)
        np.matmul(flat(ex).T, flat(dk), out=gk)
        gr[:] = np.bincount(dist[~ahead], ds.sum(axis=0)[~ahead], WINDOW)
        np.matmul(a.transpose(0, 2, 1), dctx, out=dex)
        dex += np.matmul(flat(dk), wk.T, out=of_k).reshape(dex.shape)
        np.matmul(flat(dq), wq.T, out=of_q)
        of_q += dphi[:, EMBED:-1]
        dex[:, CONTEXT:] += of_q.reshape(dctx.shape)
        by = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        kinds = x.ravel()[by]
        begin = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        np.take(flat(dex), by, axis=0, out=of_k, mode="clip")
        ge[:] = 0
        ge[kinds[begin]] = np.add.reduceat(of_k, begin, axis=0)
        first *= np.float32(0.9)
        first += np.multiply(grad, np.float32(0.1), out=step_by)
        second *= np.float32(0.99)
        grad *= grad
        second += np.multiply(grad, np.float32(0.01), out=step_by)
        np.sqrt(second, out=step_by)
        step_by += np.float32(1e-8)
        np.divide(first, step_by, out=step_by)
        fix = np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        step_by *= np.float32(rate * min(1.0, (step + 1) / 10) * fix)
        flat_p -= step_by
    whole = np.concatenate([whole[: (OWN_IDS + HASHED) * EMBED], flat_p[n_e:]])
    unpacked(whole)["e"][occurs] = e
    return whole


def model_of(start: Start, weights: np.ndarray) -> Model:
    p = unpacked(weights)
    e = p["e"]
    dist = (np.arange(STRIDE)[:, None] + CONTEXT) - np.arange(WINDOW)[None]
    bias = np.where(dist < 0, -np.inf, p["r"][np.maximum(dist, 0)]).astype(np.float32)
    return Model(start.to_model, start.to_class, start.emit, e @ p["wq"], e @ p["wk"], e @ p["wv"], (e @ p["wb"] + p["c"]).astype(np.float32), bias)


def _rate(number: int) -> float:
    return 0.02 * (1 - number / FIT_ROUNDS) ** 0.5


def _rows_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """All windows of a task, in an order that does not depend on files."""
    parts = [np.frombuffer(b, np.uint16) for b in sorted(b for batch in batches for b in batch.column("w").to_pylist())]
    return np.concatenate(parts).reshape(-1, WINDOW + 1) if parts else np.zeros((0, WINDOW + 1), np.uint16)


def fit(windows: DataFrame | Callable[[int | None], DataFrame], counts: np.ndarray, seed: int = 0) -> Model:
    """The model by rounds of averaging over the tasks that read the windows (pack, w); counts: of all training subwords.

    windows: of a round's number those that it learns from, of None all of them; or a table for every round.
    """
    of_round = windows if callable(windows) else lambda number: windows
    every = of_round(None)
    sc = every.sparkSession.sparkContext
    before = frequent(counts, CONTEXTS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(N_IDS * CONTEXTS, np.int64)
        for batch in batches:
            for blob in batch.column("w").to_pylist():
                # Targets and what stands before each: windows share the rest.
                own = np.frombuffer(blob, np.uint16).reshape(-1, WINDOW + 1)[:, CONTEXT:]
                np.add.at(sums, cooccurrence(own, before), 1)
        seen = np.flatnonzero(sums)
        for i in range(0, len(seen), 1 << 16):
            key = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums[key])], names=["id", "n"])

    # At most CONTEXTS numbers a subword come to the driver.
    found = map_arrow(every, pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(N_IDS * CONTEXTS, np.float32)
    table[found.column("id").to_numpy()] = found.column("n").to_numpy()
    start = start_of(counts, _classes(table.reshape(N_IDS, CONTEXTS).astype(np.float64), counts, CLASSES), seed)
    known, weights = sc.broadcast(start), start.weights
    part = 1 << 14

    for number in range(FIT_ROUNDS):
        now = sc.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _rows_of(batches)
            if len(own):
                task = TaskContext.get().partitionId()
                steps = max(ROUND_STEPS, -(-len(own) // BATCH))
                got = improve(known.value, now.value, own, steps, _rate(number), seed + 1000 * number + task) * np.float32(len(own))  # noqa: B023
                cuts = [got[i : i + part].tobytes() for i in range(0, len(got), part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int32()), pa.array([len(own)] * len(cuts), pa.int64()), pa.array(cuts, pa.binary())], names=["i", "n", "v"]
                )

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for i, n, v in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                    have = sums.setdefault(i, [0, 0.0])
                    have[0] += n
                    have[1] = have[1] + np.frombuffer(v, np.float32).astype(np.float64)
            cols = [list(sums), [x[0] for x in sums.values()], [x[1].astype(np.float64).tobytes() for x in sums.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["i", "n", "v"])

        # A slice of the weights is summed by one task, which holds it once; the driver gets each slice once.
        kind = "i int, n long, v binary"
        summed = map_arrow(map_arrow(of_round(number), work, kind).repartition("i"), total, kind).collect()
        if summed:
            weights = np.concatenate([np.frombuffer(r.v, np.float64) / r.n for r in sorted(summed)]).astype(np.float32)
        now.destroy()
    known.destroy()
    return model_of(start, weights)


def subword_scores(model: Model, ids: np.ndarray, begin: np.ndarray, batch: int = 64) -> np.ndarray:
    """Log of each subword's probability; begin: where documents begin in ids, and the end."""
    n_docs = len(begin) - 1
    size = np.diff(begin)
    n_win = -(-size // STRIDE)
    # Every document stands behind CONTEXT + 1 ends.
    gap = CONTEXT + 1
    padded = np.full(len(ids) + gap * n_docs + WINDOW + 1, END, np.int32)
    base = begin[:-1] + gap * np.arange(n_docs)
    padded[np.arange(len(ids)) + gap * (1 + np.repeat(np.arange(n_docs), size))] = ids
    x_all, y_all = model.to_model[padded], model.to_class[padded]
    doc = np.repeat(np.arange(n_docs), n_win)
    first = base[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win))
    out = np.empty((len(doc), STRIDE), np.float32)
    cols, rows, flat = np.arange(WINDOW), np.arange(STRIDE), np.arange(batch * STRIDE)
    one_w, one_c = np.ones(WINDOW, np.float32), np.ones(CLASSES, np.float32)
    # Arrays that every batch fills again: new ones cost as much as the work.
    kept = [np.empty((batch, n, m), np.float32) for n, m in ((STRIDE, DIM), (WINDOW, DIM), (WINDOW, CLASSES), (STRIDE, CLASSES), (STRIDE, WINDOW), (STRIDE, CLASSES))]
    for i in range(0, len(doc), batch):
        at = first[i : i + batch, None]
        n = len(at)
        q, k, v, b, a, z = (t[:n] for t in kept)
        x = x_all[at + cols]
        y = y_all[at + (gap + rows)].ravel()
        xq = x[:, CONTEXT:]
        for table, key, to in ((model.q, xq, q), (model.k, x, k), (model.v, x, v), (model.b, xq, b)):
            np.take(table, key, axis=0, out=to, mode="clip")
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        a += model.bias
        if not model.small_a:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= (a.reshape(-1, WINDOW) @ one_w).reshape(n, STRIDE, 1)
        np.matmul(a, v, out=z)
        z += b
        if not model.small_z:
            z -= z.max(axis=2, keepdims=True)
        z2 = z.reshape(-1, CLASSES)
        own = z2[flat[: n * STRIDE], y]
        np.exp(z, out=z)
        out[i : i + batch] = (own - np.log(z2 @ one_c)).reshape(n, STRIDE)
    of_target = np.repeat(np.cumsum(n_win) - n_win, size) * STRIDE + np.arange(len(ids)) - np.repeat(begin[:-1], size)
    return out.ravel()[of_target] + model.emit[ids]


def _unpacked(packs: DataFrame, column: str, numbers: str | None = None) -> DataFrame:
    """pack, at, id (and n): a row for each entry of a pack's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = unsqueeze(batch.column(1)[i].as_buffer(), np.int64)
                n = unsqueeze(batch.column(2)[i].as_buffer(), np.int64) if numbers else None
                for a in range(0, len(own), 1 << 16):
                    part = own[a : a + (1 << 16)]
                    cols = [np.full(len(part), batch.column(0)[i].as_py()), np.arange(a, a + len(part), dtype=np.int32), part]
                    cols += [n[a : a + (1 << 16)]] if numbers else []
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pack", "at", "id", "n"][: len(cols)])

    return map_arrow(packs.select("pack", column, *([numbers] if numbers else [])), run, "pack long, at int, id long" + ", n long" * bool(numbers))


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each number: its upper bits after a product that spreads them."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _cuts(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by part, and each part with where it begins and ends in that."""
    order = np.argsort(part, kind="stable")
    own, begin = np.unique(part[order], return_index=True)
    return order, list(zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True))


def _dealt(packs: DataFrame, ids: str, numbers: str | None, parts: int) -> DataFrame:
    """part, pack, at, ids (and n): the entries of a pack's list that fall into a part as one row of compressed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = unsqueeze(batch.column(1)[i].as_buffer(), np.int64)
                n = [unsqueeze(batch.column(2)[i].as_buffer(), np.int64)] if numbers else []
                order, cuts = _cuts(_part(own, parts))
                lists = [order.astype(np.int32), own[order], *[x[order] for x in n]]
                cols = [pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(cuts), pa.int64())]
                cols += [pa.array([squeeze(x[a:b]) for _, a, b in cuts], pa.binary()) for x in lists]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "pack", "at", "ids", "n"][: len(cols)])

    rows = map_arrow(packs.select("pack", ids, *([numbers] if numbers else [])), run, "part int, pack long, at binary, ids binary" + ", n binary" * bool(numbers))
    return rows


def _each_part(dealt: DataFrame, work: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of all rows of a part, by pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return map_arrow(dealt.repartition("part").sortWithinPartitions("part", "pack"), run, schema)


def _parts(entries: int | None) -> int:
    return max(1, (entries or 0) // PART)


def pack_counts(packs: DataFrame) -> DataFrame:
    """pack, at, c, kinds: places of a pack's words that other packs have too, with their counts in all training text; written.

    kinds sums to the distinct words of the training text; rows without a pack have nothing else.
    """

    def work(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        ids = [unsqueeze(r["ids"], np.int64) for r in rows]
        own, index, packs_of = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
        c = np.zeros(len(own), np.int64)
        np.add.at(c, index, np.concatenate([unsqueeze(r["n"], np.int64) for r in rows]))
        shared, out = packs_of > 1, [(None, None, None, int((c > 0).sum()))]
        for r, i in zip(rows, np.split(index, np.cumsum([len(x) for x in ids])[:-1]), strict=True):
            more = shared[i]
            if more.any():
                out.append((r["pack"], squeeze(unsqueeze(r["at"], np.int32)[more]), squeeze(c[i[more]]), 0))
        for a in range(0, len(out), 256):
            cols = zip(*out[a : a + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["pack", "at", "c", "kinds"])

    parts = _parts(packs.agg(F.sum("n_kinds")).first()[0])
    return cut(_each_part(_dealt(packs, "hashes", "n_train", parts), work, "pack long, at binary, c binary, kinds long"), "known")


def _by_pack(found: DataFrame, columns: list[str], name: str) -> DataFrame:
    """pack and name: the rows of each pack as a list of blocks."""
    return found.filter("pack is not null").groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias(name))


def _summed(packs: DataFrame, ids: str, numbers: str) -> DataFrame:
    """id, n: the sums over all packs of two columns that belong together."""
    return _unpacked(packs, ids, numbers).groupBy("id").agg(F.sum("n").alias("n"))


def _piece_counts(packs: DataFrame) -> np.ndarray:
    rows = _summed(packs, "piece_ids", "piece_n").toArrow()  # at most N_IDS rows
    counts = np.zeros(N_IDS)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gram_counts(packs: DataFrame, parts: int) -> DataFrame:
    """id, n: every triple of any pack and its count in all training words."""

    def work(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own, index = np.unique(np.concatenate([unsqueeze(r["ids"], np.int64) for r in rows]), return_inverse=True)
        n = np.zeros(len(own), np.int64)
        np.add.at(n, index, np.concatenate([unsqueeze(r["n"], np.int64) for r in rows]))
        for a in range(0, len(own), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(own[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["id", "n"])

    return _each_part(_dealt(packs, "grams", "gram_n", parts), work, "id long, n long")


def gram_weights(grams: DataFrame) -> DataFrame:
    """id, a, b for every triple of any pack, from the counts of all training words, as Backoff has them."""
    kinds = lambda n: F.sum((F.col(n) > 0).cast("long"))
    # A key of these joins has at most as many rows as there are subwords.
    pairs = grams.groupBy(F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pair")).agg(F.sum("n").alias("n2"))
    pairs = pairs.withColumn("one", F.shiftright("pair", 16))
    ones = pairs.groupBy("one").agg(F.sum("n2").alias("t2"), kinds("n2").alias("d2"))
    twos = grams.groupBy(F.shiftright("id", 16).alias("two")).agg(F.sum("n").alias("t3"), kinds("n").alias("d3"))
    mixed = lambda seen, whole, x, rest: F.when(F.col(seen) > 0, x / (F.col(whole) + F.col(seen))).otherwise(rest)
    pairs = pairs.join(ones, "one").select(
        "pair", mixed("t2", "d2", F.col("n2"), F.lit(0.0)).alias("a2"), mixed("t2", "d2", F.col("d2"), F.lit(1.0)).alias("b2")
    )
    every = grams.withColumns({"pair": F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)), "two": F.shiftright("id", 16)})
    return every.join(pairs, "pair").join(twos, "two").select(
        "id",
        mixed("t3", "d3", F.col("n") + F.col("d3") * F.col("a2"), F.col("a2")).cast("float").alias("a"),
        mixed("t3", "d3", F.col("d3") * F.col("b2"), F.col("b2")).cast("float").alias("b"),
    )


def pack_weights(packs: DataFrame) -> DataFrame:
    """pack, weights: blocks of the places of a pack's triples, in their order, and a and b of these; written."""
    parts = _parts(packs.agg(F.sum("n_grams")).first()[0])
    grams = cut(gram_counts(packs, parts), "grams")
    known = cut(gram_weights(grams), "gram_weights")
    drop(grams)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, *ab = (batch.column(k).to_numpy() for k in range(3))
            order, cuts = _cuts(_part(own, parts))
            lists = [x[order] for x in (own, *ab)]
            cols = [pa.array([k for k, _, _ in cuts], pa.int32())] + [pa.array([squeeze(x[i:j]) for _, i, j in cuts], pa.binary()) for x in lists]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "ids", "a", "b"])

    def work(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        have = [r for r in rows if r["pack"] is None]
        own = np.concatenate([unsqueeze(r["ids"], np.int64) for r in have])
        order = np.argsort(own)
        own, a, b = own[order], *(np.concatenate([unsqueeze(r[k], np.float32) for r in have])[order] for k in "ab")
        for r in rows:
            if r["pack"] is not None:
                at = np.searchsorted(own, unsqueeze(r["ids"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (r["pack"], r["at"], squeeze(a[at]), squeeze(b[at]))], names=["pack", "at", "a", "b"])

    dealt = _dealt(packs, "grams", None, parts).unionByName(map_arrow(known, deal, "part int, ids binary, a binary, b binary"), allowMissingColumns=True)
    found = cut(_each_part(dealt, work, "pack long, at binary, a binary, b binary"), "weights")
    drop(known)
    return _by_pack(found, ["at", "a", "b"], "weights")


def _given(keys: np.ndarray, blocks: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
    """a and b of a pack's triples by what pack_weights has for it."""
    own, index = np.unique(keys, return_inverse=True)
    a, b = np.zeros(len(own)), np.ones(len(own))
    inner = np.flatnonzero(_inner(own))
    for i in range(0 if blocks is None else len(blocks)):
        at, x, y = (unsqueeze(blocks.field(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int32, np.float32, np.float32)))
        a[inner[at]], b[inner[at]] = x, y
    return a[index], b[index]


def sample(packs: DataFrame) -> DataFrame:
    """pack, w: windows as bytes, each training subword of every pack with the same chance, to look into a model with; nothing learns from them."""
    total = packs.agg(F.sum("n_train_pieces")).first()[0] or 0
    chance = max(1 / FIT_EVERY, FIT_LEAST / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: unsqueeze(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                pack, docs = batch.column("pack")[i].as_py(), np.flatnonzero(get("training", np.uint8))
                found = _windows(get("words", np.int32), get("offsets", np.int64), get("piece_at", np.int32), get("pieces", np.uint16), docs, chance, pack)
                parts = [found[a : a + 1024].astype(np.uint16).tobytes() for a in range(0, len(found), 1024)]
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["pack", "w"])

    rows = map_arrow(packs.select("pack", "training", "words", "offsets", "piece_at", "pieces"), run, "pack long, w binary")
    return cut(rows.coalesce(max(1, int(chance * total) // FIT_LEAST)), "windows")


def learning(packs: DataFrame, number: int | None = None, tasks: int | None = None) -> DataFrame:
    """pack, w: windows of all training documents of a round, or of all rounds, as bytes; each document is in one round."""
    rounds = FIT_ROUNDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: unsqueeze(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                pack, docs = batch.column("pack")[i].as_py(), np.flatnonzero(get("training", np.uint8))
                words, offsets, piece_at, pieces = get("words", np.int32), get("offsets", np.int64), get("piece_at", np.int32), get("pieces", np.uint16)
                turn = (np.arange(len(docs)) + pack) % rounds
                for part in range(rounds) if number is None else (number,):
                    found = _all_windows(words, offsets, piece_at, pieces, docs[turn == part])
                    for a in range(0, len(found), 1 << 14):
                        yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([found[a : a + (1 << 14)].tobytes()], pa.binary())], names=["pack", "w"])

    rows = map_arrow(packs.select("pack", "training", "words", "offsets", "piece_at", "pieces"), run, "pack long, w binary")
    return rows.coalesce(tasks) if tasks else rows


def score(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, one row a row of docs; train: which rows to learn from."""
    with open(vocabulary, "rb") as f:  # on the driver; executors get its bytes
        vocab = f.read()
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    packs = cut(pack(docs, train, vocab), "packs")
    piece_n = _piece_counts(packs)
    # A task of a round has the windows of ROUND_STEPS steps, if there are as many.
    tasks = max(1, int(piece_n.sum()) // (STRIDE * FIT_ROUNDS * ROUND_STEPS * BATCH))
    model = sc.broadcast(fit(lambda number: learning(packs, number, tasks), piece_n))
    n_words, n_ends = packs.agg(F.sum("n_train_words"), F.sum("n_train_docs")).first()
    n_ends = n_ends or 0
    n_train = (n_words or 0) + n_ends
    counted = pack_counts(packs)
    n_kinds = (counted.agg(F.sum("kinds")).first()[0] or 0) + (n_ends > 0)

    # A word of one pack has its count there already.
    known, weights = _by_pack(counted, ["at", "c"], "known"), pack_weights(packs)
    sc._jvm.System.gc()  # the last shuffles of written tables go
    joined = packs.select("pack", "ids", "offsets", "words", "n_train", "piece_at", "pieces").join(known, "pack", "left").join(weights, "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: unsqueeze(batch.column(name)[i].as_buffer(), kind)
                offsets, own = get("offsets", np.int64), get("words", np.int32)
                piece_at, pieces = get("piece_at", np.int32), get("pieces", np.uint16)
                c = np.append(get("n_train", np.int64), n_ends)
                entries = batch.column("known")[i].values
                for k in range(0 if entries is None else len(entries)):
                    places, counts = (unsqueeze(entries.field(f)[k].as_buffer(), kind) for f, kind in enumerate((np.int32, np.int64)))
                    c[places] = counts
                given, rest = _given(triples(piece_at, pieces), batch.column("weights")[i].values)
                given, rest, ends = np.append(given, 0.0), np.append(rest, 1.0), np.append(pieces, END).astype(np.int32)
                denominator = np.log10(float(n_train + n_kinds + 1))
                ids, row, n_docs = batch.column("ids")[i].values, 0, len(offsets) - 1
                while row < n_docs:
                    end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_WORDS, "right")) - 1)
                    part = own[offsets[row] : offsets[end]]
                    at, begin, word_begin, of_doc, full = _streams(part, offsets[row : end + 1] - offsets[row], piece_at, pieces)
                    found = subword_scores(model.value, ends[at], begin)
                    attn = np.add.reduceat(np.log(given[at] + rest[at] * np.exp(found, dtype=np.float64)), word_begin[:-1])
                    cw = c[full]
                    base = np.log10(cw + 1.0) - denominator
                    per = lambda x: np.add.reduceat(x, of_doc[:-1])  # noqa: E731, B023
                    with np.errstate(divide="ignore"):  # an unknown word has no share of its own
                        own_share = np.log(cw / float(n_train + n_kinds + 1))
                    each = np.stack([per(np.logaddexp(np.log(1 - s) + attn, np.log(s) + own_share)) for s in SHARES])
                    top = each.max(axis=0)
                    text = (top + np.log(np.exp(each - top).mean(axis=0))) / np.log(10)
                    seen = cw > 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(row, end - row), pa.array(np.diff(of_doc).astype(np.int64)), pa.array(per(seen.astype(np.int64))),
                            pa.array(np.full(end - row, n_train, np.int64)), pa.array(per(base)), pa.array(text),
                        ],
                        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                    row = end

    return map_arrow(joined, run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

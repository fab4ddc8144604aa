"""Operators against their plain versions, with nulls, ties, repeated rows, empty tables and clashing names."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import attention_lm, chat_format, decontaminate, langid, line_dedup, mixing, passage_dedup, quality, simhash, suffix_dedup
from panelwright.llm.fm_index import FMIndex

from . import brute
from .conftest import ordered


def same(df, expected):
    assert ordered([tuple(r) for r in df.collect()]) == ordered(expected)


# --- 1


def test_language(docs, rows):
    out = langid.held_out(F.col("doc_id"), 5, 0)
    labels, protos = langid.fit(docs.filter(~out))
    assert labels == ["de", "en", "fr"] and np.allclose(np.linalg.norm(protos, axis=1), 1, atol=1e-5)
    got = langid.predict(docs.select("doc_id", "text", "lang"), labels, protos).collect()
    assert len(got) == len(rows)
    held = {r[0] for r in docs.filter(out).select("doc_id").collect()}
    assert held == {r[0] for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0}
    # Ids 7 to 9 hold a text with another label, every fifth a passage in another language.
    long = [r for r in got if r.text and len(r.text) > 100 and r.doc_id is not None and r.doc_id < 100 and r.doc_id % 5 and r.doc_id not in (7, 8, 9)]
    assert np.mean([r.lang_pred == r.lang for r in long]) > 0.95
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1 and (has or r.score == 0)


def test_language_edges(docs, empty, clashing):
    labels, protos = langid.fit(empty)
    assert labels == [] and {r.lang_pred for r in langid.predict(docs, labels, protos).collect()} == {"und"}
    labels, protos = langid.fit(docs)
    assert langid.predict(empty, labels, protos).count() == 0
    assert len(langid.predict(clashing, labels, protos).columns) == len(clashing.columns) + 3


# --- 2


def lm_rows(docs):
    out = langid.held_out(F.col("doc_id"), 7, 2)
    return attention_lm.score(docs, ~out).withColumn("held", out).collect()


def test_lm(docs, rows):
    got = lm_rows(docs)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [(i, [*brute.words((t or "").translate(brute.LOWER)), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for a, b in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_tokens, r.n_known))), sorted(want, key=key), strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == b[:4]
        assert a.base_score == pytest.approx(b[4], rel=1e-9) and a.score < 0
    known = [r for r in got if not r.held]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def plain_fit(windows, counts, steps):
    before = attention_lm.frequent(counts, attention_lm.CONTEXTS)
    table = np.bincount(attention_lm.cooccurrence(windows, before), minlength=attention_lm.N_IDS * attention_lm.CONTEXTS)
    classes = attention_lm._classes(table.reshape(attention_lm.N_IDS, -1).astype(float), counts, attention_lm.CLASSES)
    start = attention_lm.start_of(counts, classes)
    return attention_lm.model_of(start, attention_lm.improve(start, start.weights, windows, steps, 0.02, 0))


def test_lm_gradients():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 40, (200, attention_lm.WINDOW + 1)).astype(np.int32)
    counts = np.bincount(windows.ravel(), minlength=attention_lm.N_IDS).astype(float)
    loss = lambda m: -np.mean([attention_lm.subword_scores(m, w, np.array([0, len(w)]))[8:].mean() for w in windows[:50]])
    before, after = plain_fit(windows, counts, 0), plain_fit(windows, counts, 60)
    assert loss(after) < loss(before)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 40, (200, attention_lm.WINDOW + 1)).astype(np.int32)
    counts = np.bincount(windows.ravel(), minlength=attention_lm.N_IDS).astype(float)
    m = plain_fit(windows, counts, 30)
    # After the same subwords, over all that can come next.
    head = rng.integers(0, 40, 30).astype(np.int32)
    every = np.arange(attention_lm.N_IDS, dtype=np.int32)
    ids = np.concatenate([np.concatenate([head, [x]]) for x in every[:3000]] + [np.concatenate([head, [attention_lm.END]])])
    begin = np.arange(0, len(ids) + 1, 31)
    p = np.exp(attention_lm.subword_scores(m, ids.astype(np.int32), begin).reshape(-1, 31)[:, -1])
    rest = np.exp(m.emit)[3000:-1].sum() * (p[-2] / np.exp(m.emit[2999]))  # unseen ids share one class
    assert p.sum() + rest == pytest.approx(1, abs=1e-3)


def test_lm_windows_do_not_change_scores_of_their_overlap():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 40, (100, attention_lm.WINDOW + 1)).astype(np.int32)
    counts = np.bincount(windows.ravel(), minlength=attention_lm.N_IDS).astype(float)
    m = plain_fit(windows, counts, 5)
    a, b = rng.integers(0, 40, 100).astype(np.int32), rng.integers(0, 40, 57).astype(np.int32)
    one = attention_lm.subword_scores(m, a, np.array([0, 100]))
    two = attention_lm.subword_scores(m, np.concatenate([b, a]), np.array([0, 57, 157]))[57:]
    assert len(one) == 100 and np.allclose(one, two, atol=1e-5)
    # No subword sees what comes after it.
    c = a.copy()
    c[60:] = 39 - c[60:]
    assert np.allclose(attention_lm.subword_scores(m, c, np.array([0, 100]))[:60], one[:60], atol=1e-5)


def test_backoff_is_a_distribution():
    pieces, at = np.array([5, 6, 7, 5, 6, 8, 5, 9], np.uint16), np.array([0, 3, 6, 8])
    keys = attention_lm.triples(at, pieces)
    b = attention_lm.Backoff(*np.unique(keys, return_counts=True))
    for p, q in ((attention_lm.START, 5), (5, 6), (5, 9)):
        a, rest = b((np.int64(p) << 32) + (np.int64(q) << 16) + np.arange(100))
        assert a.sum() + rest[0] == pytest.approx(1)
    a, rest = b(keys[:1])
    assert a[0] == 0 and rest[0] == 1  # a word's first subword is the attention model's


def test_lm_counts_every_triple(docs):
    with open(attention_lm.VOCABULARY, "rb") as f:
        packs = attention_lm.pack(docs, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)), f.read()).cache()
    parts = packs.select("pack", "grams", "gram_n", "pieces", "piece_at").collect()
    keys = [attention_lm.unsqueeze(r.grams, np.int64) for r in parts]
    n = Counter()
    for r, k in zip(parts, keys, strict=True):
        n.update(dict(zip(k.tolist(), attention_lm.unsqueeze(r.gram_n, np.int64).tolist(), strict=True)))
    full = attention_lm.Backoff(*(np.array(x) for x in zip(*[(k, c) for k, c in n.items() if c], strict=True)))
    assert len(parts) > 1 and min(n.values()) == 0
    weights = {r.pack: r.weights for r in attention_lm.pack_weights(packs).collect()}
    for r in parts:
        own = attention_lm.triples(attention_lm.unsqueeze(r.piece_at, np.int32), attention_lm.unsqueeze(r.pieces, np.uint16))
        kind = pa.struct([(x, pa.binary()) for x in ("at", "a", "b")])
        got = attention_lm._given(own, pa.array([tuple(map(bytes, w)) for w in weights[r.pack]], kind))
        assert all(np.allclose(x, y, rtol=1e-6) for x, y in zip(got, full(own), strict=True))


def test_lm_sample_is_even(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "PACK_BYTES", 1 << 14)
    monkeypatch.setattr(attention_lm, "FIT_LEAST", 4000)
    # One task, many packs: a mark of its own for each quarter of the subwords, the last in one document.
    rows = [(i, f"{'abc'[i // 1200]} " * 240) for i in range(3600)] + [(3600, "d " * 288000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    with open(attention_lm.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    packs = attention_lm.cut(attention_lm.pack(docs, F.lit(True), vocabulary), "packs")
    assert packs.count() > 3
    read = lambda: np.concatenate([np.frombuffer(r.w, np.uint16).reshape(-1, attention_lm.WINDOW + 1) for r in attention_lm.sample(packs).collect()])
    windows = read()
    marks = [attention_lm.Subwords(vocabulary)(np.frombuffer(x, np.uint8), np.array([0]), np.array([1]))[1][0] for x in (b"a", b"b", b"c", b"d")]
    share = [(windows == m).any(axis=1).mean() for m in marks]
    assert len(windows) == pytest.approx(4000, rel=0.02) and np.allclose(share, 0.25, atol=0.04)
    # Beyond the least number, windows grow with the text.
    monkeypatch.setattr(attention_lm, "FIT_EVERY", 96)
    assert len(read()) == pytest.approx((4 * 288000 + 3601) / 96, rel=0.02)


def test_lm_fit_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "FIT_LEAST", 256)
    monkeypatch.setattr(attention_lm, "FIT_ROUNDS", 2)
    rng = np.random.default_rng(3)
    windows = np.cumsum(rng.integers(1, 3, (1024, attention_lm.WINDOW + 1)), axis=1) % 40
    counts = np.bincount(windows.ravel(), minlength=attention_lm.N_IDS).astype(float)
    blobs = [(i, bytearray(windows[i : i + 64].astype(np.uint16).tobytes())) for i in range(0, 1024, 64)]
    df = spark.createDataFrame(blobs, "pack long, w binary").repartition(4).cache()
    m = attention_lm.fit(df, counts)
    ids = windows[:100].ravel().astype(np.int32)
    score = lambda x: attention_lm.subword_scores(x, ids, np.arange(0, len(ids) + 1, attention_lm.WINDOW + 1)).mean()
    assert score(m) > score(plain_fit(windows, counts, 0)) + 0.3
    # No window at all leaves the start.
    assert np.isfinite(attention_lm.fit(df.limit(0), np.zeros(attention_lm.N_IDS)).emit).all()
    df.unpersist()


def test_lm_learns_from_every_training_subword(spark, monkeypatch, docs):
    monkeypatch.setattr(attention_lm, "PACK_BYTES", 1 << 14)
    got, fit = {}, attention_lm.fit

    def kept(windows, counts, *rest):
        parts = [windows(i) for i in range(attention_lm.FIT_ROUNDS)] if callable(windows) else [windows]
        rows = [r.w for p in parts for r in p.collect()]
        own = np.concatenate([np.frombuffer(w, np.uint16) for w in rows]).reshape(-1, attention_lm.WINDOW + 1)
        targets = own[:, attention_lm.CONTEXT + 1 :].ravel()
        got["targets"] = np.bincount(targets[targets < attention_lm.N_IDS], minlength=attention_lm.N_IDS)
        got["counts"] = counts
        return fit(windows, counts, *rest)

    monkeypatch.setattr(attention_lm, "fit", kept)
    assert len(lm_rows(docs)) == docs.count()
    # Each stands once among the targets of all rounds, empty texts' ends too, and nothing held out does.
    assert got["counts"].sum() > 1000 and (got["targets"] == got["counts"]).all()


def test_lm_steps_go_down_the_loss_of_scoring():
    n = attention_lm
    rng = np.random.default_rng(4)
    size = rng.integers(0, n.STRIDE, n.BATCH)  # with its end, each text is one window
    words, offsets = rng.integers(0, 40, size.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(size)])
    pieces, at = np.arange(40, dtype=np.uint16), np.arange(41)
    windows = n._all_windows(words, offsets, at, pieces, np.arange(n.BATCH))
    assert len(windows) == n.BATCH
    index, begin, *_ = n._streams(words, offsets, at, pieces)
    ids = np.append(pieces, n.END).astype(np.int32)[index]
    counts = np.bincount(ids, minlength=n.N_IDS).astype(float)
    to_class = np.arange(n.N_IDS) % n.CLASSES
    start = n.start_of(counts, to_class)
    loss = lambda x: -n.subword_scores(n.model_of(start, x), ids, begin).astype(float).sum()
    # The first step of Adam has the sign of the gradient.
    step = n.improve(start, start.weights, windows, 1, 0.02, 0) - start.weights
    place = np.cumsum([0] + [int(np.prod(x)) for x in n.shapes().values()])
    used = np.append(np.arange(40 * n.EMBED), np.arange(place[1], place[-1]))
    right = checked = 0
    for i in rng.choice(used, 300, replace=False):
        up, down = start.weights.copy(), start.weights.copy()
        up[i] += 0.05
        down[i] -= 0.05
        slope = loss(up) - loss(down)
        if abs(slope) > 0.02:
            checked += 1
            right += slope * step[i] < 0
    assert checked > 100 and right == checked


def test_lm_windows_take_turns(monkeypatch):
    monkeypatch.setattr(attention_lm, "BATCH", 16)
    counts = np.ones(attention_lm.N_IDS)
    start = attention_lm.start_of(counts, np.arange(attention_lm.N_IDS) % attention_lm.CLASSES)
    windows = np.repeat(np.arange(160)[:, None], attention_lm.WINDOW + 1, axis=1)
    moved = lambda steps: (attention_lm.unpacked(attention_lm.improve(start, start.weights, windows, steps, 0.02, 0) - start.weights)["e"] != 0).any(axis=1)
    own = start.to_model[:160]
    assert moved(10)[own].all() and moved(10).sum() == 160


def plain_lm(model, backoff, encode, rows, train):
    """Scores subword by subword and word by word."""
    n = attention_lm
    tokens = [[w.translate(brute.LOWER) for w in brute.words(t)] for _, t in rows]
    counts = Counter(w for ws, tr in zip(tokens, train, strict=True) if tr for w in [*ws, None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for ws in tokens:
        pieces = [encode(" " + w) for w in ws] + [[n.END]]
        ids = [i for p in pieces for i in p]
        word_log, j = [], 0
        for p, w in zip(pieces, [*ws, None], strict=True):
            log, before = 0.0, [n.START, n.START]
            for x in p:
                k, i = divmod(j, n.STRIDE)
                seen = lambda at: ids[at] if 0 <= at < len(ids) else n.END  # noqa: E731, B023
                keys = [seen(k * n.STRIDE - n.CONTEXT - 1 + c) for c in range(n.CONTEXT + i + 1)]
                me, keys = model.to_model[keys[-1]], model.to_model[keys]
                a = model.k[keys] @ model.q[me] + model.bias[i, : len(keys)]
                a = np.exp(a - a.max())
                z = (a / a.sum()) @ model.v[keys] + model.b[me]
                z -= np.log(np.exp(z - z.max()).sum()) + z.max()
                attention = math.exp(z[model.to_class[x]] + model.emit[x])
                if w is not None:
                    key = np.array([(before[0] << 32) + (before[1] << 16) + x], np.int64)
                    own, rest = backoff(key)
                    attention = own[0] + rest[0] * attention
                log += math.log(attention)
                before, j = [before[1], x], j + 1
            word_log.append((log, counts[w] / (total + kinds + 1)))
        each = [math.prod([1.0]) and sum(np.logaddexp(math.log(1 - s) + lg, math.log(s * u) if u else -np.inf) for lg, u in word_log) for s in n.SHARES]
        out.append((np.logaddexp.reduce(each) - math.log(len(each))) / math.log(10))
    return out


def test_lm_score_equals_a_plain_forward_pass(spark, monkeypatch, docs, rows):
    made = {}
    fit = attention_lm.fit
    monkeypatch.setattr(attention_lm, "fit", lambda *a: made.setdefault("m", fit(*a)))
    some = [(r[0], r[1]) for r in rows if r[0] is not None and len(r[1] or "") < 4000] + [(900, "z" * 3000 + " known"), (901, "z" * 3000)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
    train = [i % 3 > 0 or i == 900 for i, _ in some]
    keep = (F.col("doc_id") % 3 > 0) | (F.col("doc_id") == 900)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in attention_lm.score(df, keep).collect())
    with open(attention_lm.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    encode = attention_lm.Subwords(vocabulary).encode
    keys = Counter()
    for (_, t), tr in zip(some, train, strict=True):
        for w in brute.words(t) if tr else ():
            p = np.array(encode(" " + w.translate(brute.LOWER)), np.uint16)
            keys.update(k for k in attention_lm.triples(np.array([0, len(p)]), p).tolist() if attention_lm._inner(np.array([k]))[0])
    backoff = attention_lm.Backoff(np.array(list(keys)), np.array(list(keys.values())))
    want = plain_lm(made["m"], backoff, encode, some, train)
    want = sorted((i, len(brute.words(t)) + 1, x) for (i, t), x in zip(some, want, strict=True))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=2e-4, abs=2e-4)
    # A known word that is very long keeps its own share.
    assert dict((a, c) for a, _, c in got)[901] > -8


def test_lm_counts_meet_packs_in_parts_and_leave_no_tables(docs, rows, monkeypatch):
    monkeypatch.setattr(attention_lm, "PACK_BYTES", 1 << 14)
    monkeypatch.setattr(attention_lm, "PART", 512, raising=False)
    made, cut = [], attention_lm.cut

    def kept(df, label):
        made.append((label, cut(df, label)))
        return made[-1][1]

    monkeypatch.setattr(attention_lm, "cut", kept)
    got = lm_rows(docs)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [(i, [*brute.words((t or "").translate(brute.LOWER)), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total = sum(c.values()) + len(c) + 1
    assert sum(r.base_score for r in got) == pytest.approx(sum(math.log10((c[w] + 1) / total) for _, ws in tokens for w in ws), rel=1e-9)
    # Words and triples of all packs go in parts, and only what scoring reads is still there.
    assert sorted(label for label, t in made if os.path.exists(t._cut_path)) == ["known", "packs", "weights"]


def test_lm_distinct():
    found = np.array([7, 2**64 - 1, 7, 0, 2**64 - 1], np.uint64)
    kinds, one, index = attention_lm._distinct(found)
    assert sorted(kinds.tolist()) == [0, 7, 2**64 - 1] and (kinds[index] == found).all() and (found[one] == kinds).all()


def test_lm_edges(docs, empty, clashing):
    assert attention_lm.score(empty, F.lit(True)).count() == 0
    assert attention_lm.score(docs, F.lit(False)).filter("n_known = 0 and train_tokens = 0").count() == docs.count()
    assert attention_lm.score(clashing, F.lit(True)).count() == docs.count()


# --- 3


@pytest.mark.parametrize("least", [2, 5, 7])
def test_lines(docs, rows, least):
    got = line_dedup.mark_lines(docs, least).select(
        "_row.doc_id", F.coalesce(F.size("_lines"), F.lit(0)), F.size("_bad"),
        F.sha2(F.coalesce(F.array_join(line_dedup.kept_lines(), "\n"), F.lit("")), 256),
    )
    same(got, brute.spread([(r[0], r[1], r[3]) for r in rows], least))


def test_lines_near_the_threshold(spark):
    rows = [(i, f"line of {k} sites", None, f"s{i}", 1) for k in (90, 97, 99, 100, 101, 103, 115) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    gone = line_dedup.mark_lines(df, 100).filter("size(_bad) > 0").select("_row.text").distinct().collect()
    assert sorted(r[0].split()[2] for r in gone) == ["100", "101", "103", "115"]


def test_lines_edges(empty, clashing, docs):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(clashing, 5)
    assert out.columns == clashing.columns and out.count() == docs.count()
    assert out.filter("text is null").count() == docs.filter("text is null").count()


# --- 4 and 6


def test_passages(docs, rows):
    kept = passage_dedup.dedup_passages(docs).select("doc_id", "n", "n_removed", F.sha2("kept", 256))
    same(kept, brute.passages([(r[0], r[1]) for r in rows]))


def test_passages_split_hot_anchors(docs, rows, monkeypatch):
    monkeypatch.setattr(passage_dedup, "HOT", 1)
    kept = passage_dedup.dedup_passages(docs).select("doc_id", "n", "n_removed", F.sha2("kept", 256))
    same(kept, brute.passages([(r[0], r[1]) for r in rows]))


def test_strings(docs, rows):
    kept = suffix_dedup.dedup_strings(docs).select("doc_id", "n", "n_removed", "n_spans", F.sha2("kept", 256))
    same(kept, brute.strings([(r[0], r[1]) for r in rows]))


def test_strings_at_every_edge(spark):
    """Windows at the ends of texts, beside NULs, and copies that differ in one byte at any place."""
    import random

    r = random.Random(4)
    base = "".join(r.choice("ab \0é") for _ in range(700))
    texts = [base, base[:650], base[3:], base[100:420], "\0" * 9 + base[200:400], base[200:400] + "\0" * 9, base[5:210], base[5:204]]
    texts += [base[:k] + "#" + base[k + 1 :] for k in (0, 1, 7, 8, 9, 150, 199, 200, 201, 333, 698)]
    texts += [base[i : i + 230] + "".join(r.choice("xyz") for _ in range(i % 9)) for i in range(0, 300, 23)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, base[300:]), (None, None)]
    kept = suffix_dedup.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n", "n_removed", "n_spans", F.sha2("kept", 256))
    same(kept, brute.strings(rows))


def test_dedup_edges(empty, clashing, docs):
    for f in (passage_dedup.dedup_passages, suffix_dedup.dedup_strings):
        assert f(empty).count() == 0
        assert f(clashing).count() == docs.count()


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sigma, depth = int(rng.integers(2, 6)), int(rng.integers(1, 9))
        text = np.append(rng.integers(0, sigma, rng.integers(2, 60)), 0)
        index = FMIndex(text, sigma, depth)
        patterns = [rng.integers(1, sigma + 1, rng.integers(0, 15)) for _ in range(6)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in patterns])])
        size, place = index.matches(np.concatenate(patterns), offsets)
        t, k = text.tolist(), 0
        for p in map(list, patterns):
            for i in range(len(p)):
                best = max((q for q in range(1, min(depth, len(p) - i) + 1) if any(t[s : s + q] == p[i : i + q] for s in range(len(t)))), default=0)
                assert size[k] == best
                at = int(index.locate(place[k : k + 1])[0])
                assert t[at : at + best] == p[i : i + best]
                k += 1
        assert sorted(index.locate(np.arange(len(t))).tolist()) == list(range(len(t)))


def test_index_is_smaller_than_its_text():
    words = np.random.default_rng(0).integers(1, 5000, 200_000)
    index = FMIndex(np.append(words, 0), 5000, 50)
    index.matches(words[:1000], np.array([0, 1000]))
    arrays = [index.lcp, index.samples, index._left, index._right, index.first, index.begin, index.is_sampled.words, index.is_sampled.before]
    arrays += [x for _, b in index.levels for x in (b.words, b.before)] + [x for starts, b in index._segment.values() for x in (starts, b.words, b.before)]
    # A word and its blank are more than six bytes; the plain suffix order alone would be eight.
    assert sum(a.nbytes for a in arrays) < 20 * len(words) and not hasattr(index, "order")


def test_positions_of_runs():
    rng = np.random.default_rng(2)
    first, count, lean = rng.integers(0, 50, 200), rng.integers(1, 40, 200), rng.integers(0, 8, 200)
    run, at, near, far = suffix_dedup.steps_of(first, count, lean)
    for i in range(200):
        own = run == i
        begins = [a - t for a, x, y in zip(at[own], near[own], far[own], strict=True) for t in range(x, y + 1)]
        assert sorted(begins) == list(range(first[i], first[i] + count[i]))
        assert set((at[own] - first[i] - lean[i]) % 8) == {0} and (near[own] >= 0).all() and (far[own] < 8).all()


# --- 5


def chat_rows():
    odd = ["plain", "<|im_end|>", "a<\\|b", "<<|im_start|>x\n", "", "<\\\\|im_next|>", "ends with <", "|im_end|> begins", "\n\n", "ü漢<|"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(12) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", "user"])]
    rows += [(50, 1, "user", None), (50, 0, None, "x"), (50, None, "assistant", "first"), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, 1, "assistant", "a")]
    return rows + [(None, 0, "assi\nstant", "role with a break"), (52, 0, "<|im_end|>", "odd role")]


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat_format.format_chats(df).withColumns(
        {"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}
    )
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[c] = [(r[2] or "", r[3] or "") for r in own]
    found = {r.conv_id: r for r in got.collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        r = found[c]
        assert [tuple(x) for x in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        blocks = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][0] != t[0])
        assert r.formatted.count("<|im_start|>") == blocks == r.formatted.count("<|im_end|>\n")
    assert chat_format.format_chats(df.limit(0)).count() == 0
    assert chat_format.format_chats(df.withColumns({"turns": F.lit(1), "pieces": F.lit(2), "t": F.lit(3)})).count() == len(want)


def test_chat_of_many_turns(spark):
    df = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat_format.format_chats(df).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).select(F.size("loss_spans").alias("n"), "loss").first()
    want = [f"t{i}" for i in range(50_000) if i % 3]
    assert r.n == len(want) and r.loss == "".join(want)
    long = spark.createDataFrame([(1, 0, "user", "é" * 5000), (1, 1, "assistant", "ü<|漢" * 4000), (1, 2, "assistant", ""), (1, 3, "assistant", "x" * 4096)], "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(long).select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.loss == "ü<|漢" * 4000 + "x" * 4096


# --- 7


ITEMS = ["all sites have this line", "one", "", None, "be be be be be be be be be be be be be be be", "12 34", "Ünï çödé 漢字 ünï çödé"]


def test_contamination(spark, docs, rows):
    from .conftest import make_rows

    long = make_rows()[0][1]
    items = [(f"i{k}", t) for k, t in enumerate(ITEMS)] + [("i2", long), ("i9", long[40:900]), (None, long[100:700]), ("i9", long[40:900])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated()
    )
    same(got, brute.contamination([(r[0], r[1]) for r in rows], items))


def test_contamination_by_texts_that_share_a_name(spark):
    word = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    items = [("a", word("x", 40)), ("a", word("y", 15)), (None, word("z", 13)), (None, word("w", 30)), ("", word("v", 13))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(9, word("x", 40)[60:] + " " + word("w", 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated())
    same(got, brute.contamination(rows, items))


def test_contamination_with_a_full_filter(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 1)
    items = [("a", rows[0][1]), ("b", rows[5][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated())
    same(got, brute.contamination([(r[0], r[1]) for r in rows], items))


def test_filter_grows_with_its_tokens(spark):
    few, many = (decontaminate._filter_of(spark.range(n).select(F.xxhash64("id").alias("h")), "h") for n in (10, 200_000))
    assert len(few) * 8 == 1 << 16 and 32 * 200_000 <= 8 * len(many) <= 128 * 200_000
    own = np.array([r[0] for r in spark.range(200_000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    other = np.random.default_rng(0).integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2)
    assert decontaminate._passing(many, own).all() and decontaminate._passing(many, other).mean() < 0.01


def test_short_items_carry_no_other_words(spark):
    docs = spark.createDataFrame([(1, "one two three four one"), (2, "none")], "doc_id long, text string")
    items = decontaminate.item_tokens(spark.createDataFrame([("a", "one")], "item_id string, text string"))
    index = items.select(F.explode("hashes").alias("h"))
    hits = decontaminate.token_hits(docs, index, [1]).select(F.explode("hits").alias("x")).select("x.pos", "x.words").collect()
    assert sorted(tuple(r) for r in hits) == [(0, "one"), (4, "one")]


def test_contamination_edges(spark, docs, empty, clashing):
    bench = spark.createDataFrame([("a", "all sites have this line")], "item_id string, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(clashing, bench).count() == docs.count()


# --- 8


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id")
    prints = [brute.fingerprint(r[1]) for r in rows]
    comp = brute.linked(prints)
    low = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    same(got, [(r[0], p - (1 << 64) if p >> 63 else p, low.get(c)) for r, p, c in zip(rows, prints, comp, strict=True)])


@pytest.mark.parametrize("bucket", [2, 4096])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(15)]
    prints = sorted({x for x in near} | {0})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    stars = {r.u: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    mine = [stars.get(x, x) for x in signed]
    want = brute.linked(prints)
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 401)} | {1001: 1000}


def test_near_duplicates_edges(empty, clashing, docs):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(clashing).count() == docs.count()


# --- 9


def targets(sizes, share=1.5, most=2.0):
    """The contract's resharing, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (goal - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block_words", [1 << 16, 200])
def test_mix(docs, rows, block_words):
    plan = mixing.plan_mix(docs, block_words=block_words).collect()
    sizes, largest = Counter(), {}
    for r in rows:
        n = len(brute.words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest.get(r[3], 0), n)
    want = targets(sizes)
    taken = Counter()
    assert len(plan) == len(rows)
    for r in plan:
        assert 0 <= len(r.draws) <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert len({x["pass"] for x in r.draws}) == len(r.draws) and (r["size"] > 0 or not r.draws)
        taken[r.source] += len(r.draws) * r["size"]
    for s, t in want.items():
        assert -max(1, largest[s]) < taken[s] - t <= 1
        # What was left out would not have fitted, where one block holds the source.
        out = [r["size"] for r in plan if r.source == s and r["size"] and len(r.draws) < 1 + (t >= sizes[s])]
        assert block_words == 200 or not out or t - taken[s] < min(out) + 1
    again = mixing.plan_mix(docs.repartition(5), block_words=block_words).collect()
    assert ordered([(r.doc_id, r["size"], str(r.draws)) for r in plan]) == ordered([(r.doc_id, r["size"], str(r.draws)) for r in again])


def test_blocks_are_numbered_over_bands(docs, monkeypatch):
    one = mixing.plan_mix(docs, block_words=50).collect()
    monkeypatch.setattr(mixing, "BAND", 2)
    two = mixing.plan_mix(docs, block_words=50).collect()
    assert ordered([(r.doc_id, r["size"], str(r.draws)) for r in one]) == ordered([(r.doc_id, r["size"], str(r.draws)) for r in two])


@pytest.mark.parametrize(("whole", "marked", "drawn"), [(30, 12, 9), (7, 7, 3), (50, 1, 25), (2000, 900, 1000), (20, 15, 12)])
def test_hypergeometric(spark, whole, marked, drawn):
    n = 20000
    found = mixing.hypergeometric(f"{whole}L", f"{marked}L", f"{drawn}L", f"(id + 0.5D) / {n}")
    got = Counter(r[0] for r in spark.range(n).select(F.expr(found)).collect())
    ways = math.comb(whole, drawn)
    for k in range(max(0, drawn + marked - whole), min(marked, drawn) + 1):
        assert abs(got[k] / n - math.comb(marked, k) * math.comb(whole - marked, drawn - k) / ways) <= 1.01 / n
    assert sum(got.values()) == n


def test_hypergeometric_of_many_items(spark):
    q = mixing.shard_quotas(spark.createDataFrame([(1, 33_000_000), (2, 60_000_000), (3, 7_000_000)], "rank int, items long"), 1).collect()
    left = {r["rank"]: r.quota for r in q if r.shard == 0}
    assert sum(left.values()) == 50_000_000
    for rank, items in ((1, 33e6), (2, 60e6), (3, 7e6)):
        spread = math.sqrt(items / 4 * (1 - items / 1e8))
        assert abs(left[rank] - items / 2) < 6 * spread


@pytest.mark.parametrize("sources", [4, 130])
def test_shard_quotas(spark, sources):
    items = {r: (37, 100, 1, 0)[r % 4] * (1 + r // 4) for r in range(sources)}
    q = mixing.shard_quotas(spark.createDataFrame(list(items.items()), "rank int, items long"), 3).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in q:
        by_rank[r["rank"]] += r.quota
        by_shard[r.shard] += r.quota
    assert all(by_rank[k] == n for k, n in items.items()) and max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 8
    for rank in items:
        own = sorted((r.shard, r.before, r.quota) for r in q if r["rank"] == rank)
        assert all(b == sum(x[2] for x in own[:i]) for i, (_, b, _) in enumerate(own))


def test_mix_draws(clashing, docs, rows):
    out = mixing.draw(clashing, block_words=200)
    assert {"shard", "place", "taken", "pass", "doc_shard", "doc_place", "doc_taken"} <= set(out.columns)
    drawn = out.select("doc_id", "taken", "text").collect()
    # Whole texts, as they are.
    assert {(r.doc_id, r.text) for r in drawn} <= {(r[0], r[1]) for r in rows}
    assert all(len(brute.words(r.text)) == r.taken for r in drawn)
    plan = mixing.plan_mix(docs, block_words=200).collect()
    assert ordered([(r.doc_id, r.taken) for r in drawn]) == ordered([(r.doc_id, r["size"]) for r in plan for _ in r.draws])
    assert mixing.draw(docs.limit(0)).count() == 0 and mixing.plan_mix(docs.filter("text is null")).filter("size(draws) > 0").count() == 0


def test_mix_shuffles_texts_twice(docs):
    plan = mixing.draw(docs.select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    text = docs.columns.index("text") and "_1#"
    assert sum(text in line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange" in line) <= 2 and "Python" not in plan


# --- 10


def test_quality(docs, rows):
    ledger = quality.measure(docs)
    got = ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same(got, [(r[0], *brute.quality(r[1])) for r in rows])
    judged = quality.apply_policy(ledger, quality.BASE).collect()
    for r in judged:
        assert (not r.passes) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.policy == "base-v1"
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality.ablate(ledger, quality.STANDARD).collect():
        b = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(x & b) for x in bits) and r.n_only == sum(x == b for x in bits)


def test_letters_by_category(spark):
    df = spark.createDataFrame([(1, "aé漢ß —“”€… ١٢ ʰ")], "doc_id long, text string")
    assert quality.measure(df).first().n_letters == 5


def test_sole_failure(docs):
    rows = quality.measure(docs).select("fail_bits", quality.sole_failure(quality.STANDARD).alias("s")).collect()
    assert all(r.s == (r.fail_bits if bin(r.fail_bits).count("1") == 1 else 0) for r in rows) and any(r.s for r in rows)


def test_quality_edges(empty, clashing, docs):
    assert quality.measure(empty).count() == 0
    assert quality.measure(clashing).count() == docs.count()
    assert quality.measure(docs).filter("doc_id in (100, 101) and fail_bits & 1 = 0").count() == 0

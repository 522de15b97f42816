"""The language model turns a document into symbols once, and its short cuts keep probabilities right."""

from __future__ import annotations

import dataclasses

import numpy as np

from panelytics.llm import gru, lm_scoring


def shape_and_weights(scale: float):
    shape = gru.Shape(9, (0, 4, 7, 8, 9), 3, 4)
    flat = np.random.default_rng(4).normal(0, scale, len(gru.initial(shape, np.ones(9), 1))).astype(np.float32)
    return shape, flat, np.repeat(np.arange(4), np.diff(shape.edges))


def test_log_probability_of_any_size_of_logits():
    rng = np.random.default_rng(0)
    for scale in (0.5, 300.0):
        shape, flat, classes = shape_and_weights(scale)
        p = gru.unpack(shape, flat)
        states, targets = rng.normal(0, 1, (50, 4)).astype(np.float32), rng.integers(0, 9, 50)
        logits = states.astype(np.float64) @ p["class_w"] + p["class_b"]
        inner = states.astype(np.float64) @ p["word_w"] + p["word_b"]
        got = gru.log_probability(shape, p, classes, states, targets)
        for row, (t, k) in enumerate(zip(targets, classes[targets], strict=True)):
            low, high = shape.edges[k], shape.edges[k + 1]
            want = logits[row, k] - np.logaddexp.reduce(logits[row]) + inner[row, t] - np.logaddexp.reduce(inner[row, low:high])
            assert np.isclose(got[row], want, rtol=1e-3, atol=1e-3)


def test_windows_far_apart_in_memory_have_the_same_gradient():
    shape, flat, classes = shape_and_weights(0.5)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 9, (4, 40)).T
    x = np.vstack([np.full((1, 4), shape.start), y[:-1]])
    state, p = np.zeros((4, 4), dtype=np.float32), gru.unpack(shape, flat)
    a = gru.gradient(shape, p, classes, x[8:24], y[8:24], state)
    b = gru.gradient(shape, p, classes, x[8:24].copy(), y[8:24].copy(), state)
    assert a[2] == b[2] and all(np.array_equal(v, b[0][k]) for k, v in a[0].items())


def test_documents_become_symbols_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two w{i % 3}") for i in range(40)] + [(40, None), (None, "one")], "doc_id long, text string")
    calls, plain = [], lm_scoring.coded_rows
    monkeypatch.setattr(lm_scoring, "coded_rows", lambda *a: calls.append(plain(*a)) or calls[-1])
    got = lm_scoring.score_documents(docs, lm_scoring.Settings(replica_tokens=1_000, rounds=2)).collect()
    assert len(got) == 42 and len(calls) == 1 and calls[0].count() == 42
    assert {r["doc_id"]: r["tokens"] for r in calls[0].collect()} == {r["doc_id"]: r["n_tokens"] for r in got}


def test_stored_symbols_are_bytes_to_spark(spark):
    """Spark moves a document's symbols as one value; two bytes hold each of them, four if there are too many."""
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, "three " * 50)], "doc_id long, text string")
    settings = lm_scoring.Settings()
    vocab, _, _ = lm_scoring.vocabulary(lm_scoring.count_words(docs).cache(), settings)
    rows = {r["doc_id"]: r for r in lm_scoring.coded_rows(docs, vocab, settings).collect()}
    index = {**vocab.index(), None: -1}
    for key, text in ((1, [b"one", b"two", b"two"]), (2, []), (3, [b"three"] * 50)):
        assert rows[key]["symbols"] == vocab.symbols[[index[w] for w in [*text, b""]]].astype("<u2").tobytes()
    assert dataclasses.replace(vocab, model_words=70_000).kind == np.dtype("<u4")

"""Tags toxic spans with a linear-chain conditional random field and scores whole documents from its marginals.

Tokens lie between white space; their features are the words inside them, with prefixes of three to six and suffixes of three
and four letters, hashed. The chain has two states (other, toxic) and runs over windows of ``window`` tokens that cover a
text end to end. With two states, forward and backward messages are odds, and the odds that a token is toxic are their product.

Training takes the whole texts of a bounded sample of labelled documents, ``toxic_docs`` and ``clean_docs`` expected rows. A feature found in enough toxic documents and hardly in clean ones marks the tokens that carry it in
toxic documents; those are the labelled tokens the field learns from. The largest log odds in a document is then mapped to the
probability of its label by a logistic curve fitted on the sample, weighted to the classes' true sizes.

Scoring is one pass over all documents, whole texts, without a shuffle; each worker keeps the emission scores of at most ``keep``
tokens. Offending spans are character offsets of tokens with a marginal of at least one half.

Defined results: null text is empty and scores as a text without toxic tokens. A null id counts as the empty text when its remainder
is taken. Labels that are null or belong to no document are passed over; a document with several labels counts once for each. Without
toxic or without clean training rows every score is the share of toxic rows (zero rows: 0). Repeated rows score alike; other columns,
also clashing ones, do not matter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.common import built, hash_share, id_remainder, slices, texts

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\S+")


@dataclass(frozen=True)
class Settings:
    modulus: int = 3
    held_out: int = 1
    threshold: float = 0.7
    toxic_docs: int = 700
    clean_docs: int = 1_500
    window: int = 256
    bits: int = 20
    steps: int = 40
    rate: float = 0.3
    decay: float = 1e-6
    keep: int = 400_000


def features(token: str) -> list[int]:
    """Hashes of the words in a token, their prefixes and suffixes."""
    out: dict[int, None] = {}
    for w in WORD.findall(token.lower()):
        for f in (w, *("^" + w[:n] for n in range(3, min(6, len(w)) + 1)), *(w[-n:] + "$" for n in range(3, min(4, len(w)) + 1))):
            out[zlib.crc32(f.encode())] = None
    return list(out)


@dataclass
class Field:
    """Weights of hashed features, bias, log transitions (from, to), log odds at the start, and the curve of documents."""

    weights: np.ndarray
    bias: float
    links: np.ndarray
    start: float
    slope: float
    offset: float
    trained: bool = True

    def emission(self, token: str) -> float:
        size = len(self.weights)
        return self.bias + float(sum(self.weights[f % size] for f in features(token)))


def messages(emissions: np.ndarray, mask: np.ndarray, links: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and exp(emission) of windows (rows); places outside ``mask`` pass messages on."""
    e = np.exp(np.clip(emissions, -30, 30)).T.copy()
    on = mask.T
    a = np.exp(links)
    forward, backward = np.empty_like(e), np.empty_like(e)
    forward[0] = e[0] * np.exp(start)
    for t in range(1, len(e)):
        f = forward[t - 1]
        forward[t] = np.where(on[t], e[t] * (a[0, 1] + a[1, 1] * f) / (a[0, 0] + a[1, 0] * f), f)
    backward[-1] = 1
    for t in range(len(e) - 2, -1, -1):
        g = e[t + 1] * backward[t + 1]
        backward[t] = np.where(on[t + 1], (a[1, 0] + a[1, 1] * g) / (a[0, 0] + a[0, 1] * g), backward[t + 1])
    return forward.T, backward.T, e.T


def windows(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Values as rows of a window each, the last one filled up, and the mask of places that hold a value."""
    n = max(1, -(-len(values) // window))
    padded = np.zeros(n * window, dtype=values.dtype)
    padded[: len(values)] = values
    return padded.reshape(n, window), (np.arange(n * window) < len(values)).reshape(n, window)


@dataclass
class Sample:
    """Sampled documents as numbers of distinct tokens, and the feature hashes of each distinct token."""

    toxic: np.ndarray
    docs: list[np.ndarray]
    sizes: np.ndarray  # features of each distinct token
    hashes: np.ndarray  # one after another

    @classmethod
    def of(cls, rows: Iterable[tuple[bool, str]]) -> "Sample":
        toxic, docs, sizes, hashes = [], [], array("I"), array("I")
        index: dict[str, int] = {}
        for label, text in rows:
            tokens = text.split()
            for t in tokens:
                if t not in index:
                    index[t] = len(index)
                    own = features(t)
                    sizes.append(len(own))
                    hashes.extend(own)
            toxic.append(label)
            docs.append(np.fromiter(map(index.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        return cls(np.array(toxic, dtype=bool), docs, np.array(sizes, dtype=np.int64), np.array(hashes, dtype=np.uint32))

    def document_features(self, toxic: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """Features of a class, the number of its documents that hold each, and their number in all; near copies count as one."""
        ends = np.cumsum(self.sizes)
        sets, pairs = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.uint64)]
        for doc, label in zip(self.docs, self.toxic, strict=True):
            if label == toxic:
                own = np.unique(doc)
                sets.append(np.unique(self.hashes[_spans(ends[own] - self.sizes[own], self.sizes[own])]))
                pairs.append(doc[:-1].astype(np.uint64) << np.uint64(32) | doc[1:].astype(np.uint64))
        weights = copy_weights(pairs)
        found, at = np.unique(np.concatenate(sets), return_inverse=True)
        return found, np.bincount(at, weights=np.repeat(weights, [len(x) for x in sets]), minlength=len(found)), float(weights[1:].sum())


def copy_weights(pairs: list[np.ndarray], sketch: int = 32, shared: int = 20) -> np.ndarray:
    """One over the number of documents, itself included, that have ``shared`` of its smallest ``sketch`` hashes of token pairs."""
    small = [np.unique(x * np.uint64(0x9E3779B97F4A7C15))[:sketch] for x in pairs]
    _, at, times = np.unique(np.concatenate(small), return_inverse=True, return_counts=True)
    # A hash of one document alone is shared with none, so it needs no column.
    column = np.cumsum(times > 1) - 1
    several, owner = times[at] > 1, np.repeat(np.arange(len(pairs)), [len(x) for x in small])
    held = np.zeros((len(pairs), int((times > 1).sum())), dtype=np.float32)
    held[owner[several], column[at[several]]] = 1
    need = np.maximum(np.array([len(x) for x in small]) * shared / sketch, 0.5)
    alike = np.empty(len(pairs))
    for i in range(0, len(pairs), 256):
        alike[i : i + 256] = (held[i : i + 256] @ held.T >= need[i : i + 256, None]).sum(axis=1)
    return 1 / np.maximum(alike, 1)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def markers(sample: Sample) -> np.ndarray:
    """Features in at least four toxic documents, by their share over 30 times rarer in clean ones, and not by chance.

    The likelihood ratio of 24 leaves about one chance hit among a million features.
    """
    found, times, n_toxic = sample.document_features(True)
    clean, clean_times, n_clean = sample.document_features(False)
    at = np.minimum(np.searchsorted(clean, found), max(len(clean) - 1, 0))
    others = np.where(clean[at] == found, clean_times[at], 0) if len(clean) else np.zeros(len(found))
    both = (times + others) / (n_toxic + n_clean)
    ratio = 2 * (times * np.log(times / (both * n_toxic)) + others * np.log(np.maximum(others, 1) / (both * n_clean)))
    return found[(times >= 4) & (ratio >= 24) & (times / n_toxic > 30 * (others + 0.3) / n_clean)]


def fit(sample: Sample, class_sizes: tuple[int, int], settings: Settings) -> Field:
    """The field from sampled documents; ``class_sizes``: labelled clean and toxic rows in all."""
    size = 1 << settings.bits
    toxic, docs = sample.toxic, sample.docs
    base = class_sizes[1] / max(sum(class_sizes), 1)
    if not toxic.any() or toxic.all():
        return Field(np.zeros(size), 0.0, np.zeros((2, 2)), 0.0, 0.0, float(np.log((base + 1e-9) / (1 - base + 1e-9))), False)
    n_tokens = len(sample.sizes)
    token_at = np.repeat(np.arange(n_tokens, dtype=np.int32), sample.sizes)
    feature_at = (sample.hashes % size).astype(np.int32)
    has_marker = np.bincount(token_at, weights=np.isin(sample.hashes, markers(sample)), minlength=n_tokens) > 0
    cut = [windows(d, settings.window) for d in docs]
    tokens, mask = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
    owner = np.repeat(np.arange(len(docs)), [len(c[0]) for c in cut])
    y = has_marker[tokens] & toxic[owner][:, None] & mask
    weights = np.zeros(size)
    # Parameters: feature weights, then bias, start and the three free links (0-0 is the reference).
    flat = np.concatenate([weights, [-4.0, 0.0, 0.0, 0.0, 0.0]])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    n = mask.sum()
    del cut

    def blocks(flat):
        """Links, and for a block of windows at a time its rows and messages; only one block's messages are held."""
        links = np.array([[0.0, flat[-3]], [flat[-2], flat[-1]]])
        emission = flat[-5] + np.bincount(token_at, weights=flat[feature_at], minlength=n_tokens)
        for low in range(0, len(tokens), 512):
            rows = slice(low, low + 512)
            yield links, rows, *messages(emission[tokens[rows]], mask[rows], links, flat[-4])

    for step in range(1, settings.steps + 1):
        by_token, ends, joints = np.zeros(n_tokens), np.zeros(2), np.zeros(3)
        for links, rows, f, b, e in blocks(flat):
            odds = f * b
            off = np.where(mask[rows], odds / (1 + odds), 0.0) - y[rows]
            g = e[:, 1:] * b[:, 1:]
            a = np.exp(links)
            joint = np.stack([a[0, 1] * g, a[1, 0] * f[:, :-1], a[1, 1] * f[:, :-1] * g])
            joint /= a[0, 0] + joint.sum(axis=0)
            before, after, pair = y[rows, :-1], y[rows, 1:], mask[rows, 1:] & mask[rows, :-1]
            told = np.array([(~before & after & pair).sum(), (before & ~after & pair).sum(), (before & after & pair).sum()])
            by_token += np.bincount(tokens[rows].reshape(-1), weights=off.reshape(-1), minlength=n_tokens)
            ends += off.sum(), off[:, 0].sum()
            joints += np.where(pair, joint, 0.0).sum(axis=(1, 2)) - told
        slopes = np.bincount(feature_at, weights=by_token[token_at], minlength=size) + settings.decay * n * flat[:size]
        gradient = np.concatenate([slopes, ends, joints]) / len(docs)
        first += 0.1 * (gradient - first)
        second += 0.02 * (gradient * gradient - second)
        flat -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-6)
    top = np.full(len(docs), -15.0)
    for links, rows, f, b, _ in blocks(flat):
        np.maximum.at(top, owner[rows], np.where(mask[rows], np.log(f * b), -15.0).max(axis=1))
    slope, offset = curve(np.clip(top, -15, 15), toxic, class_sizes)
    return Field(flat[:size], float(flat[-5]), links, float(flat[-4]), slope, offset)


def curve(x: np.ndarray, toxic: np.ndarray, class_sizes: tuple[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve, classes weighted to their true sizes, a weak prior on the slope."""
    weight = np.where(toxic, class_sizes[1] / max(toxic.sum(), 1), class_sizes[0] / max((~toxic).sum(), 1))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - toxic)) + np.array([beta[0] - 0.5, 0.0])
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1.0, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


class Tagger(dict):
    """Emission scores by token; a token not yet met is scored when it is looked up."""

    def __init__(self, value: tuple[Field, Settings]) -> None:
        self.field, self.settings = value

    def __missing__(self, token: str) -> float:
        score = self.field.emission(token)
        if len(token) <= 100:
            if len(self) >= self.settings.keep:
                self.clear()
            self[token] = score
        return score

    def log_odds(self, texts_of: list[str]) -> list[np.ndarray]:
        """Log odds of the toxic state for every token of every text."""
        emissions = [np.fromiter(map(self.__getitem__, own := t.split()), dtype=np.float64, count=len(own)) for t in texts_of]
        cut = [windows(e, self.settings.window) for e in emissions]
        values, mask = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
        parts = [messages(values[i : i + 2048], mask[i : i + 2048], self.field.links, self.field.start)[:2] for i in range(0, len(values), 2048)]
        odds = np.log(np.concatenate([f * b for f, b in parts]))
        ends = np.cumsum([len(c[0]) for c in cut])
        return [o.reshape(-1)[: len(e)] for o, e in zip(np.split(odds, ends[:-1]), emissions, strict=True)]

    def judge(self, texts_of: list[str]) -> list[tuple[float, list[dict]]]:
        """Score and spans of each text."""
        out = []
        logs = self.log_odds(texts_of) if self.field.trained else [np.zeros(0)] * len(texts_of)
        for text, odds in zip(texts_of, logs, strict=True):
            top = float(np.clip(odds.max(), -15, 15)) if len(odds) else -15.0
            spans = []
            if len(odds) and top >= 0:
                for m, o in zip(TOKEN.finditer(text), odds, strict=True):
                    if o >= 0:
                        spans.append({"start": m.start(), "end": m.end(), "probability": float(1 / (1 + np.exp(-o)))})
            out.append((float(1 / (1 + np.exp(-(self.field.slope * top + self.field.offset)))), spans))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[Sample, tuple[int, int]]:
    """The sampled training documents as whole texts, and the numbers of clean and toxic training labels."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.where(id_remainder("doc_id", settings.modulus) != settings.held_out)
    sizes = dict(rows.groupBy("toxic").count().collect())
    sizes = (sizes.get(0, 0), sizes.get(1, 0))
    share = F.when(F.col("toxic") == 1, hash_share(settings.toxic_docs / max(sizes[1], 1), F.col("doc_id")))
    chosen = rows.where(share.otherwise(hash_share(settings.clean_docs / max(sizes[0], 1), F.col("doc_id"))))
    # The sample has a documented bound, so it may be broadcast and gathered.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    got = joined.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    return Sample.of((bool(r["toxic"]), r["text"]) for b in got.to_batches(max_chunksize=100) for r in b.to_pylist()), sizes


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Field:
    return fit(*labelled_sample(docs, labels, settings), settings)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def _scored(docs: DataFrame, columns: list[str], field: Field, settings: Settings) -> DataFrame:
    """``doc`` (a struct of the columns), score and spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((field, settings))
    rows = docs.select(F.struct(*columns).alias("doc"), texts(docs).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        tagger = built("toxicity", sent, Tagger)
        for batch in slices(batches, "text"):
            scores, spans = zip(*tagger.judge(batch.column(1).cast(pa.string()).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc", "score", "spans"])

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (offsets of toxic tokens) for every row of ``docs``."""
    scored = _scored(docs, ["doc_id"], train(docs, labels, settings), settings).select("doc.doc_id", "score", "spans")
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", settings.modulus) == settings.held_out).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
        "spans",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return _scored(docs, docs.columns, train(docs, labels, settings), settings).where(F.col("score") < settings.threshold).select("doc.*")

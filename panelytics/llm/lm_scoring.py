"""Scores whole documents with a gated recurrent language model and with a unigram base.

How the work is spread:

* Words are counted over all training rows, combined in each task before the shuffle; the counts are
  a stored table. Only its frequent end, at most ``word_table`` words, goes to the tasks.
* The recurrent model (see ``gru``) predicts the ``model_words`` most frequent words by frequency classes
  of equal mass, and every other word by a class for its shape (letters outside ASCII, last character). Inside
  a shape, p(word) = (c + 1) / (N_s + V_s + 1) from the counts of all training rows, c = 0 being the one slot of
  unseen words, so all probabilities add up to one.
* Weights are trained in one pass over all training documents, at every size of the input. A hash deals them to the
  rounds, and each replica of a round sees a slice of its own; after each round the replicas' weights are averaged by a
  grouped aggregation over weight positions.
* Documents become symbols once, in one pass, with their sums over the frequent words; training and scoring read the stored
  symbols, which are bytes to Spark (two for a symbol, or four where there are more than 65,536). A document's words outside the frequent end are joined to the stored counts by word; no word there is frequent
  enough to make a hot key.

Defined results: null text is empty and has one token, the end. A null id counts as the empty text when its
remainder is taken, and so trains. Rows are scored one by one, repeated rows alike. No training rows: N = V = 0,
base probability 1 and n_known 0. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm import gru
from panelytics.llm.common import built, drop_built, id_remainder, slices, texts, words
from panelytics.session import stage

END = b""  # no word is empty
SHAPES = 24
LOG10 = math.log(10)


@dataclass(frozen=True)
class Settings:
    modulus: int = 7
    held_out: int = 2
    word_table: int = 262_144
    model_words: int = 2_048
    classes: int = 32
    embedding: int = 16
    hidden: int = 32
    window: int = 32
    rounds: int = 3
    replica_tokens: int = 1_000_000
    rate: float = 0.01
    seed: int = 11


def word_shape(word: bytes) -> int:
    """0 .. SHAPES - 1: by the first letter outside ASCII (8 kinds) and the last character (3 kinds)."""
    if word.isascii():
        kind = 0
    else:
        at = next(i for i, b in enumerate(word) if b > 127)
        kind = 1 + (word[at] * 31 + (word[at + 1] if at + 1 < len(word) else 0)) % 7
    last = word[-1]
    return kind * 3 + (0 if 97 <= last <= 122 or last > 127 else 1 if last in b".,;:!?" else 2)


def count_words(training: DataFrame) -> DataFrame:
    """(word, c): occurrences in the ``text`` of all rows, ends included."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    partial = training.select(texts(training).alias("text")).mapInArrow(count, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, at most ``limit``; words of like count go in or out together."""
    step = F.floor(F.log2("c") * 16)
    found, least = 0, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 1,024 rows
        found += row["count"]
        if found > limit:
            break
        least = row["step"]
    if least is None:
        return []
    rows = counts.where(step >= least).select("word", "c").toArrow()
    pairs = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of the counts: the frequent words and, for each, its symbol and count."""

    table: bytes  # words of the table between blanks, most frequent first; END comes last
    counts: np.ndarray
    symbols: np.ndarray
    model_words: int
    rare_log: np.ndarray  # log10(N_s + V_s + 1) of each shape
    total: int  # N
    distinct: int  # V

    @property
    def kind(self) -> np.dtype:
        """The stored form of a symbol."""
        return np.dtype("<u2" if self.model_words + SHAPES <= 1 << 16 else "<u4")

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate([*self.table.split(b" "), END] if self.table else [END])}


def vocabulary(counts: DataFrame, settings: Settings) -> tuple[Vocabulary, gru.Shape, np.ndarray]:
    """The vocabulary, the model's shape and the counts of its symbols; ``counts`` is a stored table."""
    head = [(w, c) for w, c in frequent(counts, settings.word_table) if w != END]
    totals = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c")))).first()
    total, distinct, ends = (int(v or 0) for v in totals)
    modelled = min(settings.model_words - 1, len(head))
    symbols_of = {w: i for i, (w, _) in enumerate(head[:modelled])}

    def shapes(batches):
        sums = np.zeros((SHAPES, 2), dtype=np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w != END and w not in symbols_of:
                    sums[word_shape(w)] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["shape", "n", "v"])

    by_shape = np.zeros((SHAPES, 2))
    summed = counts.select("word", "c").mapInArrow(shapes, "shape long, n long, v long").groupBy("shape").agg(F.sum("n"), F.sum("v"))
    for shape, n, v in summed.collect():
        by_shape[shape] = n, v
    # Symbols: modelled words by falling count, then the end, then one for each shape.
    weight = np.array([c for _, c in head[:modelled]] + [ends], dtype=np.float64)
    share = np.concatenate([[0], np.cumsum(np.sort(weight)[::-1])[:-1]]) / max(weight.sum(), 1)
    cut = np.minimum((share * settings.classes).astype(int), settings.classes - 1)
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), *range(modelled + 1, modelled + 1 + SHAPES + 1)]
    edges = sorted(set(int(e) for e in edges))
    symbol = np.array([i if i < modelled else modelled + 1 + word_shape(w) for i, (w, _) in enumerate(head)] + [modelled], dtype=np.int32)
    vocab = Vocabulary(
        b" ".join(w for w, _ in head),
        np.array([c for _, c in head] + [ends], dtype=np.int64),
        symbol,
        modelled + 1,
        np.log10(by_shape.sum(axis=1) + 1),
        total,
        distinct,
    )
    shape = gru.Shape(modelled + 1 + SHAPES, tuple(edges), settings.embedding, settings.hidden)
    return vocab, shape, np.concatenate([weight, by_shape[:, 0]])


def _coded(text: bytes, index: dict, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Table positions (-1: outside), symbols, and the words outside the table; the end comes last."""
    found = words(text)
    at = np.empty(len(found) + 1, dtype=np.int32)
    at[:-1] = np.fromiter(map(index.get, found, repeat(-1)), dtype=np.int32, count=len(found))
    at[-1] = index[END]
    symbols = vocab.symbols[at]
    outside = np.flatnonzero(at < 0)
    tail = [found[i] for i in outside]
    if tail:
        symbols[outside] = [vocab.model_words + word_shape(w) for w in tail]
    return at, symbols, tail


def coded_rows(docs: DataFrame, vocab: Vocabulary, settings: Settings) -> DataFrame:
    """Every row of ``docs`` as symbols, with what its score takes from the counts, stored; key: a hash of id and text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def code(batches):
        index, vocab = built("words", sent, lambda v: v.index()), sent.value
        log_count = np.log10(vocab.counts + 1.0)
        known = vocab.counts > 0
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("tokens", "known", "base", "rare", "words", "times")}
            coded = []
            for text in batch.column(3).to_pylist():
                at, symbols, tail = _coded(text, index, vocab)
                inside = at[at >= 0]
                rare = symbols >= vocab.model_words
                seen = Counter(tail)
                out["tokens"].append(len(at))
                out["known"].append(int(known[inside].sum()))
                out["base"].append(float(log_count[inside].sum()))
                out["rare"].append(float(log_count[at[rare & (at >= 0)]].sum() - vocab.rare_log[symbols[rare] - vocab.model_words].sum()))
                out["words"].append(list(seen))
                out["times"].append(list(seen.values()))
                coded.append(symbols)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            symbols = pa.array([s.astype(vocab.kind).tobytes() for s in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, symbols], names)

    names = ["doc_id", "held_out", "key", "tokens", "known", "base", "rare", "words", "times", "symbols"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = id_remainder("doc_id", settings.modulus) == settings.held_out
    rows = docs.select("doc_id", held.alias("held_out"), F.xxhash64("doc_id", "text").alias("key"), texts(docs).alias("text"))
    coded = rows.mapInArrow(
        code,
        f"doc_id {kind}, held_out boolean, key long, tokens long, known long, base double, rare double, words array<binary>, times array<long>, symbols binary",
    )
    return stage(coded.withColumn("row", F.monotonically_increasing_id()), "lm-coded")


def dealt_rounds(training: DataFrame, vocab: Vocabulary, settings: Settings, coded: DataFrame | None = None) -> list[DataFrame]:
    """The training rows as (key, symbols), each in one of the rounds; a partition is the slice of one replica.

    ``coded``: the same rows as ``coded_rows`` has stored them, if they are.
    """
    coded = coded_rows(training, vocab, settings) if coded is None else coded
    part = F.pmod("key", F.lit(settings.rounds))
    tokens = dict(coded.groupBy(part).agg(F.sum("tokens")).collect())
    coded = coded.select("key", "symbols")
    # Rounds were chosen by a hash, so any even deal will do; replicas, and what they send, stay in proportion to the rows.
    return [coded.where(part == k).repartition(max(1, round(tokens[k] / settings.replica_tokens))) for k in sorted(tokens)]


def trained(rounds: list[DataFrame], shape: gru.Shape, weights: np.ndarray, settings: Settings, kind: np.dtype) -> np.ndarray:
    """One pass over all rows of the rounds, by replicas whose weights are averaged in Spark after each round."""
    for dealt in rounds:
        now = dealt.sparkSession.sparkContext.broadcast(weights)

        def replica(batches, now=now):
            gru.one_thread()
            drop_built()
            rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            own = [np.frombuffer(s.as_buffer(), dtype=kind).astype(np.int64) for _, s in sorted(rows, key=lambda r: r[0])]
            if own:
                out = gru.train(shape, now.value, own, window=settings.window, rate=settings.rate)
                seen = float(sum(map(len, own)))
                at = pa.array(np.arange(len(out), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([at, pa.array(out * seen, pa.float64()), pa.array(np.full(len(out), seen))], ["at", "value", "seen"])

        summed = dealt.mapInArrow(replica, "at int, value double, seen double").groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value"))
        got = summed.toArrow()
        weights = weights.copy()
        weights[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.float32)
    return weights


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    held = id_remainder("doc_id", settings.modulus) == settings.held_out
    training = docs.where(~held)
    counts = stage(count_words(training), "lm-counts")
    vocab, shape, symbol_counts = vocabulary(counts, settings)
    coded = coded_rows(docs, vocab, settings)
    rounds = dealt_rounds(training, vocab, settings, coded.where(~F.col("held_out")))
    weights = trained(rounds, shape, gru.initial(shape, symbol_counts, settings.seed), settings, vocab.kind)
    sent = spark.sparkContext.broadcast((shape, weights))

    def run(batches):
        gru.one_thread()
        drop_built()
        shape, weights = sent.value
        for batch in slices(batches, "symbols", (3 << 19) * kind.itemsize):
            own = [np.frombuffer(s.as_buffer(), dtype=kind).astype(np.int32) for s in batch.column(batch.num_columns - 1)]
            model = gru.score(shape, weights, own) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model)], [*kept, "model"])

    kept, kind = ["row", "doc_id", "held_out", "tokens", "known", "base", "rare"], vocab.kind
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.select(*kept, "symbols").mapInArrow(
        run, f"row long, doc_id {id_kind}, held_out boolean, tokens long, known long, base double, rare double, model double"
    )
    tail = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    log_c = F.log10(F.col("c") + F.lit(1.0))
    of_tail = tail.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * log_c).alias("more"))
    space = math.log10(vocab.total + vocab.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(of_tail, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("tokens") * F.lit(space)).alias("base_score"),
        (F.col("model") + F.col("rare") + more).alias("score"),
    )

"""Quality scores by a generalised additive model with pairwise interactions.

Each document becomes a few counts and ratios of its whole text. Training bins every feature by
quantiles and boosts in cycles: each step fits a shallow tree on one feature (later: on one pair of
features) to the gradient of the log loss and adds it, shrunken, to that feature's lookup table. A
score is then a sum of table entries, so scoring is a few vectorised gathers per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import held_out, seeded_uniform, steps, utf8, word_hashes

FEATURES = (
    "log_bytes", "symbols", "stops", "capitals", "digits", "spaces", "newlines", "bars", "marks", "wide",
    "same_byte", "word_bytes", "repeated_words", "distinct_words", "symbol_words", "words_per_line",
)
#: Labelled rows that a model learns from at most, about; see labelled_sample.
SAMPLE = 20_000
KEEP_AT = 0.7

# classes of bytes: 0 small letters, then as named
_SYMBOL, _STOP, _CAPITAL, _DIGIT, _SPACE, _NEWLINE, _BAR, _MARK, _WIDE = range(1, 10)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[128:] = _WIDE
    for chars, kind in (
        ("abcdefghijklmnopqrstuvwxyz", 0),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CAPITAL),
        ("0123456789", _DIGIT),
        (" \t\r\x0b\x0c", _SPACE),
        ("\n", _NEWLINE),
        (".,;:'\"-()", _STOP),
        ("|<>{}[]/\\", _BAR),
        ("!?", _MARK),
    ):
        out[[ord(c) for c in chars]] = kind
    return out


_CLASSES = _byte_classes()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text given as bytes and offsets; an empty text has all 0."""
    n, sizes = len(at) - 1, np.diff(at)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    row = np.repeat(np.arange(n), sizes)
    kind = _CLASSES[data]
    counts = np.bincount(row * 10 + kind, minlength=10 * n).reshape(n, 10)
    some = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 1:10] = counts[:, 1:10] / some[:, None]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (kind[1:] != _WIDE)
    out[:, 10] = np.bincount(row[same], minlength=n) / some
    inside = np.where((kind == _SPACE) | (kind == _NEWLINE), 0, data).astype(np.uint8)
    words, of, starts = word_hashes(data, at, inside)
    n_words = np.bincount(of, minlength=n)
    some = np.maximum(n_words, 1)
    out[:, 11] = np.minimum((sizes - counts[:, _SPACE] - counts[:, _NEWLINE]) / some, 50)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    out[:, 12] = np.bincount(of[again], minlength=n) / some
    key = np.sort((words >> np.uint64(24)) | (of.astype(np.uint64) << np.uint64(40)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out[:, 13] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / some
    odd = np.add.reduceat(np.isin(kind, (_SYMBOL, _BAR, _MARK)).astype(np.int32)[starts[0] :], starts - starts[0]) > 0 if len(starts) else np.zeros(0, bool)
    out[:, 14] = np.bincount(of[odd], minlength=n) / some
    out[:, 15] = np.log1p(n_words / (counts[:, _NEWLINE] + 1))
    out[sizes == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` holds (feature, feature, table)."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float
    learned_from: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        out = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[bins[i], bins[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins into two leaves."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + damp) + (all_g - left_g) ** 2 / (all_h - left_h + damp) - all_g**2 / (all_h + damp)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, damp: float, leaves: int = 3) -> np.ndarray:
    """A tree of at most ``leaves`` leaves on binned gradients, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, cut), k = max((_best_cut(g[a:b], h[a:b], damp), k) for k, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + damp)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """The better of the two trees that cut one axis and then the other in either part."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _best_cut(a.sum(1), b.sum(1), damp)
        out, gain = np.zeros_like(a), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph = a[part].sum(0), b[part].sum(0)
            more, at = _best_cut(pg, ph, damp)
            gain += more
            for side in (slice(0, at), slice(at, None)):
                out[part, side] = -pg[side].sum() / (ph[side].sum() + damp)
        if gain > best[0]:
            best = gain, out.T if turn else out
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pairs: int = 6, rate: float = 0.1, damp: float = 2.0) -> Model:
    """Cyclic boosting on all rows given. Without both labels the score is that of the one seen, or 0.5."""
    seen = len(y)
    prior = (y.sum() + 0.5) / (seen + 1.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if seen else np.zeros(0) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(prior / (1 - prior))), seen)
    if not seen or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    logit = np.full(seen, model.intercept)
    for _ in range(rounds):
        for k, b in enumerate(binned):
            p = 1.0 / (1.0 + np.exp(-logit))
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(b, p - y, size), np.bincount(b, p * (1 - p), size), damp)
            model.tables[k] += step
            logit += step[b]
    p = 1.0 / (1.0 + np.exp(-logit))
    found = []
    for i in range(len(binned)):
        for j in range(i + 1, len(binned)):
            shape = (len(model.tables[i]), len(model.tables[j]))
            cell = binned[i] * shape[1] + binned[j]
            g = np.bincount(cell, p - y, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
            found.append((_pair_tree(g, h, damp)[0], i, j))
    chosen = sorted(found, reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in chosen]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            p = 1.0 / (1.0 + np.exp(-logit))
            cell = binned[i] * t.shape[1] + binned[j]
            g = np.bincount(cell, p - y, t.size).reshape(t.shape)
            h = np.bincount(cell, p * (1 - p), t.size).reshape(t.shape)
            step = rate * _pair_tree(g, h, damp)[1]
            t += step
            logit += step.ravel()[cell]
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        found = [features(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in steps(at)]
        flat = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *[pa.array(c) for c in flat.T]], ["doc_id", "y", *FEATURES])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled documents at most, outside the held-out fold.

    Labels are chosen by a hash of the doc_id, at a rate that their count gives, so the choice is the
    same however the table is stored. Null labels are no labels; a doc_id labelled twice counts twice.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.where(seeded_uniform(6, F.col("doc_id")) < most / n)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """A model from the whole texts of a bounded sample; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label, most).select("doc_id", F.col("y").cast("double").alias("y"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, " + ", ".join(f"{c} double" for c in FEATURES)
    got = sample.mapInArrow(_features_of, schema).toPandas()
    got = got.sort_values(["doc_id", "y", *FEATURES], kind="stable")  # the model doesn't depend on how rows arrive
    return fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and a score in [0, 1] for each whole text, null counting as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, at = utf8(texts)
            found = [shipped.value.scores(features(data[at[a] : at[b]], at[a : b + 1] - at[a])) for a, b in steps(at)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(score_col, score(F.col(text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels, lang, source and doc_id are never inputs of a score: equal texts score alike. Documents
    without a label are scored like others. With no label at all every score is 0.5.
    """
    scored = with_scores(docs.select("doc_id", "text"), learn(docs, labels, most=most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))

"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier on hashed byte n-grams says
which side of the code the text is on, with a margin; loss-weighted decoding picks the codeword with
the least logistic loss, each bit weighted by how well its classifier did in training. A text whose
two best codewords are about as close is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import folded, held_out, seeded_uniform, steps, utf8

BUCKETS = 4096
#: Labelled documents that a model learns from, about, for each language.
PER_LANGUAGE = 400
UNKNOWN = "und"

_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Root frequencies of hashed bigrams and trigrams of folded word bytes, one row a text."""
    n = len(at) - 1
    if not len(data):
        return np.zeros((n, BUCKETS), np.float32)
    low = folded(data)
    low[(data >= 48) & (data <= 57)] = 0  # digits tell nothing
    text = np.zeros(len(low) + n + 2, np.uint32)  # each row ends in a gap
    row = np.repeat(np.arange(n), np.diff(at))
    text[np.arange(len(low)) + row] = low
    a, b, c = text[:-2], text[1:-1], text[2:]
    where = np.repeat(np.arange(n), np.diff(at) + 1)
    pair = a * _MULTIPLIERS[0] + b * _MULTIPLIERS[1] + np.uint32(1)
    grams = [(pair, (a | b) != 0), (pair * np.uint32(31) + c * _MULTIPLIERS[2] + np.uint32(2), (b != 0) & ((a | c) != 0))]
    out = np.zeros(n * BUCKETS, np.int64)
    for gram, real in grams:
        gram = gram ^ (gram >> np.uint32(15))
        bucket = (gram * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        spot = (where * BUCKETS + bucket[: len(where)])[real[: len(where)]]
        out += np.bincount(spot, minlength=n * BUCKETS)
    got = np.sqrt(out.reshape(n, BUCKETS).astype(np.float32))
    norm = np.sqrt((got * got).sum(1, keepdims=True))
    return got / np.maximum(norm, 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1: all splits up to 7 languages, the best of seeded random codes beyond."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = (1 << (n - 1)) - 1  # the first language has 1 everywhere; every other split once
        return np.array([[1.0 if k == 0 or ((split >> (k - 1)) & 1) == 0 else -1.0 for split in range(1, bits + 1)] for k in range(n)])
    random, best = np.random.default_rng(seed), (-1.0, np.zeros(0))
    for _ in range(64):
        code = random.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > best[0] and (np.abs(code.sum(0)) < n).all():
            best = apart.min(), code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1) x bits; the last row is the bias
    trust: np.ndarray  # one weight a bit, summing to 1
    sharpness: float = 8.0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of each row's language, its probability, and the best's lead over the next."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        best = loss.argmin(1)
        p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ordered = np.sort(p, 1)
        return best, p.max(1), ordered[:, -1] - ordered[:, -2] if p.shape[1] > 1 else np.ones(len(p))


def fit(x: np.ndarray, lang: list[str], steps_: int = 150, rate: float = 20.0, keep: float = 1e-5) -> Model:
    """All bits' logistic regressions at once, by accelerated gradient steps; classes weigh alike."""
    names = sorted(set(lang))
    code = codewords(len(names))
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    if len(names) < 2:
        return Model(names, code, weights, np.ones(code.shape[1]) / max(1, code.shape[1]))
    index = {name: k for k, name in enumerate(names)}
    y = np.array([index[v] for v in lang])
    sign = code[y].astype(np.float32)
    share = (1.0 / (len(names) * np.bincount(y)[y])).astype(np.float32)[:, None]
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ahead = weights.copy()
    for k in range(steps_):
        pull = sign * share / (1 + np.exp(np.clip(sign * (x @ ahead), -30, 30)))
        new = ahead + rate * (x.T @ pull - keep * ahead)
        ahead = new + k / (k + 3) * (new - weights)
        weights = new
    right = ((np.sign(x @ weights) == sign) * share).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(names, code, weights.astype(np.float32), trust / trust.sum())


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        rows = [r.tobytes() for a, b in steps(at) for r in features(data[at[a] : at[b]], at[a : b + 1] - at[a]).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "x"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from a hashed sample of the labelled documents outside the held-out fold.

    About ``per_language`` documents of each language are read whole; their fixed-size feature rows,
    not their texts, reach the driver, which also sees one count a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    rate = F.lit(1.0)
    for name, n in sorted(counts.items()):
        if n > per_language:
            rate = F.when(F.col("lang") == name, per_language / n).otherwise(rate)
    sample = known.where(seeded_uniform(1, F.col("doc_id")) < rate).select("doc_id", "lang", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(_features_of, f"doc_id {kind}, lang string, x binary").toPandas().sort_values(["doc_id", "lang", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(x, list(got["lang"]))


def with_language(docs: DataFrame, model: Model, text_col: str = "text", doubt: float = 0.2) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from each whole text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        names = pa.array([*model.languages, UNKNOWN])
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        for texts in batches:
            data, at = utf8(texts)
            best, score, lead = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for a, b in steps(at):
                part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
                if model.languages:
                    found, p, gap = model.decode(features(part, own))
                else:
                    found, p, gap = np.zeros(b - a, np.int64), np.ones(b - a), np.ones(b - a)
                ends = np.concatenate([[0], np.cumsum(ascii_letter[part])])
                for k in np.flatnonzero(ends[own[1:]] == ends[own[:-1]]):
                    if not any(c.isalpha() for c in bytes(part[own[k] : own[k + 1]]).decode("utf-8", "replace")):
                        found[k], p[k], gap[k] = len(model.languages), 0.0, 1.0
                if not model.languages:
                    found[:] = 0
                    p[:] = 0.0
                best.append(found)
                score.append(p)
                lead.append(gap)
            best, score, lead = np.concatenate(best), np.concatenate(score), np.concatenate(lead)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score, pa.float64()), pa.array(lead < doubt)], ["lang_pred", "score", "ambiguous"])

    return docs.withColumn("__told", tell(F.col(text_col))).select("*", "__told.*").drop("__told")


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Learns only from text and lang of documents outside the held-out fold; lang, source and doc_id
    are never inputs of a prediction, so equal texts get equal ones. A null text, or one without a
    letter, is ``und`` with score 0. So is every text where there is nothing to learn from.
    """
    told = with_language(docs.select("doc_id", "text"), learn(docs, per_language))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

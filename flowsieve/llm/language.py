"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed
character n-grams says whether a text belongs to the languages whose bit is set. The
answers are compared with all codewords under a logistic loss, each bit weighted by
how well it is known for that language; the nearest codeword wins, and a text whose
second codeword is about as near is flagged as ambiguous.

Learning is two passes over all labelled rows, both sums of small vectors: n-gram mass
by language, then the mean and spread of each bit's answer by language. What reaches
the driver has one row for each language and n-gram bucket, whatever the table's size.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, narrow

BUCKETS = 8192  # hashed n-grams
ORDERS = (1, 2, 3, 4)  # bytes in an n-gram
PIECE = 1 << 20  # bytes of a long text handled at once
UNIT = 1 << 16  # n-gram mass is summed in whole numbers, so sums do not depend on their order
LANGUAGES = 512  # most languages a model can hold
CLOSE = 0.5  # a winning language with less than this share of belief is ambiguous
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def _class_table() -> np.ndarray:
    """Letters and bytes of longer characters stay, everything else is a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    return table


_CLASS = _class_table()


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts, over the whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    for begin in range(0, len(raw), PIECE):
        data = _CLASS[raw[begin : begin + PIECE + max(ORDERS) - 1]]
        blank = data == 32
        data = data[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
        h = np.zeros(len(data), np.uint32)
        for order in ORDERS:
            if len(data) < order:
                break
            h = h[: len(data) - order + 1] * np.uint32(0x01000193) + data[order - 1 :] + np.uint32(order)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)
    root = np.sqrt(counts)
    return root / max(1e-12, math.sqrt(float(counts.sum())))


def codewords(count: int) -> np.ndarray:
    """One row of +1 and -1 for each language, with no constant and no repeated column.

    Up to six languages get every possible split; more get the random code with the
    largest smallest distance out of a fixed number of seeded tries.
    """
    if count <= 1:
        return np.ones((count, 0), np.int64)
    if count <= 6:
        splits = np.arange(1, 1 << (count - 1))
        return np.where(splits[None, :] >> np.arange(count)[:, None] & 1, 1, -1)
    width = 2 * math.ceil(5 * math.log2(count))
    best, best_gap = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice((-1, 1), (count, width))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        gap = min(int((code[a] != code[b]).sum()) for a in range(count) for b in range(a))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class LanguageModel:
    """Languages, their codewords, and for each bit a linear classifier with its calibration."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    slope: np.ndarray  # bits
    middle: np.ndarray  # bits
    trust: np.ndarray  # languages x bits

    def answers(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights - self.middle) * self.slope

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Nearest language, its share of belief among all languages, and whether it is ambiguous."""
        if not self.languages:
            return UNDETERMINED, 0.0, True
        loss = np.logaddexp(0, -self.code * self.answers(x)[None, :])
        distance = (self.trust * loss).sum(axis=1)
        near = int(distance.argmin())
        share = np.exp(distance[near] - distance)
        score = float(share[near] / share.sum())
        return self.languages[near], score, score < CLOSE


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram mass of each language in this task."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("mass", pa.int64())])
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            mass = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            mass += np.rint(features(text) * UNIT).astype(np.int64)
    for lang, mass in sums.items():
        some = np.flatnonzero(mass)
        yield batch_of(schema, {"lang": [lang] * len(some), "bucket": some.astype(np.int32), "mass": mass[some]})


def _spreads(model: LanguageModel):
    schema = pa.schema([("lang", pa.string()), ("bit", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("square", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        bits = model.code.shape[1]
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                f = features(text) @ model.weights
                own = sums.setdefault(lang, np.zeros((3, bits), np.int64))
                own += np.stack([np.ones(bits), np.rint(f * UNIT), np.rint(f * f * UNIT)]).astype(np.int64)
        for lang, (n, total, square) in sums.items():
            yield batch_of(schema, {"lang": [lang] * bits, "bit": np.arange(bits, dtype=np.int32), "n": n, "total": total, "square": square})

    return run


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row where ``train`` holds, the language is known and the text has a letter."""
    rows = docs.where(train & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    masses = rows.mapInArrow(_grams, "lang string, bucket int, mass long").groupBy("lang", "bucket").agg(F.sum("mass").alias("mass"))
    found = masses.limit(LANGUAGES * BUCKETS + 1).toPandas()
    if len(found) > LANGUAGES * BUCKETS:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(found["lang"].unique().tolist())
    at = {lang: k for k, lang in enumerate(languages)}
    mass = np.zeros((len(languages), BUCKETS))
    mass[found["lang"].map(at).to_numpy(int), found["bucket"].to_numpy(int)] = found["mass"].to_numpy(float) / UNIT
    mass /= np.maximum(mass.sum(axis=1, keepdims=True), 1e-12)  # each language counts alike
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits))
    floor = 0.01 / BUCKETS
    for j in range(bits):
        yes, no = mass[code[:, j] > 0].mean(axis=0), mass[code[:, j] < 0].mean(axis=0)
        weights[:, j] = np.log((yes + floor) / (no + floor))
    model = LanguageModel(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(code.shape))
    if not bits:
        return model
    spreads = rows.mapInArrow(_spreads(model), "lang string, bit int, n long, total long, square long")
    spreads = spreads.groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")])
    n, total, square = np.zeros(code.shape), np.zeros(code.shape), np.zeros(code.shape)
    for r in spreads.collect():  # one row for each language and bit
        n[at[r.lang], r.bit], total[at[r.lang], r.bit], square[at[r.lang], r.bit] = r.n, r.total / UNIT, r.square / UNIT
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(n, 1) - mean**2, 1e-6))
    for j in range(bits):
        yes, no = code[:, j] > 0, code[:, j] < 0
        gap = mean[yes, j].mean() - mean[no, j].mean()
        model.middle[j] = (mean[yes, j].mean() + mean[no, j].mean()) / 2
        model.slope[j] = max(gap, 1e-9) / (spread[:, j] ** 2).mean()
    # how often the bit is right for the language, were its answers normally distributed
    lean = code * (mean - model.middle) / spread
    right = 0.5 * (1 + np.vectorize(math.erf)(lean / math.sqrt(2)))
    model.trust = right / np.maximum(right.sum(axis=1, keepdims=True), 1e-12)
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, uid, lang_pred, score, ambiguous) for every row; only the text is looked at.

    Null text and text without a letter is ``und`` with score 0; so is everything if
    nothing was learned. A model of one language answers it with score 1. Repeated rows
    keep a row each; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model.__dict__))
    schema = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**pickle.loads(shipped.value))
        for batch in batches:
            found = [
                own.decode(features(t)) if _LETTER.search(t) else (UNDETERMINED, 0.0, True)
                for t in batch.column("text").to_pylist()
            ]
            lang, score, close = zip(*found, strict=True) if found else ((), (), ())
            yield batch_of(schema, {"id": batch.column("id"), "uid": batch.column("uid"), "lang_pred": lang, "score": score, "ambiguous": close})

    base = narrow(docs, id=id_col, text=text_col)
    out = base.mapInArrow(run, "id long, uid long, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)

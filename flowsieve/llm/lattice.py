"""Language-model scores from subword lattices.

A unigram vocabulary gives each piece a probability. A word, with its leading space
mark, is the sum over all ways to cut it into pieces; a log-space forward recursion
over the word's lattice adds them up. A text is its words and an end. So the score is
the marginal probability of the text, not that of one best segmentation.

The existing vocabulary orders its pieces by score; the order becomes a first Zipf
distribution, and expectation steps over all training words (forward and backward
recursion, every segmentation by its share) turn it into the corpus's own, until a step
gains next to nothing.

Words repeat, so nothing is scored twice: documents are read once and become blocks of
bounded size, each with its own word list. Word lists meet once to count and to score
the distinct words, and the numbers return to their blocks. Full texts never move.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import LOWER, batch_of, durable, narrow, text_bytes

SPACE = "▁"
BLOCK_TOKENS = 2_000_000  # words of documents that share one word list
ZIPF_SHIFT = 2.7
PRIOR_MASS = 1000.0  # pseudo-counts that the vocabulary's own order is worth
BYTE_SHARE = 1e-4  # share of probability kept for characters outside the vocabulary
GROUP_CELLS = 1 << 18  # characters of equally long words that are worked on at once
GROUP_WORDS = 16_384  # words worked on together
SETTLED = 0.01  # gain of a step, in base-10 logarithm for each training token, below which steps end
MOST_STEPS = 30
UNIT = 1 << 20  # expected counts are summed in whole numbers, so sums do not depend on their order
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LOADED: dict[str, Lattice] = {}


class Lattice:
    """Pieces of a vocabulary and the recursions over all segmentations of words."""

    def __init__(self, pieces: dict[str, float], order: list[str] | None = None) -> None:
        """``pieces``: piece and existing score, higher is likelier."""
        ranked = order or sorted(pieces, key=lambda p: (-pieces[p], p))
        self.names = ranked
        self.longest = max(map(len, ranked), default=1)
        keys = np.array([self._key(p) for p in ranked], np.uint64)
        at = np.argsort(keys)
        self.keys, self.ids = keys[at], at.astype(np.int32)
        weight = 1 / (ZIPF_SHIFT + np.arange(len(ranked)))
        self.prior = weight / weight.sum()

    @classmethod
    def of_model(cls, model: bytes) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kept = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        return cls({sp.id_to_piece(k): sp.get_score(k) for k in kept})

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def first_guess(self) -> np.ndarray:
        """Log probabilities of pieces, then one for an unknown character's byte, then the end."""
        return self.fitted(np.zeros(len(self.names)), 0.0)

    def fitted(self, counts: np.ndarray, ends: float) -> np.ndarray:
        """Log probabilities from expected counts, smoothed by the vocabulary's own order."""
        mass = counts + PRIOR_MASS * self.prior
        ends += 1.0
        whole = (mass.sum() + ends) / (1 - BYTE_SHARE)
        return np.log(np.concatenate([mass / whole, [BYTE_SHARE / 256, ends / whole]]))

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, code points) of words of one length, a bounded number at a time."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        for length, where in sorted(by_length.items()):
            step = max(1, GROUP_CELLS // length)
            for begin in range(0, len(where), step):
                some = where[begin : begin + step]
                joined = "".join([SPACE + words[k] for k in some]).encode("utf-32-le", "surrogatepass")
                yield np.array(some), np.frombuffer(joined, np.uint32).reshape(len(some), length)

    def _edges(self, points: np.ndarray, logp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each end position: log probabilities and piece ids of the pieces that end there, shortest first."""
        n, length = points.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + points[:, j] + np.uint64(1)
        table = np.concatenate([logp[: len(self.names)], [-np.inf]])
        for j in range(1, length + 1):
            sizes = np.arange(1, min(j, self.longest) + 1)
            keys = prefix[j][None, :] - prefix[j - sizes] * power[sizes][:, None]
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ids = np.where(self.keys[slot] == keys, self.ids[slot], len(self.names))
            edge = table[ids]
            unknown = ids[0] == len(self.names)
            if unknown.any():
                c = points[unknown, j - 1]
                width = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
                edge[0, unknown] = width * logp[len(self.names)]
            yield j, edge, ids

    def scores(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(words))
        for where, points in self._groups(words):
            forward = np.zeros((points.shape[1] + 1, len(where)))
            for j, edge, _ in self._edges(points, logp):
                forward[j] = _log_sum(forward[j - 1 : j - 1 - len(edge) if j > len(edge) else None : -1] + edge)
            out[where] = forward[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, the words counted by ``weights``."""
        total = np.zeros(len(self.names) + 1)
        for where, points in self._groups(words):
            length = points.shape[1]
            forward = np.zeros((length + 1, len(where)))
            steps = []
            for j, edge, ids in self._edges(points, logp):
                forward[j] = _log_sum(forward[j - 1 : j - 1 - len(edge) if j > len(edge) else None : -1] + edge)
                steps.append((j, edge, ids))
            backward = np.full((length + 1, len(where)), -np.inf)
            backward[length] = 0
            scale = np.log(weights[where]) - forward[length]
            seen, uses = [], []
            for j, edge, ids in reversed(steps):
                for k in range(len(edge)):  # the piece of k + 1 characters that ends at j
                    real = np.flatnonzero(edge[k] > -np.inf)
                    if len(real):
                        i = j - 1 - k
                        through = edge[k][real] + backward[j][real]
                        seen.append(ids[k][real])
                        uses.append(np.exp(forward[i][real] + through + scale[real]))
                        backward[i][real] = np.logaddexp(backward[i][real], through)
            if seen:
                total += np.bincount(np.concatenate(seen), weights=np.concatenate(uses), minlength=len(total))
        return total[:-1]


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def _lattice(shipped: Broadcast) -> Lattice:
    model = shipped.value
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Lattice.of_model(model)
    return _LOADED[key]


BLOCKS = "block long, uid long, id long, train boolean, n_words long, steps binary, times binary, number int, word binary, count long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as counted numbers into their block's word list, and that list with its training counts."""
    from pyspark import TaskContext

    schema = pa.schema(
        [
            ("block", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("train", pa.bool_()), ("n_words", pa.int64()),
            ("steps", pa.binary()), ("times", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("count", pa.int64()),
        ]
    )
    block, numbers, counts, tokens = TaskContext.get().partitionId() << 24, defaultdict(), np.zeros(1 << 16, np.int64), 0
    numbers.default_factory = numbers.__len__

    def word_list() -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for a in range(0, len(names), 50_000):
            some = names[a : a + 50_000]
            n = len(some)
            empty = {f.name: pa.nulls(n, f.type) for f in schema}
            yield batch_of(
                schema,
                empty | {"block": np.full(n, block), "number": np.arange(a, a + n, dtype=np.int32), "word": some, "count": counts[a : a + n]},
            )

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        lowered, rows = LOWER[data], []
        meta = zip(*[batch.column(c).to_pylist() for c in ("uid", "id", "train")], strict=True)
        for (uid, own, train), lo, hi in zip(meta, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = lowered[lo:hi].tobytes().split()
            found, times = np.unique(np.array([numbers[w] for w in words], np.int64), return_counts=True)
            while len(numbers) > len(counts):
                counts = np.concatenate([counts, np.zeros_like(counts)])
            if train:
                counts[found] += times
            steps = np.diff(found, prepend=0).astype(np.uint32)
            rows.append((block, uid, own, train, len(words), steps.tobytes(), times.astype(np.uint32).tobytes(), None, None, None))
            tokens += len(words)
            if tokens >= BLOCK_TOKENS:
                yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                yield from word_list()
                block, tokens, counts, rows = block + 1, 0, np.zeros(1 << 16, np.int64), []
                numbers.clear()
        if rows:
            yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
    yield from word_list()


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``GROUP_WORDS``, so that words of one length come many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GROUP_WORDS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _expected(shipped: Broadcast, logp: Broadcast):
    schema = pa.schema([("piece", pa.int32()), ("mass", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lattice(shipped)
        total = np.zeros(len(own.names))
        for batch in _larger(batches):
            words = [w.decode() for w in batch.column("word").to_pylist()]
            total += own.expected(words, batch.column("c").to_numpy().astype(float), logp.value)
        some = np.flatnonzero(total)
        yield batch_of(schema, {"piece": some.astype(np.int32), "mass": np.rint(total[some] * UNIT).astype(np.int64)})

    return run


def _scored(shipped: Broadcast, logp: Broadcast):
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lattice(shipped)
        for batch in _larger(batches):
            words = [w.decode() for w in batch.column("word").to_pylist()]
            found = own.scores(words, logp.value) / np.log(10)
            yield batch_of(schema, {"word": batch.column("word"), "c": batch.column("c"), "marginal": found})

    return run


def _document_scores(total: int, distinct: int, ends: int, end_logp: float):
    """Scores of a block's documents from the numbers of its word list."""
    schema = pa.schema(
        [
            ("uid", pa.int64()), ("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base_score", pa.float64()), ("score", pa.float64()),
        ]
    )

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (total + distinct + 1))

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        size = int(words.column("number").to_numpy().max()) + 1 if words.num_rows else 0
        c, marginal = np.zeros(size), np.zeros(size)
        if size:
            at = words.column("number").to_numpy()
            c[at], marginal[at] = words.column("c").to_numpy(), words.column("marginal").to_numpy()
        plain, rows = base(c), []
        for d in docs.to_pylist():
            found = np.cumsum(np.frombuffer(d["steps"], np.uint32).astype(np.int64))
            times = np.frombuffer(d["times"], np.uint32).astype(np.int64)
            known = int(times[c[found] > 0].sum()) + (ends > 0)
            own = float(times @ plain[found]) + float(base(np.array(float(ends))))
            rows.append((d["uid"], d["id"], d["train"], d["n_words"] + 1, known, own, float(times @ marginal[found]) + end_logp / np.log(10)))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def lm_score(docs: DataFrame, train: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: word counts, the add-one word score and the lattice score.

    ``train`` is a condition over the columns of ``docs``; where it is null or false a
    row is scored only. Words are split at ASCII white space with A-Z lower-cased; each
    text has one end token. Null text counts as empty: its end alone is scored. Scores
    are base-10 logarithms. Without training rows the lattice keeps the vocabulary's
    own order. Repeated rows keep a row each, an empty table gives an empty result.
    Columns: id_col, uid, train, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    base = narrow(docs.withColumn("_train", F.coalesce(train, F.lit(False))), id=id_col, text=text_col, train="_train")
    blocks = durable(base.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    texts = blocks.where("word is null").select("block", "uid", "id", "train", "n_words", "steps", "times")
    lists = blocks.where("word is not null").select("block", "number", "word", "count")
    words = durable(lists.groupBy("word").agg(F.sum("count").alias("c")), "lm-words")
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = texts.where("train").count()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)

    with open(model_path, "rb") as f:
        model = f.read()
    own, shipped = Lattice.of_model(model), spark.sparkContext.broadcast(model)
    fitted = own.first_guess()
    for _ in range(MOST_STEPS if total else 1):
        guess = spark.sparkContext.broadcast(fitted)
        masses = words.where("c > 0").mapInArrow(_expected(shipped, guess), "piece int, mass long")
        counts = np.zeros(len(own.names))
        for r in masses.groupBy("piece").agg(F.sum("mass").alias("mass")).collect():  # at most one row for each piece
            counts[r.piece] = r.mass / UNIT
        before, fitted = fitted, own.fitted(counts, float(ends))
        # what the expected uses gain is no more than what the training words gain
        gain = counts @ (fitted - before)[: len(counts)] / max(total, 1) / np.log(10)
        if gain < SETTLED:
            break
    scored = words.mapInArrow(_scored(shipped, spark.sparkContext.broadcast(fitted)), "word binary, c long, marginal double")
    returned = lists.join(scored, "word").select(F.col("block").alias("home"), "number", "c", "marginal")
    result = (
        texts.groupBy("block")
        .cogroup(returned.groupBy("home"))
        .applyInArrow(
            _document_scores(total, distinct, ends, float(fitted[-1])),
            "uid long, id long, train boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return result.withColumn("train_tokens", F.lit(total).cast("long")).withColumnRenamed("id", id_col)

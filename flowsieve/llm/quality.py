"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A
text that resembles the good examples gets smaller under the good dictionary; the
normalised difference of the two sizes is turned into a probability by a logistic
curve fitted on labelled rows that neither dictionary has seen.

Texts are compressed in pieces of a few kilobytes, each with a fresh dictionary, so a
long text keeps asking the dictionaries instead of its own beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, durable, narrow, text_bytes

PIECE = 2048  # bytes compressed at a time
SAMPLE = 4000  # ids, and pieces of their texts, of each class that a dictionary is built from; the only bound
DICTIONARY = 112_640  # bytes
LEVEL = 3
STEPS = 2000  # bins of the size difference, for calibration


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.int32()), ("order", pa.int64()), ("piece", pa.binary())])
    import xxhash

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw, rows = data.tobytes(), []
        labels, ids = batch.column("label").to_pylist(), batch.column("id").to_pylist()
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for at in range(lo, hi, PIECE):
                piece = raw[at : min(hi, at + PIECE)]
                order = xxhash.xxh64_intdigest(f"{ids[k]}/{at - lo}".encode()) >> 1
                rows.append((labels[k], order, piece))
        if rows:
            yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too little text to train on is used as it is."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


class Sizer:
    """Normalised size difference under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self.packers = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.packers.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def difference(self, raw: bytes) -> float:
        """(bad - good) / (bad + good): above 0 if the text is more like the good examples."""
        good, bad = (
            sum(len(p.compress(raw[at : at + PIECE])) for at in range(0, max(1, len(raw)), PIECE)) for p in self.packers
        )
        return (bad - good) / (bad + good)


def _sized(good: bytes, bad: bytes, keep: list[tuple[str, pa.DataType]]):
    schema = pa.schema([*keep, ("difference", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(good, bad)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            found = [sizer.difference(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch_of(schema, {"difference": found, **{n: batch.column(n) for n, _ in keep}})

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly damped logistic curve, by Newton steps."""
    scale = max(1e-9, float(np.sqrt(np.average(x**2, weights=weight))) if weight.sum() else 1.0)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-2 * beta
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1])


def marks(labels: DataFrame, train: Column, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) of the labelled ids where ``train`` (over the column ``id``) holds.

    Labels other than 0 and 1, null ids, and ids whose labels contradict each other
    are left out; an id that is labelled twice alike counts once.
    """
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).where(train)
    return rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def _half() -> Column:
    """0: ids for the dictionaries, 1: ids for calibration."""
    return F.pmod(F.xxhash64("id"), F.lit(2))


def dictionaries(
    docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> tuple[bytes, bytes] | None:
    """(good, bad) dictionaries, or None without both classes.

    Of each class the ``sample`` ids that come first by hash are looked up in ``docs``
    (a list of bounded size, so it is broadcast), and as many pieces of their texts,
    first by hash, train the dictionary.
    """
    order = F.xxhash64("id", F.lit("order"))
    chosen = [marked.where((_half() == 0) & (F.col("label") == k)).orderBy(order, "id").limit(sample) for k in (0, 1)]
    rows = narrow(docs, id=id_col, text=text_col).drop("uid").join(F.broadcast(chosen[0].union(chosen[1])), "id")
    pieces = durable(rows.mapInArrow(_pieces, "label int, order long, piece binary"), "quality-pieces")
    found = []
    for label in (1, 0):
        some = pieces.where(F.col("label") == label).orderBy("order", "piece").limit(sample)
        found.append([bytes(r.piece) for r in some.collect()])
    return (_dictionary(found[0]), _dictionary(found[1])) if all(found) else None


def differences(docs: DataFrame, pair: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, difference) of every row: the normalised size difference of its whole text."""
    run = _sized(*pair, [("id", pa.int64()), ("uid", pa.int64())])
    return narrow(docs, id=id_col, text=text_col).mapInArrow(run, "id long, uid long, difference double")


def calibrate(sized: DataFrame, marked: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the curve, over all marked rows that fed no dictionary.

    Rows meet their labels by id with their one number; what reaches the driver is a
    count for each label and step of the difference.
    """
    joined = sized.join(marked.where(_half() == 1), "id")
    bins = joined.groupBy("label", F.round(F.col("difference") * STEPS).alias("bin")).count().collect()
    x = np.array([r["bin"] / STEPS for r in bins], float)
    y, weight = np.array([r["label"] for r in bins], float), np.array([r["count"] for r in bins], float)
    return logistic(x, y, weight)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """(id_col, uid, difference, score) of every row of ``docs``; a score looks at the text only.

    Learns from the labelled ids where ``train`` (over the column ``id``) holds. Null
    text counts as empty, and an empty text is scored like any other. With only one
    class of labels every score is the share of good ones, and 0.5 without any label.
    Repeated rows keep a row each; an empty table gives an empty result.
    """
    marked = durable(marks(labels, train, id_col, label_col), "quality-labels")
    pair = dictionaries(docs, marked, id_col, text_col, sample)
    if pair is None:
        totals = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
        share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        base = narrow(docs, id=id_col)
        return base.select(F.col("id").alias(id_col), "uid", F.lit(0.0).alias("difference"), F.lit(share).alias("score"))
    sized = durable(differences(docs, pair, id_col, text_col), "quality-sizes")
    slope, intercept = calibrate(sized, marked)
    odds = F.col("difference") * slope + intercept
    return sized.select(F.col("id").alias(id_col), "uid", "difference", (1 / (1 + F.exp(-odds))).alias("score"))

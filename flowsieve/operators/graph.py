"""Approximate nearest neighbours: a neighbour graph refined by joins.

Neighbours of a row's neighbours are likely to be its neighbours. Starting from blocks
of rows that lie close along a few fixed directions, every round joins each row's list
(and the rows that list it) with itself and keeps what comes closer, until few entries
change. Work is rows times the square of a sampled list, never rows times rows; every
group is a sampled list, so a row that very many others point to costs no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions import vectors as V
from flowsieve.operators.neighbors import _matrix as matrix
from flowsieve.session import durable

LISTS_OF_TASK = 5_000
LIST_ENTRIES = 1 << 21  # numbers held at once for the lists that are compared together
PAIRS = "query_id long, ref_id long, distance double"


@dataclass(frozen=True)
class NeighborGraph:
    """``pairs`` (query_id, ref_id, distance), how many pairs were compared, and the changed entries of each round."""

    pairs: DataFrame
    compared: int
    changes: tuple[int, ...]


def _distances(vectors: np.ndarray, metric: str) -> np.ndarray:
    products = vectors @ vectors.T
    if metric == "cosine":
        return 1.0 - products
    squares = np.diag(products)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2.0 * products, 0.0))


def _closest(ids: np.ndarray, distance: np.ndarray, width: int, allowed: np.ndarray) -> pd.DataFrame:
    """For every row of a block its closest allowed others."""
    masked = np.where(allowed, np.round(distance, 12), np.inf)
    best = np.argsort(masked, axis=1, kind="stable")[:, :width]
    found = pd.DataFrame(
        {
            "query_id": np.repeat(ids, best.shape[1]),
            "ref_id": ids[best].ravel(),
            "distance": np.take_along_axis(masked, best, axis=1).ravel(),
        }
    )
    return found[np.isfinite(found["distance"])]


def _blocks(block: int, width: int, metric: str):
    """Pairs within each ``block`` rows that follow one another."""

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            while sum(len(p) for p in held) >= 2 * block:
                rows = pd.concat(held)
                held = [rows.iloc[block:]]
                yield within(rows.iloc[:block])
        if held:
            # the last block is up to twice as large, so that no block is tiny
            yield within(pd.concat(held))

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        if not len(ids):
            return pd.DataFrame({"query_id": [], "ref_id": [], "distance": []})
        return _closest(ids, _distances(matrix(rows["vector"], metric), metric), width, ids[:, None] != ids[None, :])

    return pairs


def _local_joins(width: int, metric: str):
    """Nearer pairs within each list; the rows of a task are sorted by list, and very many short lists are compared at once."""

    def joins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            rows = pd.concat([*held, pdf]) if held else pdf
            # the last list may go on in the next batch
            whole = int(np.searchsorted(rows["center"].to_numpy(), rows["center"].iloc[-1])) if len(rows) else 0
            held = [rows.iloc[whole:]]
            if whole:
                yield within(rows.iloc[:whole])
        if held and len(held[0]):
            yield within(held[0])

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        center, ids = rows["center"].to_numpy(), rows["id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
        sizes = np.diff(np.r_[starts, len(center)])
        vectors, fresh, bound = matrix(rows["vector"], metric), rows["fresh"].to_numpy(dtype=bool), rows["bound"].to_numpy()
        squares = (vectors**2).sum(axis=1)
        most = int(sizes.max())
        lists = max(1, LIST_ENTRIES // (most * max(most, vectors.shape[1])))
        return pd.concat(
            [
                near(starts[at:at + lists], sizes[at:at + lists], ids, vectors, squares, fresh, bound)
                for at in range(0, len(starts), lists)
            ]
        )

    def near(starts, sizes, ids, vectors, squares, fresh, bound) -> pd.DataFrame:
        most = int(sizes.max())
        there = np.arange(most)[None, :] < sizes[:, None]
        at = np.where(there, starts[:, None] + np.arange(most)[None, :], starts[:, None])
        some = vectors[at]
        distance = np.matmul(some, some.transpose(0, 2, 1))
        if metric == "cosine":
            distance = 1.0 - distance
        else:
            distance = np.sqrt(np.maximum(squares[at][:, :, None] + squares[at][:, None, :] - 2.0 * distance, 0.0))
        new, own = fresh[at], ids[at]
        allowed = (new[:, :, None] | new[:, None, :]) & (own[:, :, None] != own[:, None, :])
        # only what beats the farthest entry of a list can enter it
        allowed &= there[:, :, None] & there[:, None, :] & (distance < bound[at][:, :, None])
        distance = np.round(distance, 12)
        if most - 1 > width:
            order = np.argsort(np.where(allowed, distance, np.inf), axis=2, kind="stable")
            np.put_along_axis(allowed, order[:, :, width:], False, axis=2)
        g, i, j = np.nonzero(allowed)
        return pd.DataFrame({"query_id": own[g, i], "ref_id": own[g, j], "distance": distance[g, i, j]})

    return joins


def _best(pairs: DataFrame, width: int) -> DataFrame:
    """The closest ``width`` of every row; of the same pair the older entry."""
    one = pairs.groupBy("query_id", "ref_id").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)


def _sampled(pairs: DataFrame, center: str, member: str, size: int, turn: int) -> DataFrame:
    """(center, member, fresh): a fixed sample of the list of each row; new entries come first."""
    order = Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("center", "member", F.lit(turn)))
    lists = pairs.select(F.col(center).alias("center"), F.col(member).alias("member"), "fresh")
    return lists.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size).drop("rn")


def neighbor_graph(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 20,
    width: int | None = None,
    sample: int = 16,
    directions: int = 4,
    block: int = 256,
    metric: str = "cosine",
    max_rounds: int = 12,
    settled: float = 0.002,
) -> NeighborGraph:
    """About the ``k`` nearest other rows of every row.

    ``width`` entries are kept for each row while refining (1.5 k unless given) and
    ``sample`` of each list, and of each list of rows that point to a row, are joined in
    a round. Rounds end when fewer than ``settled`` of all entries change. Ids are
    distinct; rows without an id or a vector are left out.
    """
    width = width or k + k // 2
    # single precision is moved as it is, at half the bytes, and computed with in double
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    units = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).dropna()
    units = durable(units, "graph-rows")
    shape = units.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    total, dims = shape["n"], shape["d"] or 0
    found, compared = [], 0
    for axis in np.random.default_rng(7).standard_normal((directions, dims)):
        placed = V.unit(F.col("vector")) if metric == "cosine" else F.col("vector")
        along = V.dot(placed, F.array(*[F.lit(float(x)) for x in axis]))
        laid = units.withColumn("along", along).repartitionByRange("along", "id").sortWithinPartitions("along", "id")
        found.append(laid.drop("along").mapInPandas(_blocks(block, width, metric), PAIRS))
        compared += total * min(block, total) // 2
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    graph = durable(_best(pairs.withColumn("fresh", F.lit(True)), width), "graph")
    changes: list[int] = []
    tasks = 1 + total // LISTS_OF_TASK
    for turn in range(max_rounds):
        forward = _sampled(graph, "query_id", "ref_id", sample, turn)
        backward = _sampled(graph, "ref_id", "query_id", sample, turn)
        lists = forward.unionByName(backward).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
        lists = durable(lists, "graph-lists")
        sizes = lists.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fresh")).alias("old"))
        compared += sizes.agg(F.sum(F.expr("(n * (n - 1) - old * (old - 1)) div 2"))).first()[0] or 0
        bound = graph.groupBy(F.col("query_id").alias("id")).agg(
            F.when(F.count(F.lit(1)) == width, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound")
        )
        members = units.join(bound, "id").join(lists.withColumnRenamed("member", "id"), "id")
        laid = members.repartition(tasks, "center").sortWithinPartitions("center", "id")
        nearer = laid.mapInPandas(_local_joins(width, metric), PAIRS).withColumn("fresh", F.lit(True))
        # what was joined in this round is no longer new
        joined = forward.where("fresh").select(F.col("center").alias("query_id"), F.col("member").alias("ref_id"), F.lit(True).alias("done"))
        old = graph.drop("rank").join(joined, ["query_id", "ref_id"], "left")
        old = old.withColumn("fresh", F.col("fresh") & F.col("done").isNull()).drop("done")
        known = graph.select("query_id", "ref_id", F.lit(True).alias("known"))
        graph = durable(_best(old.unionByName(nearer), width).join(known, ["query_id", "ref_id"], "left"), "graph")
        changes.append(graph.where("known IS NULL").count())
        graph = graph.drop("known")
        if changes[-1] < settled * total * width:
            break
    return NeighborGraph(graph.where(F.col("rank") <= k).select("query_id", "ref_id", "distance"), int(compared), tuple(changes))

"""Array-column vector algebra, all inside codegen-friendly expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """L2-normalised vector; non-finite entries and the zero vector give zeros."""
    # repeated as an array: an outer expression inside a lambda runs once per element
    lengths = F.array_repeat(F.greatest(norm(a), F.lit(1e-12)), F.size(a))
    return F.zip_with(
        a, lengths, lambda x, n: F.coalesce(F.nanvl(x.cast("double") / n, F.lit(0.0)), F.lit(0.0))
    )


def by_matrix(values: Column, width: int, work: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> Column:
    """``work`` of whole Arrow batches, with a row of the matrix for each array.

    Null for an array that has not ``width`` entries, or a null among them. What needs
    every entry several times costs an expression over arrays one pass for each use.
    """
    whole = F.when((F.size(values) == width) & ~F.exists(values, lambda x: x.isNull()), values)

    def run(rows: pa.Array) -> pa.Array:
        here = rows.is_valid().to_numpy(zero_copy_only=False)
        found = work(rows.drop_null().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width))
        if found.ndim == 1:
            out = np.full(len(rows), np.nan)
            out[here] = found
            return pa.array(out, mask=~here)
        ends = np.cumsum(np.r_[0, here * found.shape[1]]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()), mask=pa.array(~here))

    return F.arrow_udf(run, kind)(whole)


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def linear_attribution(values: Column, background: Column, weights: Column) -> Column:
    """weight * (value - background mean): exact Shapley values of a linear model."""
    return F.zip_with(
        F.zip_with(values, background, lambda x, m: x - m), weights, lambda d, w: d * w
    )


def top_features(names: Column, contributions: Column, values: Column, k: int) -> Column:
    """The k largest |contribution| as structs, ties by position."""
    items = F.transform(
        contributions,
        lambda c, i: F.struct(
            (-F.abs(c)).alias("order"),
            i.alias("position"),
            F.get(names, i).alias("feature"),
            c.alias("contribution"),
            F.get(values, i).alias("value"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(items), 1, k),
        lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"), s["value"].alias("value")),
    )


def gradient_norm(probs: Column, weights: Sequence[Sequence[float]]) -> Column:
    """Length of W'(p - onehot(argmax p)) for a linear head with rows W[class]."""
    best = F.array_repeat(F.array_position(probs, F.array_max(probs)), F.size(probs))
    places = F.sequence(F.lit(1), F.size(probs))
    chosen = F.zip_with(places, best, lambda i, b: (i == b).cast("double"))
    residual = F.zip_with(probs, chosen, lambda p, hit: p - hit)
    sides = [dot(residual, literal(column)) for column in zip(*weights, strict=True)]
    return F.sqrt(sum((s * s for s in sides[1:]), sides[0] * sides[0]))

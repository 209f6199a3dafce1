"""Total order, prefix sums and exact order statistics without a one-task step."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.core import missing_if_infinite
from flowsieve.session import durable, small_side

# A bracket around a wanted rank is narrowed until it holds no more rows than this.
IN_TASK_ROWS = 100_000
SKETCH_ACCURACY = 10_000
MARGIN = 3.0 / SKETCH_ACCURACY  # of the rows, on either side of a wanted rank


def globally_ordered(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Range-partition by ``keys``; ``_part``, ``_pos`` then sort exactly like ``keys``.

    Range bounds are sampled, so the layout is written out before anything reads
    it twice. ``keys`` must be unique for a repeatable order.
    """
    laid_out = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return (
        durable(laid_out, "ordered")
        .withColumn("_part", F.shiftright("_slot", 33))
        .withColumn("_pos", F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_slot")
    )


def prefix_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str],
    group: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<value>``: inclusive running sums within ``group`` along ``order``.

    ``keep`` may name ``_part`` and ``_pos``, the place in the layout.
    """
    ordered = globally_ordered(df, [*group, *order])
    partials = ordered.groupBy("_part", *group).agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values]
    )
    before = (
        Window.partitionBy(*group)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = partials.select(
        F.col("_part").alias("_offset_part"),
        *[F.col(g).alias(f"_offset_{g}") for g in group],
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
    )
    local = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    on = F.col("_part") == F.col("_offset_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_offset_{g}"))
    running = ordered.select("*", *[F.sum(v).over(local).alias(f"_local_{v}") for v in values])
    joined = running.join(small_side(offsets, "offsets"), on)
    return joined.select(
        *df.columns, *keep,
        *[(F.col(f"_local_{v}") + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values],
    )


@dataclass
class _Target:
    """One wanted order statistic and the open value interval known to hold it."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    value: float | None = None


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Sequence[int]],
    in_task_rows: int = IN_TASK_ROWS,
    counts: dict[str, int] | None = None,
    brackets: dict[str, list[tuple]] | None = None,
) -> dict[str, list]:
    """Exact values at 0-based ranks of several numeric columns (nulls ignored).

    A quantile sketch narrows every rank to a value bracket, one per rank in order. One
    grouped pass then counts what lies between the brackets and each value inside them,
    which gives the ranks of all columns at once. Only a rank whose bracket holds too
    many values for that, or that the sketch missed, is narrowed again on its own.
    ``counts`` and ``brackets`` are known to some callers, and save a pass each.
    """
    columns = [c for c, ranks in wanted.items() if ranks]
    if not columns:
        return {c: [] for c in wanted}
    if counts is None:
        counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    targets = [_Target(c, int(r), inside=counts[c]) for c in columns for r in wanted[c]]
    for t in targets:
        if not 0 <= t.rank < t.inside:
            raise ValueError(f"rank {t.rank} outside 0..{t.inside - 1} of {t.column}")
    if brackets is None:
        shares = {c: [r / counts[c] for r in wanted[c]] for c in columns if counts[c] > in_task_rows}
        brackets = _brackets(df, shares)
    # of this many rows about one in_task_rows lies in a bracket
    small = in_task_rows / (2 * MARGIN)
    _settle(df, [t for t in targets if t.inside <= small], brackets, in_task_rows)
    while True:
        wide = [t for t in targets if t.value is None and t.inside > in_task_rows]
        if not wide:
            break
        _narrow(df, wide)
    _rank_inside(df, [t for t in targets if t.value is None])
    found = {(t.column, t.rank): t.value for t in targets}
    return {c: [found[(c, int(r))] for r in ranks] for c, ranks in wanted.items()}


def _bounds(shares: Sequence[float]) -> list[float]:
    return [x for p in shares for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]


def _brackets(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[tuple]]:
    """Values that the ranks at ``shares`` of each column very likely lie between."""
    if not shares:
        return {}
    row = df.agg(*[F.percentile_approx(c, _bounds(p), SKETCH_ACCURACY).alias(c) for c, p in shares.items()]).first()
    return {c: list(zip(row[c][::2], row[c][1::2], strict=True)) for c in shares}


def _settle(df: DataFrame, targets: list[_Target], brackets: dict[str, list[tuple]], in_task_rows: int) -> None:
    """Values of the targets whose rank falls into one of their column's brackets; without any, the column is one."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for kind in sorted({kinds[t.column] for t in targets}):
        some = [t for t in targets if kinds[t.column] == kind]
        columns = list(dict.fromkeys(t.column for t in some))
        entries = []
        for i, c in enumerate(columns):
            value = F.col(c)
            open_ = _merged(brackets.get(c)) if next(t for t in some if t.column == c).inside > in_task_rows else None
            bucket = F.lit(1)
            if open_ is not None:  # even buckets lie between the brackets
                bucket = F.lit(2 * len(open_))
                for k, (low, high) in reversed(list(enumerate(open_))):
                    bucket = F.when(value < F.lit(low), 2 * k).when(value <= F.lit(high), 2 * k + 1).otherwise(bucket)
            inside = F.when(bucket % 2 == 1, value)
            entries.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("c"), bucket.alias("b"), inside.alias("v"))))
        present = F.filter(F.array(*entries), lambda e: e.isNotNull())
        ranks = F.array(*[F.array(*[F.lit(t.rank).cast("long") for t in some if t.column == c]) for c in columns])
        upto = F.sum("count").over(Window.partitionBy("c").orderBy("b", "v"))
        counted = df.select(F.inline(present)).groupBy("c", "b", "v").count().withColumn("upto", upto)
        hit = F.filter(F.get(ranks, F.col("c")), lambda r: (r >= F.col("upto") - F.col("count")) & (r < F.col("upto")))
        rows = counted.where("b % 2 = 1").select("c", "v", hit.alias("ranks")).where(F.size("ranks") > 0).collect()
        found = {(columns[r["c"]], rank): r["v"] for r in rows for rank in r["ranks"]}
        for t in some:
            t.value = found.get((t.column, t.rank))


def _merged(brackets: list[tuple] | None) -> list[tuple] | None:
    """Intervals that touch as one, in order."""
    if not brackets:
        return None
    out: list[tuple] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _within(t: _Target) -> Column:
    c = F.col(t.column)
    condition = c.isNotNull()
    if t.low is not None:
        condition = condition & (c > F.lit(t.low))
    if t.high is not None:
        condition = condition & (c < F.lit(t.high))
    return condition


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    shared: dict[tuple, list[_Target]] = {}
    for t in targets:
        shared.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for i, group in enumerate(shared.values()):
        bounds = []
        for t in group:
            share = (t.rank - t.below) / t.inside
            margin = 2.0 / SKETCH_ACCURACY + 2.0 / t.inside
            bounds += [max(share - margin, 0.0), min(share + margin, 1.0)]
        value = F.when(_within(group[0]), F.col(group[0].column))
        sketches.append(F.percentile_approx(value, bounds, SKETCH_ACCURACY).alias(f"b{i}"))
    row = df.agg(*sketches).first()
    bounds_of = {}
    for i, group in enumerate(shared.values()):
        for k, t in enumerate(group):
            bounds_of[id(t)] = (row[f"b{i}"][2 * k], row[f"b{i}"][2 * k + 1])
    counted = []
    for i, t in enumerate(targets):
        c, (low, high) = F.col(t.column), bounds_of[id(t)]
        for name, hit in (
            ("less", c < F.lit(low)), ("low", c == F.lit(low)), ("high", c == F.lit(high)), ("upto", c <= F.lit(high)),
        ):
            counted.append(F.count_if(hit).alias(f"{name}{i}"))
    row = df.agg(*counted).first()
    for i, t in enumerate(targets):
        low, high = bounds_of[id(t)]
        less, at_low, at_high, upto = (row[f"{name}{i}"] for name in ("less", "low", "high", "upto"))
        end = t.below + t.inside
        if less <= t.rank < less + at_low:
            t.value = low
        elif upto - at_high <= t.rank < upto:
            t.value = high
        elif t.rank < less:  # outside the sketch's bracket: search the part before it
            t.high, t.inside = low, less - t.below
        elif t.rank >= upto:
            t.low, t.below, t.inside = high, upto, end - upto
        else:
            t.low, t.high = low, high
            t.below, t.inside = less + at_low, upto - at_high - less - at_low


def _rank_inside(df: DataFrame, targets: list[_Target]) -> None:
    if not targets:
        return
    tagged = F.filter(
        F.array(
            *[
                F.when(_within(t), F.struct(F.lit(i).alias("target"), F.col(t.column).alias("value")))
                for i, t in enumerate(targets)
            ]
        ),
        lambda s: s.isNotNull(),
    )
    ranks = F.array(*[F.lit(t.rank - t.below) for t in targets])
    running = Window.partitionBy("target").orderBy("value")
    rows = (
        df.select(F.explode(tagged).alias("s"))
        .select("s.*")
        .groupBy("target", "value")
        .count()
        .withColumn("upto", F.sum("count").over(running))
        .withColumn("rank", F.get(ranks, F.col("target")))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count")))
        .select("target", "value")
        .collect()
    )
    for row in rows:
        targets[row["target"]].value = row["value"]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    in_task_rows: int = IN_TASK_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, exact at any size; non-finite values ignored."""
    clean = df.select(*[missing_if_infinite(F.col(f"`{c}`")).alias(c) for c in columns])
    sketches = [F.percentile_approx(c, _bounds(probs), SKETCH_ACCURACY).alias(f"{c}|bounds") for c in columns]
    row = clean.agg(*[F.count(c).alias(c) for c in columns], *sketches).first()
    counts = {c: row[c] for c in columns}
    brackets = {c: list(zip(row[f"{c}|bounds"][::2], row[f"{c}|bounds"][1::2], strict=True)) for c in columns if counts[c]}
    wanted: dict[str, list[int]] = {}
    for c in columns:
        spots = [(counts[c] - 1) * p for p in probs] if counts[c] else []
        wanted[c] = sorted({f(s) for s in spots for f in (math.floor, math.ceil)})
    values = order_statistics(clean, wanted, in_task_rows, counts, brackets)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        at = dict(zip(wanted[c], values[c], strict=True))
        out[c] = []
        for p in probs:
            if not counts[c]:
                out[c].append(None)
                continue
            spot = (counts[c] - 1) * p
            low, high = math.floor(spot), math.ceil(spot)
            out[c].append(at[low] + (at[high] - at[low]) * (spot - low))
    return out


def cut_keys(
    df: DataFrame,
    time_col: str,
    id_col: str,
    ranks: Sequence[int],
    total: int,
    in_task_rows: int = IN_TASK_ROWS,
) -> list[tuple[int, int]]:
    """(time, id) of the rows at 0-based ranks in (time, id) order; ``total`` rows in all.

    ``time_col`` is a long without nulls. Rows sharing one instant are told apart
    by their id in a second selection, so a hot instant costs no big sort.
    """
    ranks = [int(r) for r in ranks]
    if not ranks:
        return []
    instants = order_statistics(df.select(time_col), {time_col: ranks}, in_task_rows, {time_col: total})[time_col]
    row = df.agg(
        *[F.count_if(F.col(time_col) < F.lit(t)).alias(f"n{i}") for i, t in enumerate(instants)]
    ).first()
    keys = []
    for i, (rank, instant) in enumerate(zip(ranks, instants, strict=True)):
        same = df.where(F.col(time_col) == F.lit(instant)).select(id_col)
        ident = order_statistics(same, {id_col: [rank - row[f"n{i}"]]}, in_task_rows)[id_col][0]
        keys.append((instant, ident))
    return keys

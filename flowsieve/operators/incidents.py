"""Anchored time-window incidents.

A cluster takes the events of one key that lie within the window of its first
event; the next later event starts a new cluster. Where a cluster starts depends
on all earlier ones, so this is neither a tumbling nor a session window.

Times are laid out in key and time order and cut into blocks of a fixed number of
rows. What lies within one block is walked in it. A key that goes on over several
blocks gives one step table for each: "if the last cluster before this block started at
s, where does its last cluster start" for all possible s at once. Only events in the
first window of a block can be a first start, so the tables are short, and they compose:
neighbouring ones are combined in levels, then the starts are handed down the same tree.
So every task has one block or a few tables, however many events a key or a moment has;
a table never has more entries than there are distinct times in one window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.core import meaningful
from flowsieve.functions.scoring import risk_severity, severity_of, severity_rank
from flowsieve.functions.times import iso_naive
from flowsieve.operators.alerts import alert_risk, correlation_pairs
from flowsieve.operators.ordered import globally_ordered
from flowsieve.session import durable, small_side

KEYS = ["group_type", "key"]
NEVER = -(1 << 62)
BLOCK = 50_000  # times that one task walks
FAN = 64  # step tables that one task combines
TOP_FIELDS = {
    "primary_classes": "classifier_class",
    "families": "zero_day_family",
    "source_ips": "src_ip",
    "services": "service",
}


def _last_starts(times: np.ndarray, window: int, candidates: int) -> np.ndarray:
    """The last cluster start reached from each of the first ``candidates`` events.

    All candidates hop together; a span holds at most span / window hops.
    """
    following = np.append(np.searchsorted(times, times + window, side="right"), len(times))
    at = np.arange(candidates)
    while True:
        ahead = following[at]
        moving = ahead < len(times)
        if not moving.any():
            return times[at]
        at = np.where(moving, ahead, at)


def _compressed(upto: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring first starts with one outcome only the latest is needed."""
    keep = np.append(last[1:] != last[:-1], True)
    return upto[keep], last[keep]


def _step_table(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First start -> last start, over sorted distinct times; a start before them is below ``times[0]``."""
    # the first event beyond the window of the latest possible earlier start closes the list
    candidates = min(int(np.searchsorted(times, times[0] + window, side="right")) + 1, len(times))
    return _compressed(times[:candidates], _last_starts(times, window, candidates))


def _after(table: tuple[np.ndarray, np.ndarray], starts: np.ndarray, window: int) -> np.ndarray:
    """The last start once a table's events have followed ``starts``; it stays where its window holds them all."""
    upto, last = table
    at = np.searchsorted(upto, starts + window, side="right")
    return np.where(at < len(upto), last[np.minimum(at, len(upto) - 1)], starts)


def _composed(first: int, left: tuple, right: tuple, window: int) -> tuple[np.ndarray, np.ndarray]:
    """One table for events that begin at ``first`` and are those of ``left``, then of ``right``."""
    upto = np.concatenate([left[0], right[0]])
    last = np.concatenate([_after(right, left[1], window), right[1]])
    reach = int(np.searchsorted(upto, first + window, side="right")) + 1
    return _compressed(upto[:reach], last[:reach])


_TABLE = "group_type string, key string, at long, first long, upto array<long>, last array<long>"


def _tables(window: int):
    """Step table of one piece: the times of a key in one block."""

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["t"].to_numpy())
        upto, last = _step_table(times, window)
        return pd.DataFrame({"group_type": key[0], "key": key[1], "at": key[2], "first": times[:1], "upto": [upto], "last": [last]})

    return table


def _combined(window: int, fan: int):
    """Neighbouring tables of a key as one."""

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first = int(rows["first"].iloc[0])
        whole = None
        for upto, last in zip(rows["upto"], rows["last"], strict=True):
            own = np.asarray(upto, np.int64), np.asarray(last, np.int64)
            whole = own if whole is None else _composed(first, whole, own, window)
        return pd.DataFrame({"group_type": key[0], "key": key[1], "at": key[2], "first": [first], "upto": [whole[0]], "last": [whole[1]]})

    return combine


def _handed_down(window: int):
    """From the last start before some neighbouring tables to the one before each of them."""

    def hand_down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        start, before = int(rows["previous"].iloc[0]), []
        for upto, last in zip(rows["upto"], rows["last"], strict=True):
            before.append(start)
            own = np.asarray(upto, np.int64), np.asarray(last, np.int64)
            start = int(_after(own, np.array([start]), window)[0])
        return pd.DataFrame({"group_type": key[0], "key": key[1], "at": rows["at"].to_numpy(), "previous": before})

    return hand_down


def _walked(code: np.ndarray, t: np.ndarray, entry: np.ndarray, window: int) -> np.ndarray:
    """Cluster start of every row, rows in (code, t) order; ``entry`` is the start before the block.

    The first row beyond each row's window is found for all rows at once, so the loop
    goes from cluster to cluster, not from row to row.
    """
    n = len(t)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(first[1:], n)
    # the key's rows, then the ends of their windows: of equal times the row comes first
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate([t, t + window]), np.tile(code, 2)))
    is_end = order >= n
    following = np.empty(n, np.int64)
    following[order[is_end] - n] = np.cumsum(~is_end)[is_end]
    hops, starts = following.tolist(), entry.copy()
    for begin, end in zip(first.tolist(), ends.tolist(), strict=True):
        # what the window of the start before the block still holds keeps that start
        at = begin + int(np.searchsorted(t[begin:end], entry[begin] + window, side="right"))
        while at < end:
            after = min(hops[at], end)
            starts[at:after] = t[at]
            at = after
    return starts


def _walk(window: int):
    """Cluster start of every time of a block, key by key."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["group_type", "key", "t"])
        code = rows.groupby(KEYS, sort=False).ngroup().to_numpy()
        starts = _walked(code, rows["t"].to_numpy(np.int64), rows["previous"].to_numpy(np.int64), window)
        return rows[[*KEYS, "t"]].assign(start=starts)

    return walk


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, *columns)])


def _same_key() -> Column:
    return (F.col("key") == F.col("_key")) & (F.col("group_type") == F.col("_group_type"))


def cluster_starts(times: DataFrame, window_micros: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(group_type, key, t) -> ``start``: the anchor of the cluster each time is in."""
    laid = globally_ordered(times.select(*KEYS, "t").distinct(), [*KEYS, "t"])
    laid = laid.select(*KEYS, "t", "_part", F.floor(F.col("_pos") / block).alias("_block"))
    # a window holds one row for each block of a key
    order = Window.partitionBy(*KEYS).orderBy("_part", "_block")
    pieces = laid.groupBy(*KEYS, "_part", "_block").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    pieces = pieces.withColumn("pieces", F.max("at").over(Window.partitionBy(*KEYS)) + 1)
    # a key that one block holds as a whole begins and ends there
    cut = small_side(pieces.where("pieces > 1").select(*KEYS, "_part", "_block", "at"), "cluster-pieces")
    named = cut.select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.col("_part").alias("_p"), F.col("_block").alias("_b"), "at")
    here = _same_key() & (F.col("_part") == F.col("_p")) & (F.col("_block") == F.col("_b"))
    tables = laid.join(named, here).select(*KEYS, "at", "t").groupBy(*KEYS, "at").applyInPandas(_tables(window_micros), _TABLE)
    levels = [durable(tables, "cluster-tables")]
    while not levels[-1].where("at > 0").isEmpty():
        group = F.floor(F.col("at") / fan).alias("above")
        above = levels[-1].groupBy(*KEYS, group).applyInPandas(_combined(window_micros, fan), _TABLE)
        levels.append(durable(above, "cluster-tables"))
    before = levels[-1].select(*KEYS, "at", F.lit(NEVER).alias("previous"))
    for tables in reversed(levels[:-1]):
        on = _same_key() & (F.floor(F.col("at") / fan) == F.col("_at"))
        below = tables.join(_renamed(before, "at", "previous"), on)
        below = below.select(*KEYS, F.col("_at").alias("above"), "at", "upto", "last", F.col("_previous").alias("previous"))
        before = below.groupBy(*KEYS, "above").applyInPandas(
            _handed_down(window_micros), "group_type string, key string, at long, previous long"
        )
    entries = cut.join(_renamed(before, "at", "previous"), _same_key() & (F.col("at") == F.col("_at")))
    entries = small_side(
        entries.select(
            *[F.col(c).alias(f"_{c}") for c in KEYS], F.col("_part").alias("_p"), F.col("_block").alias("_b"), F.col("_previous").alias("previous")
        ),
        "cluster-entries",
    )
    entered = laid.join(entries, here, "left").select(
        *KEYS, "t", "_part", "_block", F.coalesce("previous", F.lit(NEVER)).alias("previous")
    )
    return entered.groupBy("_part", "_block").applyInPandas(_walk(window_micros), "group_type string, key string, t long, start long")


def incident_members(alerts: DataFrame, window_minutes: int = 15, time_col: str = "event_ts") -> DataFrame:
    """One row per (incident candidate, alert), alerts without a time dropped."""
    severity = F.coalesce(F.col("severity"), F.lit("")) if "severity" in alerts.columns else F.lit("")
    timed = alerts.where(F.col(time_col).isNotNull()).withColumns(
        {
            "t": F.unix_micros(F.col(time_col).cast("timestamp")),
            "_risk": alert_risk(alerts),
            "_severity": F.upper(severity),
        }
    )
    fields = [f for f in TOP_FIELDS.values() if f in alerts.columns]
    pairs = correlation_pairs(
        timed,
        list(dict.fromkeys(["alert_id", "t", "is_zeroday", "_risk", "_severity", *fields])),
        skip=("Batch File",),
    )
    starts = cluster_starts(pairs.select(*KEYS, "t"), int(window_minutes * 60_000_000))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("t").alias("_t"), "start")
    on = (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")) & (F.col("group_type") == F.col("_group_type"))
    # both sides grow with the alerts, and the planner takes the exploded side for less than it is
    return pairs.join(starts.hint("merge"), on).drop("_t", *[f"_{k}" for k in KEYS])


def top_values(members: DataFrame, fields: dict[str, str], limit: int = 3) -> DataFrame:
    """The most frequent meaningful values of several fields per incident, ties by name."""
    groups = [*KEYS, "start"]
    items = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.when(F.lower(meaningful(F.col(c))) != "normal", meaningful(F.col(c))).alias("value"))
            for name, c in fields.items()
        ]
    )
    counted = (
        members.select(*groups, F.explode(items).alias("i"))
        .select(*groups, "i.*")
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(*groups, "field").orderBy(F.desc("n"), "value")
    kept = counted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    columns = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("rn", "value")))), lambda s: s["value"]
        ).alias(name)
        for name in fields
    ]
    return kept.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(*columns)


def build_incidents(
    alerts: DataFrame,
    window_minutes: int = 15,
    min_alerts: int = 2,
    max_alert_ids: int = 12,
    time_col: str = "event_ts",
) -> DataFrame:
    """Analyst-facing incident rows."""
    groups = [*KEYS, "start"]
    members = durable(incident_members(alerts, window_minutes, time_col), "incident-members")
    totals = members.groupBy(*groups).agg(
        F.max("t").alias("end"),
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if("is_zeroday").alias("ood_count"),
        F.count_if(F.col("_risk") >= 70).alias("high_count"),
        F.max("_risk").alias("max_risk"),
        # a number, so that the totals stay in a hash aggregate
        F.max(severity_rank(F.col("_severity"))).alias("strongest"),
    ).where(F.col("alert_count") >= min_alerts)
    order = Window.partitionBy(*groups).orderBy("t", "alert_id")
    ids = (
        members.select(*groups, "t", "alert_id")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= max_alert_ids)
        .groupBy(*[F.col(g).alias(f"_{g}") for g in groups])
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "alert_id"))), lambda s: s["alert_id"]).alias("alert_ids"))
    )
    fields = {name: c for name, c in TOP_FIELDS.items() if c in members.columns}

    def on() -> Column:
        return (
            (F.col("start") == F.col("_start"))
            & (F.col("key") == F.col("_key"))
            & (F.col("group_type") == F.col("_group_type"))
        )

    drop = ["_start", "_key", "_group_type"]
    joined = totals.join(ids, on()).drop(*drop).join(top_values(members, fields), on(), "left").drop(*drop)
    empty = F.lit([]).cast("array<string>")
    joined = joined.withColumns({n: F.coalesce(F.col(n), empty) if n in fields else empty for n in TOP_FIELDS})
    start, end = F.timestamp_micros("start"), F.timestamp_micros("end")
    signals = F.when(F.size("primary_classes") > 0, F.col("primary_classes")).otherwise(F.col("families"))
    subject = F.concat("group_type", F.lit(": "), "key")
    raw_id = F.concat_ws("|", F.col("group_type"), F.col("key"), iso_naive(start), iso_naive(end))
    return joined.select(
        F.concat(F.lit("INC-"), F.substring(F.upper(F.sha1(raw_id)), 1, 10)).alias("incident_id"),
        *KEYS,
        F.lit(window_minutes).alias("window_minutes"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.bround((F.col("end") - F.col("start")) / 60_000_000.0, 1).alias("duration_minutes"),
        "alert_count", "ood_count", "high_count", "max_risk",
        F.coalesce(severity_of(F.col("strongest")), risk_severity(F.col("max_risk"))).alias("severity"),
        *TOP_FIELDS,
        "alert_ids",
        F.when(
            F.size(signals) > 0,
            F.concat(
                F.lit("Review repeated alerts for "), subject, F.lit("; dominant signal: "),
                F.array_join(F.slice(signals, 1, 2), ", "), F.lit("."),
            ),
        )
        .otherwise(F.concat(F.lit("Review repeated alerts for "), subject, F.lit(" within the same time window.")))
        .alias("recommended_focus"),
    )


def incident_order() -> list[Column]:
    return [F.desc("max_risk"), F.desc("ood_count"), F.desc("alert_count"), F.desc("end_time"), F.asc("incident_id")]

"""Vendor flow logs to one flow schema.

The header is resolved once on the driver (metadata only); rows are then one
projection plus, where needed, a per-file aggregate joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import vocab
from flowsieve.functions import flow as flow_fn
from flowsieve.functions.core import number, ref, text
from flowsieve.functions.times import parse_event_time
from flowsieve.session import durable, small_side

FILE = "source_file"
MICROS = 1_000_000.0


@dataclass
class HeaderPlan:
    """What a header maps to, decided before any row is read."""

    schema: str
    input_columns: int
    mapped: dict[str, str]
    derived: list[str] = field(default_factory=list)
    output: list[str] = field(default_factory=list)
    guess_duration_unit: bool = False
    duration_from_times: bool = False
    missing: list[str] = field(default_factory=list)
    coverage: float = 0.0
    mapped_coverage: float = 0.0


def clean_header(raw: DataFrame) -> DataFrame:
    """Lower-case, underscored column names; a repeated name keeps its first column."""
    names, seen = [], set()
    for position, name in enumerate(raw.columns):
        cleaned = vocab.clean_name(name)
        names.append(f"{cleaned}__{position}" if cleaned in seen else cleaned)
        seen.add(cleaned)
    return raw.toDF(*names)


def plan_header(columns: list[str], expected: list[str] | None = None, own: tuple[str, ...] = ()) -> HeaderPlan:
    """Resolve aliases and list which columns will be derived.

    ``columns`` are cleaned names; ``own`` are bookkeeping columns of ours that are
    not part of the log's header.
    """
    header = [c for c in columns if c not in own]
    mapped = {}
    for target in vocab.ALIASES:
        found = vocab.first_present(header, vocab.aliases(target))
        if found is not None:
            mapped[target] = found
    plan = HeaderPlan(vocab.detect_schema(header), len(header), mapped)
    have = set(mapped)

    def derive(*names: str) -> None:
        plan.derived.extend(n for n in names if n not in plan.derived)
        have.update(names)

    if "dur" in have:
        if mapped["dur"] == "flow_duration":
            derive("dur")
        else:
            plan.guess_duration_unit = True
    elif {"stime", "ltime"} <= have:
        plan.duration_from_times = True
        derive("dur")
    for source, total in ((("sbytes", "dbytes"), vocab.TOTAL_BYTES), (("spkts", "dpkts"), vocab.TOTAL_PACKETS)):
        if not set(source) <= have and vocab.first_present(header, total):
            derive(*source)
    for name in ("sintpkt", "dintpkt", "sjit", "djit"):
        if "iat" in mapped.get(name, ""):
            derive(name)
    for name, needs in (
        ("sload", {"sbytes"}),
        ("dload", {"dbytes"}),
        ("smeansz", {"sbytes", "spkts"}),
        ("dmeansz", {"dbytes", "dpkts"}),
        ("sintpkt", {"spkts"}),
        ("dintpkt", {"dpkts"}),
    ):
        if name not in have and needs <= have:
            derive(name)
    derive(*[n for n in ("sttl", "dttl", "sloss", "dloss", "tcprtt", "synack", "ackdat") if n not in have])
    flags = ("syn_flag_count", "fin_flag_count", "rst_flag_count", "ack_flag_count")
    if "state" not in have and set(flags) & set(header):
        derive("state")
    derive(*[n for n in vocab.CONTEXT_COUNTS if n not in have])
    derive(*[n for n in vocab.DEFAULTS if n not in have])

    wanted = [c for c in (expected or vocab.CORE_FEATURES) if c in vocab.CORE_FEATURES] or vocab.CORE_FEATURES
    plan.missing = [c for c in wanted if c not in have]
    plan.coverage = round(1 - len(plan.missing) / len(wanted), 4)
    plan.mapped_coverage = round(sum(c in mapped for c in wanted) / len(wanted), 4)
    plan.output = [t for t in vocab.ALIASES if t in have]
    return plan


def map_columns(raw: DataFrame, plan: HeaderPlan, keep: tuple[str, ...] = ()) -> DataFrame:
    """First present alias of every target, untouched values."""
    return raw.select(*[ref(k) for k in keep], *[ref(src).alias(t) for t, src in plan.mapped.items()])


def coerce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text fields trimmed, ``label`` integer, everything else a number."""
    typed: dict[str, Column] = {}
    for c in columns:
        if c in vocab.TEXT_FIELDS:
            typed[c] = text(ref(c))
        elif c == "label":
            typed[c] = F.coalesce(ref(c).try_cast("double").try_cast("int"), F.lit(0))
        else:
            typed[c] = number(ref(c))
    return df.withColumns(typed)


def duration_unit(df: DataFrame, dur: Column, file_col: str = FILE) -> DataFrame:
    """Per file, the divisor a median-based unit guess picks (1, 1e3 or 1e6).

    "Is the median above T" needs no sort: it follows from how many values exceed
    T and, when exactly half do, from the two values either side of T. So this is
    a plain partial aggregation however many rows one file has.
    """
    limits = (1_000.0, 100_000.0)
    sums = [F.count(F.lit(1)).alias("n")]
    for i, limit in enumerate(limits):
        sums += [
            F.count_if(dur > limit).alias(f"over{i}"),
            F.max(F.when(dur <= limit, dur)).alias(f"under_max{i}"),
            F.min(F.when(dur > limit, dur)).alias(f"over_min{i}"),
        ]
    stats = df.groupBy(file_col).agg(*sums)

    def median_over(i: int, limit: float) -> Column:
        twice = F.col(f"over{i}") * 2
        middle = (F.col(f"under_max{i}") + F.col(f"over_min{i}")) / 2.0
        return F.when(twice == F.col("n"), middle > limit).otherwise(twice > F.col("n"))

    return stats.select(
        file_col,
        F.when(median_over(1, limits[1]), F.lit(MICROS))
        .when(median_over(0, limits[0]), F.lit(1_000.0))
        .otherwise(F.lit(1.0))
        .alias("duration_divisor"),
    )


def context_counts(df: DataFrame, names: list[str], file_col: str = FILE) -> DataFrame:
    """Rows of the same file sharing each key set; null keys form a group.

    The rows are reduced once to the distinct tuples of all keys. One grouping-sets
    aggregation of the tuples gives every counter, and the counters meet the tuples, so
    that whatever is joined seven times has key columns only; the rows themselves are
    joined once, on the full tuple, which spreads a busy host. The planner broadcasts
    what is small in stored bytes; otherwise the joins are plain equality ones, whose
    skewed keys split at run time. A counter whose key column is absent is 1.
    """
    usable = {n: vocab.CONTEXT_COUNTS[n] for n in names if set(vocab.CONTEXT_COUNTS[n]) <= set(df.columns)}
    out = df
    if usable:
        keys = sorted({k for ks in usable.values() for k in ks})

        def same(columns: list[str], own: str, other: str) -> Column:
            on = F.col(f"{own}{file_col}").eqNullSafe(F.col(f"{other}{file_col}"))
            for k in columns:
                on = on & F.col(f"{own}{k}").eqNullSafe(F.col(f"{other}{k}"))
            return on

        tuples = durable(df.groupBy(
            F.col(file_col).alias(f"_t_{file_col}"), *[F.col(k).alias(f"_t_{k}") for k in keys]
        ).agg(F.count(F.lit(1)).alias("_n")), "context-keys")
        sets = [[F.col(f"_t_{c}") for c in (file_col, *ks)] for ks in usable.values()]
        counted = durable(tuples.groupingSets(sets, *[F.col(f"_t_{c}") for c in (file_col, *keys)]).agg(
            F.grouping_id().alias("_gid"), F.sum("_n").cast("double").alias("_total")
        ), "context-counts")
        side = tuples.drop("_n")
        for name, ks in usable.items():
            # grouping_id has one bit per column, 1 where the column is rolled up
            gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
            counter = counted.where(F.col("_gid") == gid).select(
                *[F.col(f"_t_{c}").alias(f"_c_{c}") for c in (file_col, *ks)], F.col("_total").alias(name)
            )
            side = side.join(counter, same(list(ks), "_t_", "_c_"), "left").drop(*[f"_c_{c}" for c in (file_col, *ks)])
        side = small_side(side, "context-side")
        out = df.join(side, same(keys, "", "_t_"), "left").drop(*[f"_t_{c}" for c in (file_col, *keys)])
    rest = {n: F.lit(1.0) for n in names if n not in usable}
    return out.withColumns(rest) if rest else out


def _duration(df: DataFrame, plan: HeaderPlan, file_col: str) -> DataFrame:
    if plan.duration_from_times:
        seconds = (
            F.unix_micros(parse_event_time(F.col("ltime"))) - F.unix_micros(parse_event_time(F.col("stime")))
        ) / MICROS
        return df.withColumn("dur", F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)))
    if "dur" not in plan.mapped:
        return df
    df = df.withColumn("dur", number(F.col("dur")))
    if not plan.guess_duration_unit:
        return df.withColumn("dur", F.col("dur") / MICROS)
    # one row per file
    unit = small_side(
        duration_unit(df, F.col("dur"), file_col).withColumnRenamed(file_col, "_unit_file"), "duration-unit"
    )
    return (
        df.join(unit, F.col(file_col).eqNullSafe(F.col("_unit_file")), "left")
        .withColumn("dur", F.col("dur") / F.col("duration_divisor"))
        .drop("_unit_file", "duration_divisor")
    )


def directional_totals(
    have: set[str], source: str, target: str, total: Column, whole: bool
) -> dict[str, Column]:
    """Split an undirected total: the remainder of a known side, else halves."""
    if source not in have and target in have:
        return {source: flow_fn.remainder(total, number(F.col(target)))}
    if target not in have and source in have:
        return {target: flow_fn.remainder(total, number(F.col(source)))}
    half = total * F.lit(0.5)
    if whole:
        return {source: F.ceil(half).cast("double"), target: F.floor(half).cast("double")}
    return {source: half, target: half}


def normalize_flows(
    raw: DataFrame,
    file_col: str = FILE,
    keep: tuple[str, ...] = (),
    expected: list[str] | None = None,
    counts: bool = True,
) -> tuple[DataFrame, HeaderPlan]:
    """One row per flow in the common schema, plus the resolved header plan.

    ``file_col`` names the file of a row; per-file rules (duration unit, context
    counts) use it. ``keep`` columns pass through untouched.
    """
    own = (file_col, *keep)
    df = clean_header(raw) if any(c != vocab.clean_name(c) for c in raw.columns) else raw
    if file_col not in df.columns:
        df = df.withColumn(file_col, F.lit(""))
    plan = plan_header(df.columns, expected, own)
    extra = {
        "_total_bytes": vocab.first_present(df.columns, vocab.TOTAL_BYTES),
        "_total_pkts": vocab.first_present(df.columns, vocab.TOTAL_PACKETS),
        **{f"_{f}": f"{f}_flag_count" for f in ("syn", "fin", "rst", "ack") if f"{f}_flag_count" in df.columns},
    }
    carried = {alias: src for alias, src in extra.items() if src}
    passthrough = [ref(c) for c in dict.fromkeys(own) if c not in plan.mapped]
    out = df.select(
        *passthrough,
        *[ref(src).alias(t) for t, src in plan.mapped.items()],
        *[ref(src).alias(alias) for alias, src in carried.items()],
    )
    out = _duration(out, plan, file_col)
    have = set(plan.mapped) | ({"dur"} if plan.duration_from_times else set())

    for (source, target), alias, whole in (
        (("sbytes", "dbytes"), "_total_bytes", False),
        (("spkts", "dpkts"), "_total_pkts", True),
    ):
        if alias in carried and not {source, target} <= have:
            out = out.withColumns(directional_totals(have, source, target, number(F.col(alias)), whole))
            have |= {source, target}

    counters = [
        "sbytes", "dbytes", "spkts", "dpkts", "sload", "dload", "sttl", "dttl", "sloss", "dloss",
        "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat",
    ]
    out = out.withColumns({c: number(F.col(c)) for c in counters if c in have})
    micro = {c: F.col(c) / MICROS for c in ("sintpkt", "dintpkt") if "iat" in plan.mapped.get(c, "")}
    micro |= {c: number(F.col(c)) / MICROS for c in ("sjit", "djit") if "iat" in plan.mapped.get(c, "")}
    if micro:
        out = out.withColumns(micro)

    dur = F.col("dur") if "dur" in have else F.lit(1.0)
    rates: dict[str, Column] = {}
    for side in ("s", "d"):
        size, packets = F.col(f"{side}bytes"), F.col(f"{side}pkts")
        has_size, has_packets = f"{side}bytes" in have, f"{side}pkts" in have
        if has_size and f"{side}load" not in have:
            rates[f"{side}load"] = flow_fn.bits_per_second(size, dur)
        if has_size and has_packets and f"{side}meansz" not in have:
            rates[f"{side}meansz"] = flow_fn.mean_size(size, packets)
        if has_packets and f"{side}intpkt" not in have:
            rates[f"{side}intpkt"] = flow_fn.packet_gap(packets, dur)
    for c in ("sttl", "dttl", "sloss", "dloss", "tcprtt", "synack", "ackdat"):
        if c not in have:
            rates[c] = F.lit(0.0)
    if "state" not in have and any(a in carried for a in ("_syn", "_fin", "_rst", "_ack")):
        flag = {f: number(F.col(f"_{f}")) if f"_{f}" in carried else F.lit(0.0) for f in ("syn", "fin", "rst", "ack")}
        rates["state"] = flow_fn.tcp_state(**flag)
    out = out.withColumns(rates)
    have |= set(rates)

    absent = [n for n in vocab.CONTEXT_COUNTS if n not in have]
    if counts:
        out = context_counts(out, absent, file_col)
    else:
        out = out.withColumns({n: F.lit(1.0) for n in absent})
    have |= set(absent)
    out = coerce_types(out, [c for c in vocab.ALIASES if c in have])
    defaults = {c: F.lit(v) for c, v in vocab.DEFAULTS.items() if c not in have}
    if defaults:
        out = out.withColumns(defaults)
    return out.select(*[ref(c) for c in dict.fromkeys(own)], *[c for c in plan.output if c not in own]), plan


def normalization_report(raw: DataFrame, plan: HeaderPlan, file_col: str = FILE) -> DataFrame:
    """One row per file: schema, mapping, derived and missing columns, coverage."""
    derived = F.array(*[F.lit(d) for d in sorted(plan.derived)]).cast("array<string>")
    counted = raw.groupBy(file_col).agg(F.count(F.lit(1)).alias("rows"))
    if plan.guess_duration_unit:
        unit = duration_unit(raw, number(ref(plan.mapped["dur"])), file_col)
        counted = counted.join(unit, file_col)
        derived = F.when(
            F.col("duration_divisor") != 1.0, F.array_sort(F.array_union(derived, F.array(F.lit("dur"))))
        ).otherwise(derived)
    mapped = F.create_map(*[F.lit(x) for pair in plan.mapped.items() for x in pair]).cast("map<string,string>")
    return counted.select(
        file_col,
        F.lit(plan.schema).alias("schema"),
        "rows",
        F.lit(plan.input_columns).alias("input_columns"),
        F.lit(len(plan.output)).alias("output_columns"),
        mapped.alias("mapped_columns"),
        derived.alias("derived_columns"),
        F.array(*[F.lit(m) for m in plan.missing]).cast("array<string>").alias("missing_core_features"),
        F.lit(plan.coverage).alias("feature_coverage"),
        F.lit(plan.mapped_coverage).alias("mapped_coverage"),
    )


def union_logs(frames: list[DataFrame]) -> DataFrame:
    """Files with different headers under one header; absent columns are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out

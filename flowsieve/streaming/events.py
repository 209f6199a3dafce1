"""Live events: any vendor's JSON object to a scored flow, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import vocab
from flowsieve.functions import flow as flow_fn
from flowsieve.functions.core import number, text
from flowsieve.functions.scoring import risk_score
from flowsieve.functions.times import parse_event_time
from flowsieve.streaming.scorer import LinearScorer

MICROS = 1_000_000.0


FLAGS = ("syn_flag_count", "fin_flag_count", "rst_flag_count", "ack_flag_count")


def known_names() -> list[str]:
    """Every field name any rule looks at."""
    names = [a for t in vocab.ALIASES for a in vocab.aliases(t)]
    return list(dict.fromkeys([*names, *vocab.TOTAL_BYTES, *vocab.TOTAL_PACKETS, *FLAGS]))


def parse_events(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Add ``keys`` (cleaned names) and ``fields``.

    ``fields`` is a struct with one text field per known name, so that looking a
    name up is a position, not a search through the event. A field that is present
    but null reads as empty text; an absent one is null. Events that are no object
    or have no field are dropped, as a request without content is refused; the
    explode does that without parsing the event a second time in a filter.
    """
    parsed = F.from_json(json_col, "map<string,string>")
    cleaned = F.transform_keys(parsed, lambda k, _: F.translate(F.lower(F.trim(k)), " -", "__"))
    filled = F.transform_values(cleaned, lambda _, v: F.coalesce(v, F.lit("")))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in known_names()])
    some = F.filter(F.array(filled), lambda m: F.coalesce(F.size(m), F.lit(0)) > 0)
    return df.select("*", F.explode(some).alias("_map")).select(
        *df.columns, F.map_keys("_map").alias("keys"), F.from_json(F.to_json("_map"), schema).alias("fields")
    )


def _field(name: str) -> Column:
    return F.col("fields").getField(name)


def _has(names: list[str]) -> Column:
    return F.coalesce(*[_field(n) for n in names]).isNotNull()


def _first(names: list[str]) -> Column:
    return F.coalesce(*[_field(n) for n in names])


def normalize_events(df: DataFrame, keep: list[str]) -> DataFrame:
    """One event is one flow: the batch rules applied to a table of one row.

    The duration unit is judged by the event's own value and every context count
    is 1. Adds ``schema``, ``mapped_columns`` and ``feature_coverage`` per event.
    """
    mapped_here = {t: _has(vocab.aliases(t)) for t in vocab.ALIASES}
    raw = df.select(
        *keep, "fields", "keys",
        *[_first(vocab.aliases(t)).alias(t) for t in vocab.ALIASES],
        *[h.alias(f"_has_{t}") for t, h in mapped_here.items()],
        number(_first(vocab.TOTAL_BYTES)).alias("_total_bytes"),
        _has(vocab.TOTAL_BYTES).alias("_has_total_bytes"),
        number(_first(vocab.TOTAL_PACKETS)).alias("_total_pkts"),
        _has(vocab.TOTAL_PACKETS).alias("_has_total_pkts"),
    )
    has = {t: F.col(f"_has_{t}") for t in vocab.ALIASES}
    value = {t: number(F.col(t)) for t in vocab.ALIASES if t not in vocab.TEXT_FIELDS}

    dur = value["dur"]
    from_micros = _has(["flow_duration"]) & ~_has(
        [a for a in vocab.aliases("dur")[: vocab.aliases("dur").index("flow_duration")]]
    )
    seconds = (
        F.when(from_micros, dur / MICROS)
        .when(dur > 100_000, dur / MICROS)
        .when(dur > 1_000, dur / 1_000.0)
        .otherwise(dur)
    )
    span = (F.unix_micros(parse_event_time(F.col("ltime"))) - F.unix_micros(parse_event_time(F.col("stime")))) / MICROS
    timed = F.greatest(F.coalesce(span, F.lit(0.0)), F.lit(0.0))
    out = {"dur": F.when(has["dur"], seconds).when(has["stime"] & has["ltime"], timed).otherwise(F.lit(0.0))}
    known_dur = has["dur"] | (has["stime"] & has["ltime"])

    def side(mine: str, other: str, total: str, whole: Column) -> Column:
        known_total = F.col(f"_has{total}")
        return (
            F.when(has[mine], value[mine])
            .when(known_total & has[other], flow_fn.remainder(F.col(total), value[other]))
            .when(known_total, whole)
            .otherwise(F.lit(0.0))
        )

    half_bytes, half_pkts = F.col("_total_bytes") * 0.5, F.col("_total_pkts") * 0.5
    out["sbytes"] = side("sbytes", "dbytes", "_total_bytes", half_bytes)
    out["dbytes"] = side("dbytes", "sbytes", "_total_bytes", half_bytes)
    out["spkts"] = side("spkts", "dpkts", "_total_pkts", F.ceil(half_pkts).cast("double"))
    out["dpkts"] = side("dpkts", "spkts", "_total_pkts", F.floor(half_pkts).cast("double"))
    sized = {
        "sbytes": has["sbytes"] | F.col("_has_total_bytes"),
        "dbytes": has["dbytes"] | F.col("_has_total_bytes"),
        "spkts": has["spkts"] | F.col("_has_total_pkts"),
        "dpkts": has["dpkts"] | F.col("_has_total_pkts"),
    }
    base = raw.withColumns(out)
    length = F.when(known_dur, F.col("dur")).otherwise(F.lit(1.0))
    rates = {}
    for s in ("s", "d"):
        size, packets = F.col(f"{s}bytes"), F.col(f"{s}pkts")
        both = sized[f"{s}bytes"] & sized[f"{s}pkts"]
        gap = value[f"{s}intpkt"]
        own_names = vocab.aliases(f"{s}intpkt")
        iat = ~_has([n for n in own_names if "iat" not in n])
        rates[f"{s}load"] = F.when(has[f"{s}load"], value[f"{s}load"]).when(
            sized[f"{s}bytes"], flow_fn.bits_per_second(size, length)
        ).otherwise(F.lit(0.0))
        rates[f"{s}meansz"] = F.when(has[f"{s}meansz"], value[f"{s}meansz"]).when(
            both, flow_fn.mean_size(size, packets)
        ).otherwise(F.lit(0.0))
        rates[f"{s}intpkt"] = F.when(has[f"{s}intpkt"], F.when(iat, gap / MICROS).otherwise(gap)).when(
            sized[f"{s}pkts"], flow_fn.packet_gap(packets, length)
        ).otherwise(F.lit(0.0))
    rest = {c: F.when(has[c], value[c]).otherwise(F.lit(0.0)) for c in (
        "sttl", "dttl", "sloss", "dloss", "sjit", "djit", "tcprtt", "synack", "ackdat", "sport", "dsport"
    )}
    counts = {c: F.when(has[c], value[c]).otherwise(F.lit(1.0)) for c in vocab.CONTEXT_COUNTS}
    flags = {f.split("_")[0]: number(_field(f)) for f in FLAGS}
    flagged = _has(list(FLAGS))
    words = {
        "srcip": text(F.col("srcip")),
        "dstip": text(F.col("dstip")),
        "proto": F.when(has["proto"], text(F.col("proto"))).otherwise(F.lit("tcp")),
        "service": F.when(has["service"], text(F.col("service"))).otherwise(F.lit("unknown")),
        "state": F.when(has["state"], text(F.col("state"))).when(flagged, flow_fn.tcp_state(**flags)).otherwise(F.lit("UNK")),
    }
    # what the batch plan calls present: mapped, derived or defaulted
    covered = {
        "sload": has["sload"] | sized["sbytes"], "dload": has["dload"] | sized["dbytes"],
        "sintpkt": has["sintpkt"] | sized["spkts"], "dintpkt": has["dintpkt"] | sized["dpkts"],
    }
    share = sum((c.cast("double") for c in covered.values()), F.lit(float(len(vocab.CORE_FEATURES) - len(covered))))
    mapped = F.array(*[F.when(h, F.lit(t)) for t, h in has.items()])
    return base.withColumns({**rates, **rest, **counts, **words}).select(
        *keep, "srcip", "dstip", "sport", "dsport", "proto", "service", "state", "dur", "sbytes", "dbytes", "spkts", "dpkts",
        *rates, *[c for c in rest if c not in ("sport", "dsport")], *counts,
        event_schema().alias("schema"),
        F.size(F.filter(mapped, lambda m: m.isNotNull())).alias("mapped_columns"),
        F.round(share / len(vocab.CORE_FEATURES), 4).alias("feature_coverage"),
    )


def event_schema() -> Column:
    """Vendor family of one event's field names."""
    def all_of(*names: str) -> Column:
        found = F.lit(True)
        for n in names:
            found = found & (_has([n]) if n in known else F.array_contains("keys", n))
        return found

    known = set(known_names())
    keys = F.col("keys")
    return (
        F.when(all_of("flow_duration", "total_fwd_packets", "total_backward_packets"), F.lit("cic_ids2017"))
        .when(_has(["id.orig_h", "id.resp_h"]) | all_of("conn_state", "orig_bytes", "resp_bytes"), F.lit("zeek_conn"))
        .when(F.exists(keys, lambda k: k.startswith("flow.")) | _has(["alert.signature"]), F.lit("suricata_eve_flat"))
        .when(_has(["srcaddr", "dstaddr"]), F.lit("netflow_or_cloud_flow"))
        .when(all_of("src_ip", "dst_ip") | all_of("source_ip", "destination_ip"), F.lit("firewall_or_flow_csv"))
        .when(all_of("attack_cat", "sbytes", "dbytes"), F.lit("unsw_nb15"))
        .otherwise(F.lit("generic_csv"))
    )


def score_events(events: DataFrame, scorer: LinearScorer, keep: list[str], json_col: str = "value") -> DataFrame:
    """Stateless scoring of JSON events; works on batch and streaming frames alike."""
    flows = normalize_events(parse_events(events, json_col), keep)
    meta = ["schema", "mapped_columns", "feature_coverage"]
    scored = scorer.score(flows, [*keep, *meta])
    severity = F.when(F.col("is_zeroday"), F.lit("HIGH")).otherwise(F.lit("LOW"))
    quality = (
        F.when(F.col("feature_coverage") >= 0.80, F.lit("GOOD"))
        .when(F.col("feature_coverage") >= 0.60, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    return scored.select(
        *keep,
        F.col("predicted_class").alias("label"),
        "classifier_class",
        F.col("max_prob").alias("confidence"),
        "ae_re", "hybrid_score",
        F.col("is_zeroday").alias("is_anomaly"),
        "zero_day_rule",
        risk_score(F.col("hybrid_score"), F.col("ae_re"), F.col("is_zeroday"), severity).alias("risk"),
        "schema", quality.alias("quality"), "feature_coverage", "mapped_columns",
    )

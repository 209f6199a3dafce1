"""Flow arithmetic: totals, rates, TCP state, engineered features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import finite

EPS = 1e-8


def remainder(total: Column, known: Column) -> Column:
    return F.greatest(total - known, F.lit(0.0))


def bounded_duration(dur: Column) -> Column:
    return F.greatest(dur, F.lit(1e-6))


def bits_per_second(size: Column, dur: Column) -> Column:
    return size * F.lit(8.0) / bounded_duration(dur)


def mean_size(size: Column, packets: Column) -> Column:
    return ratio(size, packets + F.lit(EPS))


def packet_gap(packets: Column, dur: Column) -> Column:
    return bounded_duration(dur) / F.greatest(packets, F.lit(1.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division where a zero divisor gives null instead of an error."""
    return F.try_divide(top, bottom)


def tcp_state(syn: Column, fin: Column, rst: Column, ack: Column) -> Column:
    return (
        F.when(rst > 0, F.lit("RST"))
        .when(fin > 0, F.lit("FIN"))
        .when((syn > 0) & (ack > 0), F.lit("CON"))
        .when(syn > 0, F.lit("SYN"))
        .otherwise(F.lit("CON"))
    )


def _positive_log(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def _per_second(size: Column, dur: Column) -> Column:
    return ratio(size, bounded_duration(dur))


# name -> (columns that must be present, formula over them). ``extended`` features
# belong to the wider feature line only.
_Formula = tuple[tuple[str, ...], Callable[..., Column], bool]

FEATURES: dict[str, _Formula] = {
    "bytes_ratio": (("sbytes", "dbytes"), lambda s, d: ratio(s, s + d + EPS), False),
    "log_total_bytes": (("sbytes", "dbytes"), lambda s, d: F.log1p(s + d + EPS), False),
    "log_sbytes": (("sbytes", "dbytes"), lambda s, d: _positive_log(s), False),
    "log_dbytes": (("sbytes", "dbytes"), lambda s, d: _positive_log(d), False),
    "pkts_ratio": (("spkts", "dpkts"), lambda s, d: ratio(s, s + d + EPS), False),
    "log_total_pkts": (("spkts", "dpkts"), lambda s, d: F.log1p(s + d + EPS), False),
    "bytes_per_pkt_src": (("sbytes", "spkts", "dpkts"), lambda b, s, d: ratio(b, s + EPS), True),
    "bytes_per_pkt_dst": (("dbytes", "spkts", "dpkts"), lambda b, s, d: ratio(b, d + EPS), True),
    "src_bps": (("sbytes", "dur"), _per_second, False),
    "log_src_bps": (("sbytes", "dur"), lambda s, t: F.log1p(_per_second(s, t)), False),
    "pkt_rate": (("spkts", "sbytes", "dur"), lambda p, s, t: _per_second(p + EPS, t), False),
    "load_asym": (("sload", "dload"), lambda s, d: ratio(F.abs(s - d), s + d + EPS), False),
    "log_sload": (("sload", "dload"), lambda s, d: _positive_log(s), False),
    "log_dload": (("sload", "dload"), lambda s, d: _positive_log(d), True),
    "ttl_diff": (("sttl", "dttl"), lambda s, d: F.abs(s - d), False),
    "ttl_sum": (("sttl", "dttl"), lambda s, d: s + d, False),
    "loss_rate_src": (("sloss", "spkts"), lambda x, p: ratio(x, p + EPS), False),
    "loss_rate_dst": (("dloss", "dpkts"), lambda x, p: ratio(x, p + EPS), False),
    "jit_ratio": (("sjit", "djit"), lambda s, d: ratio(s, d + EPS), False),
    "log_sjit": (("sjit", "djit"), lambda s, d: _positive_log(s), False),
    "jit_sum": (("sjit", "djit"), lambda s, d: s + d, True),
    "handshake_ratio": (("synack", "ackdat"), lambda s, a: ratio(s, a + EPS), False),
    "incomplete_tcp": (("synack", "ackdat"), lambda s, a: ((s > 0) & (a == 0)).cast("double"), False),
    "intpkt_ratio": (("sintpkt", "dintpkt"), lambda s, d: ratio(s, d + EPS), False),
    "intpkt_diff": (("sintpkt", "dintpkt"), lambda s, d: F.abs(s - d), True),
    "ct_srv_ratio": (("ct_srv_src", "ct_srv_dst"), lambda s, d: ratio(s, d + EPS), True),
}


def engineered(columns: list[str], extended: bool = False) -> dict[str, Column]:
    """Every feature whose inputs are present; non-finite results become 0."""
    present = set(columns)
    out: dict[str, Column] = {}
    for name, (inputs, formula, only_extended) in FEATURES.items():
        if only_extended and not extended:
            continue
        if name == "pkt_rate" and {"sbytes", "dur"} <= present and "spkts" not in present:
            out[name] = finite(_per_second(F.lit(EPS), F.col("dur").cast("double")))
            continue
        if set(inputs) <= present:
            out[name] = finite(formula(*[F.col(c).cast("double") for c in inputs]))
    return out

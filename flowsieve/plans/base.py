"""Query registry and the flow, score and alert views over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query and, where SQL can say it, the equivalent text."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(lambda spark, folder: tidy(run(spark, folder)), sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 places, integers long, arrays joined."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(1e-10), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    """Doubles to 6 places; the tiny shift keeps exact halves from splitting engines."""
    return f"(round({expr} + 1E-10, 6) + 0E0)"


# Flow, score and alert views. The same expressions run in Spark and in plain SQL.
FLOW_COLUMNS = {
    "source_row": "event_id",
    "event_ts": "ts",
    "source_file": "concat('fw-', CAST(CAST(ts AS DATE) AS STRING), '.csv')",
    "src_ip": "concat('10.0.0.', CAST(user_id % 250 AS STRING))",
    "dst_ip": "concat('172.16.1.', CAST(event_id % 40 AS STRING))",
    "src_port": "1024 + (event_id * 7919) % 60000",
    "dst_port": "CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 8443"
    " WHEN 'signup' THEN 22 ELSE 3389 END",
    "protocol": "CASE WHEN event_type = 'error' THEN 'icmp' WHEN event_id % 5 = 0 THEN 'udp' ELSE 'tcp' END",
    "service": "CASE event_type WHEN 'view' THEN 'https' WHEN 'click' THEN 'http' WHEN 'purchase' THEN 'pay'"
    " WHEN 'signup' THEN 'ssh' ELSE '-' END",
    "action": "CASE WHEN event_id % 11 = 0 THEN 'RST' WHEN event_id % 7 = 0 THEN 'FIN' ELSE 'CON' END",
    "duration": "value / 10E0",
    "sent_bytes": "CAST(floor(value * 100E0) AS BIGINT)",
    "received_bytes": "CAST(floor(value * 37E0) AS BIGINT)",
    "sent_pkts": "1 + event_id % 50",
    "received_pkts": "(event_id * 3) % 40",
    "attack_cat": "CASE user_id % 10 WHEN 6 THEN 'DoS' WHEN 7 THEN 'Exploits' WHEN 8 THEN 'Reconnaissance'"
    " WHEN 9 THEN 'Fuzzers' ELSE 'Normal' END",
}
MAX_PROB = "(0.2E0 + 0.8E0 * CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000E0)"
SCORE_COLUMNS = {
    "source_row": "event_id",
    "event_ts": "ts",
    "source_file": FLOW_COLUMNS["source_file"],
    "src_ip": FLOW_COLUMNS["src_ip"],
    "dst_ip": FLOW_COLUMNS["dst_ip"],
    "service": FLOW_COLUMNS["service"],
    "ae_re": "value / 500E0",
    "max_prob": MAX_PROB,
    "softmax": f"1E0 - {MAX_PROB}",
    "classifier_class": "CASE (user_id + event_id) % 7 WHEN 0 THEN 'DoS' WHEN 1 THEN 'Exploits'"
    " WHEN 2 THEN 'Reconnaissance' WHEN 3 THEN 'Generic' ELSE 'Normal' END",
    "attack_cat": FLOW_COLUMNS["attack_cat"],
    "hybrid": f"1E0 / (1E0 + exp(-(2.63E0 * (value / 500E0) + 14.73E0 * (1E0 - {MAX_PROB}) - 3.36E0)))",
}
# two of three votes over fixed limits
VOTE = (
    "(CASE WHEN hybrid > 0.99E0 THEN 1 ELSE 0 END + CASE WHEN ae_re > 0.2E0 THEN 1 ELSE 0 END"
    " + CASE WHEN softmax > 0.5E0 THEN 1 ELSE 0 END) >= 2"
)
VERDICT = (
    f"CASE WHEN {VOTE} THEN 'Zero-Day Candidate' WHEN classifier_class = 'Normal' THEN 'Normal'"
    " ELSE 'Known-Attack' END"
)
ALERT_COLUMNS = {
    "alert_id": "concat('A-', CASE WHEN length(CAST(source_row AS STRING)) >= 6 THEN CAST(source_row AS STRING)"
    " ELSE lpad(CAST(source_row AS STRING), 6, '0') END)",
    "source_row": "source_row",
    "event_ts": "event_ts",
    "src_ip": "src_ip",
    "dst_ip": "dst_ip",
    "service": "service",
    "classifier_class": "classifier_class",
    "zero_day_family": "attack_cat",
    "ae_score": "ae_re",
    "max_prob": "max_prob",
    "hybrid_score": "hybrid",
    "is_zeroday": VOTE,
    "predicted_class": VERDICT,
    "source_file_hash": "md5(source_file)",
    "severity": "CASE source_row % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END",
    "status": "CASE source_row % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'investigating'"
    " WHEN 3 THEN 'closed' ELSE 'false_positive' END",
}


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*_list(FLOW_COLUMNS))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*_list(SCORE_COLUMNS))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """The score contract: scores with decision, rule and verdict."""
    return scores(spark, folder).selectExpr(
        "*", "hybrid AS hybrid_score", "ae_re AS ae_score", f"{VOTE} AS is_zeroday", f"{VERDICT} AS predicted_class"
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """High-scoring rows as alerts with a text timestamp."""
    return (
        scores(spark, folder)
        .where("hybrid > 0.9E0")
        .selectExpr(*_list(ALERT_COLUMNS))
        .withColumn("timestamp", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))
    )


_CTES = {
    "flows_v": f"SELECT {', '.join(_list(FLOW_COLUMNS))} FROM events",
    "scores_v": f"SELECT {', '.join(_list(SCORE_COLUMNS))} FROM events",
    "judged_v": f"SELECT *, hybrid AS hybrid_score, ae_re AS ae_score, {VOTE} AS is_zeroday,"
    f" {VERDICT} AS predicted_class FROM scores_v",
    "alerts_v": f"SELECT {', '.join(_list(ALERT_COLUMNS))}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS timestamp"
    " FROM scores_v WHERE hybrid > 0.9E0",
}


def with_views(sql: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """Prefix ``sql`` with the views it mentions plus named extra ones."""
    body = " ".join([sql, *[text for _, text in extra]])
    needed = [name for name in _CTES if name in body]
    if any(n in ("judged_v", "alerts_v") for n in needed) and "scores_v" not in needed:
        needed.append("scores_v")
    parts = [f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed]
    parts += [f"{name} AS ({text})" for name, text in extra]
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    return head + sql


def class_text(column: str) -> str:
    """Fixture categories are canonical already; truth is Normal or an attack."""
    return f"CASE WHEN {column} = 'Normal' THEN 'Normal' ELSE 'Known-Attack' END"

"""Technique mapping of classes and dominant features, as joins to rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Technique id, name, tactic, response actions.
TECHNIQUES = [
    ("T1498", "Network Denial of Service", "Impact", ["Rate-limit or block source ranges", "Check upstream firewall and WAF counters"]),
    ("T1499", "Endpoint Denial of Service", "Impact", ["Inspect target service saturation", "Correlate host CPU, memory and socket exhaustion"]),
    ("T1190", "Exploit Public-Facing Application", "Initial Access", ["Review exposed service logs", "Check recent CVEs and patch level for destination service"]),
    ("T1203", "Exploitation for Client Execution", "Execution", ["Inspect payload-bearing sessions", "Hunt for follow-up process or script execution"]),
    ("T1068", "Exploitation for Privilege Escalation", "Privilege Escalation", ["Review endpoint privilege changes", "Search for abnormal child processes"]),
    ("T1595", "Active Scanning", "Reconnaissance", ["Correlate with port/service scan telemetry", "Throttle or block repeat scanners"]),
    ("T1046", "Network Service Discovery", "Discovery", ["Check connection fan-out and destination diversity", "Review asset inventory exposure"]),
    ("T1071", "Application Layer Protocol", "Command and Control", ["Inspect protocol legitimacy", "Hunt for repeated low-volume beaconing"]),
    ("T1543", "Create or Modify System Process", "Persistence", ["Inspect service creation events", "Check startup persistence locations"]),
    ("T1078", "Valid Accounts", "Defense Evasion", ["Review authentication logs", "Check impossible travel and new device signals"]),
    ("T1091", "Replication Through Removable Media", "Lateral Movement", ["Review lateral movement telemetry", "Check removable media and autorun events"]),
    ("T1210", "Exploitation of Remote Services", "Lateral Movement", ["Inspect remote service authentication", "Patch vulnerable internal services"]),
    ("T1055", "Process Injection", "Defense Evasion", ["Collect endpoint process tree", "Check memory injection detections"]),
    ("T1059", "Command and Scripting Interpreter", "Execution", ["Review shell/script telemetry", "Contain host if suspicious execution is confirmed"]),
    ("T1110", "Brute Force", "Credential Access", ["Check failed login velocity", "Temporarily enforce account lockout or MFA challenge"]),
    ("T1040", "Network Sniffing", "Credential Access", ["Review promiscuous-mode or SPAN misuse", "Check credential exposure on cleartext protocols"]),
    ("T1030", "Data Transfer Size Limits", "Exfiltration", ["Inspect byte volume and destination reputation", "Apply egress controls for suspicious flows"]),
    ("T1132", "Data Encoding", "Command and Control", ["Inspect encoded payload patterns", "Correlate with DNS/HTTP beaconing"]),
]
# Class, technique id, confidence, rationale, in rule order per class.
CLASS_RULES = [
    ("DoS", "T1498", 0.86, "Traffic pattern resembles volumetric or protocol-level denial of service."),
    ("DoS", "T1499", 0.70, "Classifier indicates service availability impact risk."),
    ("Exploits", "T1190", 0.82, "Exploit class maps to public service exploitation in network telemetry."),
    ("Exploits", "T1203", 0.68, "Payload-like traffic can indicate client or application exploitation."),
    ("Exploits", "T1068", 0.55, "Follow-up privilege escalation should be checked if host telemetry confirms compromise."),
    ("Reconnaissance", "T1595", 0.88, "Reconnaissance traffic commonly reflects active probing or scanning."),
    ("Reconnaissance", "T1046", 0.80, "Connection count and service diversity may indicate service discovery."),
    ("Generic", "T1071", 0.62, "Generic attack traffic may use common application protocols for C2 or abuse."),
    ("Generic", "T1190", 0.50, "Generic abnormal service traffic can still represent exploitation attempts."),
    ("Backdoors", "T1543", 0.64, "Backdoor activity may lead to service or process persistence."),
    ("Backdoors", "T1078", 0.58, "Account misuse should be checked when persistence indicators are weak."),
    ("Worms", "T1210", 0.80, "Worm behavior often spreads through vulnerable remote services."),
    ("Worms", "T1091", 0.50, "Replication vectors should be considered if endpoint evidence supports it."),
    ("Shellcode", "T1055", 0.76, "Shellcode-like behavior can indicate injected execution."),
    ("Shellcode", "T1059", 0.64, "Command execution should be checked after suspected payload delivery."),
    ("Fuzzers", "T1595", 0.72, "Fuzzing traffic frequently appears as probing or active scanning."),
    ("Fuzzers", "T1110", 0.42, "Credential attack correlation is needed before treating this as brute force."),
    ("Analysis", "T1040", 0.58, "Analysis traffic may involve capture or inspection of network data."),
    ("Analysis", "T1046", 0.54, "Service discovery is a plausible analyst-facing interpretation."),
    ("Zero-Day", "T1190", 0.48, "Unknown attack is safest to triage first as possible exposed-service exploitation."),
]
# Feature set, then technique id, confidence, rationale.
FEATURE_RULES = [
    (
        ("sbytes", "dbytes", "sload", "dload", "log_total_bytes", "log_sbytes", "log_dbytes"),
        [
            ("T1030", 0.72, "Byte and load features are dominant, suggesting abnormal transfer volume."),
            ("T1498", 0.66, "High traffic asymmetry or volume can represent network DoS pressure."),
        ],
    ),
    (
        ("ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_srv_src", "ct_dst_src_ltm", "ct_dst_sport_ltm"),
        [
            ("T1046", 0.76, "Connection-count features are dominant, suggesting service discovery or scanning."),
            ("T1595", 0.70, "Repeated destination/service probing is consistent with active scanning."),
        ],
    ),
    (
        ("dur", "sintpkt", "dintpkt", "intpkt_ratio", "intpkt_diff"),
        [
            ("T1132", 0.52, "Timing and duration anomalies can indicate encoded or staged C2 traffic."),
            ("T1071", 0.50, "Application protocol abuse should be checked for repeated timing patterns."),
        ],
    ),
    (
        ("tcprtt", "synack", "ackdat", "handshake_ratio", "incomplete_tcp", "state_num"),
        [
            ("T1190", 0.58, "Handshake and TCP-state anomalies can accompany service exploitation attempts."),
            ("T1498", 0.55, "Incomplete TCP patterns may also indicate protocol-level DoS behavior."),
        ],
    ),
]
NOTE_KNOWN = "MITRE mapping is heuristic and should be validated with endpoint, firewall and SIEM evidence."
NOTE_ZERO_DAY = "Zero-day mapping is a hypothesis based on model anomaly score and dominant features."
DEFAULT_CLASS = "Generic"
FEATURE_SEQ = 100


def technique_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TECHNIQUES, "technique_id string, name string, tactic string, response_actions array<string>"
    ).withColumn("url", F.format_string("https://attack.mitre.org/techniques/%s/", "technique_id"))


def class_rules(spark: SparkSession) -> DataFrame:
    rows = [(c, i, t, conf, why) for i, (c, t, conf, why) in enumerate(CLASS_RULES)]
    return spark.createDataFrame(
        rows, "rule_class string, seq int, technique_id string, confidence double, rationale string"
    )


def feature_rules(spark: SparkSession) -> DataFrame:
    """One row per (feature, technique) of every rule set."""
    rows, seq = [], FEATURE_SEQ
    for features, techniques in FEATURE_RULES:
        for technique, confidence, why in techniques:
            rows += [(f, seq, technique, confidence, why) for f in features]
            seq += 1
    return spark.createDataFrame(
        rows, "feature string, seq int, technique_id string, confidence double, rationale string"
    )


def by_class(alerts: DataFrame, class_col: str = "classifier_class", id_col: str = "alert_id") -> DataFrame:
    """Candidate techniques from the class; unknown classes use Generic, Normal has none."""
    spark = alerts.sparkSession
    names = sorted({c for c, *_ in CLASS_RULES})
    rule_class = F.when(F.col(class_col).isin(*names), F.col(class_col)).otherwise(F.lit(DEFAULT_CLASS))
    picked = alerts.where(F.coalesce(F.col(class_col), F.lit("")) != "Normal").select(
        id_col, F.col(class_col).alias("attack_class"), rule_class.alias("rule_class")
    )
    rules = F.broadcast(class_rules(spark))  # fixed table of 20 rows
    return picked.join(rules, "rule_class").select(
        id_col, "seq", "technique_id", "confidence", "rationale",
        F.array(F.concat(F.lit("classifier:"), F.col("attack_class"))).alias("evidence"),
    )


def by_features(alerts: DataFrame, features_col: str, id_col: str = "alert_id") -> DataFrame:
    """Candidate techniques from dominant features: one equality join on the name.

    Grouping is per (alert, rule), at most a rule's few features each.
    """
    rules = F.broadcast(feature_rules(alerts.sparkSession))  # fixed table of 48 rows
    exploded = alerts.select(id_col, F.explode(F.array_distinct(features_col)).alias("feature"))
    return (
        exploded.join(rules, "feature")
        .groupBy(id_col, "seq", "technique_id", "confidence", "rationale")
        .agg(F.array_sort(F.collect_set("feature")).alias("evidence"))
    )


def zero_day(alerts: DataFrame, features_col: str, ae_col: str = "ae_score", id_col: str = "alert_id") -> DataFrame:
    """Feature techniques lifted by the anomaly score, else the default hypothesis."""
    ae = F.col(ae_col)
    shown = F.concat(F.lit("ae_score:"), F.format_string("%.3f", ae))
    names = [f for features, _ in FEATURE_RULES for f in features]
    has_rule = F.exists(features_col, lambda f: f.isin(*names))
    lifted = (
        by_features(alerts, features_col, id_col)
        .join(alerts.select(id_col, ae_col), id_col)
        .select(
            id_col, "seq", "technique_id",
            F.round(F.least(F.col("confidence") + ae * 0.10, F.lit(0.92)), 2).alias("confidence"),
            "rationale", F.concat("evidence", F.array(shown)).alias("evidence"),
        )
    )
    (seq, technique, confidence, why), = [
        (i, t, conf, why) for i, (c, t, conf, why) in enumerate(CLASS_RULES) if c == "Zero-Day"
    ]
    plain = alerts.where(~F.coalesce(has_rule, F.lit(False))).select(
        id_col, F.lit(seq).alias("seq"), F.lit(technique).alias("technique_id"),
        F.round(F.least(F.lit(confidence) + ae * 0.15, F.lit(0.75)), 2).alias("confidence"),
        F.lit(why).alias("rationale"), F.array(shown).alias("evidence"),
    )
    return lifted.unionByName(plain)


def rank(candidates: DataFrame, max_items: int, id_col: str = "alert_id") -> DataFrame:
    """One row per technique kept: highest confidence, first on ties.

    Evidence of later candidates that did not beat the kept one is merged in;
    an alert has at most a dozen candidates, so the windows are tiny.
    """
    same = Window.partitionBy(id_col, "technique_id").orderBy(F.desc("confidence"), "seq")
    first = candidates.withColumn("_n", F.row_number().over(same)).withColumn(
        "_kept_seq", F.first("seq").over(same)
    )
    merged = first.groupBy(id_col, "technique_id").agg(
        F.min_by(F.struct("seq", "confidence", "rationale", "evidence"), F.col("_n")).alias("kept"),
        F.flatten(F.collect_list(F.when(F.col("seq") > F.col("_kept_seq"), F.col("evidence")))).alias("later"),
        F.count_if(F.col("seq") > F.col("_kept_seq")).alias("later_rows"),
        F.min("seq").alias("first_seq"),
    )
    evidence = F.when(
        F.col("later_rows") > 0, F.array_sort(F.array_distinct(F.concat("kept.evidence", "later")))
    ).otherwise(F.col("kept.evidence"))
    order = Window.partitionBy(id_col).orderBy(F.desc("confidence"), "first_seq")
    return (
        merged.select(
            id_col, "technique_id", "first_seq", F.col("kept.confidence").alias("confidence"),
            F.col("kept.rationale").alias("rationale"), evidence.alias("evidence"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_items)
        .drop("first_seq")
    )


def describe(ranked: DataFrame) -> DataFrame:
    """Add name, tactic, response actions and url of every technique."""
    return ranked.join(F.broadcast(technique_table(ranked.sparkSession)), "technique_id")  # fixed 18 rows


def overall_confidence(best: Column) -> Column:
    return (
        F.when(best >= 0.75, F.lit("HIGH")).when(best >= 0.55, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    )


def summarise(described: DataFrame, mode: str, note: str, attack_class: DataFrame, id_col: str = "alert_id") -> DataFrame:
    """One row per alert: primary tactic, overall confidence and the summary text.

    ``attack_class`` maps alerts to the class named in the text.
    """
    fields = ["rank", "technique_id", "name", "tactic", "confidence", "rationale", "response_actions"]
    per_alert = described.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("techniques")
    )
    joined = per_alert.join(attack_class, id_col)
    lines = F.transform(
        "techniques",
        lambda t: F.concat(
            F.lit("- ["), t["technique_id"], F.lit("] "), t["name"], F.lit(" | Tactic="), t["tactic"],
            F.lit(" | Confidence="), t["confidence"].cast("string"), F.lit(" | Why="), t["rationale"],
        ),
    )
    confidence = overall_confidence(F.array_max(F.transform("techniques", lambda t: t["confidence"])))
    head = F.array(
        F.concat(F.lit("Attack class: "), "attack_class"),
        F.lit(f"Mapping mode: {mode}"),
        F.concat(F.lit("Overall confidence: "), confidence),
        F.lit("Mapped MITRE ATT&CK techniques:"),
    )
    return joined.select(
        id_col, "attack_class", F.lit(mode).alias("mapping_mode"),
        F.get("techniques", F.lit(0))["tactic"].alias("primary_tactic"),
        confidence.alias("confidence"),
        F.size("techniques").alias("technique_count"),
        F.array_join(F.concat(head, lines, F.array(F.lit(f"Note: {note}"))), "\n").alias("summary"),
        F.array_distinct(F.flatten(F.transform("techniques", lambda t: t["response_actions"]))).alias("checklist"),
    )

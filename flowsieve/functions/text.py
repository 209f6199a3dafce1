"""Text pulled out of model answers and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def embedded_json(raw: Column) -> Column:
    """The JSON object inside an answer.

    The first fenced part that starts with a brace wins (an optional ``json`` tag
    before it is dropped); then everything from the first to the last brace.
    """
    answer = F.trim(F.coalesce(raw, F.lit("")))
    parts = F.transform(F.split(answer, FENCE), lambda p: F.regexp_replace(strip(p), r"(?s)^json\s*", ""))
    fenced = F.get(F.filter(parts, lambda p: p.startswith("{")), F.lit(0))
    body = F.when(answer.contains(FENCE), F.coalesce(fenced, answer)).otherwise(answer)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(body)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^\s+|\s+$", "")


def fallback_triage(hybrid: Column, ae: Column, is_zeroday: Column, predicted: Column) -> Column:
    """Triage record when no language model answers (fixed wording)."""
    subject = F.when(is_zeroday, F.lit("Zero-Day Candidate")).otherwise(predicted)
    return F.struct(
        F.when(hybrid > 0.6, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.concat(
            subject, F.lit(" detected - hybrid score: "), F.format_string("%.3f", hybrid)
        ).alias("verdict"),
        F.concat(
            F.lit("AE reconstruction error cao ("),
            F.format_string("%.3f", ae),
            F.lit(") cho thay traffic bat thuong. Can kiem tra thu cong."),
        ).alias("attack_summary"),
        F.array(
            F.lit("Kiem tra nguon IP"), F.lit("Xem xet block traffic"), F.lit("Escalate len Tier 2")
        ).alias("recommended_actions"),
        F.lit("MEDIUM").alias("false_positive_risk"),
        F.lit("Chua co LLM de phan tich sau hon").alias("false_positive_reason"),
        F.lit("Kich hoat LLM agent de co phan tich chi tiet hon").alias("analyst_note"),
    )

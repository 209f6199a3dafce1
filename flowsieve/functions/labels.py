"""Label vocabularies: attack categories, truth verdicts, analyst labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import lookup

# Class vocabulary of the flow data set.
KNOWN_CLASSES = ("Normal", "DoS", "Exploits", "Reconnaissance", "Generic")
HELD_OUT_FAMILIES = ("Fuzzers", "Analysis", "Backdoors", "Shellcode", "Worms")
ANALYST_LABELS = ("normal", "known_attack", "suspicious", "false_positive", "unknown")

# Spelling -> canonical category.
CATEGORY_SPELLINGS = {
    "normal": "Normal",
    "dos": "DoS",
    "exploits": "Exploits",
    "exploit": "Exploits",
    "reconnaissance": "Reconnaissance",
    "generic": "Generic",
    "fuzzers": "Fuzzers",
    "fuzzer": "Fuzzers",
    "analysis": "Analysis",
    "backdoor": "Backdoors",
    "backdoors": "Backdoors",
    "shellcode": "Shellcode",
    "worms": "Worms",
    "worm": "Worms",
}


def canonical_category(raw: Column) -> Column:
    """Attack category with one spelling per class; missing means Normal."""
    trimmed = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    lowered = F.lower(trimmed)
    capitalised = F.concat(F.upper(F.left(lowered, F.lit(1))), F.substring(lowered, 2, 1 << 30))
    return F.when(trimmed.isin("", "nan", "NaN", "None", "-"), F.lit("Normal")).otherwise(
        lookup(lowered, CATEGORY_SPELLINGS, capitalised)
    )


def binary_label(category: Column, label: Column | None = None) -> Column:
    """0/1 label from a numeric label column, else from the category."""
    if label is not None:
        return F.coalesce(label.try_cast("double").try_cast("int"), F.lit(0))
    return (category != F.lit("Normal")).cast("int")


def truth_verdict(label: Column) -> Column:
    """Normal / Known-Attack, or empty text when the label says nothing."""
    value = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return (
        F.when(value.isin("", "nan", "none", "-", "unknown"), F.lit(""))
        .when(value.isin("0", "benign", "normal"), F.lit("Normal"))
        .otherwise(F.lit("Known-Attack"))
    )


def default_analyst_label(label: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit(""))))
    return (
        F.when(value.isin("", "nan", "none", "unknown"), F.lit("unknown"))
        .when(value.isin("0", "benign", "normal"), F.lit("normal"))
        .otherwise(F.lit("known_attack"))
    )


def clean_analyst_label(label: Column) -> Column:
    value = F.translate(F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")))), "- ", "__")
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def attack_category(raw: Column) -> Column:
    """Trimmed category text; every spelling of benign becomes Normal."""
    value = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(
        F.lower(value).isin("", "nan", "none", "benign", "normal", "0"), F.lit("Normal")
    ).otherwise(value)


def known_set(category: Column) -> Column:
    return category.isin(*KNOWN_CLASSES)


def held_out_set(category: Column) -> Column:
    return category.isin(*HELD_OUT_FAMILIES)

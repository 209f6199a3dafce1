"""Stages of the pipeline decide row by row, also where doc_id is null or repeats."""

import random

import corpus_pipeline
from tests.llm.test_text_models import WORDS

SCHEMA = "doc_id long, text string, lang string"


def test_opposite_verdicts_under_one_id(spark, tmp_path):
    """Fails where one kept row saves all rows of its id."""
    rng = random.Random(4)
    some = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefg") for _ in range(n))
    item, near = some("fr", 30), some("en", 80)
    other = " ".join([*near.split()[:-1], "other"])
    texts = {"clean": some("en", 60), "item": some("fr", 20) + " " + item, "digits": "12 34 56", "near": near, "other": other}
    rows = [(i, t, "fr" if k == "item" else "en") for i in (None, 7) for k, t in texts.items()]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    names = {t: k for k, t in texts.items()}

    def kept(stage, rows):
        return sorted((str(r.doc_id), names[r.text]) for r in stage(spark, rows, str(tmp_path)).collect())

    both = lambda *some: sorted((i, k) for i in ("7", "None") for k in some)
    assert kept(corpus_pipeline.identify_language, docs) == both("clean", "item", "near", "other")
    assert kept(corpus_pipeline.decontaminate_benchmark, docs) == both("clean", "digits", "near", "other")
    nulls = kept(corpus_pipeline.near_dedup, docs.where("doc_id IS NULL"))
    assert len(nulls) == 4 and {"clean", "item", "digits"} < {k for _, k in nulls}

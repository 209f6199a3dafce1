"""A corpus pipeline over ``documents``: each stage is one text operator whose decisions take effect.

A document is a row. Its doc_id may be null or repeat, so stages tell rows apart by
doc_id and text together; only rows that repeat both share a decision. Null text counts
as empty; an empty table passes every stage as an empty table; other columns travel
along, whatever they are called.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, exact, language, pieces, simhash
from flowsieve.llm.common import durable, tune
from flowsieve.session import work_dir

NEAR_WORDS = 3  # words in a shingle of the near-duplicate stage
NEAR_BITS = simhash.BITS  # differing bits that still link
KEY = "_pipeline_key"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear; texts without letters and ambiguous ones go.

    The model learns from all labelled rows it is given. A single class of labels, or
    none, leaves nothing to tell apart: then only texts without letters go. Equal texts
    are judged alike, so repeated rows stay or go together.
    """
    tune(spark)
    model = language.fit(docs, F.lit(True))
    key = _key(docs)
    found = language.predict(_keyed(docs, key), model, id_col=KEY)
    unclear = F.col("lang_pred") == language.UNDETERMINED
    if len(model.languages) > 1:
        unclear = unclear | F.col("ambiguous")
    elif not model.languages:
        unclear = F.col("lang_pred").isNull()
    return _keep(docs, key, found.where(~unclear))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one row of each.

    A null doc_id is the smallest. Of rows that repeat both id and text one stays. All
    empty texts are equal.
    """
    tune(spark)
    found = durable(exact.exact_dedup(docs), "exact")
    kept = found.where("kept").select(F.col("doc_id").alias("_pipeline_id"), F.col("text_sha256").alias("_pipeline_sha"))
    sha = F.sha2(F.translate(_text(), UPPER, LOWER), 256)
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_pipeline_id")) & (sha == F.col("_pipeline_sha")), "left_semi")
    again = found.groupBy("doc_id", "text_sha256").count().where("count > 1")
    again = durable(again.select(F.col("doc_id").alias("_pipeline_id"), F.col("text_sha256").alias("_pipeline_sha")), "repeated")
    return _single(rows, again, sha)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id stays, null being the largest.

    Texts link where the SimHash fingerprints of their three-word shingles differ in at
    most three bits; classes are what links connect. Texts without words have the
    fingerprint zero and link like any other. Of rows that repeat both id and text one
    stays.
    """
    tune(spark)
    key = _key(docs)
    keyed = _keyed(docs, key, "doc_id")
    found = simhash.simhash_dedup(keyed, id_col=KEY, words=NEAR_WORDS, bits=NEAR_BITS).select(KEY, "component_id")
    ids = keyed.select(F.col(KEY).alias("_named"), "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")
    stays = found.join(ids, F.col(KEY) == F.col("_named")).groupBy("component_id").agg(first)
    rows = _keep(docs, key, stays.select(F.col("first")[KEY].alias(KEY)))
    sha = F.sha2(_text(), 256)
    again = keyed.groupBy(KEY, "doc_id").agg(F.count("*").alias("n"), F.min(F.sha2("text", 256)).alias("_pipeline_sha")).where("n > 1")
    return _single(rows, durable(again.select(F.col("doc_id").alias("_pipeline_id"), "_pipeline_sha"), "repeated"), sha)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to the allowed edits, go.

    Null and empty texts hold none and stay, null and empty items are in no text.
    Equal texts are judged alike.
    """
    tune(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _key(docs)
    found = decontaminate.contamination(_keyed(docs, key), benchmark, id_col=KEY)
    return _keep(docs, key, found.where("NOT contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_text, ids_sha256, decoded_sha256): each text encoded, and decoded again.

    A row for every row, repeated ones and null ids included; an empty text is the end
    id alone.
    """
    tune(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = pieces.encode(docs, model, outputs=("ids_text", "decoded"))
    return tokens.select(
        "doc_id",
        "n_tokens",
        "ids_text",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key(docs: DataFrame) -> Column:
    """Names a row by its id, null or not, and its text: a 64-bit hash, or a second one where the first is ambiguous.

    Among very many rows two different ones may share a hash. Those hashes, found by
    comparing the second ones, are a handful.
    """
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    one, two = F.xxhash64(F.length(id_), id_, _text()), F.xxhash64(_text(), F.lit(2), id_)
    pairs = docs.select(one.alias("one"), two.alias("two")).groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high"))
    shared = [r["one"] for r in pairs.where("low <> high").select("one").collect()]
    return F.when(one.isin(shared), two).otherwise(one) if shared else one


def _keyed(docs: DataFrame, key: Column, *more: str) -> DataFrame:
    return docs.select(key.alias(KEY), _text().alias("text"), *more)


def _keep(docs: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """The rows whose key is listed, as they were."""
    listed = found.select(F.col(KEY).alias("_pipeline_listed")).distinct()
    return docs.join(listed, key == F.col("_pipeline_listed"), "left_semi")


def _single(rows: DataFrame, again: DataFrame, sha: Column) -> DataFrame:
    """``rows``, and of those that repeat an id and a text (listed in ``again``) one each, the first by a hash of all columns."""
    if again.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("_pipeline_id")) & (sha == F.col("_pipeline_sha"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    twice = rows.join(again, same, "left_semi").groupBy(F.col("doc_id"), sha.alias("_pipeline_sha"))
    picked = twice.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return rows.join(again, same, "left_anti").union(picked)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", tokenize),
]
ORACLE_SQL = None  # language models, fingerprints and edit distances have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is stored and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

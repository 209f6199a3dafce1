"""The registered queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import alignment, decontaminate, exact, language, lattice, packing, pieces, quality, quotes, repair, simhash, suffix_array, suffix_tree
from flowsieve.llm.common import bucket_of, tune

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = lambda spark, folder: run(tune(spark), folder)
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs, bucket_of(F.col("doc_id"), 5) != 0)
    held_out = (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out")
    return language.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = pieces.encode(table(spark, folder, "documents"), model, outputs=("ids_text", "decoded"))
    ids, decoded = F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return tokens.select("doc_id", "n_tokens", ids, decoded)


# Bytes as pairs of hex digits; a 400-byte string is 800 of them.
@query(
    "op3_suffix_array_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
    edge AS (SELECT doc_id, i, CAST(i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 400 AS INT) AS new FROM twice),
    run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
    span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY doc_id, r),
    rest AS (SELECT span.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY span.doc_id ORDER BY a) + 1,
     2 * (a - lag(b, 1, 0) OVER (PARTITION BY span.doc_id ORDER BY a))) AS before, h FROM span JOIN d ON d.doc_id = span.doc_id),
    cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, concat(string_agg(before, '' ORDER BY a), substr(any_value(h), 2 * max(b) + 1)) AS k FROM rest GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
     sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_array.remove_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    items = F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), " ")
    return found.select("doc_id", "contaminated", F.size("hits").cast("long").alias("n_items"), items.alias("item_ids"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), 7) == 2
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice.lm_score(table(spark, folder, "documents"), ~held_out, model)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.quality_scores(docs, labels, bucket_of(F.col("id"), 4) != 2)
    held_out = (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query(
    "op7_substring_dedup",
    """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM late)),
    word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY ALL)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_tree.remove_seen_words(table(spark, folder, "documents"))
    gone = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long")
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op8_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_chat_formatting")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The given messages, which quote nothing, and replies derived from them by a rule, linked back to what they quote."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return quotes.link_quotes(given.unionByName(quotes.replies(given)))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(table(spark, folder, "documents"), tokenizer)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json")]
    return alignment.align(table(spark, folder, "documents"), *files)


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(table(spark, folder, "conversations"))

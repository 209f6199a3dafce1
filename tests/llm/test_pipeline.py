"""The pipeline and the registered queries."""

import os
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flowsieve.llm import decontaminate, language
from tests.llm.test_dedup import lowered, plain_fingerprint
from tests.llm.test_text_models import MODEL, WORDS

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string"


def corpus():
    rng = random.Random(17)
    rows = []
    for k in range(120):
        lang = ["en", "de", "fr"][k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefg") * rng.randint(0, 2) for _ in range(rng.randint(30, 120))), lang))
    rows += [(200, rows[0][1].upper(), "en"), (201, rows[1][1], None), (201, rows[1][1], None), (202, "12 34", "en"), (203, None, "de"), (None, "the of and to in that", "en")]
    near = rows[6][1].split()
    rows.append((204, " ".join(near[:-1] + ["other"]), "en"))
    item = " ".join(rng.choice(WORDS["fr"]) + "zq" for _ in range(20))
    rows.append((205, rows[9][1] + " " + item.upper() + "  " + rows[12][1][:60], "fr"))
    return [(*r, "s", 1, "clash") for r in rows], [(1, item), (2, None)]


def stages_by_hand(spark, rows, items, path):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs, F.lit(True))
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "") and not model.decode(language.features(r[1]))[2]]
    best = {}
    for r in rows:
        key = lowered(r[1])
        if key not in best or (best[key][0] is None) or (r[0] is not None and r[0] > best[key][0]):
            best[key] = r
    rows = list(best.values())
    fps = [plain_fingerprint(r[1], 3) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    first = {}
    for g, r in zip(group, rows):
        first.setdefault(g, []).append(r)
    rows = [min(some, key=lambda r: (r[0] is None, r[0])) for some in first.values()]
    matcher = decontaminate.Matcher([i for i in items if i[1]], decontaminate.RATE)
    rows = [r for r in rows if not matcher.matches(r[1])]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return Counter((str(r[0]), " ".join(map(str, [*sp.encode(r[1]), 2]))) for r in rows)


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((str(r.doc_id), r.ids_text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == stages_by_hand(spark, rows, items, tmp_path)
    ids = {i for i, _ in got}
    assert {"0", "1", "202", "203", "205"} & ids == set() and {"200", "201"} <= ids and not {"6", "204"} <= ids


def test_empty_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_tables
def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.count() > 0.5 * docs.count(), name


@needs_tables
@pytest.mark.parametrize("number", range(1, 14))
def test_one_row_for_each_input_row(spark, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    table = "conversations" if number in (10, 13) else "documents"
    key = "conv_id" if number in (10, 13) else "doc_id"
    got = entry.queries()[name](spark, FOLDER)
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    if number == 10:
        got = got.where("turn < 1000000")
    if number == 11:
        got = got.where("piece = 0")
    if number == 13:
        want = want.select(key).distinct()
    assert Counter(r[0] for r in got.select(key).collect()) == Counter(r[0] for r in want.select(key).collect())

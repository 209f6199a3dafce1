"""Language codes, SentencePiece backtracking and compression scores."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from flowsieve.llm import language, pieces, quality
from flowsieve.llm.common import bucket_of
from tests.llm.test_dedup import frame, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {
    "en": "the of and to in that was with for this from have not are they".split(),
    "de": "der die und nicht mit für über eine auch werden zu größe schön ist".split(),
    "fr": "le la les été avec pour dans être où ça qui que une français très".split(),
    "tr": "ve bir bu için çok değil daha güzel şey ile olarak ığdır gibi".split(),
}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return pieces.Codec(f.read())


def hostile_texts():
    rng = random.Random(11)
    out = ["", " ", "  ", "a", " a  b   c ", "\n\n\t x\r\n", "▁", "▁▁a ▁b", "日本語テキスト", "😀😀 a😀b", "<s> </s> <0x0A> <unk>", "ﬁ é é", "a\u0000b", "　x y"]
    out += ["a" * n for n in (2, 3, 5, 17, 64, 1000)] + [" " * n for n in (3, 15, 16, 17, 40, 333)]
    out += ["".join(rng.choice("abtheior nsAÉ .\n▁1") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    out += ["".join(rng.choice(["th", "er", "tion", "  ", " ", "ou", "ing", "$$$", "###", "0", "é", "中"]) for _ in range(300)) for _ in range(60)]
    out += ["".join(chr(rng.randint(32, 0x2FFF)) for _ in range(80)) for _ in range(60)]
    return out


def test_backtracking_equals_library(codec, library):
    for text in hostile_texts():
        assert codec.encode(text).tolist() == [*library.encode(text), library.eos_id()], repr(text)


def test_backtracking_equals_merging_on_small_vocabularies():
    rng = random.Random(2)
    for _ in range(150):
        vocabulary = {c: 0.0 for c in "abc"}
        for _ in range(rng.randint(1, 14)):
            vocabulary["".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))] = -float(rng.randint(1, 6))
        encoder = pieces.MergeEncoder({p: k for k, p in enumerate(vocabulary)}, vocabulary)
        for _ in range(40):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
            assert [encoder.names[t] for t in encoder.encode(text)] == encoder.merged(text), (vocabulary, text)


def test_side_by_side_equals_merging_on_small_vocabularies():
    """Scores with ties, strange characters, empty texts and repeated texts; pairs answered from slots and anew."""
    rng = random.Random(5)
    for _ in range(150):
        vocabulary = {c: 0.0 for c in "abc"}
        for _ in range(rng.randint(0, 14)):
            vocabulary["".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))] = -float(rng.randint(1, 6))
        encoder = pieces.MergeEncoder({p: k for k, p in enumerate(vocabulary)}, vocabulary)
        for _ in range(2):
            texts = ["".join(rng.choice("abcabcabcabcd") for _ in range(rng.randint(0, 14))) for _ in range(40)]
            tokens, counts, left_out = encoder.encode_all(texts)
            assert left_out == [k for k, t in enumerate(texts) if not t or "d" in t] and len(tokens) == counts.sum()
            ends = np.cumsum(counts)
            for k, (text, n, end) in enumerate(zip(texts, counts, ends, strict=True)):
                assert k in left_out or [encoder.names[t] for t in tokens[end - n : end]] == encoder.merged(text), (vocabulary, text)


def test_words_are_encoded_once_whatever_stands_beside_them(codec, library):
    """No piece joins letters to marks, digits or line breaks, so a word is remembered without them."""
    assert codec.cuts.findall("▁thes.\nIt▁▁(12,▁") == ["▁thes", ".", "\n", "It", "▁▁(", "1", "2", ",", "▁"]
    texts = [f"zyxwordly{mark} Zyxwordly{mark}x" for mark in (".", ",", "\n", ";", "!?", "7", "中", "。")]
    before = len(codec.seen)
    assert [ids.tolist() for ids in codec.encode_texts(texts)] == [[*library.encode(t), library.eos_id()] for t in texts]
    assert sum("yxwordly" in cut for cut in codec.seen) == 2 and len(codec.seen) - before < 16


def test_many_texts_at_once(library, monkeypatch):
    """Portions, groups of cuts and forgetting change no id."""
    monkeypatch.setattr(pieces, "PORTION", 500)
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", 7)
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    with open(MODEL, "rb") as f:
        codec = pieces.Codec(f.read())
    texts = [*hostile_texts(), "word " * 2000, "x" * 5000 + "中" * 50]
    got = [ids.tolist() for some in pieces._portions(texts) for ids in codec.encode_texts(some)]
    assert got == [[*library.encode(t), library.eos_id()] for t in texts]


def test_round_trip_in_spark(spark, library):
    texts = [None, *hostile_texts()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x"), (3, "a"), (3, "a")]
    got = pieces.decode(pieces.encode(frame(spark, rows), MODEL), MODEL).collect()
    want = sorted((str(i), [*library.encode(t or ""), 2], library.decode(library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
    both = pieces.encode(frame(spark, rows), MODEL, outputs=("ids_text", "decoded")).collect()
    assert sorted((str(r.doc_id), [int(x) for x in r.ids_text.split()], r.decoded) for r in both) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert pieces.encode(frame(spark, rows).where("doc_id < 0"), MODEL).count() == 0


def labelled(spark, langs, n=160):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        lang = langs[k % len(langs)]
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 80)))
        rows.append((k, text.upper() if k % 7 == 0 else text, lang if k % 9 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 $$$", "en"), (None, "the of and to in that", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("uid", F.lit("clash"))


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "de", "fr", "tr"]])
def test_language_held_out(spark, langs):
    docs = labelled(spark, langs)
    model = language.fit(docs, bucket_of(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1002].score == 0
    wrong = [k for k in range(160) if got[k].lang_pred != langs[k % len(langs)]]
    assert not wrong and all(0 <= r.score <= 1 for r in got.values())
    assert got[None].lang_pred == "en"


def plain_grams(text):
    """Hashed n-gram counts, one gram at a time."""
    letters = [c if 97 <= c < 123 or c >= 128 else 32 for c in text.lower().encode()]
    letters = [c for k, c in enumerate(letters) if c != 32 or k == 0 or letters[k - 1] != 32]
    counts = np.zeros(language.BUCKETS)
    for order in language.ORDERS:
        for k in range(len(letters) - order + 1):
            h = 0
            for n, c in enumerate(letters[k : k + order], 1):
                h = (h * 0x01000193 + c + n) % (1 << 32)
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
            counts[h >> 19] += 1
    return np.sqrt(counts) / max(1e-12, math.sqrt(counts.sum()))


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "tr"]])
def test_language_by_hand(spark, langs):
    """Fit and decoding, worked out text by text: masses, bits, their spread and trust, then every codeword's loss."""
    docs = labelled(spark, langs, 60)
    model = language.fit(docs, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    rows = docs.collect()
    train = [(r.lang, plain_grams(r.text)) for r in rows if r.lang and r.doc_id is not None and r.doc_id % 4 and r.text and any(c.isalpha() for c in r.text)]
    names = sorted({lang for lang, _ in train})
    mass = np.array([sum(x for lang, x in train if lang == name) for name in names])
    mass /= mass.sum(axis=1, keepdims=True)
    code = language.codewords(len(names))
    floor = 0.01 / language.BUCKETS
    weights = np.stack([np.log((mass[c > 0].mean(0) + floor) / (mass[c < 0].mean(0) + floor)) for c in code.T], 1)
    answers = [np.array([x @ weights for lang, x in train if lang == name]) for name in names]
    mean, spread = np.array([a.mean(0) for a in answers]), np.array([a.std(0) for a in answers])
    spread = np.sqrt(np.maximum(spread**2, 1e-6))
    middle, slope = np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for j, bits in enumerate(code.T):
        yes, no = mean[bits > 0, j].mean(), mean[bits < 0, j].mean()
        middle[j], slope[j] = (yes + no) / 2, max(yes - no, 1e-9) / (spread[:, j] ** 2).mean()
    right = np.array([[0.5 * (1 + math.erf(code[a, j] * (mean[a, j] - middle[j]) / spread[a, j] / math.sqrt(2))) for j in range(code.shape[1])] for a in range(len(names))])
    trust = right / right.sum(axis=1, keepdims=True)
    assert names == model.languages and np.allclose(model.middle, middle, atol=1e-3) and np.allclose(model.trust, trust, atol=1e-3)
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            bits = (plain_grams(r.text) @ weights - middle) * slope
            loss = [sum(t * math.log1p(math.exp(-c * b)) if -c * b < 50 else t * -c * b for t, c, b in zip(trust[a], code[a], bits)) for a in range(len(names))]
            belief = [math.exp(min(loss) - x) for x in loss]
            assert got[r.doc_id].lang_pred == names[loss.index(min(loss))]
            assert got[r.doc_id].score == pytest.approx(max(belief) / sum(belief), abs=5e-3)


def test_language_without_labels(spark):
    docs = labelled(spark, ["en", "de"]).withColumn("lang", F.lit(None).cast("string"))
    model = language.fit(docs, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}
    assert language.predict(docs.where("doc_id < 0"), model).count() == 0


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 7, 12, 30])
def test_codewords(count):
    code = language.codewords(count)
    assert len({tuple(r) for r in code.tolist()}) == count
    assert (np.abs(code.sum(axis=0)) < count).all()
    gap = min((code[a] != code[b]).sum() for a in range(count) for b in range(a))
    assert gap >= (2 ** (count - 2) if count <= 6 else 5)  # so (gap - 1) // 2 wrong bits are corrected


def test_long_text_counts_once():
    text = "the größe " * 150_000
    assert np.allclose(language.features(text), language.features("the größe " * 1000), atol=2e-3)


def test_quality_held_out(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(400):
        bad = k % 3 == 0
        text = prose(rng, rng.randint(40, 200)) if not bad else " ".join(w + rng.choice(["###", "$$$", " |"]) for w in prose(rng, 90).split())
        rows.append((k, text))
        marks.append((k, int(not bad), "noise"))
    marks += [(1, 0, "contradicts"), (5000, 1, "no such row"), (7, None, "null"), (8, 5, "odd"), (None, 1, "null id")]
    rows += [(900, None), (901, ""), (902, "x" * 300_000), (None, "abc"), (2, rows[2][1])]
    docs = frame(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text string")
    got = [(r.doc_id, r.score) for r in quality.quality_scores(docs, labels, bucket_of(F.col("id"), 4) != 2).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    right = [(s >= 0.7) == (i % 3 != 0) for i, s in got if i is not None and i < 400]
    assert sum(right) / len(right) > 0.97
    assert len({s for i, s in got if i in (900, 901)}) == 1


def test_quality_by_hand(spark):
    """Sizes piece by piece under the two dictionaries, and the curve by plain gradient steps over the marked rows."""
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.randint(30, 700)) if k % 3 else " ".join(w + " ##" for w in prose(rng, 60).split())) for k in range(300)]
    rows += [(None, "x y"), (400, ""), (401, None)]
    marked = spark.createDataFrame([(k, int(bool(k % 3)) if k % 10 else 1 - int(bool(k % 3))) for k in range(300)], "doc_id long, quality int")
    docs, train = frame(spark, rows), F.col("id") % 4 != 2
    got = [(r.doc_id, r.difference, r.score) for r in quality.quality_scores(docs, marked, train).collect()]
    labels = quality.marks(marked, train)
    pair = quality.dictionaries(docs, labels)

    def size(content, raw):
        total = 0
        for at in range(0, max(1, len(raw)), quality.PIECE):
            d = zstandard.ZstdCompressionDict(content)
            packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            total += len(packer.compress(raw[at : at + quality.PIECE]))
        return total

    plain = {}
    for i, t in rows:
        good, bad = (size(c, (t or "").encode()) for c in pair)
        plain[i] = (bad - good) / (bad + good)
    assert all(d == pytest.approx(plain[i], abs=1e-12) for i, d, _ in got)
    unseen = {r.id: r.label for r in labels.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).collect()}
    x, y = np.array([plain[i] for i in unseen]), np.array(list(unseen.values()), float)
    scale = np.sqrt((x**2).mean())
    a = b = 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(a * x / scale + b)))
        a += 0.02 * ((y - p) @ x / scale - 0.01 * a)
        b += 0.02 * ((y - p).sum() - 0.01 * b)
    for i, d, score in got:
        assert score == pytest.approx(1 / (1 + math.exp(-(a * d / scale + b))), abs=0.01)


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score == 1.0 for r in quality.quality_scores(docs, one, F.lit(True)).collect())
    assert quality.quality_scores(docs.where("doc_id > 9"), one, F.lit(True)).count() == 0

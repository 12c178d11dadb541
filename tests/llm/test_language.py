"""Language spans: Viterbi against every path, scripts, mixed texts, odd rows, held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import language

TRAIN = {
    "en": "the quick brown fox jumps over the lazy dog and then with this that there which would have been under every other word",
    "de": "der schnelle braune fuchs springt über den faulen hund und nicht auch eine schöne zeit während die straße noch nass ist",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом она бежит домой по длинной дороге",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά γυρίζει στο σπίτι",
    "ja": "速い茶色の狐がのろまな犬を飛び越えるそして家に帰るのです",
    "zh": "快速的棕色狐狸跳过懒狗然后回家这是一个很长的故事我们都知道",
}


def documents(spark, extra=()):
    draw = random.Random(2)
    rows, number = [], 0
    for lang, text in TRAIN.items():
        for _ in range(12):
            words = text.split()
            draw.shuffle(words)
            rows.append((number, " ".join(words), lang))
            number += 1
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(documents(spark))


def cost(score, path, switch):
    return sum(score[k, x] for k, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("seed", range(40))
def test_path_is_the_best_of_all(seed):
    draw = np.random.default_rng(seed)
    scores = [-draw.exponential(draw.choice([0.2, 2, 6]), (n, 3)) for n in draw.integers(0, 8, 6)]
    for score, label in zip(scores, language.viterbi(scores, 2.5), strict=True):
        if len(score):
            best = max(cost(score, p, 2.5) for p in itertools.product(range(3), repeat=len(score)))
            assert cost(score, label.tolist(), 2.5) == pytest.approx(best)


def test_a_text_that_no_excursion_improves_is_labelled_at_once(monkeypatch):
    draw = np.random.default_rng(0)
    scores = [-draw.exponential(1.5, (30, 4)) for _ in range(60)]
    quick = language.viterbi(scores, 6.0)
    monkeypatch.setattr(language, "excursion", lambda score, single: np.inf)
    for score, a, b in zip(scores, quick, language.viterbi(scores, 6.0), strict=True):
        assert cost(score, a.tolist(), 6.0) == pytest.approx(cost(score, b.tolist(), 6.0))


def test_spans_of_a_mixed_text(model):
    parts = [("en", TRAIN["en"]), ("de", TRAIN["de"]), ("ru", TRAIN["ru"]), ("en", TRAIN["en"])]
    text = " -- ".join(x for _, x in parts)
    spans, lang, score = language.read_texts([text], model)[0]
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in spans] == parts
    assert lang == "en" and 0.3 < score < 0.7


def test_a_borrowed_word_is_no_span_and_scripts_narrow(model):
    spans, lang, _ = language.read_texts(["the quick brown fox schnelle jumps over the lazy dog"], model)[0]
    assert lang == "en" and len(spans) == 1
    latin, cyrillic, han = (language.SCRIPTS.index(x) for x in ("Latin", "Cyrillic", "Han"))
    named = lambda script: {x for x, on in zip(model.languages, model.uses[script], strict=True) if on}
    assert named(latin) == {"en", "de"} and named(cyrillic) == {"ru"} and named(han) == {"zh", "ja"}
    assert [x[1] for x in language.read_texts(["懒狗回家", "собаку", "犬を飛び越える", "σκυλί", "ΣΚΥΛΊ"], model)] == ["zh", "ru", "ja", "el", "el"]


def test_words_of_texts():
    found = language.words(["Ab1 cd", "", "é! привет", "éx", "́"])
    assert list(zip(found.text.tolist(), found.start.tolist(), found.end.tolist(), found.letters.tolist(), strict=True)) == [(0, 0, 2, 2), (0, 4, 6, 2), (2, 0, 1, 1), (2, 3, 9, 6), (3, 0, 3, 2)]
    grams, of = found.grams(2)
    assert np.bincount(of).tolist() == [3, 3, 2, 7, 4] and len(grams) == 19
    assert len(language.words([]).text) == 0 and len(language.words(["", "12"]).text) == 0


def test_long_texts_are_read_whole(model, monkeypatch):
    text = (TRAIN["en"] + " ") * 40 + (TRAIN["de"] + " ") * 60
    whole = language.read_texts([text, "x"], model)
    monkeypatch.setattr(language, "PIECE", 97)
    assert language.read_texts([text, "x"], model) == whole
    assert whole[0][1] == "de" and [s["lang"] for s in whole[0][0]] == ["en", "de"]


def test_portions_hold_every_text_once():
    for texts in ([], ["a"], ["aaaa", "b", "cc", "ddddd", "e"], ["", ""], ["x" * 9]):
        parts = list(language.portions(texts, 4))
        assert [x for part in parts for x in part] == texts
        assert all(len(part) == 1 or sum(map(len, part)) <= 4 for part in parts)


def test_odd_rows(spark):
    extra = [(900, None, "en"), (901, "", None), (902, "123 !?", "en"), (903, "the dog", None), (903, "the dog", None), (None, "der hund", "de"), (904, "ગુજરાતી", None), (905, "the " * 50000, None)]
    got = {}
    for r in language.language_id(documents(spark, extra).withColumn("spans", F.lit("clash"))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[k][0]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert [got[k][0]["score"] for k in (900, 901, 902)] == [0.0] * 3
    assert len(got[903]) == 2 and got[903][0]["lang_pred"] == got[905][0]["lang_pred"] == "en"
    assert got[None][0]["held_out"] is False and got[None][0]["lang_pred"] == "de"
    assert got[904][0]["lang_pred"] in TRAIN
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, rs in got.items() if k is not None for r in rs)


def test_nothing_learned_and_nothing_at_all(spark):
    none = spark.createDataFrame([(1, "the dog", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.language_id(none).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert language.language_id(none.limit(0)).collect() == []


def test_labels_of_held_out_rows_are_not_read(spark):
    held = [k for k in range(5000, 5400) if zlib.crc32(str(k).encode()) % 4 == 2]
    lies = [(k, "the quick brown fox", "xx") for k in held]
    assert "xx" not in language.fit(documents(spark, lies)).languages


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_id(table.select("doc_id", "text", "lang")).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.98

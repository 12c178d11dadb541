import random

import pytest

WORDS = ["the", "of", "sat", "river", "quiet", "élan", "Straße", "naïve", "über", "cat", "dog", "hill", "moon", "salt", "reed", "oak"]


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, repeats within a text, null, empty, short and long texts."""
    draw = random.Random(3)
    base = [sentence(draw, draw.choice([3, 30, 120, 300])) for _ in range(24)]
    passage = sentence(draw, 70)
    rows = [(10 * k, t) for k, t in enumerate(base)]
    rows += [(1000 + k, base[k]) for k in range(6)]
    for k in range(6, 12):
        words = base[k].split()
        if len(words) > 60:
            words[50] = "changed"
        rows.append((1100 + k, " ".join(words)))
    rows += [(1200 + k, base[k + 12] + " " + passage + "\n" + base[k]) for k in range(5)]
    rows += [(2000, passage + " x " + passage), (2001, "ab" * 300), (2002, "the " * 200), (2003, None), (2004, ""), (2005, "  \t\n"), (2006, "one two"), (2007, "one two"), (2008, sentence(draw, 9000))]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With columns that clash with names used inside the operators."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    for name in ("key", "doc", "shard", "lo", "hi", "score", "component", "side", "rank", "class", "n", "word"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")

from lodeframe.llm import jaccard, phrase_dedup

WORDS = [f"w{k}" for k in range(60)]
COPY, CLEAN = " ".join(WORDS), " ".join(f"z{k}" for k in range(70))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)


def test_first_of_each_judges_every_row(spark):
    rows = [(3, COPY, "a"), (7, COPY, "b"), (7, CLEAN, "c"), (8, "one two", "d"), (8, "one two", "d"), (None, COPY, "e"), (None, "other words here", "f"), (None, None, "g")]
    kept = jaccard.first_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "tag"]
    assert sorted(r.tag for r in kept.collect()) == ["a", "c", "d", "f", "g"]


def test_deduplicated_cuts_the_row_that_repeats(spark):
    before, after = " ".join(f"m{k}" for k in range(8)), " ".join(f"n{k}" for k in range(9))
    rows = [(3, COPY, "a"), (7, f"{before} {COPY} {after}", "b"), (7, CLEAN, "c"), (7, CLEAN, "c"), (None, f"{COPY} tail", "e")]
    made = phrase_dedup.deduplicated(frame(spark, rows))
    assert made.columns == ["doc_id", "text", "tag"]
    assert sorted((r.tag, r.text) for r in made.collect()) == [("a", COPY), ("b", f"{before} {after}"), ("c", CLEAN), ("e", "tail")]

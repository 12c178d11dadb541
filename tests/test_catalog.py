"""Pattern files: what is wrong with them, all of them rescored, scores that are stale."""

import pytest
from pyspark.sql import functions as F

from lodeframe.plans import catalog, pattern

GOOD = "name: {}\nproperty_type: CHINTAI\nmust: {{rent_total_max: 100}}\nwant: {{numeric: [{{metric: rent_total, weight: 1, best: 0, worst: {}}}], features: [{{code: A, weight: 2}}]}}\n"


def test_files_are_loaded_by_name_or_say_what_is_wrong(tmp_path):
    (tmp_path / "2.yaml").write_text(GOOD.format("q", 100))
    (tmp_path / "1.yaml").write_text(GOOD.format("p", 200))
    (tmp_path / "notes.txt").write_text("no pattern")
    loaded = catalog.load(str(tmp_path))
    assert [p.name for p in loaded] == ["p", "q"]
    assert catalog.faults(loaded, {"CHINTAI": {"A"}}) == {} and catalog.faults(loaded, {}) == {"p": ["A"], "q": ["A"]}
    for body, message in ((GOOD.format("p", 1), "p is there already"), ("- a\n", "no mapping"), ("name: x\nproperty_type: BOAT\n", "BOAT"), ("name: x\ncolour: red\n", "unknown keys"), ("name: x\nproperty_type: CHINTAI\nwant: {features: [{code: A}]}\n", "weight")):
        (tmp_path / "3.yaml").write_text(body)
        with pytest.raises(pattern.PatternError, match=f"3.yaml: .*{message}"):
            catalog.load(str(tmp_path))
    with pytest.raises(pattern.PatternError, match="no patterns"):
        catalog.load(str(tmp_path / "none"))


def test_all_patterns_are_rescored_and_stale_scores_named(spark, tmp_path):
    (tmp_path / "1.yaml").write_text(GOOD.format("p", 200))
    (tmp_path / "2.yaml").write_text(GOOD.format("q", 100))
    loaded = catalog.load(str(tmp_path))
    offers = spark.range(1, 5).select(
        F.col("id").alias("listing_id"), F.lit(1).alias("site_id"), F.lit("active").alias("status"), (F.col("id") * 40).alias("price"), (F.col("id") * 40).alias("rent_total"), F.lit("CHINTAI").alias("property_family"), F.lit(1).alias("site_priority"), F.lit(0).alias("feature_count"),
        F.array(F.lit("A")).alias("feature_codes"), F.lit(True).alias("detail_fetched"), F.when(F.col("id") < 3, "home").alias("dedup_key"), F.lit("1K").alias("layout"),
    )
    scores = catalog.rescored(offers, loaded)
    got = {(r["pattern"], r["listing_id"]): (r["must"], r["rank"]) for r in scores.collect()}
    assert got == {("p", 1): ("pass", 1), ("p", 3): ("fail", None), ("p", 4): ("fail", None), ("q", 1): ("pass", 1), ("q", 3): ("fail", None), ("q", 4): ("fail", None)}
    assert catalog.stale(scores, loaded).collect() == []
    (tmp_path / "2.yaml").write_text(GOOD.format("q", 150))
    (tmp_path / "1.yaml").unlink()
    assert {tuple(r) for r in catalog.stale(scores, catalog.load(str(tmp_path))).collect()} == {("p", 3, "gone"), ("q", 3, "changed")}

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import numbers, text


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


CASES = [
    (lambda c: text.yen(text.nfkc(c)), ["3.5万円", "1億2,800万円", "25000円", "１４．３万円", "5,000万円～7,000万円", "価格未定", None, "2億円", "1万2,500円"], [35000, 128000000, 25000, 143000, 50000000, None, None, 200000000, 12500]),
    (lambda c: text.fee(text.nfkc(c)), ["-", "なし", "", "３，０００円", None, "--", "0円", "5千"], [0, 0, 0, 3000, None, 0, 0, None]),
    (lambda c: text.area(text.nfkc(c)), ["18m2", "42.5m²", "42.9㎡", "1,200.5㎡", "x", None], [18.0, 42.5, 42.9, 1200.5, None, None]),
    (text.age, ["築40年", "新築", "築 5 年", "中古", None], [40, 0, 5, None, None]),
    (text.walk, ["歩50分 / 歩 7分", "徒歩12分", "バス5分", None], [7, 12, None, None]),
    (text.floor, ["3階", "地下1階", "2-3階", "平屋", None], [3, -1, 3, None, None]),
    (text.total_floors, ["2階建", "1階/2階建", "地上13階地下1階建", "3階", None], [2, 2, 13, None, None]),
    (text.built_on, ["1987年1月", "2024年12月築", "1999年", "1987年13月", "1700年1月", None], [dt.date(1987, 1, 1), dt.date(2024, 12, 1), dt.date(1999, 1, 1), None, None, None]),
    (text.layout, ["1ldk", "１ＬＤＫ".replace("１", "1"), "ワンルーム", "1SLDK", "2LDK+S（納戸）", "1LDK～3LDK", "", None], ["1LDK", "1LDK", "1R", "1LDK", "2LDK", "1LDK～3LDK", None, None]),
    (text.address_cleaned, ["東京都1-2地図を見る", "地図を見る", "千葉23-2周辺地図 千葉の行政データ", None], ["東京都1-2", "地図を見る", "千葉23-2", None]),
    (text.minutes, ["43分", "1時間25分", "9時間31分", "x", None], [43, 85, 571, None, None]),
    (text.normalized, ["ＡＢＣ　　Ｄ", None, "  x "], ["abc d", "", "x"]),
    (text.tokens, ["a, b／(c)、a;;", ""], [["a", "b", "c"], []]),
    (text.recordable, ["ab", "a", "12-3", "x" * 41, "éà"], [True, False, False, False, True]),
    (text.safe_link, ["https://a.b/c", "javascript:x", "http://", None], ["https://a.b/c", None, None, None]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_text(spark, case):
    expression, given, expected = CASES[case]
    assert values(spark, given, expression) == expected


def test_months_fee_and_years(spark):
    assert values(spark, ["1.5ヶ月", "なし", "3000円", None], lambda c: text.months_fee(text.nfkc(c), F.lit(50000))) == [75000, 0, 3000, None]
    today = F.lit("2026-09-06").cast("date")
    assert values(spark, ["1987年1月", "2026年10月", "2025年10月", None], lambda c: text.full_years(text.built_on(c), today)) == [39, 0, 0, None]


def test_memo(spark):
    assert values(spark, ["a\r\nb\x07", None], text.memo) == ["a\nb", None]
    with pytest.raises(Exception, match="memo too long"):
        values(spark, ["x" * 11], lambda c: text.memo(c, 10))


def test_costs_and_scores(spark):
    rows = spark.createDataFrame([(100, None), (None, 5), (None, None), (100, 5)], "a int, b int")
    made = rows.select(numbers.rent_total(F.col("a"), F.col("b")).alias("r"), numbers.monthly_cost(F.col("a"), F.col("b")).alias("m"), numbers.ratio(F.col("a"), F.lit(0)).alias("z")).collect()
    assert [tuple(r) for r in made] == [(100, 100, None), (None, 5, None), (None, None, None), (105, 105, None)]
    assert values(spark, [10.0, 20.0, 30.0, 0.0, None], lambda c: numbers.share_of_range(c, 10, 30), "double")[:4] == [1.0, 0.5, 0.0, 1.0]
    with pytest.raises(ValueError, match="differ"):
        numbers.share_of_range(F.lit(1), 2, 2)


def test_loan(spark):
    assert values(spark, [35_000_000, 0, None], numbers.loan_payment, "long") == [90855, None, None]
    assert values(spark, [4200], lambda c: numbers.loan_payment(c, 0.0, 35), "long") == [10]


def test_energy(spark):
    assert values(spark, [0.0, 10.0, 20.0, 30.0, 300.0], lambda c: F.round(numbers.city_gas_bill(c), 2), "double") == [0.0, 2610.3, 4461.6, 6164.4, 51656.0]
    assert values(spark, [5.0, 10.0, 15.0, 50.0, 60.0], lambda c: F.round(numbers.lpg_bill(c), 1), "double") == [5960.0, 9736.0, 13240.0, 35790.0, 42138.7]
    rows = spark.createDataFrame([(["GAS_CITY"],), (["GAS_LPG", "GAS_CITY"],), (["ALL_ELECTRIC"],), ([],), (["GAS_LPG", "STOVE_IH"],)], "codes array<string>")
    made = [r.u for r in rows.select(numbers.estimated_utility(F.col("codes"), 1, 0.25).alias("u")).collect()]
    assert [(u.gas, u.gas_basis, u.stove, u.stove_basis) for u in made] == [
        ("city", "listing", "gas", "assumed"), ("unknown", "conflict", "gas", "assumed"), ("electric", "listing", "ih", "assumed"), ("unknown", "prior", "gas", "assumed"), ("lpg", "listing", "ih", "listing"),
    ]
    assert made[1].yen == made[3].yen and abs(made[3].yen - (0.25 * made[3].lpg_yen + 0.75 * made[3].city_yen)) <= 1
    assert made[2].city_yen is None


def test_distance(spark):
    assert values(spark, [139.022], lambda c: F.round(numbers.haversine_km(F.lit(35.7), F.lit(139.0), F.lit(35.7), c), 3), "double") == [1.987]
    assert values(spark, [0.0], lambda c: numbers.commute_estimate(c, F.lit(0), F.lit(True)), "double") == [0]
    assert values(spark, [10.0], lambda c: numbers.commute_estimate(c, F.lit(1), F.lit(False)), "double") == [26]
    assert values(spark, [35.68], lambda c: numbers.tile(c, F.lit(139.77), 10), "double")[0].asDict() == {"x": 909, "y": 403}

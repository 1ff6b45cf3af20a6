from pyspark.sql import functions as F

from cardloom.functions import numeric, text


def one(spark, column, **values):
    kinds = {int: "long", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_reverse_scores(spark):
    from cardloom.operators.scoring import annual_fee_score, performance_score

    for fee, score in ((0, 100), (15_000, 70), (49_999, 1), (50_000, 0), (50_001, 0), (2_000_000_000, 0)):
        assert one(spark, annual_fee_score(F.col("x")), x=fee) == score
    for need, score in ((0, 100), (300_000, 70), (1_000_000, 0)):
        assert one(spark, performance_score(F.col("x")), x=need) == score


def test_percent_difference(spark):
    for a, b, d in ((0, 0, 0), (5, 0, 100), (5, 10, -50), (39, 40, -2), (41, 40, 3)):
        assert one(spark, numeric.percent_difference(F.col("a"), F.col("b")), a=a, b=b) == d


def test_percent_of_nothing_is_null(spark):
    assert one(spark, numeric.percent(F.col("a"), F.col("b")), a=5, b=0) is None
    assert one(spark, numeric.percent(F.col("a"), F.col("b")), a=1, b=200) == 1


def test_labels(spark):
    assert one(spark, numeric.manwon_label(F.col("x")), x=25_000) == "3만원"
    assert one(spark, numeric.manwon_label(F.col("x"), 1), x=25_500) == "2.6만원"
    assert one(spark, numeric.won_label(F.col("x")), x=1_234_567) == "1,234,567원"
    assert one(spark, numeric.won_label(F.col("x")), x=0) == "무료"
    assert one(spark, numeric.performance_label(F.col("x")), x=305_000) == "30.5만원"


def test_phone_and_selection(spark):
    for raw, shown in (("01012345678", "010-1234-5678"), ("0101234", "010-1234"), ("010", "010"), ("+82 10", "821-0"), ("", "")):
        assert one(spark, text.format_phone(F.col("x")), x=raw) == shown
    assert one(spark, text.parse_selection(F.col("x")), x=" a+b ,%EC%B9%B4,,　c　") == ["a+b", "카", "c"]
    assert one(spark, text.summary_items(F.col("x")), x=" a / /b") == ["a", "b"]
    assert one(spark, text.summary_items(F.col("x")), x=None) == []
    assert one(spark, text.drop_suffix_once(F.col("x")), x="국민카드카드") == "국민카드"
    assert one(spark, text.last_word(F.col("x")), x="a b c") == "c"

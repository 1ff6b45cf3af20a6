"""Small dimension tables. Each has a fixed number of rows, so joins may broadcast it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 21 benefit categories, in the order of their ids 1 to 21.
CATEGORIES = (
    "온라인쇼핑", "패션/뷰티", "슈퍼마켓/생활잡화", "백화점/아울렛", "대중교통/택시", "자동차/주유", "반려동물",
    "구독/스트리밍", "레저/스포츠", "페이/간편결제", "문화/엔터", "생활비", "편의점", "커피/카페/베이커리",
    "배달", "외식", "여행/숙박", "항공", "해외", "교육/육아", "의료",
)

# For each persona the categories that weigh 0.25 and those that weigh 0.10; all others weigh 0.0125.
PERSONAS = {
    "STUDENT": ((20, 5), (13, 14, 15)),
    "SINGLE": ((15, 13), (1, 10, 8)),
    "WORKER": ((6, 16), (1, 19, 12)),
    "FAMILY": ((20, 3), (21, 12, 6)),
    "SENIOR": ((21, 3), (12, 16, 5)),
}
HIGH_WEIGHT, MIDDLE_WEIGHT, LOW_WEIGHT = 2500, 1000, 125  # ten-thousandths
UNKNOWN_PERSONA, DEFAULT_PERSONA = "SINGLE", "STUDENT"

# Keywords that a category looks for in a card's summary.
CATEGORY_KEYWORDS = {
    "온라인쇼핑": ("쇼핑",), "패션/뷰티": ("쇼핑", "뷰티"), "슈퍼마켓/생활잡화": ("마트",), "백화점/아울렛": ("마트", "쇼핑"),
    "대중교통/택시": ("교통",), "자동차/주유": ("주유",), "반려동물": (), "구독/스트리밍": (), "레저/스포츠": (),
    "페이/간편결제": (), "문화/엔터": ("영화",), "생활비": ("통신",), "편의점": ("편의점",), "커피/카페/베이커리": ("카페",),
    "배달": ("배달",), "외식": ("외식",), "여행/숙박": ("여행",), "항공": ("항공",), "해외": ("해외",), "교육/육아": (),
    "의료": ("의료", "병원", "약국"),
}

# Benefit categories that each spending category matches.
SPENDING_MATCH = {
    "온라인 쇼핑": ("온라인 쇼핑", "쇼핑", "간편결제"),
    "식당/외식": ("외식", "식당/외식"),
    "마트/편의점": ("편의점", "마트", "마트/편의점"),
    "배달앱": ("배달앱",),
    "카페": ("카페",),
    "대중교통": ("대중교통",),
    "통신비": ("통신비",),
    "구독서비스": ("구독 서비스",),
    "주유": ("주유",),
}

# Issuers with their short name.
ISSUERS = (
    ("삼성카드", "삼성"), ("신한카드", "신한"), ("현대카드", "현대"), ("KB국민카드", "국민"),
    ("NH농협카드", "농협"), ("우리카드", "우리"), ("하나카드", "하나"), ("롯데카드", "롯데"),
)

# Fee bands, inclusive at both ends, and caps of the required monthly spending.
FEE_BANDS = {"전체": (0, 999_999), "~1만원": (1, 10_000), "~3만원": (1, 30_000), "~10만원": (1, 100_000), "10만원~": (100_001, 999_999)}
PERFORMANCE_CAPS = {"전체": 9_999_999, "~30만원": 300_000, "~50만원": 500_000}

# Labels of benefit kinds in the comparison and in the ranking, and known networks.
KIND_LABELS = {"comparison": {"discount": "할인", "cashback": "캐시백", "point": "적립", "special": "특별"}, "ranking": {"cashback": "캐시백", "point": "적립"}}
RANKING_DEFAULT_KIND = "할인"
NO_CONDITION = "제한없음"
NETWORKS = ("VISA", "Mastercard", "BC", "신한")
CARD_TYPES = {"신용": "credit", "체크": "debit"}


def persona_weights(spark: SparkSession) -> DataFrame:
    """``persona, category_id, weight`` in ten-thousandths: 5 x 21 rows."""
    rows = [(p, c, HIGH_WEIGHT if c in hi else MIDDLE_WEIGHT if c in mid else LOW_WEIGHT) for p, (hi, mid) in PERSONAS.items() for c in range(1, len(CATEGORIES) + 1)]
    return spark.createDataFrame(rows, "persona string, category_id long, weight long")


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PERSONAS], "persona string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES, 1)), "category_id long, category_name string")


def keyword_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in CATEGORY_KEYWORDS.items()], "category string, keywords array<string>")


def match_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, b) for s, found in SPENDING_MATCH.items() for b in found], "spend_category string, benefit_category string")


def issuer_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ISSUERS), "issuer string, short string")

"""Inputs of benchmarks: generated corpora and lists of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: queries run where no list is given
DEFAULT_QUERIES = ("채권", '"이사회 결의"', "채권 AND 발행", "채권 OR 예산", "채권 NOT 국채", "발행*")

#: Sentences of generated texts, with the queries' words among them.
SENTENCES = (
    "이사회 결의에 따라 채권 발행 한도를 정한다.", "국채 금리는 전월보다 소폭 하락하였다.", "내년 예산 편성 지침을 부서별로 전달하였다.", "발행 절차와 승인 권한을 규정에 명시한다.", "회의록은 작성 후 사흘 안에 공유한다.",
    "성장률 전망은 상반기 실적을 반영하여 수정한다.", "신규 사업의 위험 요인을 분기마다 점검한다.", "채권 투자자에게 공시 자료를 제공하였다.", "감사 결과 지적 사항은 모두 개선되었다.", "예산 집행 현황을 매달 보고한다.", "이사회 승인 없이 계약을 변경할 수 없다.", "발행 조건은 시장 상황에 따라 달라진다.",
)


def generate(spark: SparkSession, n: int = 5000, seed: int = 7) -> DataFrame:
    """``path, text`` of n texts: a third each of 3-7, 10-29 and 50-149 sentences; the same every time."""
    number = lambda k, most: F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(most))
    size = F.when(F.col("id") % 3 == 0, 3 + number(F.lit(-1), 5)).when(F.col("id") % 3 == 1, 10 + number(F.lit(-1), 20)).otherwise(50 + number(F.lit(-1), 100))
    sentences = F.array(*map(F.lit, SENTENCES))
    text = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), size), lambda k: F.get(sentences, number(k, len(SENTENCES)).cast("int"))), " ")
    return spark.range(n).select(F.format_string("/bench/doc_%06d.txt", "id").alias("path"), text.alias("text"))


def read_queries(spark: SparkSession, path: str | None) -> list[str]:
    """One query a line, without blank ones; the default ones without a path."""
    if path is None:
        return list(DEFAULT_QUERIES)
    return [r["q"] for r in spark.read.text(path).select(F.trim("value").alias("q")).where("q <> ''").collect()]

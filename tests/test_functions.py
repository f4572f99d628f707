import pytest
from pyspark.sql import functions as F

from fleetscan.functions import severity as S
from fleetscan.functions import text as T
from fleetscan.values import TRIM_CHARS


def evaluate(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "secret,shown",
    [("", ""), ("abc", "***"), ("abcd", "***"), ("abcdefg", "ab***g"), ("abcdefgh", "ab***h"),
     ("abcdefghi", "abcd...fghi"), ("sk-1234567890abcdefghijkl", "sk-1...ijkl")],
)
def test_redact(spark, secret, shown):
    assert evaluate(spark, T.redact(F.lit(secret)))[0] == shown


def test_strip_takes_all_white_space(spark):
    text = TRIM_CHARS + "a b" + TRIM_CHARS
    assert evaluate(spark, T.strip(F.lit(text)))[0] == "a b"


def test_lines(spark):
    rows = evaluate(
        spark,
        *[f for t in ("", "a", "a\n", "\n\n", "a\r\nb") for f in
          (F.size(T.split_lines(F.lit(t))), T.line_count(F.lit(t)))],
    )
    assert list(rows) == [1, 1, 1, 1, 2, 2, 3, 3, 2, 2]


def test_count_word(spark):
    texts = ["any", "any any,any", "many anyone any_ any1", "éany", "$any", ""]
    row = evaluate(spark, *[T.count_word(F.lit(t), "any") for t in texts])
    assert list(row) == [1, 3, 0, 1, 1, 0]


@pytest.mark.parametrize(
    "score,status", [(0, "danger"), (39, "danger"), (40, "warning"), (69, "warning"), (70, "safe")]
)
def test_deploy_status(spark, score, status):
    row = evaluate(
        spark,
        S.deploy_status(F.lit(score), F.lit(False)),
        S.deploy_status(F.lit(score), F.lit(True)),
    )
    assert list(row) == [status, "blocker"]


def test_severity_order(spark):
    lit = F.lit
    row = evaluate(
        spark,
        S.more_severe(lit("critical"), lit("high")),
        S.more_severe(lit("low"), lit("low")),
        S.max_severity(lit("low"), lit("medium")),
        S.at_least(lit("low"), "medium"),
        S.exit_code(lit("danger")),
        S.exit_code(lit("warning")),
    )
    assert list(row) == [True, False, "medium", False, 1, 0]


def test_penalties_are_whole_tenths(spark):
    from fleetscan import values as V

    for s in V.SEVERITIES:
        for c in V.CATEGORIES:
            exact = V.SEVERITY_WEIGHT[s] * V.CATEGORY_MULTIPLIER[c] * 10
            assert abs(exact - S.penalty_tenths_of(s, c)) < 1e-9


def test_score_rounds_half_up_and_stops_at_zero(spark):
    row = evaluate(spark, *[S.score_from_tenths(F.lit(t)) for t in (0, -5, -6, -515, -5000)])
    assert list(row) == [100, 100, 99, 49, 0]


def test_worst_severity(spark):
    df = spark.createDataFrame([("low",), ("high",), ("medium",)], "s string")
    assert df.agg(S.worst_severity(F.col("s"))).first()[0] == "high"

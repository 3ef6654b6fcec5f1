"""What spark.sql can call once register(spark) has run: functions of SQL, and a table function.

churn_concentration(scores), bus_factor(shares, threshold) and decay_weight(at, now,
half_life_days) are expressions that Catalyst inlines.  line_kinds(TABLE(lines) PARTITION BY
path, language ORDER BY number) follows block comments from line to line of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from repolytics.operators.code import strip_line

FUNCTIONS = (
    """churn_concentration(scores ARRAY<BIGINT>) RETURNS DOUBLE RETURN
    CASE WHEN size(scores) = 0 OR aggregate(scores, 0L, (s, x) -> s + x) = 0 THEN 0.0D WHEN size(scores) = 1 THEN 1.0D ELSE
    CAST(greatest(0.0D, least(1.0D, (aggregate(scores, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * x) / power(CAST(aggregate(scores, 0L, (s, x) -> s + x) AS DOUBLE), 2) - 1.0D / size(scores)) / (1.0D - 1.0D / size(scores)))) * 100 + 0.5D AS BIGINT) / 100.0D END""",
    """bus_factor(shares ARRAY<DOUBLE>, threshold DOUBLE) RETURNS INT RETURN
    CASE WHEN size(shares) = 0 THEN 0 WHEN threshold <= 0 THEN 1 ELSE aggregate(array_sort(shares, (a, b) -> CASE WHEN a > b THEN -1 WHEN a < b THEN 1 ELSE 0 END), named_struct('sum', 0.0D, 'n', 0),
    (s, x) -> CASE WHEN s.sum >= threshold THEN s ELSE named_struct('sum', s.sum + x, 'n', s.n + 1) END).n END""",
    """decay_weight(at TIMESTAMP, now TIMESTAMP, half_life_days DOUBLE) RETURNS DOUBLE RETURN
    CASE WHEN half_life_days <= 0 OR at >= now THEN 1.0D ELSE exp((unix_micros(now) - unix_micros(at)) / 86400000000.0D * (-0.6931471805599453D / half_life_days)) END""",
)


@udtf(returnType="path string, number int, kind string, code string")
class LineKinds:
    """path, number, kind (code, comment or blank) and the code of each line (path, language, number, line) of a file, in order."""

    def __init__(self):
        self._in_block = False

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["line"] or ""
        code, skip, self._in_block = strip_line(text, row["language"] or "", self._in_block)
        yield row["path"], row["number"], "blank" if not text.strip() else "comment" if skip else "code", None if skip else code


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; again changes nothing."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("line_kinds", LineKinds)

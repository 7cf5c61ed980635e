"""Exact order statistics that never bring a whole group to one task.

``median()`` and a window ordered over a group both hold every distinct value of the group in
one task. One day of one chain can be a third of all rows, so both functions here first count
equal values (partial aggregation on the map side) and then walk down buckets of the value
range: each window covers the children of one bucket, never the group. Bucket numbers are
fixed monotone functions of the value, so a retried task gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import finite_or_null


def _names(keys: Sequence[str]) -> str:
    return "".join(f"`{k}`, " for k in keys)


def _same(keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}`" for k in keys)


# Bucket position t of a value v: monotone, whole part = coarse bucket, fraction = fine bucket.
# Logarithmic, as ln of the smallest positive double is about -744.4. The bucket numbers are never
# NULL (coalesce): the joins below would else push different null filters into each use of
# "counts", and Spark would scan and exchange the input once per use instead of reusing it.
_POSITION = "CASE WHEN v = 0 THEN 0D ELSE signum(v) * (ln(abs(v)) + 746D) * 2048D END"
_HOLDS = "(before <= {k} AND {k} < before + n)"
_ANY = f"({_HOLDS.format(k='k_lo')} OR {_HOLDS.format(k='k_hi')})"

_QUANTILE = """
WITH counts AS (
  SELECT {k} v, n, coalesce(floor(t), 0) AS b1, coalesce(floor((t - floor(t)) * 65536D), 0) AS b2
  FROM (SELECT {k} v, count(1) AS n, {position} AS t FROM {{rows}} WHERE {known} GROUP BY {k} v)
),
fine AS (SELECT {k} b1, b2, sum(n) AS n FROM counts GROUP BY {k} b1, b2),
coarse AS (
  SELECT *, floor(position) AS k_lo, ceil(position) AS k_hi, position - floor(position) AS part, upto - n AS before
  FROM (SELECT *, (sum(n) OVER (PARTITION BY {by}) - 1) * {q} AS position,
          sum(n) OVER (PARTITION BY {by} ORDER BY b1 ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT {k} b1, sum(n) AS n FROM fine GROUP BY {k} b1))
),
in_coarse AS (
  SELECT {k} b1, b2, n, k_lo, k_hi, part,
    base - n + sum(n) OVER (PARTITION BY {k} b1 ORDER BY b2 ROWS UNBOUNDED PRECEDING) AS before
  FROM fine JOIN (SELECT {k} b1, k_lo, k_hi, part, before AS base FROM coarse WHERE {any}) USING ({k} b1)
),
in_fine AS (
  SELECT {k} v, n, k_lo, k_hi, part,
    base - n + sum(n) OVER (PARTITION BY {k} b1, b2 ORDER BY v ROWS UNBOUNDED PRECEDING) AS before
  FROM counts JOIN (SELECT {k} b1, b2, k_lo, k_hi, part, before AS base FROM in_coarse WHERE {any}) USING ({k} b1, b2)
)
SELECT {k} lo + (hi - lo) * part AS `{out}`
FROM (SELECT {k} max(CASE WHEN {lo} THEN v END) AS lo, max(CASE WHEN {hi} THEN v END) AS hi, max(part) AS part
      FROM in_fine WHERE {any} GROUP BY {by})"""


def exact_quantile(df: DataFrame, keys: Sequence[str], value: Column, out: str, q: float = 0.5) -> DataFrame:
    """Quantile with linear interpolation of a finite double per group of non-null keys.

    Groups without any non-null value are absent from the result.
    """
    if not keys:
        raise ValueError("at least one key is needed")
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    text = _QUANTILE.format(
        k=_names(keys), by=_same(keys), position=_POSITION, q=f"{float(q)!r}D", any=_ANY, out=out,
        known=" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "v"]), lo=_HOLDS.format(k="k_lo"), hi=_HOLDS.format(k="k_hi"),
    )
    return df.sparkSession.sql(text, rows=df.select(*keys, value.cast("double").alias("v")))


_AUC = """
WITH d4 AS (
  SELECT {k} d1, d2, floor(r2 * 65536D) AS d3, r2 * 65536D - floor(r2 * 65536D) AS d4, pos, neg, bad FROM (
    SELECT {k} d1, floor(r1 * 65536D) AS d2, r1 * 65536D - floor(r1 * 65536D) AS r2, pos, neg, bad FROM (
      SELECT {k} floor(p * 65536D) AS d1, p * 65536D - floor(p * 65536D) AS r1, pos, neg, bad FROM (
        SELECT {k} p, count_if(y = 1) AS pos, count_if(y = 0) AS neg, count_if(bad) AS bad FROM {{rows}} GROUP BY {k} p)))
),
d3 AS (SELECT {k} d1, d2, d3, sum(pos) AS pos, sum(neg) AS neg, sum(bad) AS bad FROM d4 GROUP BY {k} d1, d2, d3),
d2 AS (SELECT {k} d1, d2, sum(pos) AS pos, sum(neg) AS neg, sum(bad) AS bad FROM d3 GROUP BY {k} d1, d2),
d1 AS (SELECT {k} d1, sum(pos) AS pos, sum(neg) AS neg, sum(bad) AS bad FROM d2 GROUP BY {k} d1),
nodes AS (
  SELECT {k} 4 AS depth, d1 AS p1, d2 AS p2, d3 AS p3, d4 AS digit, pos, neg, bad FROM d4
  UNION ALL SELECT {k} 3, d1, d2, NULL, CAST(d3 AS DOUBLE), pos, neg, bad FROM d3
  UNION ALL SELECT {k} 2, d1, NULL, NULL, CAST(d2 AS DOUBLE), pos, neg, bad FROM d2
  UNION ALL SELECT {k} 1, NULL, NULL, NULL, CAST(d1 AS DOUBLE), pos, neg, bad FROM d1
),
ranked AS (
  SELECT *, CAST(pos AS DECIMAL(19,0)) AS pos_d,
    CAST(coalesce(sum(neg) OVER (PARTITION BY {k} depth, p1, p2, p3 ORDER BY digit
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(19,0)) AS lower,
    CAST(CASE WHEN depth = 4 THEN neg ELSE 0 END AS DECIMAL(19,0)) AS tied
  FROM nodes
)
SELECT {k} CASE WHEN bad = 0 THEN try_divide(pairs, 2D * p * q) END AS `{out}`
FROM (SELECT {k} CAST(sum(pos_d * (2 * lower + tied)) AS DOUBLE) AS pairs,
        CAST(sum(CASE WHEN depth = 1 THEN pos END) AS DOUBLE) AS p,
        CAST(sum(CASE WHEN depth = 1 THEN neg END) AS DOUBLE) AS q,
        sum(CASE WHEN depth = 1 THEN bad END) AS bad
      FROM ranked {group})"""


def rank_auc(df: DataFrame, keys: Sequence[str], label: str, score: str, out: str = "auc") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL when one class is absent.

    The pairs (positive, lower negative) are counted digit by digit: scores in [0, 1] are read
    as base-65536 fractions, and two scores are compared at the first digit they differ in.
    Summed over all digits that gives the exact pair count from windows of at most 65,537
    siblings (the last one holds what is left after 48 bits). A group that holds
    a label other than 0 and 1, or a score that is no number in [0, 1], has no AUC: NULL.
    """
    y, p = finite_or_null(label), finite_or_null(score)
    good = F.coalesce(y.isin(0.0, 1.0) & p.between(0.0, 1.0), F.lit(False))
    rows = df.select(*keys, F.when(good, y).alias("y"), F.when(good, p).otherwise(0.0).alias("p"), (~good).alias("bad"))
    text = _AUC.format(k=_names(keys), out=out, group=f"GROUP BY {_same(keys)}" if keys else "")
    return df.sparkSession.sql(text, rows=rows)


def count_distinct_values(df: DataFrame, keys: Sequence[str], values: Column, out: str,
                          approximate: bool = False) -> DataFrame:
    """Distinct non-null entries of an array column per group.

    Equal entries are dropped on the map side and the exchange is keyed by the entry as well,
    so a large group is spread over all tasks before it is counted.
    """
    entries = df.select(*keys, F.explode(values).alias("_e")).where("_e IS NOT NULL")
    if approximate:
        return entries.groupBy(*keys).agg(F.approx_count_distinct("_e").alias(out))
    return entries.distinct().groupBy(*keys).agg(F.count("_e").alias(out))

"""Running sums, maxima and as-of values over a long order of rows, spread over tasks.

A key's rows are dealt to buckets of its order. Each bucket is reduced to one row of totals; a window over those few rows
carries into each bucket what comes before it (or after it, for looks ahead); and a window inside each bucket starts from
there. So one recording with all rows is as many tasks as it has buckets, and the only window over a whole key has a row for
each of its buckets. The width of buckets changes no result.

Where Spark's own estimate puts all rows together below SMALL bytes, no key can be too much for a task, and plain windows
spare the further stages; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Six hours in microseconds.
BUCKET = 6 * 3600 * 1_000_000
SMALL = 64 << 20

#: kind: (total of a bucket, whether it looks ahead, whether the row itself counts).
KINDS = {
    "sum": ("sum", False, True),
    "sum_before": ("sum", False, False),
    "max": ("max", False, True),
    "max_before": ("max", False, False),
    "last": ("last", False, True),
    "lag": ("last", False, False),
    "next": ("last", True, True),
    "lead": ("last", True, False),
    "min_ahead": ("min", True, True),
}


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of df, which goes by the size of the files it reads, is at most SMALL bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL


def _take(how: str):
    return {"sum": F.sum, "max": F.max, "min": F.min}.get(how) or (lambda c: F.last(c, ignorenulls=True))


def scanned(rows: DataFrame, keys: tuple[str, ...], at: str, order: list[str], width: int = BUCKET, **wanted: tuple[str, str]) -> DataFrame:
    """rows with further columns, each name=(kind, column), over the rows of equal keys in order, whose first column is at.

    sum and max take the rows up to each, sum_before and max_before those before it, last the latest value that is not null
    up to each row and next the nearest from it on; lag and lead are last and next without the row itself; min_ahead is the
    least from the row on. Rows that are equal in order count in any order.
    """
    if is_small(rows):
        found = {}
        for name, (kind, column) in wanted.items():
            how, ahead, itself = KINDS[kind]
            whole = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if ahead else F.col(c) for c in order])
            found[name] = _take(how)(F.col(column)).over(whole.rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
        return rows.withColumns(found)
    dealt = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    place = F.struct(*order)
    totals = []
    for name, (kind, column) in wanted.items():
        how, ahead, _ = KINDS[kind]
        value = F.col(column)
        pick = F.min_by if ahead else F.max_by
        totals.append({"sum": F.sum, "max": F.max, "min": F.min}[how](value).alias(f"_c_{name}") if how != "last" else pick(value, F.when(value.isNotNull(), place)).alias(f"_c_{name}"))
    whole = dealt.groupBy(*keys, "_bucket").agg(*totals)
    carried = []
    for name, (kind, _) in wanted.items():
        how, ahead, _ = KINDS[kind]
        others = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc() if ahead else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(_take(how)(F.col(f"_c_{name}")).over(others).alias(f"_c_{name}"))
    carry = whole.select(*keys, "_bucket", *carried).withColumn("_o", F.lit(0))
    both = dealt.withColumn("_o", F.lit(1)).unionByName(carry, allowMissingColumns=True)  # a bucket's carry is its first row in either direction
    found = {}
    for name, (kind, column) in wanted.items():
        how, ahead, itself = KINDS[kind]
        inside = Window.partitionBy(*keys, "_bucket").orderBy("_o", *[F.col(c).desc() if ahead else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        value = F.when(F.col("_o") == 0, F.col(f"_c_{name}")).otherwise(F.col(column))
        found[name] = _take(how)(value).over(inside)
    return both.withColumns(found).where("_o = 1").drop("_o", "_bucket", *[f"_c_{name}" for name in wanted])

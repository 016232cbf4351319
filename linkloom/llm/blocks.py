"""Meet all rows of a group pair by pair in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: list[str], identity: Column, limit: int) -> DataFrame:
    """Deal ``rows`` out to blocks: adds _i, _j (block) and _left, _right (which part of it a row is in).

    A group of up to ``limit`` rows is one block. A larger one is cut by hash into parts of about that
    size, and each two parts (or a part with itself) make a block, so every pair of rows of a group
    meets in exactly one block and none holds much more than two parts. Groups of one row go.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    sized = rows.join(sizes, group)
    parts = F.ceil(F.col("_rows") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), identity), F.col("_parts")).cast("int")
    dealt = sized.withColumn("_parts", parts).withColumn("_own", own)
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.withColumns(
        {
            "_i": F.least("_own", "_other"),
            "_j": F.greatest("_own", "_other"),
            "_left": F.col("_own") <= F.col("_other"),
            "_right": F.col("_own") >= F.col("_other"),
        }
    ).drop("_rows", "_parts", "_own", "_other")

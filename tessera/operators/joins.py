"""A nested-loop join that goes by blocks.

Every row of the outer side is compared with every row of one block of the inner side, pair by pair.  Both
sides are cut into blocks by a hash of the keys, so rows with equal keys are always in blocks of the same
number, and no pair is lost.  The number of blocks follows the inner side's rows, so the comparisons are
about ``block`` for each outer row, not the product of the sizes.

Nulls equal nothing; repeated keys give all their pairs.  NaN equals NaN and 0.0 equals -0.0, as in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inner rows of a block, on average.
BLOCK = 64


def nested_loop(outer: DataFrame, inner: DataFrame, on: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Pairs of rows whose keys are equal; ``on`` gives the inner key for each outer one.

    All columns of both sides, which need different names.  Counts the inner side when called.
    """
    # Types that compare must hash alike.
    kinds = [f.dataType for f in outer.select(*on).unionAll(inner.select(*on.values())).schema]
    blocks = max(int(outer.sparkSession.conf.get("spark.sql.shuffle.partitions")), inner.count() // block + 1)

    def cut(side: DataFrame, keys: list[str], name: str) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        number = F.pmod(F.xxhash64(*[F.col(k).cast(t) for k, t in zip(keys, kinds, strict=True)]), F.lit(blocks))
        return side.withColumn(name, F.when(known, number))

    # Between, as Catalyst would take an equality for another key of the merge and leave no pairs to compare.
    equal = [F.col(a).between(F.col(b), F.col(b)) for a, b in on.items()]
    both = reduce(lambda a, b: a & b, [F.col("_outer_block") == F.col("_inner_block"), *equal])
    pairs = cut(outer, [*on], "_outer_block").join(cut(inner, [*on.values()], "_inner_block").hint("merge"), both)
    return pairs.drop("_outer_block", "_inner_block")

"""Row versions: visibility to a snapshot and vacuum, over columns _xmin and _xmax."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    xid: int
    active: frozenset[int] = field(default_factory=frozenset)
    xmax: int = 0  # the next transaction id

    def sees(self, xid: Column) -> Column:
        """Whether what transaction ``xid`` did is visible."""
        done = xid < F.lit(self.xmax)
        if self.active:
            done = done & ~xid.isin(*sorted(self.active))
        return (xid == F.lit(self.xid)) | done


def visible(df: DataFrame, s: Snapshot) -> DataFrame:
    """Versions created visibly and not visibly deleted."""
    deleted = F.coalesce(s.sees(F.col("_xmax")), F.lit(False))
    return df.filter(F.coalesce(s.sees(F.col("_xmin")), F.lit(False)) & ~deleted)


def vacuum(df: DataFrame, oldest: int, key: str = "_row_id") -> DataFrame:
    """Without versions deleted before the oldest snapshot, except each row's newest."""
    newest = df.groupBy(key).agg(F.max("_xmin").alias("_newest"))
    dead = (F.col("_xmin") < F.col("_newest")) & F.col("_xmax").isNotNull() & (F.col("_xmax") < oldest)
    return df.join(newest, key).filter(~dead).select(*df.columns)


def insert(df: DataFrame, xid: int) -> DataFrame:
    """Rows as first versions, created by ``xid``."""
    return df.withColumns({"_xmin": F.lit(xid).cast("long"), "_xmax": F.lit(None).cast("long")})


def _hit(where: Column | None, s: Snapshot) -> Column:
    """Versions that the snapshot sees and that the predicate holds for; unknown is no match."""
    seen = F.coalesce(s.sees(F.col("_xmin")), F.lit(False)) & ~F.coalesce(s.sees(F.col("_xmax")), F.lit(False))
    return seen if where is None else seen & F.coalesce(where, F.lit(False))


def update(df: DataFrame, changes: dict[str, Column], where: Column | None, s: Snapshot) -> DataFrame:
    """Each visible version that matches ends by the snapshot's transaction, and one with the new values follows.

    Both come of the same row in one pass, without a second scan or a shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    ended = {"_xmax": F.lit(s.xid)}
    begun = changes | {"_xmin": F.lit(s.xid), "_xmax": F.lit(None)}
    version = lambda new: F.struct(*[new.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in df.columns])
    rows = F.when(_hit(where, s), F.array(version(ended), version(begun))).otherwise(F.array(version({})))
    return df.select(F.inline(rows))


def delete(df: DataFrame, where: Column | None, s: Snapshot) -> DataFrame:
    """Each visible version that matches ends by the snapshot's transaction."""
    kind = df.schema["_xmax"].dataType
    return df.withColumn("_xmax", F.when(_hit(where, s), F.lit(s.xid).cast(kind)).otherwise(F.col("_xmax")))

"""Turns in spoken order without one task per transcript.

A transcript may hold a third of all rows. Transcripts of at most BLOCK rows are one block each. Longer ones are cut into
blocks by time, and where many turns share a time by turn index, so that windows run inside blocks of bounded size; what
a row must know of the rows before or after its block is carried by one row per block. Blocks depend on the data alone,
never on how it is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import cut, join_small

#: Rows from which a transcript is cut; width of its slices in milliseconds.
BLOCK, SLICE = 50_000, 3_600_000
#: Long transcripts that are read by their ids, so that files without them are passed over; more of them are joined.
FEW = 100
#: Stands for an unknown time, which comes before all known ones.
_NEVER = -(1 << 45)
_PLACE = ["_slice", "_at", "_part"]
ORDER = ["at", "turn_index"]  # NULL comes first


@dataclass(frozen=True)
class Blocks:
    """How rows are cut: `keys` of a block, and whether a transcript may have several."""

    keys: tuple[str, ...]
    several: bool

    def inside(self, first: int = Window.unboundedPreceding, last: int = 0) -> Window:
        return self.whole().rowsBetween(first, last)

    def whole(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*ORDER)

    def _others(self, first: int, last: int) -> Window:
        return Window.partitionBy("transcript_id").orderBy(*_PLACE).rowsBetween(first, last)

    def along(self, df: DataFrame, written: bool = False, **columns: tuple[str, Column]) -> DataFrame:
        """Adds for each name, in one pass over the transcript, what its kind says of a value:

        `before`: its last one that isn't NULL in the rows before this one; `by`: in those and this one;
        `previous`, `next`: that of the row before or after (never NULL itself; NULL at the ends of the transcript);
        `last`: that of the transcript's last row (never NULL); `count`: how many rows up to and with this one have the
        flag; `total`: how many rows of the transcript have it. `written`: `df` is a written table or cheap to read twice.
        """
        df = cut(df) if self.several and not written else df
        flag = lambda v: F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))
        order, begin, end = F.struct(*ORDER), Window.unboundedPreceding, Window.unboundedFollowing
        here = {
            "before": lambda v: F.last(v, ignorenulls=True).over(self.inside(last=-1)), "by": lambda v: F.last(v, ignorenulls=True).over(self.inside()),
            "previous": lambda v: F.lag(v).over(self.whole()), "next": lambda v: F.lead(v).over(self.whole()), "last": lambda v: F.last(v).over(self.inside(last=end)),
            "count": lambda v: F.sum(flag(v)).over(self.inside()), "total": lambda v: F.sum(flag(v)).over(self.inside(last=end)),
        }
        out = df.withColumns({n: here[kind](v) for n, (kind, v) in columns.items()})
        if not self.several:
            return out
        # what a block says of a value, and what a block is told by the others
        latest = lambda v: F.max_by(v, F.when(v.isNotNull(), order))
        told = dict.fromkeys(("before", "by", "previous"), (latest, lambda v: F.last(v, ignorenulls=True).over(self._others(begin, -1)))) | {
            "next": (lambda v: F.min_by(v, order), lambda v: F.lead(v).over(Window.partitionBy("transcript_id").orderBy(*_PLACE))), "last": (lambda v: F.max_by(v, order), lambda v: F.last(v).over(self._others(begin, end))),
            "count": (lambda v: F.sum(flag(v)), lambda v: F.sum(v).over(self._others(begin, -1))), "total": (lambda v: F.sum(flag(v)), lambda v: F.sum(v).over(self._others(begin, end))),
        }
        said = df.groupBy(*self.keys).agg(*[told[kind][0](v).alias(n) for n, (kind, v) in columns.items()])
        carried = cut(said.select(*self.keys, F.struct(*[told[kind][1](F.col(n)).alias(n) for n, (kind, _) in columns.items()]).alias("_carried")))
        both = {"last": lambda n: F.col(f"_carried.{n}"), "total": lambda n: F.col(f"_carried.{n}"), "count": lambda n: F.col(n) + F.coalesce(f"_carried.{n}", F.lit(0).cast("bigint"))}
        out = join_small(out, carried, list(self.keys))
        return out.withColumns({n: both.get(kind, lambda n: F.coalesce(n, f"_carried.{n}"))(n) for n, (kind, _) in columns.items()}).drop("_carried")

    def before(self, df: DataFrame, value: str, name: str) -> DataFrame:
        """Adds the last value of the struct column `value` that isn't NULL in the rows before this one in the transcript."""
        return self.along(df, **{name: ("before", F.col(value))})

    def numbered(self, df: DataFrame, **flags: Column) -> DataFrame:
        """Adds for each name how many rows of the transcript up to and with this one have the flag."""
        return self.along(df, **{n: ("count", f) for n, f in flags.items()})


def in_spoken_order(rows: DataFrame, counted: DataFrame, of: Callable[[DataFrame, Blocks], DataFrame]) -> DataFrame:
    """`of(rows, blocks)` over `rows` (transcript_id, at, turn_index, ...), for short and long transcripts apart.

    `counted` is a written table that has at least as many rows of each transcript.
    """
    long = cut(counted.groupBy("transcript_id").count().where(F.col("count") > BLOCK).select("transcript_id"))
    if long.isEmpty():
        return of(rows, Blocks(("transcript_id",), False))
    short = of(join_small(rows, long, ["transcript_id"], "left_anti"), Blocks(("transcript_id",), False))
    at = F.coalesce(F.col("at"), F.lit(_NEVER))
    ids = [r[0] for r in long.limit(FEW + 1).collect()]
    x = rows.where(F.col("transcript_id").isin(ids)) if len(ids) <= FEW else join_small(rows, long, ["transcript_id"], "left_semi")
    x = cut(x.withColumn("_slice", F.floor(at / SLICE)))
    full = x.groupBy("transcript_id", "_slice").count().where(F.col("count") > BLOCK)
    x = join_small(x, cut(full.select("transcript_id", "_slice", F.lit(True).alias("_full"))), ["transcript_id", "_slice"])
    x = x.withColumn("_at", F.when(F.col("_full"), at).otherwise(0)).withColumn("_part", F.when(F.col("_full"), F.floor(F.col("turn_index") / BLOCK)).otherwise(0)).drop("_full")
    return short.unionByName(of(x, Blocks(("transcript_id", *_PLACE), True)))

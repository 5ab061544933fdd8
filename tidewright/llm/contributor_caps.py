"""Cap the rows of each contributor, best score first, by parallel bisection.

Instead of sorting a contributor's rows, which would put the largest contributor into one task, the operator
searches the cutoff of every contributor above the cap at once. Each round counts the rows above many
midpoints per contributor (one map-side combined aggregation over three narrow columns) and keeps the bounds
around the place where the count passes the cap. Scores that tie at the cutoff are bisected by identifier.

Rules: null and NaN scores come last; infinities count as the largest finite numbers; rows without a
contributor have no limit; rows that share score and identifier stand or fall together, and fall where they
do not all fit. An empty table gives an empty result. Other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut_lineage, written

LARGEST = 1.7976931348623157e308
#: Midpoints counted together for each contributor in a round.
MIDPOINTS = 4096
#: Bounds of so many contributors are sent to every task; more are joined by shuffle.
SMALL_STATE = 100_000


def _narrow(df: DataFrame, contributor: Column, score: Column, identifier: Column) -> DataFrame:
    finite = F.greatest(F.least(score.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    value = F.when(score.isNull() | F.isnan(score.cast("double")), None).otherwise(finite)
    return df.select(contributor.alias("k"), value.alias("v"), identifier.cast("bigint").alias("i"))


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(state) if state.count() <= SMALL_STATE else state, "k")


def _narrowed(counted: DataFrame, descending: bool) -> DataFrame:
    """Of each contributor's counted buckets, the one in which its cutoff lies."""
    order = F.col("b").desc() if descending else F.col("b").asc()
    through = F.sum("n").over(Window.partitionBy("k").orderBy(order))
    return (
        counted.withColumn("through", through)
        .where((F.col("through") >= F.col("need")) & (F.col("through") - F.col("n") < F.col("need")))
        .withColumn("need", F.col("need") - (F.col("through") - F.col("n")))
    )


def _value_round(rows: DataFrame, state: DataFrame, midpoints: int) -> DataFrame:
    width = F.col("hi") / 2 - F.col("lo") / 2
    place = F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * F.lit(midpoints)).cast("int")
    bucket = F.when(width <= 0, F.when(F.col("v") > F.col("lo"), 1).otherwise(0)).otherwise(F.least(place, F.lit(midpoints - 1)))
    inside = _with_state(rows, state).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counted = inside.groupBy("k", "need", bucket.alias("b")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("i").alias("ilo"), F.max("i").alias("ihi")
    )
    return _narrowed(counted, True).select("k", "need", "n", "lo", "hi", "ilo", "ihi")


def _identifier_round(rows: DataFrame, state: DataFrame, midpoints: int) -> DataFrame:
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    step = F.floor((wide("ihi") - wide("ilo")) / F.lit(midpoints)) + 1
    bucket = F.floor((wide("i") - wide("ilo")) / step).cast("int")
    inside = _with_state(rows, state).where(F.col("v").eqNullSafe(F.col("cut")) & F.col("i").between(F.col("ilo"), F.col("ihi")))
    counted = inside.groupBy("k", "need", "cut", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("i").alias("ilo"), F.max("i").alias("ihi"))
    return _narrowed(counted, False).select("k", "need", "n", "cut", "ilo", "ihi")


def cutoffs(rows: DataFrame, cap: int, midpoints: int = MIDPOINTS) -> DataFrame:
    """(k, cut, last): contributor ``k`` keeps scores above ``cut`` and, at ``cut``, identifiers up to ``last``."""
    start = cut_lineage(
        rows.groupBy("k")
        .agg(F.count("*").alias("all"), F.count("v").alias("scored"), F.min("v").alias("lo"), F.max("v").alias("hi"),
             F.min(F.when(F.col("v").isNull(), F.col("i"))).alias("ilo"), F.max(F.when(F.col("v").isNull(), F.col("i"))).alias("ihi"))
        .where(F.col("all") > cap)
    )
    searched = F.col("scored") >= F.lit(cap)
    values = start.where(searched & (F.col("scored") > 0)).select("k", F.lit(cap).cast("bigint").alias("need"), "lo", "hi")
    if cap <= 0:
        return start.select("k", F.lit(None).cast("double").alias("cut"), F.lit(None).cast("bigint").alias("last"))
    columns = ("k", "need", "n", "cut", "ilo", "ihi")
    ties = [start.where(~searched).select(
        "k", (F.lit(cap) - F.col("scored")).alias("need"), (F.col("all") - F.col("scored")).alias("n"), F.lit(None).cast("double").alias("cut"), "ilo", "ihi")]
    while not values.isEmpty():
        narrowed = cut_lineage(_value_round(rows, values, midpoints))
        ties.append(narrowed.where(F.col("lo") == F.col("hi")).withColumn("cut", F.col("lo")).select(*columns))
        values = narrowed.where(F.col("lo") < F.col("hi")).select("k", "need", "lo", "hi")
    open_ties = ties[0]
    for more in ties[1:]:
        open_ties = open_ties.unionByName(more)
    done = []
    while True:
        whole = F.col("n") == F.col("need")
        single = F.col("ilo") == F.col("ihi")
        done.append(open_ties.where(whole | single).select("k", "cut", F.when(whole, F.col("ihi")).otherwise(F.col("ilo") - 1).alias("last")))
        open_ties = open_ties.where(~(whole | single)).select("k", "need", "cut", "ilo", "ihi")
        if open_ties.isEmpty():
            break
        open_ties = cut_lineage(_identifier_round(rows, open_ties, midpoints))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return cut_lineage(result)


def _marked(rows: DataFrame, cap: int, midpoints: int) -> DataFrame:
    """``rows`` (k, v, i) with gone: whether a row is beyond its contributor's cutoff. No row meets another again."""
    cuts = cutoffs(rows.where(F.col("k").isNotNull()), cap, midpoints).withColumn("capped", F.lit(True))
    cuts = F.broadcast(cuts) if cuts.count() <= SMALL_STATE else cuts
    below = F.when(
        F.col("last").isNull(), True
    ).when(
        F.col("v").isNull(), F.col("cut").isNotNull() | (F.col("i") > F.col("last"))
    ).otherwise(
        F.col("cut").isNotNull() & ((F.col("v") < F.col("cut")) | ((F.col("v") == F.col("cut")) & (F.col("i") > F.col("last"))))
    )
    return rows.join(cuts, "k", "left").withColumn("gone", F.coalesce(F.col("capped") & below, F.lit(False))).drop("cut", "last", "capped")


def over_cap(df: DataFrame, contributor: Column, score: Column, identifier: Column, cap: int, midpoints: int = MIDPOINTS) -> DataFrame:
    """(k, i): the rows that go when every contributor keeps its ``cap`` best rows."""
    return _marked(written(_narrow(df, contributor, score, identifier)), cap, midpoints).where("gone").select("k", "i")


def over_two_caps(items: DataFrame, contributor: Column, group_of: DataFrame, score: Column, identifier: Column, cap: int, group_cap: int, midpoints: int = MIDPOINTS) -> DataFrame:
    """(row_id, cap): rows above the contributor's cap ('source'), then, of the rows left, above the group's ('category').

    ``group_of`` maps a contributor (``k``) to its group (``g``) and is one small row per contributor. The rounds read
    three narrow columns, written once for each cap.
    """
    first = _marked(written(_narrow(items, contributor, score, identifier)), cap, midpoints)
    both = written(first.join(group_of, "k", "left").select(F.when(~F.col("gone"), F.col("g")).alias("k"), "v", "i", F.col("gone").alias("over")))
    fallen = F.when(F.col("over"), "source").when(F.col("gone"), "category")
    return _marked(both, group_cap, midpoints).select(F.col("i").alias("row_id"), fallen.alias("cap")).where(F.col("cap").isNotNull())

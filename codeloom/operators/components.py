"""Connected components by contraction.

Each round hooks every vertex to its least neighbour under a priority drawn anew from a
hash, jumps pointers once, and replaces links by links between hooks. Random priorities
make the links shrink geometrically whatever the ids and shapes (paths included), so the
rounds are logarithmic and their total work is a constant times the first round. Every
step is an aggregate with map-side combine or an equi-join; a hub of any degree is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(v, comp) for every vertex of ``links`` (a long, b long); comp is a vertex of it.

    Rows with a null end are ignored; self links give their vertex a component of its own;
    repeated links don't matter; an empty input gives an empty result.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    maps: list[DataFrame] = []
    current, rounds = links, 0
    while True:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("component contraction did not converge")
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, r=rounds: F.struct(F.xxhash64(c, F.lit(r)).alias("p"), F.col(c).alias("v"))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("m"))
        hook = scratch.spool(hook)
        up = hook.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        jump = scratch.spool(hook.join(up, "m").select("v", F.col("mm").alias("m")))
        maps.append(jump)
        left, right = jump.select(F.col("v").alias("a"), F.col("m").alias("ma")), jump.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        later = current.join(left, "a").join(right, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        later = scratch.spool(later)
        scratch.drop(hook)
        if rounds > 1:
            scratch.drop(current)
        current = later
        if current.isEmpty():
            break
    labels = maps.pop().select("v", F.col("m").alias("comp"))
    while maps:
        below = maps.pop()
        labels = below.join(labels.select(F.col("v").alias("m"), "comp"), "m", "left").select("v", F.coalesce("comp", "m").alias("comp"))
    return labels

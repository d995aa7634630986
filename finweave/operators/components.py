"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.session import attach, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node of the edge list with its component, named by the smallest node: node, component.

    Each round hooks neighbours to local minima with two aggregations, so it takes about log(n) rounds; a round
    ends in a table in the shared folder. A hub is no gathering point: its edges are joined with its one minimum, never collected.
    Null ends and loops carry no link and are left out; repeated edges count once; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    star = materialize(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).distinct(), "components"
    )
    before = None
    while True:
        both = star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        kept = both.join(low, "x").where("y < x and m = y").select("x", "y")
        large = large.unionByName(kept).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        star = materialize(small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).distinct(), "components")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = star.select(F.col("y").alias("node")).distinct()
    return star.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


#: Members of a class that one task pairs with as many others.
PAIR_BLOCK = 2_000


def pairs_within(member: DataFrame, group: str, member_id: str, block: int = PAIR_BLOCK) -> DataFrame:
    """All pairs of members of one class: {member_id}_a < {member_id}_b.

    The result is quadratic in a class by definition. A class of more than ``block`` members is cut into blocks by a hash of the member, and each pair of
    blocks is a join key of its own, so a class with a third of all rows is spread over as many tasks as its pairs need. A null member or class is in no pair.
    """
    rows = member.where(F.col(group).isNotNull() & F.col(member_id).isNotNull()).select(F.col(group).alias("g"), F.col(member_id).alias("m")).distinct()
    blocks = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    cut = attach(rows, materialize(blocks, "pair-blocks"), ["g"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.select("g", "m", "blocks", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = cut.select("g", F.col("own").alias("i"), F.col("other").alias("j"), F.col("m").alias(f"{member_id}_a"))
    b = cut.select("g", F.col("other").alias("i"), F.col("own").alias("j"), F.col("m").alias(f"{member_id}_b"))
    return a.join(b, ["g", "i", "j"]).where(F.col(f"{member_id}_a") < F.col(f"{member_id}_b")).select(f"{member_id}_a", f"{member_id}_b")

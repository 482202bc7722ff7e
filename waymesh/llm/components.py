"""Connected components of an edge table, without a driver-side structure and safe against lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A key that holds more than this share of a table's rows (and more than MANY of them) is dealt over PARTS tasks.
SHARE, MANY, PARTS = 100, 200, 32


def split_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` joined with ``one`` (no key twice) on ``key``; keys that are very common in ``many`` are split by ``by``.

    At most SHARE keys can be that common, so the list of them is bounded; only their rows of ``one`` are repeated.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("n"))
    least = max(MANY, many.count() // SHARE)
    common = [r[0] for r in counts.filter(F.col("n") > least).select(key).collect()]
    if not common:
        return many.join(one, key)
    hot = F.col(key).isin(common)
    dealt = many.withColumn("__part", F.when(hot, F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).otherwise(0))
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(one.withColumn("__part", F.explode(parts)), [key, "__part"]).drop("__part")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: long); component is the smallest node reachable.

    Hook-and-jump label propagation: in each round a node takes the smallest parent among its neighbours' parents,
    hands it to its own parent, and jumps to its grandparent. The number of rounds grows with the logarithm of the
    longest path. Minima combine before each shuffle; the root of a large component and a node with very many links
    are split over tasks. Every round ends in a table in the shared folder. Self-loops and repeated edges do no harm;
    an empty edge table gives an empty result.
    """
    both = written(edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    parent = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("p")), "parents")
    for _ in range(max_rounds):
        above = parent.select("p").distinct().join(parent.select(F.col("node").alias("p"), F.col("p").alias("g")), "p")
        grand = split_join(parent, above, "p", "node")
        near = split_join(both.withColumnRenamed("dst", "node"), grand.select("node", "g"), "node", "src").groupBy("src").agg(F.min("g").alias("m"))
        seen = grand.join(near, grand.node == near.src).select("node", "p", "g", "m")
        offers = seen.select("p", F.explode(F.array(F.struct(F.col("node").alias("to"), F.least("g", "m").alias("v")), F.struct(F.col("p").alias("to"), F.col("m").alias("v")))).alias("o"))
        new = offers.groupBy(F.col("o.to").alias("node")).agg(F.min("o.v").alias("v"))
        step = written(parent.join(new, "node").select("node", F.least("p", "v").alias("p"), F.col("p").alias("old")), "round")
        changed = step.filter("p <> old").limit(1).count()
        parent = step.select("node", "p")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return parent.select("node", F.col("p").alias("component"))

"""Reachability through a condensed graph: strongly connected components, and sets closed over their order.

Nodes are numbered in the order of their ids, so what belongs together has numbers close to each other, and a set of nodes
is a few rows (component, word, bits) of 64 numbers each. Every component holds one set, however many nodes it has; sets
are merged by ``bit_or`` from the ends of the graph upwards, one round for each level, and sizes are counted on bits.
Pairs of nodes are made only for the nodes that are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, numbered

#: Tables that a union may have before it is written as one.
PARTS = 8


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, comp) of the nodes of edges (src, dst: long) that lie on a cycle of two or more; comp is the smallest of its nodes.

    Edges at nodes without a way in or out are trimmed off. Then every node takes the smallest node that reaches it; what
    reaches that node, inside the nodes that took it, is its component. Edges between the others go through all of it again.
    """
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    n, found = left.count(), []
    for _ in range(max_rounds):
        while n:
            ways_in, ways_out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left, before = cut(left.join(ways_in, "src", "left_semi").join(ways_out, "dst", "left_semi").select("src", "dst")), n
            n = left.count()
            if n == before:
                break
        if not n:
            break
        took = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        changed = took
        while changed.limit(1).count():
            offers = changed.join(left, changed.node == left.src).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            took = cut(took.select("node", "c").join(offers, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("new")))
            changed = took.filter("new").select("node", "c")
        took = took.select("node", "c")
        own = left.join(took.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(took.withColumnsRenamed({"node": "dst", "c": "b"}), "dst").filter("a = b")
        own = cut(own.select("src", "dst", "a"))
        inside = frontier = cut(took.filter("node = c").select("node", F.col("c").alias("comp")))
        while frontier.limit(1).count():
            back = frontier.join(own, (frontier.node == own.dst) & (frontier.comp == own.a)).select(F.col("src").alias("node"), "comp").distinct()
            frontier = cut(back.join(inside, "node", "left_anti"))
            inside = cut(inside.union(frontier))
        found.append(inside)
        done = inside.select("node")
        left = cut(own.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        n = left.count()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not found:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("comp"))
    every = reduce(DataFrame.union, found)
    many = every.groupBy("comp").agg(F.count("*").alias("n")).filter("n > 1").select("comp")
    return cut(every.join(many, "comp", "left_semi").select("node", "comp"))


@dataclass(frozen=True)
class Condensed:
    """nodes: node (its name), at (its number), comp; dag: src, dst (components), without cycles."""

    nodes: DataFrame
    dag: DataFrame

    def close(self, own: DataFrame, max_rounds: int = 10_000) -> DataFrame:
        """(comp, word, bits): the bits that each component's own rows have, and those of all components that it reaches."""
        own = cut(own.groupBy("comp", "word").agg(F.bit_or("bits").alias("bits")))
        left = cut(self.dag.select(F.col("src").alias("comp")).distinct())
        waiting = cut(self.dag.join(left.select(F.col("comp").alias("dst")), "dst", "left_semi").select("src", "dst"))
        parts = [cut(own.join(left, "comp", "left_anti"))]
        for _ in range(max_rounds):
            if not left.limit(1).count():
                return reduce(DataFrame.union, parts)
            ready = cut(left.join(waiting.select(F.col("src").alias("comp")), "comp", "left_anti"))
            below = self.dag.join(ready.withColumnRenamed("comp", "src"), "src", "left_semi")
            told = below.join(reduce(DataFrame.union, parts).withColumnRenamed("comp", "dst"), "dst").select(F.col("src").alias("comp"), "word", "bits")
            parts.append(cut(told.union(own.join(ready, "comp", "left_semi")).groupBy("comp", "word").agg(F.bit_or("bits").alias("bits"))))
            if len(parts) > PARTS:
                parts = [cut(reduce(DataFrame.union, parts))]
            left = cut(left.join(ready, "comp", "left_anti"))
            waiting = cut(waiting.join(ready.withColumnRenamed("comp", "dst"), "dst", "left_anti"))
        raise RuntimeError(f"still open after {max_rounds} rounds")

    def reach(self) -> DataFrame:
        """(comp, word, bits): the numbers of all nodes that each component reaches, its own included."""
        return self.close(self.nodes.select("comp", *bit("at")))

    def pairs(self, asked: DataFrame, sets: DataFrame) -> DataFrame:
        """(seed, node): what each node of ``asked`` (seed) reaches, itself included."""
        rows = asked.select("seed").distinct().join(self.nodes.select(F.col("node").alias("seed"), "comp"), "seed").join(sets, "comp")
        return rows.select("seed", F.explode(numbers("word", "bits")).alias("at")).join(self.nodes.select("at", "node"), "at").select("seed", "node")

    def sizes(self, sets: DataFrame) -> DataFrame:
        """(comp, n): how many numbers each set has."""
        return sets.groupBy("comp").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))

    def weigh(self, weights: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
        """(comp, by..., n): sums of weights (node, by..., n) over the nodes of each set. A word's weights are one row, so no pair is made."""
        held = weights.join(self.nodes.select("node", "at"), "node").groupBy(F.expr("at div 64").alias("word"), *by).agg(F.collect_list(F.struct((F.col("at") % 64).cast("int").alias("i"), F.col("n").alias("n"))).alias("w"))
        some = F.expr("aggregate(w, 0L, (s, x) -> s + if((shiftrightunsigned(bits, x.i) & 1L) = 1L, x.n, 0L))")
        return sets.join(held, "word").select("comp", *by, some.alias("n")).filter("n > 0").groupBy("comp", *by).agg(F.sum("n").alias("n"))

    def union(self, items: DataFrame) -> DataFrame:
        """(comp, n): how many different items (node, item) the nodes have that each component reaches."""
        places = numbered(items.select("item").distinct(), "at", "item", kind="long")
        own = items.join(places, "item").join(self.nodes.select("node", "comp"), "node").select("comp", *bit("at"))
        return self.sizes(self.close(own))


def bit(at: str):
    """(word, bits) of a number."""
    return F.expr(f"{at} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))").alias("bits")


def numbers(word: str, bits: str):
    """The numbers of one word's bits."""
    return F.expr(f"transform(filter(sequence(0, 63), i -> (shiftrightunsigned({bits}, i) & 1L) = 1L), i -> {word} * 64 + i)")


def condensed(edges: DataFrame, more: DataFrame | None = None) -> Condensed:
    """The condensed graph of edges (src, dst: names); ``more`` (node) may have nodes without an edge."""
    steps = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    names = steps.select(F.col("src").alias("node")).union(steps.select("dst"))
    names = names if more is None else names.union(more.select("node").filter("node is not null"))
    at = cut(numbered(names.distinct(), "at", "node", kind="long"))
    by = lambda end: at.select(F.col("node").alias(end), F.col("at").alias(f"{end}_at"))
    told = cut(steps.join(by("src"), "src").join(by("dst"), "dst").select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst")))
    strong = strong_components(told).withColumnRenamed("node", "at")
    nodes = cut(at.join(strong, "at", "left").select("node", "at", F.coalesce("comp", "at").alias("comp")))
    comp = lambda end: nodes.select(F.col("at").alias(end), F.col("comp").alias(f"{end}_comp"))
    dag = told.join(comp("src"), "src").join(comp("dst"), "dst").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")).filter("src <> dst").distinct()
    return Condensed(nodes, cut(dag))

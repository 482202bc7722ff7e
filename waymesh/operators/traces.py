"""Observed calls against the static graph: confirmation, and drift in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.session import numbered
from .build import EDGE, ISSUE, Graph, nodes, place, shaped


def resolve_names(g: Graph, observed: DataFrame) -> DataFrame:
    """(name, id, ord, known) of each name in traces: by settings, by node id, by the only service that has all its tokens, or as an external system."""
    names = observed.select(F.col("source").alias("name"), (F.col("ord") * 2).alias("o")).union(observed.select("target", F.col("ord") * 2 + 1)).groupBy("name").agg(F.min("o").alias("ord"))
    told = names.sparkSession.createDataFrame([(k, v) for k, v in g.config.trace_names.items() if v], "name string, told string")
    out = names.join(told, "name", "left").join(nodes(g).select(F.col("id").alias("name"), F.col("id").alias("node")), "name", "left")
    words = names.select("name", F.array_distinct(fn.tokens("name")).alias("ts")).filter("size(ts) > 0")
    theirs = g.services.select("id", F.explode(F.array_distinct(fn.tokens("id"))).alias("t"))
    hits = words.withColumn("t", F.explode("ts")).join(theirs, "t").groupBy("name", "id", F.size("ts").alias("n")).agg(F.count("*").alias("met")).filter("met = n")
    only = hits.groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("by_tokens")).filter("k = 1").drop("k")
    out = out.join(only, "name", "left")
    id = F.coalesce("told", "node", "by_tokens", fn.external_node("name"))
    return out.select("name", id.alias("id"), "ord", F.coalesce("told", "node", "by_tokens").isNotNull().alias("known"))


def observed_pairs(g: Graph, observed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(source, target, seen, ord): resolved pairs without self-calls, with the number of rows that show them."""
    names = resolve_names(g, observed) if names is None else names
    s, t = names.select(F.col("name").alias("source"), F.col("id").alias("s")), names.select(F.col("name").alias("target"), F.col("id").alias("t"))
    return observed.join(s, "source").join(t, "target").filter("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("seen"), F.min("ord").alias("ord"))


def drift(static: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full outer join of static pairs (source, target) with observed ones: (source, target, status, seen, ord)."""
    both = static.select("source", "target").distinct().withColumn("s", F.lit(True)).join(pairs.select("source", "target", "seen", "ord"), ["source", "target"], "full")
    status = F.when(F.col("s").isNull(), F.when(F.col("seen") > 1, "both").otherwise("observed")).when(F.col("seen").isNotNull(), "both").otherwise("declared")
    return both.select("source", "target", status.alias("status"), "seen", "ord", F.col("s").isNull().alias("new"))


def merge_traces(g: Graph, observed: DataFrame) -> Graph:
    """The graph with confirmed and observed-only edges; unchanged if there is no observation."""
    names = resolve_names(g, observed)
    pairs = observed_pairs(g, observed, names)
    service_level = F.col("kind").isin("http", "declared")
    found = drift(g.edges.filter(service_level), pairs)
    any_seen = observed.limit(1).count() > 0
    if not any_seen:
        return g
    seen = pairs.select("source", "target", F.lit(True).alias("seen"))
    e = g.edges.join(seen, ["source", "target"], "left")
    hit = service_level & F.col("seen").isNotNull()
    e = e.withColumn("status", F.when(hit, "both").otherwise(F.col("status"))).withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence"))).select(*EDGE)
    new = found.filter("new")
    again = F.col("status") == "both"
    added = shaped(new, EDGE, id=F.concat(F.lit("http:"), "source", F.lit("->"), "target"), kind="http", resolution="trace", confidence=F.when(again, F.lit(1.0)).otherwise(0.85), ord=place(3, "ord"))
    message = F.concat(F.lit("Traces show "), "source", F.lit(" calling "), "target", F.lit(" but static analysis found no such call"))
    issues = shaped(new, ISSUE, level="warn", code="drift:observed-only", service=F.col("source"), message=message)
    unseen = found.filter("status = 'declared'").filter(~F.col("target").startswith("external:"))
    message = F.concat(F.lit("Static analysis found "), "source", F.lit(" → "), "target", F.lit(" but traces never observed it"))
    issues = issues.union(shaped(unseen, ISSUE, level="info", code="drift:declared-only", service=F.col("source"), message=message))
    strange = names.filter("not known").join(g.services.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    message = F.concat(F.lit('Trace service "'), "name", F.lit('" has no manifest; added as external'))
    issues = issues.union(shaped(strange, ISSUE, level="info", code="trace:unknown-service", message=message))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in g.services.dtypes}
    outer = numbered(strange, "place", "ord").select(*({
        **none, "m_ord": (F.lit(1 << 21) + F.col("place")).alias("m_ord"), "id": F.col("id"), "name": F.col("name"), "layer": F.lit("external").alias("layer"), "inferred": F.lit(True).alias("inferred"),
        "description": F.concat(F.lit('Seen only in traces as "'), "name", F.lit('"')).alias("description"), **{f"n_{n}": F.lit(0).cast("long").alias(f"n_{n}") for n in ("endpoints", "consumers", "calls", "publishes")},
    }[c] for c in g.services.columns))
    return g.replace(edges=e.unionByName(added), issues=g.issues.unionByName(issues), services=g.services.unionByName(outer))

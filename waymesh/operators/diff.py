"""Differences between two states of an estate's manifests, by service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from .estate import Estate

FACETS = ("endpoints", "consumers", "calls", "publishes")


def facet_keys(e: Estate) -> DataFrame:
    """(service, facet, key), distinct."""
    lit = F.lit
    keyed = F.when(fn.truthy("routingKey").isNotNull(), F.concat(lit(" ("), "routingKey", lit(")"))).otherwise("")
    to = F.when(fn.truthy("targetService").isNotNull(), F.concat(lit(" → "), "targetService")).when(fn.truthy("targetHint").isNotNull(), F.concat(lit(" ("), "targetHint", lit(")"))).otherwise("")
    key: dict[str, Column] = {
        "endpoints": F.concat("method", lit(" "), "path"),
        "consumers": F.concat("broker", lit(":"), F.coalesce("exchange", "topic"), keyed),
        "calls": F.concat(F.coalesce("method", lit("HTTP")), lit(" "), "url", to),
        "publishes": F.concat("broker", lit(":"), "topic", keyed),
    }
    return reduce(DataFrame.union, [getattr(e, f).select("service", lit(f).alias("facet"), key[f].alias("key")) for f in FACETS]).distinct()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(service, facet, key, change): what was added and removed, from distinct facet keys."""
    names = ["service", "facet", "key"]
    added = after.select(*names).join(before, names, "left_anti").withColumn("change", F.lit("added"))
    return added.union(before.select(*names).join(after, names, "left_anti").withColumn("change", F.lit("removed")))


def handler_churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(service, added, removed, changed): handlers by id, changed where the hash differs."""
    b = before.groupBy("service", "id").agg(F.max_by("hash", "i_ord").alias("b_hash"), F.lit(1).alias("b"))
    a = after.groupBy("service", "id").agg(F.max_by("hash", "i_ord").alias("a_hash"), F.lit(1).alias("a"))
    both = b.join(a, ["service", "id"], "full")
    count = lambda c: F.count_if(c).alias
    return both.groupBy("service").agg(count(F.col("b").isNull())("added"), count(F.col("a").isNull())("removed"), count(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a_hash").eqNullSafe(F.col("b_hash")))("changed"))


def summary(delta: DataFrame, churn: DataFrame) -> DataFrame:
    """(service, has_changes, new_dependencies) of every service in the churn or the changes."""
    d = delta.groupBy("service").agg(F.lit(True).alias("moved"), F.bool_or((F.col("change") == "added") & F.col("facet").isin("calls", "publishes")).alias("new"))
    out = churn.join(d, "service", "full")
    grown = F.coalesce(F.col("added") + F.col("removed") + F.col("changed"), F.lit(0)) > 0
    return out.select("service", (F.coalesce("moved", F.lit(False)) | grown).alias("has_changes"), F.coalesce("new", F.lit(False)).alias("new_dependencies"))


TITLES = {"endpoints": "Endpoints", "consumers": "Message consumers", "calls": "Outbound HTTP calls", "publishes": "Publishes"}


def markdown(before: Estate, after: Estate, title: str = "service graph") -> DataFrame:
    """(service, text): the change report of each service of ``after``."""
    b, a = facet_keys(before), facet_keys(after)
    delta, churn = changes(b, a), handler_churn(before.handlers, after.handlers)
    mark = F.when(F.col("change") == "added", F.lit("- ➕ `")).otherwise(F.lit("- ➖ `"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("change", "key", F.concat(mark, "key", F.lit("`")).alias("line")))), lambda x: x["line"])
    parts = delta.groupBy("service").pivot("facet", list(FACETS)).agg(F.array_join(lines, "\n"))
    out = after.services.select(F.col("id").alias("service")).join(summary(delta, churn), "service", "left").join(parts, "service", "left").join(churn, "service", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    sections = [F.when(F.coalesce(F.col(f), F.lit('')) != '', F.concat(F.lit(f"\n\n**{TITLES[f]}**\n"), f)).otherwise("") for f in FACETS]
    counts = F.concat(F.lit("\n\nHandlers: "), n("added"), F.lit(" added, "), n("changed"), F.lit(" changed, "), n("removed"), F.lit(" removed."))
    warning = F.when(F.coalesce("new_dependencies", F.lit(False)), F.lit("\n\n> ⚠️ This change introduces a new outbound dependency. Make sure the aggregation targets can resolve it, or it will show as unresolved in the flow map.")).otherwise("")
    body = F.when(F.coalesce("has_changes", F.lit(False)), F.concat(*sections, counts, warning)).otherwise("\n\nNo changes to endpoints, consumers, outbound calls or publishes.")
    return out.select("service", F.concat(F.lit(f"### {title}: "), "service", body).alias("text"))

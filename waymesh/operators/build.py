"""The property graph of an estate: nodes, edges and issues."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.session import cut, numbered
from ..schema import LOC
from .estate import Config, Estate
from .resolve import resolve

EDGE = {"id": "string", "kind": "string", "source": "string", "target": "string", "fromHandler": "string", "endpoint": "string", "routingKey": "string", "method": "string", "url": "string", "status": "string", "resolution": "string", "confidence": "double", "loc": LOC, "ord": "array<int>"}
ISSUE = {"level": "string", "code": "string", "service": "string", "message": "string", "loc": LOC}


def shaped(df: DataFrame, columns: dict[str, str], **values: Column | str | float) -> DataFrame:
    """``columns`` of ``df``, from ``values`` (text and numbers are literals), from columns of that name, or null."""
    out = []
    for name, kind in columns.items():
        v = values.get(name)
        c = v if isinstance(v, Column) else F.lit(v) if v is not None else F.col(f"`{name}`") if name in df.columns and name not in values else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def place(phase: int, *columns: Column | str) -> Column:
    return F.array(F.lit(phase), *(fn.col(c).cast("int") for c in columns))


def service_nodes(e: Estate) -> DataFrame:
    """Service nodes with the sizes of their manifests."""
    out = e.services
    for name in ("endpoints", "consumers", "calls", "publishes"):
        n = getattr(e, name).groupBy("service").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(n, out.id == n.service, "left").drop("service")
    counts = (F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("endpoints", "consumers", "calls", "publishes"))
    return out.select("m_ord", "id", "name", "layer", "owner", "repo", "language", "frameworks", "description", "tags", F.lit(False).alias("inferred"), *counts)


def endpoint_nodes(e: Estate) -> DataFrame:
    return e.endpoints.select(fn.endpoint_node("service", "id").alias("node"), *e.endpoints.columns)


def handler_nodes(e: Estate) -> DataFrame:
    return e.handlers.select(fn.endpoint_node("service", "id").alias("node"), *e.handlers.columns)


def internal_edges(e: Estate) -> DataFrame:
    rows = e.handlers.select("m_ord", "i_ord", "service", F.col("id").alias("caller"), "loc", F.posexplode("calls").alias("c_ord", "callee"))
    name = F.concat(F.lit("internal:"), F.col("service"), F.lit(":"), F.col("caller"), F.lit("->"), F.col("callee"))
    return shaped(rows, EDGE, id=name, kind="internal", source=fn.handler_node("service", "caller"), target=fn.handler_node("service", "callee"), status="declared", resolution="static", confidence=0.9, ord=place(0, "m_ord", "i_ord", "c_ord"))


def passed_issues(e: Estate) -> DataFrame:
    return shaped(e.issues, ISSUE, code=F.concat(F.lit("extract:"), F.col("code")))


def listened(c: str = "topic") -> Column:
    """The topic a consumer hears: a RabbitMQ exchange, if it is bound to one."""
    return F.when((F.col("broker") == "rabbitmq") & fn.truthy("exchange").isNotNull(), F.col("exchange")).otherwise(F.col(c))


def topic_nodes(e: Estate) -> DataFrame:
    pub = e.publishes.select("broker", F.col("topic").alias("name"), place(0, "m_ord", F.lit(0), "i_ord").alias("ord"))
    con = e.consumers.select("broker", listened().alias("name"), place(0, "m_ord", F.lit(1), "i_ord").alias("ord"))
    return pub.union(con).groupBy("broker", "name").agg(F.min("ord").alias("ord")).select(fn.topic_node("broker", "name").alias("id"), "broker", "name", "ord")


def publish_edges(e: Estate) -> DataFrame:
    return shaped(e.publishes, EDGE, id=F.concat(F.lit("publish:"), F.col("service"), F.lit(":"), F.col("id")), kind="publish", source=F.col("service"), target=fn.topic_node("broker", "topic"), fromHandler=fn.handler_node("service", "fromHandler"), status="declared", resolution="static", confidence=0.95, ord=place(1, "m_ord", F.lit(0), "i_ord"))


def consume_edges(e: Estate) -> DataFrame:
    return shaped(e.consumers, EDGE, id=F.concat(F.lit("consume:"), F.col("service"), F.lit(":"), F.col("id")), kind="consume", source=fn.topic_node("broker", listened()), target=F.col("service"), fromHandler=fn.handler_node("service", "handler"), routingKey=F.coalesce("routingKey", "group"), status="declared", resolution="static", confidence=0.95, ord=place(1, "m_ord", F.lit(1), "i_ord"))


def orphan_topics(topics: DataFrame, edges: DataFrame) -> DataFrame:
    out = []
    for kind, end, word in (("publish", "target", "publisher"), ("consume", "source", "consumer")):
        lone = topics.join(edges.filter(F.col("kind") == kind).select(F.col(end).alias("id")), "id", "left_anti")
        role = "producer" if word == "publisher" else "consumer"
        message = F.concat(F.lit(f"No {word} found in the estate for "), F.col("broker"), F.lit(' topic "'), F.col("name"), F.lit(f'" (external {role}?)'))
        out.append(shaped(lone, ISSUE, level="info", code=f"topic:no-{word}", message=message, service=None))
    return out[0].union(out[1])


def http_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each pair: resolution of the first call with the highest confidence, place of the first call."""
    at = F.struct("m_ord", "i_ord")
    g = resolved.groupBy("service", "target").agg(F.max_by("resolution", F.struct("confidence", -F.col("i_ord"))).alias("resolution"), F.max("confidence").alias("confidence"), F.min_by("loc", at).alias("loc"), F.min(at).alias("at"))
    pair = F.concat(F.lit("http:"), F.col("service"), F.lit("->"), F.col("target"))
    return shaped(g, EDGE, id=pair, kind="http", source=F.col("service"), target=F.col("target"), status="declared", ord=place(2, F.col("at.m_ord"), F.col("at.i_ord"), F.lit(0)))


def detail_edges(resolved: DataFrame) -> DataFrame:
    r = resolved.withColumn("endpoint", F.when(F.col("ep").isNotNull(), F.concat("target", F.lit("#"), F.col("ep.id"))))
    name = F.concat(F.lit("http-detail:"), F.col("service"), F.lit(":"), F.col("id"))
    source = fn.handler_node("service", "fromHandler")
    return shaped(r, EDGE, id=name, kind="http-detail", source=source, target=F.coalesce("endpoint", "target"), fromHandler=source, status="declared", ord=place(2, "m_ord", "i_ord", F.lit(1)), routingKey=None)


def unmatched_endpoints(resolved: DataFrame, services: DataFrame) -> DataFrame:
    rows = resolved.filter("ep is null").filter(~F.col("target").startswith("external:"))
    message = F.concat(F.lit("Resolved "), F.coalesce("method", F.lit("HTTP")), F.lit(" "), F.col("url"), F.lit(" to "), F.col("target"), F.lit(" but no endpoint matched its path"))
    return shaped(rows, ISSUE, level="info", code="call:endpoint-unmatched", message=message)


def external_nodes(resolved: DataFrame, config: Config = Config()) -> DataFrame:
    """External systems in order of first reference, with what the settings tell of them."""
    spark = resolved.sparkSession
    first = resolved.filter("outer is not null").groupBy(F.col("target").alias("id")).agg(F.min_by("outer", F.struct("m_ord", "i_ord")).alias("host"), F.min(F.struct("m_ord", "i_ord")).alias("at"))
    told = [(k, v.get("name"), v.get("owner"), v.get("description"), v.get("tags")) for k, v in config.externals.items()]
    x = spark.createDataFrame(told, "key string, x_name string, x_owner string, x_description string, x_tags array<string>")
    by_host, by_id = x.select(F.col("key").alias("host"), F.struct("*").alias("h")), x.select(F.col("key").alias("id"), F.struct("*").alias("i"))
    out = first.join(by_host, "host", "left").join(by_id, "id", "left").withColumn("x", F.coalesce("h", "i"))
    zero = (F.lit(0).cast("long").alias(f"n_{n}") for n in ("endpoints", "consumers", "calls", "publishes"))
    none = lambda n, t="string": F.lit(None).cast(t).alias(n)
    out = numbered(out, "place", "at")
    return out.select((F.lit(1 << 20) + F.col("place") - 1).alias("m_ord"), "id", F.coalesce("x.x_name", "host").alias("name"), F.lit("external").alias("layer"), F.col("x.x_owner").alias("owner"), none("repo"), none("language"), none("frameworks", "array<string>"), F.coalesce("x.x_description", F.concat(F.lit("External system at "), "host")).alias("description"), F.col("x.x_tags").alias("tags"), F.lit(True).alias("inferred"), *zero)


def declared_edges(e: Estate, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, issues) of declared dependencies. An external system counts as known once an earlier call has named it."""
    from .resolve import known_nodes

    outer = resolved.filter("outer is not null").groupBy(F.col("target").alias("x_node")).agg(F.min("m_ord").alias("x_ord"))
    d = e.declared.join(known_nodes(e), F.col("dep_service") == F.col("node"), "left").join(outer, F.col("dep_service") == F.col("x_node"), "left")
    d = d.withColumn("known", F.col("node").isNotNull() | (F.coalesce(F.col("x_ord") <= F.col("m_ord"), F.lit(False))))
    message = F.concat(F.lit('Declared dependency on unknown service "'), F.col("dep_service"), F.lit('"'))
    issues = shaped(d.filter("not known"), ISSUE, level="warn", code="declared:unknown-service", message=message, loc=None)
    pairs = resolved.select("service", F.col("target").alias("dep_service")).distinct()
    new = d.filter("known").join(pairs, ["service", "dep_service"], "left_anti").groupBy("service", "dep_service", "m_ord").agg(F.min("i_ord").alias("i_ord"))
    name = F.concat(F.lit("declared:"), F.col("service"), F.lit("->"), F.col("dep_service"))
    edges = shaped(new, EDGE, id=name, kind="declared", source=F.col("service"), target=F.col("dep_service"), status="declared", resolution="config", confidence=1.0, ord=place(2, "m_ord", F.lit(1 << 30), "i_ord"))
    return edges, issues


@dataclass(frozen=True)
class Graph:
    """services: manifest services, then external ones; edges and issues in their order of making (``ord``)."""

    estate: Estate
    services: DataFrame
    topics: DataFrame
    endpoints: DataFrame
    handlers: DataFrame
    edges: DataFrame
    issues: DataFrame
    resolved: DataFrame
    config: Config

    def replace(self, **changes) -> Graph:
        return replace(self, **changes)


def nodes(g: Graph) -> DataFrame:
    """All nodes by id and kind; where an endpoint and a handler share an id, the handler is the node."""
    parts = [g.services.select("id", F.lit("service").alias("kind"), F.lit(0).alias("k")), g.endpoints.select(F.col("node").alias("id"), F.lit("endpoint"), F.lit(1)), g.handlers.select(F.col("node").alias("id"), F.lit("handler"), F.lit(2)), g.topics.select("id", F.lit("topic"), F.lit(0))]
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.max_by("kind", "k").alias("kind"))


def build_graph(estate: Estate, config: Config = Config()) -> Graph:
    e = estate.without(config.ignore).written()
    resolved, call_issues = resolve(e, config)
    services, topics = service_nodes(e), topic_nodes(e)
    messages = publish_edges(e).union(consume_edges(e))
    declared, declared_issues = declared_edges(e, resolved)
    edges = reduce(DataFrame.unionByName, [internal_edges(e), messages, http_edges(resolved), detail_edges(resolved), declared])
    issues = reduce(DataFrame.unionByName, [passed_issues(e), orphan_topics(topics, messages), call_issues.select(*ISSUE), unmatched_endpoints(resolved, services), declared_issues])
    return Graph(e, services.unionByName(external_nodes(resolved, config)), topics, endpoint_nodes(e), handler_nodes(e), cut(edges), cut(issues), resolved, config)

"""Questions about a built graph: filters, searches, neighbourhoods, impact and detail tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from .build import Graph
from .condense import Condensed, condensed
from .reach import neighbourhood

MAP_KINDS = ("http", "publish", "consume", "declared")


@dataclass(frozen=True)
class GraphQuery:
    """What is shown. Empty sets mean everything."""

    layers: frozenset[str] = frozenset()
    owners: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()
    statuses: frozenset[str] = frozenset()
    hide_external: bool = False
    collapse_topics: bool = False
    focus: str = ""
    upstream: int = 1
    downstream: int = 1
    search: str = ""
    view: str = "map"
    flow: str = ""
    service: str = ""
    edge: str = ""
    step: int = 0

    def to_hash(self) -> str:
        """As URL parameters; defaults are left out."""
        plain = GraphQuery()
        show = lambda v: ",".join(sorted(v)) if isinstance(v, frozenset) else str(int(v)) if isinstance(v, bool | int) else v
        return urlencode([(k, show(v)) for k, v in self.__dict__.items() if v != getattr(plain, k)])

    @classmethod
    def from_hash(cls, text: str) -> GraphQuery:
        """From URL parameters; unknown ones are ignored, and numbers that are none are the default."""
        plain, got = cls(), {}
        for k, v in parse_qsl(text.lstrip("#")):
            if k in plain.__dict__:
                kind = type(getattr(plain, k))
                if kind is frozenset:
                    got[k] = frozenset(x for x in v.split(",") if x)
                elif kind is bool:
                    got[k] = v in ("1", "true")
                elif kind is int:
                    got[k] = int(v) if v.lstrip("-").isdigit() else getattr(plain, k)
                else:
                    got[k] = v
        return cls(**got)


def index(g: Graph) -> DataFrame:
    """(service, n_out, n_in, n_endpoints, n_handlers, n_issues) of each service."""
    out = g.services.select(F.col("id").alias("service"))
    for name, rows, key in (("n_out", g.edges, "source"), ("n_in", g.edges, "target"), ("n_endpoints", g.endpoints, "service"), ("n_handlers", g.handlers, "service"), ("n_issues", g.issues, "service")):
        out = out.join(rows.groupBy(F.col(key).alias("service")).agg(F.count("*").alias(name)), "service", "left")
    return out.na.fill(0)


def owners(services: DataFrame) -> DataFrame:
    return services.filter(fn.truthy("owner").isNotNull()).select("owner").distinct()


def map_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind").isin(*MAP_KINDS))


def flow_by_entry(flows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(node, flow_id): the last flow, in rank order, that each endpoint begins."""
    entry = flows.groupBy(fn.qualify_ref("entry_service", "entry_ref").alias("node")).agg(F.max_by("flow_id", "rank").alias("flow_id"))
    return endpoints.select("node").join(entry, "node")


def detail_edges(edges: DataFrame, handlers: DataFrame, service: str | None = None, target: str | None = None) -> DataFrame:
    """http-detail edges from a service's handlers, perhaps to one service only."""
    own = handlers.select(F.col("node").alias("source"), F.col("service").alias("from_service"))
    out = edges.filter("kind = 'http-detail'").join(own.distinct(), "source")
    if service is not None:
        out = out.filter(F.col("from_service") == service)
    return out if target is None else out.filter((F.col("target") == target) | F.col("target").startswith(target + "#"))


def target_services(edges: DataFrame, endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """(id, target_service) of edges: the service of an endpoint or handler, else the text before the first #."""
    known = endpoints.select(F.col("node").alias("target"), "service").union(handlers.select("node", "service")).distinct()
    return edges.join(known, "target", "left").select("id", F.coalesce("service", F.substring_index("target", "#", 1)).alias("target_service"))


def flows_of_services(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(service, flow_id) for each service that begins a flow or takes a step in it."""
    return flows.select(F.col("entry_service").alias("service"), "flow_id").union(steps.select("service", "flow_id")).distinct()


def call_graph(internal: DataFrame, entries: DataFrame) -> Condensed:
    """The condensed graph of internal edges, with the entries (entry) that have none."""
    return condensed(internal.select(F.col("source").alias("src"), F.col("target").alias("dst")), entries.select(F.col("entry").alias("node")))


def reachable_handlers(internal: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, handler): handler nodes that each entry handler node reaches inside its service, itself included."""
    c = call_graph(internal, entries)
    return c.pairs(entries.select(F.col("entry").alias("seed")), c.reach()).select(F.col("seed").alias("entry"), F.col("node").alias("handler"))


def reachable_counts(internal: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, n): how many handlers each entry reaches, itself included, without a row for each of them."""
    c = call_graph(internal, entries)
    return entries.select("entry").distinct().join(c.nodes.select(F.col("node").alias("entry"), "comp"), "entry").join(c.sizes(c.reach()), "comp").select("entry", "n")


def set_off(edges: DataFrame) -> DataFrame:
    """Edges out of services with the handler node (by) that sets them off: map edges that name their handler, and call details."""
    service_level = edges.filter(F.col("kind").isin("http", "publish", "declared") & F.col("fromHandler").isNotNull()).withColumn("by", fn.handler_node("source", "fromHandler"))
    return service_level.unionByName(edges.filter("kind = 'http-detail'").withColumn("by", F.col("source")))


def outbound(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(entry, edge...): edges out of the service by the reached handlers."""
    return set_off(edges).join(reached, F.col("by") == F.col("handler")).drop("by", "handler")


def outbound_counts(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, kind, n): how many edges of each kind each entry sets off, itself and through the handlers that it reaches. Counted on the condensed graph: an edge belongs to one handler, so counts add up."""
    c = call_graph(edges.filter("kind = 'internal'"), entries)
    weights = set_off(edges).groupBy(F.col("by").alias("node"), "kind").agg(F.count("*").alias("n"))
    sums = c.weigh(weights, c.reach(), "kind")
    return entries.select("entry").distinct().join(c.nodes.select(F.col("node").alias("entry"), "comp"), "entry").join(sums, "comp").select("entry", "kind", "n")


def target_counts(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, n): how many different targets the edges have that each entry sets off, service-level calls left out."""
    c = call_graph(edges.filter("kind = 'internal'"), entries)
    sums = c.union(set_off(edges).filter("kind <> 'http'").select(F.col("by").alias("node"), F.col("target").alias("item")).distinct())
    return entries.select("entry").distinct().join(c.nodes.select(F.col("node").alias("entry"), "comp"), "entry").join(sums, "comp").select("entry", "n")


def endpoint_impact(g: Graph, endpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((endpoint, handler), (endpoint, edge...)): all that endpoints set off inside their services and out of them."""
    eps = (g.endpoints if endpoints is None else endpoints).select(F.col("node").alias("endpoint"), fn.handler_node("service", "handler").alias("entry"))
    reached = reachable_handlers(g.edges.filter("kind = 'internal'"), eps.select("entry").distinct())
    out = outbound(g.edges.drop("ord", "loc").withColumnRenamed("endpoint", "called"), reached)
    return eps.join(reached, "entry").select("endpoint", "handler"), eps.join(out, "entry").drop("entry")


def headline(g: Graph, flows: DataFrame) -> DataFrame:
    """One row: services, endpoints, topics, edges, unresolved, flows, issues."""
    e = map_edges(g.edges).agg(F.count("*").alias("edges"), F.count_if((F.col("resolution") == "unresolved") | (F.col("confidence") < 0.5)).alias("unresolved"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return reduce(DataFrame.crossJoin, [count(g.services, "services"), count(g.endpoints, "endpoints"), count(g.topics, "topics"), e, count(flows, "flows"), count(g.issues, "issues")])


def collapsed_topics(edges: DataFrame) -> DataFrame:
    """Publish edges straight from publishers to consumers (id via:publisher>consumer edge ids), instead of both messaging edges."""
    p = edges.filter("kind = 'publish'").select(F.col("id").alias("p"), "source", F.col("target").alias("topic"), "confidence")
    c = edges.filter("kind = 'consume'").select(F.col("id").alias("c"), F.col("source").alias("topic"), "target")
    return p.join(c, "topic").select(F.concat(F.lit("via:"), "p", F.lit(">"), "c").alias("id"), F.lit("publish").alias("kind"), "source", "target", fn.sub("topic", "^[^:]*:[^:]*:").alias("url"), "confidence")


def visible(g: Graph, q: GraphQuery) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the filters leave; edges with a hidden end and topics without an edge go."""
    s = g.services
    if q.layers:
        s = s.filter(F.col("layer").isin(*q.layers))
    if q.owners:
        s = s.filter(F.col("owner").isin(*q.owners))
    if q.hide_external:
        s = s.filter("layer <> 'external'")
    columns = ["id", "kind", "source", "target", "url", "status", "confidence"]
    e = map_edges(g.edges).select(*columns)
    if q.collapse_topics:
        via = collapsed_topics(g.edges).withColumn("status", F.lit("declared")).select(*columns)
        e = e.filter("kind not in ('publish', 'consume')").union(via)
    if q.kinds:
        e = e.filter(F.col("kind").isin(*q.kinds))
    if q.statuses:
        e = e.filter(F.col("status").isin(*q.statuses))
    nodes = s.select("id", F.lit("service").alias("kind"))
    if not q.collapse_topics:
        nodes = nodes.union(g.topics.select("id", F.lit("topic")))
    if q.focus:
        near, _ = neighbourhood(map_edges(g.edges), g.services.filter(F.col("id") == q.focus).select(F.col("id").alias("origin")), q.upstream, q.downstream)
        nodes = nodes.join(near.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    ends = lambda side: nodes.select(F.col("id").alias(side))
    e = e.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")
    used = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return nodes.filter("kind = 'service'").union(nodes.filter("kind = 'topic'").join(used, "id", "left_semi")), e.select(*columns)


def contains(c: Column | str, text: str) -> Column:
    return F.coalesce(F.contains(F.lower(fn.col(c)), F.lit(text.lower())), F.lit(False))


def search_nodes(g: Graph, text: str) -> DataFrame:
    """Ids of services and topics that have the text in a name, tag, framework or endpoint path."""
    within = lambda c: F.coalesce(F.exists(c, lambda x: contains(x, text)), F.lit(False))
    by_path = g.endpoints.filter(contains("path", text)).select(F.col("service").alias("id"))
    s = g.services.filter(reduce(lambda a, b: a | b, [*(contains(c, text) for c in ("id", "name", "owner", "description")), within("tags"), within("frameworks")])).select("id")
    t = g.topics.filter(contains("name", text) | contains("broker", text)).select("id")
    return s.union(by_path.join(g.services.select("id"), "id", "left_semi")).union(t).distinct()


def dimmed(nodes: DataFrame, matches: DataFrame | None = None, near: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(id, dim): nodes outside any of the given sets of ids."""
    out = nodes.select("id").withColumn("dim", F.lit(False))
    for some in (matches, near, ends):
        if some is not None:
            out = out.join(some.select("id").distinct().withColumn("__in", F.lit(True)), "id", "left").withColumn("dim", F.col("dim") | F.col("__in").isNull()).drop("__in")
    return out


def endpoint_table(g: Graph, flows: DataFrame, text: str = "") -> DataFrame:
    """(node, service, service_name, layer, method, path, handler, downstream, has_flow) per endpoint."""
    entries = g.endpoints.select("node", fn.handler_node("service", "handler").alias("entry"))
    down = entries.join(target_counts(g.edges, entries), "entry").select("node", F.col("n").alias("downstream"))
    s = g.services.select(F.col("id").alias("service"), F.col("name").alias("service_name"), "layer")
    f = flow_by_entry(flows, g.endpoints).withColumn("has_flow", F.lit(True)).drop("flow_id")
    out = g.endpoints.join(s, "service", "left").join(down, "node", "left").join(f, "node", "left")
    out = out.select("node", "service", F.coalesce("service_name", "service").alias("service_name"), F.coalesce("layer", F.lit("unknown")).alias("layer"), "method", "path", "handler", "summary", F.coalesce("downstream", F.lit(0)).alias("downstream"), F.coalesce("has_flow", F.lit(False)).alias("has_flow"))
    if text:
        out = out.filter(reduce(lambda a, b: a | b, (contains(c, text) for c in ("path", "method", "service", "service_name", "handler", "summary"))))
    return out


SORTS = {"service": ["service_name", "path"], "path": ["path"], "method": ["method", "path"], "layer": ["__layer", "service_name", "path"], "downstream": ["downstream", "path"]}


def sort_endpoints(table: DataFrame, by: str = "service", descending: bool = False) -> DataFrame:
    first, *rest = SORTS[by]
    table = table.withColumn("__layer", fn.layer_index("layer"))
    return table.orderBy(F.desc(first) if descending else F.asc(first), *rest, "node").drop("__layer")


def issue_table(issues: DataFrame, levels: tuple[str, ...] = (), code: str = "", text: str = "") -> DataFrame:
    out = issues
    if levels:
        out = out.filter(F.col("level").isin(*levels))
    if code:
        out = out.filter(F.col("code") == code)
    if text:
        out = out.filter(reduce(lambda a, b: a | b, (contains(c, text) for c in ("code", "message", "service", "loc.file"))))
    return out


def search_flows(flows: DataFrame, steps: DataFrame, text: str) -> DataFrame:
    """(flow_id, services): flows with the text in their names, entry or steps' services; and how many services they touch."""
    s = steps.groupBy("flow_id").agg(F.countDistinct("service").alias("services"), F.bool_or(contains("service", text)).alias("hit"))
    out = flows.join(s, "flow_id")
    own = reduce(lambda a, b: a | b, (contains(c, text) for c in ("name", "useCase", "description", "entry_service")))
    return out.filter(own | F.col("hit")).select("flow_id", "services")


def service_detail(g: Graph, flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(service, consumes, calls, publishes, inbound, issues, flows): the tab counts of each service."""
    count = lambda df, key, name, what="*": df.groupBy(F.col(key).alias("service")).agg((F.countDistinct(what) if what != "*" else F.count("*")).alias(name))
    of = lambda *kinds: g.edges.filter(F.col("kind").isin(*kinds))
    parts = [count(of("consume"), "target", "consumes"), count(of("http", "declared"), "source", "calls"), count(of("publish"), "source", "publishes"), count(of("http", "declared"), "target", "inbound", "source"), count(g.issues.filter("service is not null"), "service", "issues"), count(flows_of_services(flows, steps), "service", "flows")]
    return reduce(lambda a, b: a.join(b, "service", "left"), parts, g.services.select(F.col("id").alias("service"))).na.fill(0)


def calls_with_details(g: Graph) -> DataFrame:
    """(edge, source, target, details): service edges with the ids of the call details under them."""
    d = detail_edges(g.edges, g.handlers).join(target_services(g.edges, g.endpoints, g.handlers), "id").groupBy(F.col("from_service").alias("source"), F.col("target_service").alias("target")).agg(F.sort_array(F.collect_list("id")).alias("details"))
    e = g.edges.filter("kind in ('http', 'declared')").select(F.col("id").alias("edge"), "source", "target")
    return e.join(d, ["source", "target"], "left").select("edge", "source", "target", F.coalesce("details", F.array().cast("array<string>")).alias("details"))


def impact_rows(impact_edges: DataFrame, targets: DataFrame) -> DataFrame:
    """An endpoint's outbound edges without http edges whose target a detail edge covers already. ``targets``: id, target_service."""
    e = impact_edges.join(targets, "id")
    covered = e.filter("kind = 'http-detail'").select("endpoint", "target_service").distinct()
    return e.filter("kind <> 'http'").unionByName(e.filter("kind = 'http'").join(covered, ["endpoint", "target_service"], "left_anti"))


def topic_detail(g: Graph) -> DataFrame:
    """(topic, publishers, consumers): sorted services of each topic."""
    p = g.edges.filter("kind = 'publish'").groupBy(F.col("target").alias("topic")).agg(F.sort_array(F.collect_set("source")).alias("publishers"))
    c = g.edges.filter("kind = 'consume'").groupBy(F.col("source").alias("topic")).agg(F.sort_array(F.collect_set("target")).alias("consumers"))
    none = F.array().cast("array<string>")
    return g.topics.select(F.col("id").alias("topic")).join(p, "topic", "left").join(c, "topic", "left").select("topic", F.coalesce("publishers", none).alias("publishers"), F.coalesce("consumers", none).alias("consumers"))


def edge_detail(g: Graph) -> DataFrame:
    """(id, source_service, target_service) of every edge."""
    known = g.endpoints.select("node", "service").union(g.handlers.select("node", "service")).distinct()
    out = g.edges.select("id", "source", "target")
    for side in ("source", "target"):
        out = out.join(known.select(F.col("node").alias(side), F.col("service").alias(f"__{side}")), side, "left").withColumn(f"{side}_service", F.coalesce(f"__{side}", F.substring_index(side, "#", 1)))
    return out.select("id", "source_service", "target_service")


def present_layers(services: DataFrame) -> DataFrame:
    return services.select("layer").distinct().withColumn("place", fn.layer_index("layer")).orderBy("place")


def topic_ranks(g: Graph) -> DataFrame:
    """(id, rank): columns of the map: a service's is twice its layer's place; a topic's is after its last publisher, else before its first consumer, else before processors."""
    s = g.services.select("id", (fn.layer_index("layer") * 2).alias("rank"))
    at = s.select(F.col("id").alias("end"), F.col("rank").alias("r"))
    p = g.edges.filter("kind = 'publish'").join(at, F.col("source") == F.col("end")).groupBy(F.col("target").alias("id")).agg(F.max("r").alias("p"))
    c = g.edges.filter("kind = 'consume'").join(at, F.col("target") == F.col("end")).groupBy(F.col("source").alias("id")).agg(F.min("r").alias("c"))
    processor = 2 * fn.LAYERS.index("processor") - 1
    t = g.topics.select("id").join(p, "id", "left").join(c, "id", "left")
    return s.union(t.select("id", F.coalesce(F.col("p") + 1, F.greatest(F.lit(0), F.col("c") - 1), F.lit(processor)).cast("int")))


def drill_targets(endpoints: DataFrame, flows: DataFrame) -> DataFrame:
    """(node, view, target): where an endpoint leads: its flow, or else its service on the map."""
    f = flow_by_entry(flows, endpoints)
    return endpoints.select("node", "service").join(f, "node", "left").select("node", F.when(F.col("flow_id").isNotNull(), "flow").otherwise("map").alias("view"), F.coalesce("flow_id", "service").alias("target"))

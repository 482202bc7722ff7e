"""End-to-end flows: ordered, path-sensitive expansion from entry points across services.

Inside a service the order is that of a depth-first walk over its handlers, computed for each service by itself. Across
services sub-flows are shared: forwards, each is found once a hop; backwards, their sizes are summed; then flows are laid
out by offsets, from rows of numbers alone, and the text of steps is joined at the end.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.session import cut, numbered
from .build import Graph
from .condense import bit

#: Hops that one job looks ahead before its rows are written.
ROUNDS = 4


def walks(handlers: DataFrame, entries: DataFrame) -> DataFrame:
    """(service, entry, pos, handler): handlers reachable inside the service from each entry, in depth-first pre-order."""
    schema = pa.schema([("service", pa.string()), ("entry", pa.string()), ("pos", pa.int32()), ("handler", pa.string())])

    def walk(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        calls: dict[str, list[str]] = {}
        for id, to, _ in sorted(zip(mine["id"].to_pylist(), mine["calls"].to_pylist(), mine["i_ord"].to_pylist()), key=lambda r: r[2]):
            calls[id] = to or []
        rows = []
        for entry in theirs["entry"].to_pylist():
            seen: dict[str, None] = {}
            stack = [entry]
            while stack:
                h = stack.pop()
                if h not in seen:
                    seen[h] = None
                    stack.extend(reversed(calls.get(h, [])))
            rows += [(key[0].as_py(), entry, i, h) for i, h in enumerate(seen)]
        return pa.table([list(c) for c in zip(*rows)] or [[]] * 4, schema=schema)

    own = handlers.select("service", "id", "calls", "i_ord").groupBy("service")
    return own.cogroup(entries.select(F.col("service").alias("e_service"), "entry").distinct().groupBy("e_service")).applyInArrow(walk, "service string, entry string, pos int, handler string")


def topic_text(c: str):
    return fn.sub(c, "^[^:]*:[^:]*:")


def effects(g: Graph) -> DataFrame:
    """What each entry (service, handler) does, in order: (service, entry, k, step..., next_service, next_handler)."""
    e = g.estate
    entries = e.endpoints.select("service", F.col("handler").alias("entry")).union(e.consumers.select("service", "handler")).union(e.handlers.join(e.services.filter("layer = 'ui'").select(F.col("id").alias("service")), "service").select("service", "id"))
    order = walks(e.handlers, entries).withColumn("node", fn.handler_node("service", "handler"))
    eps = g.endpoints.select(F.col("node").alias("endpoint"), F.col("service").alias("ep_service"), F.col("handler").alias("ep_handler"))
    layers = g.services.select(F.col("id").alias("to"), "layer")
    http = g.edges.filter("kind = 'http-detail'").select(F.col("fromHandler").alias("node"), "endpoint", "target", "method", "url", F.col("ord")[2].alias("i"))
    http = http.join(eps, "endpoint", "left").withColumn("to", F.coalesce("ep_service", "target")).join(layers, "to", "left")
    kind = F.when(F.col("layer") == "external", "external").when(F.col("endpoint").isNotNull(), "endpoint").otherwise("call")
    http = order.join(http, "node").select("service", "entry", F.array("pos", F.lit(0), "i").alias("k"), F.col("to").alias("s_service"), F.coalesce("endpoint", "target").alias("s_ref"), kind.alias("s_kind"), F.col("service").alias("s_from"), fn.trimmed(F.concat_ws(" ", F.coalesce("method", F.lit("HTTP")), F.coalesce("url", F.lit("")))).alias("s_text"), F.when(F.col("endpoint").isNotNull(), F.col("ep_service")).alias("next_service"), F.col("ep_handler").alias("next_handler"))
    pub = g.edges.filter("kind = 'publish'").select(F.col("fromHandler").alias("node"), "target", "routingKey", F.col("ord")[3].alias("i"))
    pub = order.join(pub, "node")
    keyed = F.when(fn.truthy("routingKey").isNotNull(), F.concat(F.lit(" ("), "routingKey", F.lit(")"))).otherwise("")
    none = F.lit(None).cast("string")
    said = pub.select("service", "entry", F.array("pos", F.lit(1), "i").alias("k"), F.col("service").alias("s_service"), F.col("target").alias("s_ref"), F.lit("publish").alias("s_kind"), F.col("service").alias("s_from"), F.concat(F.lit("publish "), topic_text("target"), keyed).alias("s_text"), none.alias("next_service"), none.alias("next_handler"))
    con = g.edges.filter("kind = 'consume'").select(F.col("id").alias("c_id"), F.col("source").alias("topic"), F.col("target").alias("c_service"), "fromHandler", (F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1).alias("j"))
    heard = pub.join(con, pub.target == con.topic).select("service", "entry", F.array("pos", F.lit(1), "i", "j").alias("k"), F.col("c_service").alias("s_service"), F.col("c_id").alias("s_ref"), F.lit("consumer").alias("s_kind"), F.col("target").alias("s_from"), F.concat(F.lit("consume "), topic_text("target")).alias("s_text"), F.col("c_service").alias("next_service"), F.expr("substring(fromHandler, length(c_service) + 2)").alias("next_handler"))
    return reduce(DataFrame.unionByName, [http, said, heard])


def roots(g: Graph) -> DataFrame:
    """Entry points in their order: uncalled endpoints, consumers of topics that nobody publishes, and UI handlers that call."""
    e, c = g.estate, g.config
    detail = g.edges.filter("kind = 'http-detail'")
    eps = g.endpoints
    if not c.include_non_roots:
        eps = eps.join(detail.filter("endpoint is not null").select(F.col("endpoint").alias("node")), "node", "left_anti")
    lit, at = F.lit, lambda k: F.struct("m_ord", F.lit(k).alias("kind"), "i_ord").alias("at")
    route = F.concat_ws(" ", "method", "path")
    out = [eps.select(at(0), "service", lit("endpoint").alias("kind"), F.col("node").alias("ref"), F.col("handler").alias("entry"), route.alias("text"), fn.flow_slug(F.concat_ws("-", lit("flow"), "service", "method", "path")).alias("flow_id"), route.alias("name"))]
    published = g.edges.filter("kind = 'publish'").select(F.col("target").alias("source"))
    lone = g.edges.filter("kind = 'consume'").join(published, "source", "left_anti").select(F.col("id").alias("ref"))
    con = e.consumers.withColumn("ref", F.concat(lit("consume:"), "service", lit(":"), "id")).join(lone.distinct(), "ref")
    out.append(con.select(at(1), "service", lit("consumer").alias("kind"), "ref", F.col("handler").alias("entry"), F.concat(lit("consume "), "topic").alias("text"), fn.flow_slug(F.concat_ws("-", lit("flow"), "service", lit("consume"), "topic")).alias("flow_id"), F.concat(lit("on "), "topic").alias("name")))
    ui = g.handlers.join(e.services.filter("layer = 'ui'").select(F.col("id").alias("service"), F.col("name").alias("s_name")), "service").join(detail.select(F.col("fromHandler").alias("node")), "node", "left_semi")
    out.append(ui.select(at(2), "service", lit("handler").alias("kind"), F.col("node").alias("ref"), F.col("id").alias("entry"), F.col("name").alias("text"), fn.flow_slug(F.concat_ws("-", lit("flow"), "service", "id")).alias("flow_id"), F.concat(F.col("s_name"), lit(": "), F.col("name")).alias("name")))
    return reduce(DataFrame.union, out)


def returns(edges: DataFrame, hops: int) -> DataFrame:
    """(at, back) of the nodes of edges (src, dst: long) on a cycle of at most ``hops``; back: word to bits of the nodes of such cycles that the node reaches in as many hops."""
    direct = reach = edges.select("src", *bit("dst")).groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
    for hop in range(1, hops):
        further = edges.join(reach.withColumnRenamed("src", "dst"), "dst").select("src", "word", "bits")
        reach = direct.union(further).groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
        reach = reach if hop % ROUNDS else cut(reach)
    reach = cut(reach)
    looped = reach.select("src", "bits", F.col("word").alias("w"), *(c.alias(n) for c, n in zip(bit("src"), ("word", "own")))).filter("w = word and (bits & own) <> 0").select("src", "word", F.col("own").alias("bits"))
    mask = looped.groupBy("word").agg(F.bit_or("bits").alias("mask"))
    held = reach.join(looped.select("src"), "src", "left_semi").join(mask, "word").select("src", "word", F.expr("bits & mask").alias("bits")).filter("bits <> 0")
    return cut(held.groupBy(F.col("src").alias("at")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("back")))


def shared(acts: DataFrame, entries: DataFrame, max_depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Every sub-flow once for each hop at which it starts: ([(at, path, act, place, next_at, next_path, below) of a hop], sizes of the first).

    ``acts``: at, act (unique), k (its order), next_at (null: nothing follows). A sub-flow is a node and those nodes of the
    way to it that it can come back to in the hops that are left, so ways that differ elsewhere share it. ``place`` is where
    the act's step stands in its sub-flow, ``below`` the steps under it.
    """
    edges = acts.filter("next_at is not null").select(F.col("at").alias("src"), F.col("next_at").alias("dst")).distinct()
    back = returns(cut(edges), max_depth) if max_depth else None
    none = F.array().cast("array<long>")
    frontier, levels = entries.select("at", none.alias("path")).distinct(), []
    for depth in range(max_depth + 1):
        met = frontier.join(acts.select("at", "act", "k", "next_at"), "at")
        if depth == max_depth:
            met = met.withColumn("next_at", F.lit(None).cast("long")).withColumn("next_path", F.lit(None).cast("array<long>"))
        else:
            way = F.concat("path", F.array("at"))
            met = met.withColumn("way", way).withColumn("next_at", F.when(~F.array_contains("way", F.col("next_at")), F.col("next_at")))
            kept = F.expr("array_sort(filter(way, a -> (shiftrightunsigned(coalesce(back[a div 64], 0L), cast(a % 64 as int)) & 1L) = 1L))")
            met = met.join(back.withColumnRenamed("at", "next_at"), "next_at", "left").withColumn("next_path", F.when(F.col("next_at").isNotNull(), F.when(F.col("back").isNull(), none).otherwise(kept)))
        levels.append(cut(met.select("at", "path", "act", "k", "next_at", "next_path")))
        entered = levels[-1].filter("next_at is not null")
        if depth == max_depth or not entered.limit(1).count():
            break
        frontier = entered.select(F.col("next_at").alias("at"), F.col("next_path").alias("path")).distinct()
    sizes = None
    before = Window.partitionBy("at", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    for depth in reversed(range(len(levels))):
        met = levels[depth]
        if sizes is None:
            met = met.withColumn("below", F.lit(0).cast("long"))
        else:
            met = met.join(sizes.withColumnsRenamed({"at": "next_at", "path": "next_path", "n": "below"}), ["next_at", "next_path"], "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long")))
        place = F.coalesce(F.sum(F.col("below") + 1).over(before), F.lit(0)) + 1
        levels[depth] = cut(met.select("at", "path", "act", place.alias("place"), "next_at", "next_path", "below"))
        sizes = levels[depth].groupBy("at", "path").agg(F.sum(F.col("below") + 1).alias("n"))
    return levels, sizes.select("at", "n")


def placed(levels: list[DataFrame], flows: DataFrame) -> DataFrame:
    """(flow_id, step_no, act): the sub-flows of flows (flow_id, at) put where they belong; a flow's first step is its entry."""
    here = flows.select("flow_id", "at", F.array().cast("array<long>").alias("path"), F.lit(1).cast("long").alias("start"))
    steps = []
    for level in levels:
        rows = here.join(level, ["at", "path"]).select("flow_id", (F.col("start") + F.col("place")).alias("step_no"), "act", F.when(F.col("below") > 0, F.col("next_at")).alias("next_at"), "next_path")
        steps.append(cut(rows))
        here = steps[-1].filter("next_at is not null").select("flow_id", F.col("next_at").alias("at"), F.col("next_path").alias("path"), F.col("step_no").alias("start"))
    return reduce(DataFrame.union, (s.select("flow_id", F.col("step_no").cast("int").alias("step_no"), "act") for s in steps))


def derive_flows(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(flows, steps). flows: flow_id, name, entry_service, entry_kind, entry_ref, n_steps, rank. steps: flow_id, step_no, service, ref, kind, from, description.

    ``max_depth`` bounds the hops; a service and handler already on the path is not entered again, but its step stays.
    """
    todo = cut(effects(g).withColumn("act", F.monotonically_increasing_id()))
    nodes = cut(numbered(todo.select("service", "entry").distinct(), "at", "service", "entry", kind="long"))
    ahead = nodes.select(F.col("service").alias("next_service"), F.col("entry").alias("next_handler"), F.col("at").alias("next_at"))
    acts = cut(todo.join(nodes, ["service", "entry"]).join(ahead, ["next_service", "next_handler"], "left").select("at", "act", "k", "next_at"))
    start = cut(roots(g).withColumnRenamed("at", "place").join(nodes, ["service", "entry"]))
    levels, sizes = shared(acts, start, g.config.max_depth)
    flows = start.join(sizes, "at").withColumn("n_steps", (F.col("n") + 1).cast("int"))
    flows = cut(flows.withColumn("first", F.row_number().over(Window.partitionBy("flow_id").orderBy("place"))).filter("first = 1"))
    walked = placed(levels, flows).join(todo, "act").select("flow_id", "step_no", F.col("s_service").alias("service"), F.col("s_ref").alias("ref"), F.col("s_kind").alias("kind"), F.col("s_from").alias("from"), F.col("s_text").alias("description"))
    walked = flows.select("flow_id", F.lit(1).alias("step_no"), "service", "ref", "kind", F.lit(None).cast("string").alias("from"), F.col("text").alias("description")).union(walked)
    flows = numbered(flows, "rank", F.desc("n_steps"), "name", "flow_id")
    flows = flows.select("flow_id", "name", F.lit(None).cast("string").alias("useCase"), F.lit(None).cast("string").alias("description"), F.col("service").alias("entry_service"), F.col("kind").alias("entry_kind"), F.col("ref").alias("entry_ref"), "n_steps", "rank")
    return flows, walked

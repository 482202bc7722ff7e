"""Sequence diagrams from flows: arrows, lifelines and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn

DRAWN = ("endpoint", "external", "handler")


def current_service(steps: DataFrame) -> DataFrame:
    """Adds current: the service where the flow stands before the step (the last earlier step that is not a publish or call; the first step's own at the start)."""
    moves = F.when((F.col("step_no") == 1) | F.col("kind").isin("consumer", *DRAWN), F.col("service"))
    before = Window.partitionBy("flow_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("current", F.last(moves, True).over(before))


def inferred_callers(steps: DataFrame, service_edges: DataFrame) -> DataFrame:
    """(flow_id, step_no, caller): the nearest earlier step, not a publish, whose service calls the step's service."""
    calls = service_edges.filter("kind in ('http', 'declared')").select(F.col("source").alias("c_service"), F.col("target").alias("service")).distinct()
    asked = steps.filter(F.col("kind").isin(*DRAWN)).select("flow_id", "step_no", "service").join(calls, "service").filter("c_service <> service")
    earlier = steps.filter("kind <> 'publish'").select("flow_id", F.col("service").alias("c_service"), F.col("step_no").alias("j"))
    return asked.join(earlier, ["flow_id", "c_service"]).filter("j < step_no").groupBy("flow_id", "step_no").agg(F.max_by("c_service", "j").alias("caller"))


def inferred_topics(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow_id, step_no, topic): the nearest earlier publish to a topic that the step's service consumes, else the nearest earlier publish."""
    heard = edges.filter("kind = 'consume'").select(F.col("source").alias("ref"), F.col("target").alias("service")).distinct()
    asked = steps.filter("kind = 'consumer'").select("flow_id", "step_no", "service")
    said = steps.filter("kind = 'publish'").select("flow_id", F.col("step_no").alias("j"), F.col("ref").alias("ref"))
    own = said.join(heard, "ref").join(asked, ["flow_id", "service"]).filter("j < step_no").groupBy("flow_id", "step_no").agg(F.max_by("ref", "j").alias("own"))
    running = Window.partitionBy("flow_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    near = steps.withColumn("near", F.last(F.when(F.col("kind") == "publish", F.col("ref")), True).over(running)).filter("kind = 'consumer'").select("flow_id", "step_no", "near")
    return near.join(own, ["flow_id", "step_no"], "left").select("flow_id", "step_no", F.coalesce("own", "near").alias("topic"))


def matched_edges(arrows: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow_id, step_no, edge) for arrows (from, to, ref): the http or declared edge whose endpoint the ref ends with, else whose URL it holds, else the first."""
    e = edges.filter("kind in ('http', 'declared')").select(F.col("id").alias("edge"), F.col("source").alias("from"), F.col("target").alias("to"), "endpoint", "url", "ord")
    met = arrows.select("flow_id", "step_no", "from", "to", "ref").join(e, ["from", "to"])
    rank = F.when(F.col("endpoint").isNotNull() & F.endswith("ref", "endpoint"), 0).when(fn.truthy("url").isNotNull() & F.contains("ref", "url"), 1).otherwise(2)
    return met.groupBy("flow_id", "step_no").agg(F.min_by("edge", F.struct(rank.alias("r"), "ord")).alias("edge"))


def arrows(flows: DataFrame, steps: DataFrame, edges: DataFrame, services: DataFrame, topics: DataFrame) -> DataFrame:
    """(flow_id, step_no, from, to, label, kind, edge, description): what each step draws; call steps draw nothing."""
    key = ["flow_id", "step_no"]
    label = F.coalesce("description", fn.ref_label("ref"))
    s = current_service(steps).join(inferred_callers(steps, edges), key, "left").join(inferred_topics(steps, edges), key, "left")
    known = services.select(F.col("id").alias("from"), F.lit(True).alias("from_service")), topics.select(F.col("id").alias("from"), F.lit(True).alias("from_topic"))
    s = s.join(known[0], "from", "left").join(known[1], "from", "left").join(topics.select(F.col("id").alias("ref"), F.col("name").alias("topic_name")), "ref", "left")
    is_service, is_topic = F.col("from_service").isNotNull(), F.col("from_topic").isNotNull()
    first, kind = F.col("step_no") == 1, F.col("kind")
    node = is_service | is_topic
    caller = F.when(node & (F.col("from") != F.col("service")), F.col("from")).otherwise(F.coalesce("caller", "current"))
    own = (kind == "handler") & (F.col("service") == F.col("current"))
    source = F.when(first, F.col("service")).when(kind == "publish", F.when(is_service, F.col("from")).otherwise(F.col("service"))).when(kind == "consumer", F.coalesce(F.when(is_topic, F.col("from")), "topic", "current")).when(own, F.col("current")).otherwise(caller)
    to = F.when(kind == "publish", F.when(first, F.col("service")).otherwise(F.col("ref"))).otherwise(F.col("service"))
    drawn = F.when(first | own, "self").when(kind == "publish", "publish").when(kind == "consumer", "consume").when(kind == "external", "external").when(kind == "handler", "handler").otherwise("http")
    both = (kind == "endpoint") & (F.coalesce("description", F.lit("")) != "") & (F.col("description") != fn.ref_label("ref"))
    text = F.when(first, F.when(kind == "endpoint", fn.ref_label("ref")).otherwise(label)).when(kind == "publish", F.coalesce("topic_name", label)).when(both & ~own, F.concat("description", F.lit(" · "), fn.ref_label("ref"))).otherwise(label)
    out = s.filter(first | (kind != "call")).select(*key, source.alias("from"), to.alias("to"), text.alias("label"), drawn.alias("kind"), "ref", "description")
    http = matched_edges(out.filter("kind in ('http', 'external', 'handler')"), edges)
    messages = edges.filter("kind in ('publish', 'consume')").groupBy(F.col("kind").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to")).agg(F.min_by("id", "ord").alias("message"))
    out = out.join(http, key, "left").join(messages, ["kind", "from", "to"], "left")
    return out.select(*key, "from", "to", "label", "kind", F.coalesce("edge", "message").alias("edge"), "description")


def first_steps(drawn: DataFrame, flows: DataFrame) -> DataFrame:
    """(flow_id, node, step_no): where each node first appears; the entry's service at step 1."""
    ends = drawn.select("flow_id", "step_no", F.col("from").alias("node"), F.lit(0).alias("side")).union(drawn.select("flow_id", "step_no", "to", F.lit(1))).union(flows.select("flow_id", F.lit(1), "entry_service", F.lit(0)))
    return ends.groupBy("flow_id", "node").agg(F.min("step_no").alias("step_no"))


def edge_notes(drawn: DataFrame) -> DataFrame:
    """(flow_id, edge, step_no, description): the last step along each edge, and the last text given there."""
    return drawn.filter("edge is not null").groupBy("flow_id", "edge").agg(F.max("step_no").alias("step_no"), F.max_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("step_no"))).alias("description"))


def lifelines(drawn: DataFrame, flows: DataFrame, services: DataFrame, topics: DataFrame) -> DataFrame:
    """(flow_id, node, label, kind, layer, place): services by layer and first step; a topic comes right after its first publisher."""
    at = first_steps(drawn, flows)
    s = at.join(services.select(F.col("id").alias("node"), F.col("name").alias("label"), "layer"), "node")
    s = s.withColumn("sort", F.struct(fn.layer_index("layer").alias("l"), F.col("step_no").cast("int").alias("s"), F.lit(0).alias("t"), F.lit(0).alias("u")))
    by = drawn.filter("kind = 'publish'").groupBy("flow_id", F.col("to").alias("node")).agg(F.min_by("from", "step_no").alias("publisher"))
    t = at.join(topics.select(F.col("id").alias("node"), F.col("name").alias("label")), "node").join(by, ["flow_id", "node"], "left")
    home = s.select("flow_id", F.col("node").alias("publisher"), F.col("sort").alias("p"))
    last = F.struct(F.lit(99).alias("l"), F.lit(0).alias("s"), F.lit(1).alias("t"), F.col("step_no").cast("int").alias("u"))
    # a later topic of the same publisher is put before the earlier ones
    t = t.join(home, ["flow_id", "publisher"], "left").withColumn("sort", F.when(F.col("p").isNotNull(), F.struct(F.col("p.l").alias("l"), F.col("p.s").alias("s"), F.lit(1).alias("t"), (-F.col("step_no")).cast("int").alias("u"))).otherwise(last))
    both = s.select("flow_id", "node", "label", F.lit("service").alias("kind"), "layer", "sort").union(t.select("flow_id", "node", "label", F.lit("topic"), F.lit("topic"), "sort"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("flow_id").orderBy("sort", "node"))).drop("sort")

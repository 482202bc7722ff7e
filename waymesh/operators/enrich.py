"""Enrichment: merging summaries into an estate, and planning what still has to be summarised."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.session import cut, numbered
from .estate import Estate
from .reach import reach

SLICE_LINES = 120
CHUNK_CHARS = 60_000
FLOWS_PER_REQUEST = 25


def describe_services(services: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Descriptions fill gaps only."""
    d = enrichment.select(F.col("service").alias("id"), F.col("description").alias("__d"))
    return services.join(d, "id", "left").withColumn("description", F.coalesce(fn.truthy("description"), fn.truthy("__d"), "description")).select(*services.columns)


def summarise_handlers(handlers: DataFrame, enrichment: DataFrame) -> DataFrame:
    """A summary applies while its hash is the handler's, or either has none; a stale one is dropped."""
    s = enrichment.select("service", F.explode("handlers").alias("id", "__h"))
    free = fn.truthy("__h.hash").isNull() | fn.truthy("hash").isNull() | (F.col("__h.hash") == F.col("hash"))
    return handlers.join(s, ["service", "id"], "left").withColumn("summary", F.when(F.col("__h").isNotNull() & free, F.col("__h.summary")).otherwise(F.col("summary"))).select(*handlers.columns)


def summarise_endpoints(endpoints: DataFrame, enrichment: DataFrame) -> DataFrame:
    s = enrichment.select("service", F.explode("endpoints").alias("id", "__e"))
    return endpoints.join(s, ["service", "id"], "left").withColumn("summary", F.when(F.col("__e").isNotNull(), F.col("__e.summary")).otherwise(F.col("summary"))).select(*endpoints.columns)


def enrich(e: Estate, enrichment: DataFrame) -> Estate:
    return e.replace(services=describe_services(e.services, enrichment), handlers=summarise_handlers(e.handlers, enrichment), endpoints=summarise_endpoints(e.endpoints, enrichment))


def enrich_flows(flows: DataFrame, steps: DataFrame, enrichment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and texts of flows where given, and step texts by their place (from 0)."""
    x = enrichment.select(F.explode("flows").alias("flow_id", "__f"))
    out = flows.join(x, "flow_id", "left")
    for c in ("name", "useCase", "description"):
        out = out.withColumn(c, F.coalesce(fn.truthy(f"__f.{c}"), c))
    texts = x.select("flow_id", F.explode("__f.steps").alias("place", "__t")).select("flow_id", (F.expr("try_cast(place as int)") + 1).alias("step_no"), "__t")
    told = steps.join(texts, ["flow_id", "step_no"], "left").withColumn("description", F.coalesce("__t", "description"))
    return out.select(*flows.columns), told.select(*steps.columns)


def interesting_handlers(e: Estate) -> DataFrame:
    """(service, id): handlers of endpoints and consumers, and all that reach an outbound call or publish."""
    key = lambda c: F.concat_ws("\0", "service", c)
    up = e.handlers.select("service", "id", F.explode("calls").alias("callee")).select(key("callee").alias("src"), key("id").alias("dst"))
    ends = reduce(DataFrame.union, [e.calls.select("service", "fromHandler"), e.publishes.select("service", "fromHandler")]).distinct()
    above = reach(up, ends.select(F.lit(0).alias("seed"), key("fromHandler").alias("node"))).select(F.split("node", "\0").alias("x")).select(F.col("x")[0].alias("service"), F.col("x")[1].alias("id"))
    return reduce(DataFrame.union, [above, e.endpoints.select("service", "handler"), e.consumers.select("service", "handler")]).distinct()


def slices(handlers: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(service, id, file, start_line, end_line, text): each handler's source up to the next handler of its file, 120 lines at most and one at least. ``files``: service, file, text. A file is taken apart once for all its handlers."""
    by_line = Window.partitionBy("service", "file").orderBy("line", "i_ord")
    at = handlers.select("service", "id", "i_ord", F.col("loc.file").alias("file"), F.col("loc.line").alias("line"), "hash").withColumn("next", F.lead("line").over(by_line))
    if only is not None:
        at = at.join(only.select("service", "id"), ["service", "id"], "left_semi")
    of_file = at.groupBy("service", "file").agg(F.collect_list(F.struct("id", "i_ord", "line", "hash", "next")).alias("hs"))
    s = of_file.join(files.select("service", "file", F.split("text", "\r?\n").alias("lines")), ["service", "file"])
    size = F.size("lines")

    def cut_out(h):
        start = F.greatest(F.lit(1), h["line"])
        end = F.greatest(F.least(F.coalesce(h["next"], size + 1) - 1, start + SLICE_LINES - 1, size), start)
        return F.struct(h["id"].alias("id"), h["i_ord"].alias("i_ord"), h["line"].alias("line"), h["hash"].alias("hash"), start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", start, end - start + 1), "\n").alias("text"))

    out = s.select("service", "file", F.explode(F.transform("hs", cut_out)).alias("x"))
    return out.select("service", "x.id", "x.i_ord", "file", "x.line", "x.hash", "x.start_line", "x.end_line", "x.text")


def split_cached(cut: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """Slices with their cache key, and whether the cache (key) has it."""
    key = fn.cache_key(F.lit("handler"), F.lit(version), F.lit(model), F.col("service"), F.col("id"), F.coalesce("hash", "text"))
    return cut.withColumn("key", key).join(cache.select("key", F.lit(True).alias("cached")), "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def folded(rows: DataFrame, limit: int) -> DataFrame:
    """(g, o, chunk) of rows (g, o, n): each group's sizes taken in order by one task, which holds one running number of them."""

    def fold(batches):
        now, chunk, size, held = (), 0, 0, False
        for b in batches:
            out = []
            for g, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if (g,) != now:
                    now, chunk, size, held = (g,), 0, 0, False
                if held and size + n > limit:
                    chunk, size = chunk + 1, 0
                size, held = size + n, True
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], names=["g", "o", "chunk"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.repartition("g").sortWithinPartitions("g", "o", "n").mapInArrow(fold, f"g {types['g']}, o {types['o']}, chunk int")


def running(rows: DataFrame, name: str, value: Column, *order: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` in each group g, in order; a group is dealt over tasks by range."""
    dealt = cut(rows.withColumn(name, value).repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("g", "part").agg(F.sum(name).alias("before"))
    before = sums.select("g", "part", F.coalesce(F.sum("before").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # as many rows of a group as tasks
    inside = F.sum(name).over(Window.partitionBy("g", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = dealt.withColumn(name, inside)
    on = near["g"].eqNullSafe(before["g"]) & (near["part"] == before["part"])
    return near.join(before, on).select(*(near[c] for c in rows.columns), (near[name] + before["before"]).alias(name))


def pointed(rows: DataFrame, limit: int, max_rounds: int = 64) -> DataFrame:
    """What :func:`folded` gives, for groups that are too large for one task.

    Running sums place every slice. Where the chunk ends that would begin at a slice is how many sums don't exceed the sum
    before it plus the limit: sums and these bounds are sorted together, and sums counted. From each group's first slice
    the beginnings are found by doubling: in each round those known jump once, and then all jumps become twice as long.
    """
    placed = running(rows, "s", F.col("n"), "o", "n")
    placed = cut(running(placed, "i", F.lit(1).cast("long"), "o", "n", "s"))
    sums = placed.select("g", F.col("s").alias("v"), F.lit(0).alias("bound"), "i")
    bounds = placed.select("g", (F.col("s") - F.col("n") + limit).alias("v"), F.lit(1).alias("bound"), "i")
    met = running(sums.union(bounds), "fit", (1 - F.col("bound")).cast("long"), "v", "bound", "i").filter("bound = 1")
    jump = cut(met.select("g", "i", F.greatest(F.col("fit"), F.col("i")).alias("j")).withColumn("j", F.col("j") + 1))
    last = placed.groupBy("g").agg(F.max("i").alias("last"))
    jump = cut(jump.join(last, jump["g"].eqNullSafe(last["g"])).filter("j <= last").select(jump["g"], "i", "j"))
    begins = cut(placed.filter("i = 1").select("g", "i").distinct())
    for _ in range(max_rounds):
        a, b = begins, jump
        new = a.join(b, a["g"].eqNullSafe(b["g"]) & (a["i"] == b["i"])).select(a["g"], b["j"].alias("i"))
        if not new.limit(1).count():
            break
        begins = cut(begins.union(new).distinct())
        x, y = jump, jump.select(F.col("g").alias("h"), F.col("i").alias("at"), F.col("j").alias("to"))
        jump = cut(x.join(y, x["g"].eqNullSafe(y["h"]) & (x["j"] == y["at"])).select("g", "i", F.col("to").alias("j")))
    starts = begins.withColumn("b", F.lit(1))
    on = placed["g"].eqNullSafe(starts["g"]) & (placed["i"] == starts["i"])
    marked = placed.join(starts, on, "left").select(placed["g"], placed["o"], placed["i"], F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    return running(marked, "chunk", F.col("b"), "i").select("g", "o", (F.col("chunk") - 1).cast("int").alias("chunk"))


#: Slices of a service that one task takes in order.
FOLD_ROWS = 1_000_000


def packed(pending: DataFrame, limit: int = CHUNK_CHARS, group: str = "service", order: str = "ord", chars: str = "chars", fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Adds chunk: slices in order, a new chunk whenever the next would exceed the limit.

    Where a chunk begins depends on all before it. One task folds the sizes of a service of up to ``fold_rows`` slices;
    larger services are dealt over tasks (:func:`pointed`), with the same result. A missing size is 0; of slices with the
    same place the smaller size comes first, and both are in the later one's chunk.
    """
    rows = cut(pending.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(chars).cast("long"), F.lit(0)).alias("n")))
    large = rows.groupBy("g").agg(F.count("*").alias("many")).filter(F.col("many") > fold_rows).select(F.col("g").alias("wide"))
    if large.limit(1).count():
        of = rows["g"].eqNullSafe(large["wide"])
        found = folded(rows.join(large, of, "left_anti"), limit).union(pointed(rows.join(large, of, "left_semi"), limit))
    else:
        found = folded(rows, limit)
    found = found.groupBy("g", "o").agg(F.max("chunk").alias("chunk"))
    on = pending[group].eqNullSafe(found["g"]) & pending[order].eqNullSafe(found["o"])
    return pending.join(found, on).select(*(pending[c] for c in pending.columns), "chunk")


def batches(flows: DataFrame, order: str = "rank", size: int = FLOWS_PER_REQUEST) -> DataFrame:
    """Adds batch: so many flows to a request, in order."""
    return numbered(flows, "batch", order).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))


def merge_summaries(parts: DataFrame, handlers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers (service, part, description, handlers, endpoints: arrays of structs with id) to (descriptions, handlers, endpoints): the first description, and the last entry of each id with the handler's current hash."""
    d = parts.filter(fn.truthy("description").isNotNull()).groupBy("service").agg(F.min_by("description", "part").alias("description"))
    h = parts.select("service", "part", F.posexplode("handlers").alias("i", "h")).groupBy("service", F.col("h.id").alias("id")).agg(F.max_by("h.summary", F.struct("part", "i")).alias("summary"))
    h = h.join(handlers.select("service", "id", "hash"), ["service", "id"], "left")
    e = parts.select("service", "part", F.posexplode("endpoints").alias("i", "e")).groupBy("service", F.col("e.id").alias("id")).agg(F.max_by(F.struct("e.summary", "e.useCase"), F.struct("part", "i")).alias("x")).select("service", "id", "x.*")
    return d, h, e


def section(rows: DataFrame, keys: list[str], order: list[str], line, header: str, name: str) -> DataFrame:
    """One text for each key: the header and the rows' lines in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(header), F.array_join(lines, "\n")).alias(name))


def prompts(e: Estate, cut: DataFrame) -> DataFrame:
    """(service, chunk, prompt): manifest facts of the chunk's handlers, then their sources. ``cut``: slices with chunk and ord."""
    keys, mine = ["service", "chunk"], cut.select("service", "chunk", F.col("id").alias("handler"), "ord")
    lit = F.lit
    extra = lambda c, a, b: F.when(fn.truthy(c).isNotNull(), F.concat(lit(a), c, lit(b))).otherwise("")
    from_ = lambda df: df.withColumnRenamed("fromHandler", "handler").join(mine, ["service", "handler"])
    parts = [
        section(e.endpoints.join(mine, ["service", "handler"]), keys, ["i_ord"], F.concat(lit('- id="'), "id", lit('" '), "method", lit(" "), "path", lit(" -> "), "handler"), "\n\n## Endpoints\n", "a"),
        section(e.consumers.join(mine, ["service", "handler"]), keys, ["i_ord"], F.concat(lit("- "), "broker", lit(" "), "topic", extra("routingKey", " (", ")"), lit(" -> "), "handler"), "\n\n## Consumers\n", "b"),
        section(from_(e.calls), keys, ["i_ord"], F.concat(lit("- "), "handler", lit(": "), F.coalesce("method", lit("HTTP")), lit(" "), "url", F.when(fn.truthy("targetService").isNotNull(), F.concat(lit(" -> "), "targetService")).otherwise(extra("targetHint", " (hint ", ")"))), "\n\n## Outbound HTTP\n", "c"),
        section(from_(e.publishes), keys, ["i_ord"], F.concat(lit("- "), "handler", lit(": "), "broker", lit(" "), "topic", extra("routingKey", " (", ")")), "\n\n## Publishes\n", "d"),
        section(e.handlers.filter("size(calls) > 0").withColumn("handler", F.col("id")).join(mine, ["service", "handler"]), keys, ["i_ord"], F.concat(lit("- "), "handler", lit(" -> "), F.array_join("calls", ", ")), "\n\n## Handler call graph\n", "e"),
        section(cut, keys, ["ord"], F.concat(lit("\n### "), "id", lit(" ("), "file", lit(":"), F.col("start_line").cast("string"), lit("-"), F.col("end_line").cast("string"), lit(")\n```\n"), "text", lit("\n```")), "\n\n## Source slices (handler id, then code)\n", "f"),
    ]
    head = F.concat(lit("# Service: "), "id", lit(" ("), "name", lit("), layer="), "layer", extra("language", ", language=", ""))
    out = mine.select(*keys).distinct().join(e.services.select(F.col("id").alias("service"), head.alias("h")), "service")
    for p in parts:
        out = out.join(p, keys, "left")
    return out.select(*keys, F.concat("h", *(F.coalesce(c, lit("")) for c in "abcdef"), lit("\n\nSummarise every handler id listed above and every endpoint id listed above.")).alias("prompt"))

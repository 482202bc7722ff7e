"""Reports of a graph as text: Markdown pages and Mermaid diagrams, each a row (path, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.documents import document_lines, write_document
from .build import Graph

lit = F.lit


def said(*parts: Column | str) -> Column:
    """Concatenation; plain strings are text, nulls are empty."""
    return F.concat(*(lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), lit("")) for p in parts))


c = F.col


def listed(rows: DataFrame, keys: list[str], order: list[str | Column], line: Column, name: str = "text", header: str = "", end: str = "") -> DataFrame:
    """The rows' lines in order, as one text for each key."""
    cols = [fn.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*cols, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.concat(lit(header), F.array_join(lines, ""), lit(end)).alias(name))


def table(*names: str) -> str:
    return "| " + " | ".join(names) + " |\n" + "|---" * len(names) + "|\n"


def row(*cells: Column) -> Column:
    return said("| ", *[x for cell in cells for x in (cell, " | ")][:-1], " |\n")


def placed(loc: str = "loc") -> Column:
    return F.when(c(loc).isNotNull(), said(" (", c(f"{loc}.file"), ":", c(f"{loc}.line"), ")")).otherwise("")


def service_map(g: Graph) -> DataFrame:
    """One row (text): services by layer, topics, and the lines between them."""
    s = g.services.withColumn("place", fn.layer_index("layer"))
    inside = listed(s, ["place", "layer"], ["m_ord"], said("    ", fn.mermaid_id("id"), '["', fn.mermaid_text("name"), '"]\n'), "body")
    parts = [inside.select(lit(0).alias("part"), F.array("place").alias("o"), said("  subgraph ", c("layer"), "\n", c("body"), "  end\n").alias("line"))]
    parts.append(g.topics.select(lit(1), c("ord"), said("  ", fn.mermaid_id("id"), '>"', fn.mermaid_text("broker"), ": ", fn.mermaid_text("name"), '"]\n')))
    arrow = F.when(c("kind").isin("publish", "consume") | (c("status") == "observed"), "-.->").otherwise("-->")
    drawn = g.edges.filter(c("kind").isin("http", "declared", "publish", "consume"))
    parts.append(drawn.select(lit(2), c("ord"), said("  ", fn.mermaid_id("source"), " ", arrow, " ", fn.mermaid_id("target"), "\n")))
    rows = reduce(DataFrame.union, parts)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "o", "line"))), lambda x: x["line"]), "")
    return rows.agg(F.concat(lit("flowchart LR\n"), F.coalesce(body, lit(""))).alias("text"))


def sequences(g: Graph, flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow_id, text): a Mermaid sequence diagram for each flow."""
    who = steps.select("flow_id", F.when(c("kind") == "publish", c("ref")).otherwise(c("service")).alias("p"), c("step_no").alias("at")).union(flows.select("flow_id", "entry_service", lit(0)))
    who = who.groupBy("flow_id", "p").agg(F.min("at").alias("at"))
    names = g.services.select(c("id").alias("p"), c("name").alias("label")).union(g.topics.select("id", said(c("broker"), ":", c("name"))))
    who = who.join(names, "p", "left")
    head = listed(who, ["flow_id"], ["at", "p"], said("  participant ", fn.mermaid_id("p"), " as ", fn.mermaid_text(F.coalesce("label", "p")), "\n"), "head")
    s = steps.join(flows.select("flow_id", "entry_service"), "flow_id").withColumn("from", F.coalesce("from", "entry_service"))
    text = lambda other: fn.mermaid_text(F.coalesce(c("description"), other))
    line = (
        F.when(c("step_no") == 1, said("  Note over ", fn.mermaid_id("service"), ": ", text(c("ref")), "\n"))
        .when(c("kind") == "publish", said("  ", fn.mermaid_id("service"), "-)", fn.mermaid_id("ref"), ": ", text(lit("publish")), "\n"))
        .when(c("kind") == "consumer", said("  ", fn.mermaid_id("from"), "-)", fn.mermaid_id("service"), ": ", text(lit("consume")), "\n"))
        .otherwise(said("  ", fn.mermaid_id("from"), "->>", fn.mermaid_id("service"), ": ", text(c("ref")), "\n"))
    )
    body = listed(s, ["flow_id"], ["step_no"], line, "body")
    return flows.select("flow_id").join(head, "flow_id").join(body, "flow_id").select("flow_id", said("sequenceDiagram\n", c("head"), c("body")).alias("text"))


def service_pages(g: Graph) -> DataFrame:
    """(service, path, text) for each service."""
    eps = g.endpoints.select("node", c("service").alias("e_service"), c("method").alias("e_method"), c("path").alias("e_path"))
    topics = g.topics.select(c("id").alias("topic"), "broker", c("name").alias("t_name"))
    handler = F.split_part("fromHandler", lit("#"), lit(2))
    e = g.edges.select(*g.edges.columns)
    parts = [listed(g.endpoints, ["service"], ["i_ord"], row(c("method"), said("`", c("path"), "`"), c("handler"), c("summary")), "p0", "\n## Endpoints\n\n" + table("Method", "Path", "Handler", "Summary"))]
    heard = e.filter("kind = 'consume'").join(topics, c("source") == c("topic"))
    parts.append(listed(heard.withColumn("service", c("target")), ["service"], ["ord"], row(c("t_name"), c("broker"), c("routingKey"), handler), "p1", "\n## Consumes\n\n" + table("Topic", "Broker", "Routing key / group", "Handler")))
    calls = e.filter("kind = 'http-detail'").join(eps, c("endpoint") == c("node"), "left").withColumn("service", F.substring_index("source", "#", 1))
    to = F.when(c("endpoint").isNotNull(), said(c("e_service"), " `", c("e_method"), " ", c("e_path"), "`")).otherwise(c("target"))
    parts.append(listed(calls, ["service"], ["ord"], row(handler, c("method"), said("`", fn.mermaid_text(F.coalesce("url", lit(""))), "`"), to, c("resolution"), F.format_string("%.2f", "confidence")), "p2", "\n## Outbound HTTP calls\n\n" + table("From handler", "Method", "URL", "Target", "Resolution", "Confidence")))
    told = e.filter("kind = 'publish'").join(topics, c("target") == c("topic"))
    parts.append(listed(told.withColumn("service", c("source")), ["service"], ["ord"], row(c("t_name"), c("broker"), c("routingKey"), handler), "p3", "\n## Publishes\n\n" + table("Topic", "Broker", "Routing key", "From handler")))
    parts.append(listed(e.filter("kind = 'http'").withColumn("service", c("target")), ["service"], ["ord"], said("- ", c("source"), " (", c("status"), ")\n"), "p4", "\n## Called by\n\n"))
    parts.append(listed(g.issues.filter("service is not null"), ["service"], ["level", "code", "message"], said("- **", c("level"), "** ", c("code"), ": ", c("message"), placed(), "\n"), "p5", "\n## Issues\n\n"))
    out = g.services.withColumn("service", c("id"))
    for p in parts:
        out = out.join(p, "service", "left")
    fact = lambda name, column: F.when(fn.truthy(column).isNotNull(), said(f"- **{name}**: ", c(column), "\n")).otherwise("")
    language = F.when(fn.truthy("language").isNotNull(), said("- **Language**: ", c("language"), F.when(F.size("frameworks") > 0, said(" (", F.array_join("frameworks", ", "), ")")).otherwise(""), "\n")).otherwise("")
    about = F.when(fn.truthy("description").isNotNull(), said("\n", c("description"), "\n")).otherwise("")
    text = said("# ", c("name"), "\n\n- **Id**: `", c("id"), "`\n- **Layer**: ", c("layer"), "\n", fact("Owner", "owner"), fact("Repo", "repo"), language, about, *(c(f"p{i}") for i in range(6)))
    return out.select("service", said("services/", fn.file_name("id"), ".md").alias("path"), text.alias("text"))


def flow_pages(g: Graph, flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow_id, path, text) for each flow."""
    numbered = listed(steps, ["flow_id"], ["step_no"], said(c("step_no"), ". **", c("service"), "** ", c("kind"), " — ", F.coalesce("description", "ref"), "\n"), "numbered")
    out = flows.join(sequences(g, flows, steps), "flow_id").join(numbered, "flow_id")
    use = F.when(fn.truthy("useCase").isNotNull(), said("**Use case:** ", c("useCase"), "\n\n")).otherwise("")
    about = F.when(fn.truthy("description").isNotNull(), said(c("description"), "\n\n")).otherwise("")
    entry = said("Entry: `", c("entry_service"), "` ", c("entry_kind"), " `", F.substring_index("entry_ref", "#", -1), "`\n\n")
    text = said("# ", c("name"), "\n\n", use, about, entry, "```mermaid\n", c("text"), "```\n\n## Steps\n\n", c("numbered"))
    return out.select("flow_id", said("flows/", c("flow_id"), ".md").alias("path"), text.alias("text"))


def index_page(g: Graph, flows: DataFrame, steps: DataFrame, generated: str = "") -> DataFrame:
    """One row (path, text): counts, the map, services by layer, flows and issues."""
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((g.services, "n_s"), (g.endpoints, "n_e"), (g.topics, "n_t"), (flows, "n_f"), (g.issues, "n_i"))]
    s = g.services.withColumn("place", fn.layer_index("layer"))
    in_layer = listed(s, ["place", "layer"], ["m_ord"], row(said("[", c("name"), "](services/", fn.file_name("id"), ".md)"), c("owner"), c("n_endpoints"), c("n_consumers"), c("n_calls"), c("n_publishes")), "body")
    head = table("Service", "Owner", "Endpoints", "Consumers", "Calls", "Publishes")
    whole = lambda df, order, line, name: listed(df.withColumn("__one", lit(1)), ["__one"], order, line, name).drop("__one")
    layers = whole(in_layer, ["place"], said("## ", fn.capitalised("layer"), "\n\n" + head, c("body"), "\n"), "t_layers")
    touched = steps.groupBy("flow_id").agg(F.countDistinct("service").alias("n_services"))
    flow_rows = whole(flows.join(touched, "flow_id"), ["rank"], row(said("[", c("name"), "](flows/", c("flow_id"), ".md)"), c("useCase"), c("entry_service"), c("n_steps"), c("n_services")), "t_flows")
    issue_rows = whole(g.issues, ["level", "code", "service", "message"], row(c("level"), c("code"), c("service"), said(fn.mermaid_text("message"), placed())), "t_issues")
    out = reduce(DataFrame.crossJoin, [*counts, service_map(g).withColumnRenamed("text", "t_map")])
    for part in (layers, flow_rows, issue_rows):
        out = out.join(part, lit(True), "left")
    numbers = said(*[x for name, n in (("Services", "n_s"), ("Endpoints", "n_e"), ("Topics", "n_t"), ("Flows", "n_f"), ("Issues", "n_i")) for x in (f"| {name} | ", c(n), " |\n")])
    text = said(f"# Application flow map\n\nGenerated {generated}\n\n" + table("Metric", "Count"), numbers, "\n## Service map\n\n```mermaid\n", c("t_map"), "```\n\n", c("t_layers"), "## Flows\n\n" + table("Flow", "Use case", "Entry", "Steps", "Services"), c("t_flows"), "\n## Issues\n\n" + table("Level", "Code", "Service", "Message"), c("t_issues"))
    return out.select(lit("index.md").alias("path"), text.alias("text"))


def gate(issues: DataFrame, level: str) -> bool:
    """Whether issues of at least this level exist."""
    return issues.filter(c("level").isin(*(("error",) if level == "error" else ("error", "warn")))).limit(1).count() > 0


def graph_arrays(g: Graph, flows: DataFrame, steps: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """What a document of the graph holds: its arrays by name, each a table and the order of its rows."""
    services = g.services.select(c("m_ord"), "id", lit("service").alias("kind"), "name", "layer", "owner", "description", "inferred", F.struct(c("n_endpoints").alias("endpoints"), c("n_consumers").alias("consumers"), c("n_calls").alias("calls"), c("n_publishes").alias("publishes")).alias("stats"))
    f = flows.join(steps.groupBy("flow_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_no", F.struct("service", "ref", "kind", "from", "description").alias("s")))), lambda x: x["s"]).alias("steps")), "flow_id")
    f = f.select("rank", c("flow_id").alias("id"), "name", "useCase", "description", F.struct(c("entry_service").alias("service"), c("entry_kind").alias("kind"), c("entry_ref").alias("ref")).alias("entry"), "steps")
    return {"services": (services, ["m_ord"]), "topics": (g.topics.withColumn("kind", lit("topic")), ["ord"]), "edges": (g.edges, ["ord"]), "flows": (f, ["rank"]), "issues": (g.issues, ["level", "code", "message"])}


def write_graph(g: Graph, flows: DataFrame, steps: DataFrame, folder: str, generated: str = "") -> None:
    """The graph as a document in parts, of any size: see :mod:`waymesh.sources.documents`."""
    when = generated.replace("\\", "\\\\").replace('"', '\\"')
    write_document(document_lines(graph_arrays(g, flows, steps), f'{{"schemaVersion":"1","generatedAt":"{when}",'), folder)


def graph_document(g: Graph, flows: DataFrame, steps: DataFrame, generated: str = "") -> DataFrame:
    """One row (json): the whole graph as a document, for estates small enough to be one; :func:`write_graph` has no such limit."""
    drop = ("ord", "m_ord", "i_ord")
    every = lambda df, order, name: df.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*(x for x in df.columns if x not in drop)).alias("doc")))), lambda x: x["doc"])).alias(name))
    out = reduce(DataFrame.crossJoin, [every(df, order, name) for name, (df, order) in graph_arrays(g, flows, steps).items()])
    empty = lambda n: F.coalesce(n, lit("[]"))
    return out.select(said('{"schemaVersion":"1","generatedAt":"', generated, '","services":', empty("services"), ',"topics":', empty("topics"), ',"edges":', empty("edges"), ',"flows":', empty("flows"), ',"issues":', empty("issues"), "}").alias("json"))

"""The tram estate: resolution, messaging, flows, drift, diff and reports."""

import json

import pytest
from fixtures import LOC, TARGETS, TRAMS, manifest, write
from pyspark.sql import functions as F

from waymesh.operators import diff, docs, enrich, explore, flows, sequence, traces, validate
from waymesh.operators.build import build_graph
from waymesh.operators.estate import Config
from waymesh.sources import manifests as src


@pytest.fixture(scope="module")
def trams(spark, tmp_path_factory):
    return src.estate(src.read_manifests(spark, write(tmp_path_factory.mktemp("trams"), TRAMS)))


@pytest.fixture(scope="module")
def graph(trams):
    return build_graph(trams, Config(TARGETS, {"giro": {"name": "Giro Bank"}}))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_each_rule_resolves(graph):
    http = {(r.source, r.target): (r.resolution, r.confidence) for r in graph.edges.filter("kind = 'http'").collect()}
    assert http == {
        ("kiosk", "route-planner"): ("hint", 0.8500000000000001), ("kiosk", "fare-cards"): ("config", 1.0), ("route-planner", "timetable"): ("host-match", 0.75),
        ("fare-cards", "external:giro"): ("config", 0.95), ("fare-cards", "zoning"): ("path-match", 0.7), ("receipts", "external:post.letters.example"): ("literal-host", 0.9),
    }
    assert rows(graph.services.filter("layer = 'external'"), "id", "name") == {("external:giro", "Giro Bank"), ("external:post.letters.example", "post.letters.example")}
    assert ("fare-cards#Limits.check", "zoning#GET /api/zones/{zone}/limit") in rows(graph.edges.filter("kind = 'http-detail'"), "source", "endpoint")
    assert rows(graph.edges.filter("kind = 'declared'"), "source", "target", "confidence") == {("zoning", "timetable", 1.0)}
    assert rows(graph.issues, "code", "service") == {("topic:no-publisher", None), ("declared:unknown-service", "zoning")}


def test_hint_tie_is_settled_by_path(spark, tmp_path):
    """Two services share a hint's word; only one has the path. With neither, the tie is an issue and the call stays open."""
    two = [manifest(f"ferry-{x}", "domain", None, [("H.h", "http")], [("GET", f"/{x}/berths", "H.h")]) for x in ("north", "south")]
    caller = manifest("pier", "ui", None, [("P.p", "client")], calls=[("a", "GET", "{u}/south/berths", "FERRY_URL", "P.p"), ("b", "GET", "{u}/tides", "FERRY_URL", "P.p")])
    g = build_graph(src.estate(src.read_manifests(spark, write(tmp_path, [caller, *two]))))
    assert rows(g.edges.filter("kind = 'http'"), "target", "resolution") == {("ferry-south", "hint+path")}
    assert rows(g.issues, "code") == {("call:ambiguous-hint",), ("call:unresolved",)}


def test_messaging(graph):
    assert rows(graph.topics, "id") == {("topic:kafka:card.credited",), ("topic:rabbitmq:delays",)}
    assert rows(graph.edges.filter("kind in ('publish', 'consume')"), "source", "target") == {("fare-cards", "topic:kafka:card.credited"), ("topic:kafka:card.credited", "receipts"), ("topic:rabbitmq:delays", "timetable")}


def test_flow(trams, graph, tmp_path):
    f, steps = flows.derive_flows(graph)
    ids = [r.flow_id for r in f.orderBy("rank").collect()]
    assert ids == ["flow-kiosk-cardscreen-topup", "flow-kiosk-ridescreen-plan"]
    got = [(r.service, r.kind) for r in steps.filter(F.col("flow_id") == ids[0]).orderBy("step_no").collect()]
    assert got == [("kiosk", "handler"), ("fare-cards", "endpoint"), ("external:giro", "external"), ("fare-cards", "publish"), ("receipts", "consumer"), ("external:post.letters.example", "external"), ("zoning", "endpoint")]
    assert not f.filter("entry_ref = 'timetable#GET /departures/{stop}'").count()
    f2, _ = flows.derive_flows(build_graph(trams, Config(TARGETS, include_non_roots=True)))
    assert f2.filter("entry_ref = 'fare-cards#POST /cards/{card}/credit'").first().n_steps == 6
    assert not f2.filter("entry_ref = 'timetable#GET /departures/{stop}'").count()  # one step is no flow
    f3, _ = flows.derive_flows(build_graph(trams, Config(TARGETS, max_depth=1)))
    assert {r.flow_id: r.n_steps for r in f3.collect()} == {ids[0]: 6, ids[1]: 3}
    drawn = sequence.arrows(f, steps, graph.edges, graph.services, graph.topics).filter(F.col("flow_id") == ids[0])
    assert [(r["from"], r.to, r.kind) for r in drawn.orderBy("step_no").collect()][3:5] == [("fare-cards", "topic:kafka:card.credited", "publish"), ("topic:kafka:card.credited", "receipts", "consume")]
    lines = [r.node for r in sequence.lifelines(drawn, f.filter(F.col("flow_id") == ids[0]), graph.services, graph.topics).orderBy("place").collect()]
    assert lines.index("topic:kafka:card.credited") == lines.index("fare-cards") + 1
    text = docs.sequences(graph, f, steps).filter(F.col("flow_id") == ids[0]).first().text
    assert text.startswith("sequenceDiagram\n  participant n_kiosk as Ticket Kiosk\n") and "Note over n_kiosk" in text
    page = docs.index_page(graph, f, steps).first().text
    assert "| Services | 8 |" in page and "## Ui" in page
    assert docs.service_pages(graph).count() == 8 and docs.flow_pages(graph, f, steps).count() == f.count()
    one = json.loads(docs.graph_document(graph, f, steps, "to\"day").first().json.replace('to"day', 'to\\"day'))
    docs.write_graph(graph, f, steps, str(tmp_path / "graph"), 'to"day')
    assert one["edges"] and one == json.loads("".join(p.read_text() for p in sorted((tmp_path / "graph").glob("*/part-*"))))


def test_cycles_end(spark, tmp_path):
    pair = [manifest(s, "domain", None, [("H", "http")], [("GET", f"/{s}", "H")], [("c", "GET", f"/{o}", None, "H")]) for s, o in (("aa", "bb"), ("bb", "aa"))]
    g = build_graph(src.estate(src.read_manifests(spark, write(tmp_path, pair))), Config(include_non_roots=True))
    f, steps = flows.derive_flows(g)
    assert [r.n_steps for r in f.collect()] == [3, 3]


def test_drift(spark, tmp_path):
    shed = manifest("shed", "domain", None, [("Gate.open", "service")], calls=[("g", "GET", "{x}/keys", None, "Gate.open")])
    g = build_graph(src.estate(src.read_manifests(spark, write(tmp_path, [*TRAMS, shed]))), Config(TARGETS))
    assert g.issues.filter("code = 'call:unresolved' and service = 'shed'").count() == 1
    seen = spark.createDataFrame([(0, "fare-cards", "zoning", None), (1, "shed", "kiosk", 3), (2, "Fare Cards", "zoning", None), (3, "Oracle", "kiosk", 1)], "ord int, source string, target string, count long")
    g = traces.merge_traces(g, seen)
    status = {(r.source, r.target): (r.status, r.confidence) for r in g.edges.filter("kind = 'http'").collect()}
    assert status["fare-cards", "zoning"] == ("both", 1.0)
    assert status["shed", "kiosk"] == ("observed", 0.85)
    assert status["external:oracle", "kiosk"] == ("observed", 0.85)
    assert status["kiosk", "fare-cards"] == ("declared", 1.0)
    codes = {r.code for r in g.issues.collect()}
    assert {"drift:observed-only", "drift:declared-only", "trace:unknown-service"} <= codes


def test_diff(spark, tmp_path):
    before = TRAMS[2]
    more = {"id": "DELETE /cards/{card}", "method": "DELETE", "path": "/cards/{card}", "handler": "CardDesk.credit", "location": LOC}
    after = before | {"endpoints": [*before["endpoints"], more], "handlers": [h | {"hash": "changed"} if h["id"] == "Purse.add" else h for h in before["handlers"]]}
    (tmp_path / "b").mkdir()
    (tmp_path / "a").mkdir()
    b, a = (src.estate(src.read_manifests(spark, write(tmp_path / n, [m]))) for n, m in (("b", before), ("a", after)))
    delta = diff.changes(diff.facet_keys(b), diff.facet_keys(a))
    assert rows(delta, "facet", "key", "change") == {("endpoints", "DELETE /cards/{card}", "added")}
    churn = diff.handler_churn(b.handlers, a.handlers)
    assert rows(churn, "added", "removed", "changed") == {(0, 0, 1)}
    assert rows(diff.summary(delta, churn), "has_changes", "new_dependencies") == {(True, False)}
    none = diff.facet_keys(b).limit(0)
    assert rows(diff.summary(diff.changes(none, diff.facet_keys(a)), diff.handler_churn(b.handlers.limit(0), a.handlers)), "new_dependencies") == {(True,)}
    assert "**Endpoints**\n- ➕ `DELETE /cards/{card}`" in diff.markdown(b, a).first().text


def test_validation(spark, tmp_path):
    good = manifest("tide-tables", "domain", None, [("Tide.of", "http")], [("GET", "/tides/{port}", "Tide.of")])
    bad = manifest("berths", "domain", None, [("Berth.list", "http", "Berth.gone"), ("Berth.list", "http")], [("GET", "/berths", "Pier.list"), ("FETCH", "berths", "Berth.list")])
    layer = manifest("cranes", "heavy", None, [("Crane.lift", "http")])
    found = validate.validate(src.read_manifests(spark, write(tmp_path, [bad, layer, good])))
    assert rows(found, "m_ord", "path") == {(0, "endpoints[0].handler"), (0, "endpoints[1].method"), (0, "endpoints[1].path"), (0, "handlers[0].calls[0]"), (0, "handlers[1].id"), (1, "service.layer")}


def test_impact_and_neighbourhood(graph):
    handlers, out = explore.endpoint_impact(graph)
    credit = "endpoint = 'fare-cards#POST /cards/{card}/credit'"
    assert rows(handlers.filter(credit), "handler") == {("fare-cards#CardDesk.credit",), ("fare-cards#Purse.add",), ("fare-cards#Limits.check",)}
    assert rows(out.filter(credit), "target") == {("zoning#GET /api/zones/{zone}/limit",), ("external:giro",), ("topic:kafka:card.credited",)}
    one = graph.services.filter("id = 'fare-cards'").select(F.col("id").alias("origin"))
    nodes, _ = explore.neighbourhood(explore.map_edges(graph.edges), one, 1, 2)
    assert rows(nodes, "node", "depth") == {("fare-cards", 0), ("kiosk", 1), ("external:giro", 1), ("zoning", 1), ("topic:kafka:card.credited", 1), ("timetable", 2), ("receipts", 2)}
    shown, edges = explore.visible(graph, explore.GraphQuery(hide_external=True, collapse_topics=True))
    assert ("via:publish:fare-cards:f3>consume:receipts:p2",) in rows(edges, "id")
    q = explore.GraphQuery(layers=frozenset({"ui"}), upstream=2)
    assert explore.GraphQuery.from_hash(q.to_hash()) == q and explore.GraphQuery().to_hash() == ""
    assert rows(explore.search_nodes(graph, "ZONES/"), "id") == {("zoning",)}


def test_enrichment(spark):
    """A bakery: what an entry point reaches, or what reaches a call, is described; the shelf, which does neither, is not."""
    from waymesh.operators.estate import estate_of

    at = [("Counter.sell", ["Till.ring"], "aa", 2), ("Till.ring", [], "bb", 6), ("Oven.tick", ["Flour.order"], "cc", 8), ("Flour.order", [], "dd", 13), ("Shelf.count", [], "ee", 17)]
    h = spark.createDataFrame([(0, i, "bakery", n, c, x, ("shop.py", line)) for i, (n, c, x, line) in enumerate(at)], "m_ord int, i_ord int, service string, id string, calls array<string>, hash string, loc struct<file:string,line:int>")
    e = estate_of(spark, handlers=h, calls=spark.createDataFrame([(0, 0, "bakery", "Flour.order")], "m_ord int, i_ord int, service string, fromHandler string"), endpoints=spark.createDataFrame([(0, 0, "bakery", "POST /sales", "Counter.sell")], "m_ord int, i_ord int, service string, id string, handler string"))
    wanted = enrich.interesting_handlers(e)
    assert rows(wanted, "id") == {("Counter.sell",), ("Oven.tick",), ("Flour.order",)}
    files = spark.createDataFrame([("bakery", "shop.py", "\n".join(f"{i:02d} knead and wait" for i in range(1, 21)))], "service string, file string, text string")
    slices = enrich.slices(e.handlers, files, wanted)
    assert rows(slices, "id", "start_line", "end_line") == {("Counter.sell", 2, 5), ("Oven.tick", 8, 12), ("Flour.order", 13, 16)}
    packed = enrich.packed(slices.withColumn("ord", F.col("line")).withColumn("chars", F.length("text")), 150)
    assert {r.id: r.chunk for r in packed.collect()} == {"Counter.sell": 0, "Oven.tick": 1, "Flour.order": 2}
    key = enrich.split_cached(slices, spark.createDataFrame([], "key string"), "1", "m").filter("id = 'Oven.tick'").select("key")
    assert rows(enrich.split_cached(slices, key, "1", "m").filter("cached"), "id") == {("Oven.tick",)}
    services = estate_of(spark, services=spark.createDataFrame([(0, "bakery", "Bakery", "domain")], "m_ord int, id string, name string, layer string")).services
    assert "## Source slices" in enrich.prompts(e.replace(services=services), packed).first().prompt

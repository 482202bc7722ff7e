"""Flows, sequences and reports over an estate that is sparse by itself: the suppliers of a nation in a row.

Each supplier's work calls the next two suppliers of its nation; the last calls the second again, so there are cycles.
Every third supplier publishes to a topic; the second of each nation listens to one, and tells an outside system. The
twins compute the same flows by a recursive query over these tables, from the definitions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, docs, explore, flows, sequence
from ..operators.estate import Config, estate_of
from ..sources import documents
from . import estate as est
from . import twins as tw
from .queries import query
from .session import cut, shared_dir

S = "(SELECT s_suppkey AS k, concat('sup-', CAST(s_suppkey AS STRING)) AS sid, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier)"
SQL = {
    "services": f"SELECT CAST(k AS INT) AS m_ord, 0 AS i_ord, sid AS id, concat('Supplier ', CAST(k AS STRING)) AS name, CASE WHEN r = 1 AND n % 5 = 0 THEN 'ui' ELSE 'domain' END AS layer FROM {S} s",
    "handlers": f"SELECT CAST(k AS INT) AS m_ord, i AS i_ord, sid AS service, h AS id, h AS name, kind, calls FROM {S} s JOIN (SELECT 0 AS i, 'In' AS h, 'http' AS kind, array('Work') AS calls UNION ALL SELECT 1, 'Work', 'service', array('Work') UNION ALL SELECT 2, 'On', 'message', array('Tell') UNION ALL SELECT 3, 'Tell', 'service', array('Tell', 'Tell')) x ON true",
    "endpoints": f"SELECT CAST(k AS INT) AS m_ord, 0 AS i_ord, sid AS service, 'GET /at' AS id, 'GET' AS method, concat('/at/', sid) AS path, 'In' AS handler FROM {S} s UNION ALL SELECT CAST(k AS INT), 1, sid, 'GET /again', 'GET', concat('/at-', sid), 'On' FROM {S} s WHERE r = 1",
    "calls": f"SELECT CAST(a.k AS INT) AS m_ord, CAST(b.r - a.r AS INT) AS i_ord, a.sid AS service, concat('to-', b.sid) AS id, 'GET' AS method, concat('{{base}}/at/', b.sid) AS url, b.sid AS targetService, 'Work' AS fromHandler FROM {S} a JOIN {S} b ON a.n = b.n WHERE b.r = a.r + 1 OR b.r = a.r + 2 UNION ALL SELECT CAST(a.k AS INT), 5, a.sid, 'back', 'GET', concat('{{base}}/at/', b.sid), b.sid, 'Work' FROM {S} a JOIN {S} b ON a.n = b.n WHERE a.r = a.c AND b.r = 2 AND a.c > 2 UNION ALL SELECT CAST(k AS INT), 9, sid, 'log', 'GET', 'https://log.example.com/v1', CAST(NULL AS STRING), 'Tell' FROM {S} s",
    "publishes": f"SELECT CAST(k AS INT) AS m_ord, 0 AS i_ord, sid AS service, 'p' AS id, 'kafka' AS broker, concat('moved-', CAST(n % 4 AS STRING)) AS topic, CASE WHEN k % 2 = 0 THEN 'key' END AS routingKey, 'Work' AS fromHandler FROM {S} s WHERE k % 3 = 0",
    "consumers": f"SELECT CAST(k AS INT) AS m_ord, 0 AS i_ord, sid AS service, 'c' AS id, 'kafka' AS broker, concat('moved-', CAST(n % 5 AS STRING)) AS topic, 'g' AS `group`, 'On' AS handler FROM {S} s WHERE r = 2",
}

_built: dict = {}


def forget() -> None:
    _built.clear()


def chain_graph(spark: SparkSession, sf_dir: str, **config):
    """(graph, flows, steps); the last one is kept for queries that ask for the same, until :func:`forget`."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(config.items()))
    if key not in _built:
        _built.clear()
        g = build.build_graph(estate_of(spark, **{n: est.run(spark, sf_dir, s) for n, s in SQL.items()}), Config(**config))
        _built[key] = (g, *map(cut, flows.derive_flows(g)))
    return _built[key]


# --- the twin: effects of each entry handler, roots, and a walk with sort keys

TABLES = ", ".join(f"f_{n} AS ({tw.duck(s)})" for n, s in SQL.items())
DONE = "(VALUES ('In', 0, 'In'), ('In', 1, 'Work'), ('Work', 0, 'Work'), ('On', 0, 'On'), ('On', 1, 'Tell'), ('Tell', 0, 'Tell')) AS d(entry, pos, handler)"
LOG = "'external:log.example.com'"
EFFECTS = f"""done AS (SELECT * FROM {DONE}),
heard AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY m_ord, i_ord) - 1 AS j FROM f_consumers),
eff AS (SELECT c.service, d.entry, [d.pos, 0, c.i_ord] AS k, coalesce(c.targetService, {LOG}) AS s_service, CASE WHEN c.targetService IS NULL THEN {LOG} ELSE c.targetService || '#GET /at' END AS s_ref, CASE WHEN c.targetService IS NULL THEN 'external' ELSE 'endpoint' END AS s_kind, c.service AS s_from, 'GET ' || c.url AS s_text, c.targetService AS n_service, CASE WHEN c.targetService IS NOT NULL THEN 'In' END AS n_handler FROM f_calls c JOIN done d ON d.handler = c.fromHandler
 UNION ALL SELECT p.service, d.entry, [d.pos, 1, p.i_ord], p.service, 'topic:kafka:' || p.topic, 'publish', p.service, 'publish ' || p.topic || CASE WHEN p.routingKey IS NULL THEN '' ELSE ' (' || p.routingKey || ')' END, NULL::VARCHAR, NULL::VARCHAR FROM f_publishes p JOIN done d ON d.handler = p.fromHandler
 UNION ALL SELECT p.service, d.entry, [d.pos, 1, p.i_ord, h.j], h.service, 'consume:' || h.service || ':' || h.id, 'consumer', 'topic:kafka:' || p.topic, 'consume ' || p.topic, h.service, h.handler FROM f_publishes p JOIN done d ON d.handler = p.fromHandler JOIN heard h ON h.topic = p.topic)"""
ROOTS = f"""rooted AS (SELECT m_ord, 0 AS kno, i_ord, service, 'endpoint' AS kind, service || '#' || id AS ref, handler AS entry, method || ' ' || path AS txt, 'flow-' || service || '-get-at-' || service AS flow_id, method || ' ' || path AS name FROM f_endpoints e WHERE {{every}} OR id <> 'GET /at' OR service NOT IN (SELECT targetService FROM f_calls WHERE targetService IS NOT NULL)
 UNION ALL SELECT m_ord, 1, i_ord, service, 'consumer', 'consume:' || service || ':' || id, handler, 'consume ' || topic, 'flow-' || service || '-consume-' || topic, 'on ' || topic FROM f_consumers WHERE topic NOT IN (SELECT topic FROM f_publishes)
 UNION ALL SELECT h.m_ord, 2, h.i_ord, h.service, 'handler', h.service || '#' || h.id, h.id, h.id, 'flow-' || h.service || '-' || lower(h.id), s.name || ': ' || h.id FROM f_handlers h JOIN f_services s ON s.id = h.service WHERE s.layer = 'ui' AND EXISTS (SELECT 1 FROM f_calls c WHERE c.service = h.service AND c.fromHandler = h.id))"""
WALK = """w(root, d, path, sort, service, ref, kind, frm, txt, ns, nh) AS (
 SELECT [m_ord, kno, i_ord], 0, []::VARCHAR[], []::BIGINT[], service, ref, kind, NULL::VARCHAR, txt, service, entry FROM rooted
 UNION ALL SELECT w.root, w.d + 1, list_append(w.path, w.ns || '#' || w.nh), list_concat(w.sort, e.k), e.s_service, e.s_ref, e.s_kind, e.s_from, e.s_text, e.n_service, e.n_handler FROM w JOIN eff e ON e.service = w.ns AND e.entry = w.nh WHERE w.d <= {depth} AND NOT list_contains(w.path, w.ns || '#' || w.nh)),
sized AS (SELECT root, count(*) AS n FROM w GROUP BY root HAVING count(*) > 1),
flow AS (SELECT * FROM (SELECT r.*, [r.m_ord, r.kno, r.i_ord] AS root, CAST(s.n AS INT) AS n_steps, row_number() OVER (PARTITION BY r.flow_id ORDER BY m_ord, kno, i_ord) AS place FROM rooted r JOIN sized s ON s.root = [r.m_ord, r.kno, r.i_ord]) t WHERE place = 1),
st AS (SELECT f.flow_id, CAST(row_number() OVER (PARTITION BY f.flow_id ORDER BY w.sort) AS INT) AS step_no, w.service, w.ref, w.kind, w.frm, w.txt FROM w JOIN flow f ON f.root = w.root)"""


def walked(select: str, *more: str, depth: int = 8, every: str = "false") -> str:
    return f"WITH RECURSIVE {', '.join([TABLES, EFFECTS, ROOTS.replace('{every}', every), WALK.replace('{depth}', str(depth)), *more])} {select}"


def chain_query(key: str, sql: str | None = None, **config):
    def add(f):
        return query(key, sql)(lambda spark, sf_dir: f(*chain_graph(spark, sf_dir, **config)))

    return add


# --- flows

chain_query("flw_01_effects", f"WITH {TABLES}, {EFFECTS} SELECT service, entry, array_to_string(k, '.') AS k, s_service, s_ref, s_kind, s_text, n_service AS next_service, n_handler AS next_handler FROM eff WHERE entry = 'In' OR entry = 'On' AND service IN (SELECT service FROM f_consumers UNION SELECT service FROM f_endpoints WHERE handler = 'On') OR service IN (SELECT id FROM f_services WHERE layer = 'ui')")(
    lambda g, f, s: flows.effects(g).select("service", "entry", F.array_join(F.transform("k", lambda x: x.cast("string")), ".").alias("k"), "s_service", "s_ref", "s_kind", "s_text", "next_service", "next_handler")
)
chain_query("flw_03_steps", walked("SELECT flow_id, step_no, service, ref, kind, frm AS caller FROM st"))(lambda g, f, s: s.select("flow_id", "step_no", "service", "ref", "kind", F.col("from").alias("caller")))
chain_query("flw_04_depth", walked("SELECT flow_id, step_no, service, kind FROM st", depth=2), max_depth=2)(lambda g, f, s: s.select("flow_id", "step_no", "service", "kind"))
chain_query("flw_05_non_roots", walked("SELECT flow_id, n_steps FROM flow", depth=1, every="true"), max_depth=1, include_non_roots=True)(lambda g, f, s: f.select("flow_id", "n_steps"))
chain_query("flw_05_roots", f"WITH {TABLES}, {ROOTS.replace('{every}', 'false')} SELECT service, kind, ref, name FROM rooted")(lambda g, f, s: flows.roots(g).select("service", "kind", "ref", "name"))
chain_query("flw_08_roots_without_flow", walked("SELECT m_ord, ref FROM rooted WHERE ref NOT IN (SELECT ref FROM flow)"))(lambda g, f, s: flows.roots(g).select("at.m_ord", "ref").join(f.select(F.col("entry_ref").alias("ref")), "ref", "left_anti").select("m_ord", "ref"))
chain_query("flw_09_first_of_an_id", walked("SELECT flow_id, ref AS entry_ref FROM flow WHERE flow_id IN (SELECT flow_id FROM rooted GROUP BY 1 HAVING count(*) > 1)"))(lambda g, f, s: f.join(flows.roots(g).groupBy("flow_id").count().filter("count > 1").select("flow_id"), "flow_id").select("flow_id", "entry_ref"))
chain_query("flw_10_flows", walked("SELECT flow_id, name, n_steps, kind AS entry_kind, row_number() OVER (ORDER BY n_steps DESC, name, flow_id) AS rank FROM flow"))(lambda g, f, s: f.select("flow_id", "name", "n_steps", "entry_kind", "rank"))
chain_query("flw_11_step_text", walked("SELECT flow_id, step_no, txt AS description FROM st"))(lambda g, f, s: s.select("flow_id", "step_no", "description"))

# --- questions about flows

chain_query("qry_04_flow_by_entry", walked("SELECT ref AS node, flow_id FROM flow WHERE kind = 'endpoint'"))(lambda g, f, s: explore.flow_by_entry(f, g.endpoints))
chain_query("qry_07_flows_of_services", walked("SELECT DISTINCT service, flow_id FROM st"))(lambda g, f, s: explore.flows_of_services(f, s))
chain_query("qry_12_headline", walked(f"SELECT (SELECT count(*) FROM f_services) + 1 AS services, (SELECT count(*) FROM f_endpoints) AS endpoints, (SELECT count(DISTINCT topic) FROM (SELECT topic FROM f_publishes UNION SELECT topic FROM f_consumers)) AS topics, (SELECT count(DISTINCT service || ' ' || coalesce(targetService, {LOG})) FROM f_calls) + (SELECT count(*) FROM f_publishes) + (SELECT count(*) FROM f_consumers) AS edges, 0::BIGINT AS unresolved, (SELECT count(*) FROM flow) AS flows"))(lambda g, f, s: explore.headline(g, f).drop("issues"))
chain_query("qry_19_flow_drills", walked("SELECT e.service || '#' || e.id AS node, CASE WHEN f.flow_id IS NULL THEN 'map' ELSE 'flow' END AS view, coalesce(f.flow_id, e.service) AS target FROM f_endpoints e LEFT JOIN flow f ON f.ref = e.service || '#' || e.id"))(lambda g, f, s: explore.drill_targets(g.endpoints, f))
chain_query("qry_21_flow_search", walked("SELECT f.flow_id, count(DISTINCT st.service) AS services FROM flow f JOIN st ON st.flow_id = f.flow_id GROUP BY f.flow_id, f.name HAVING bool_or(contains(st.service, 'sup-1')) OR lower(f.name) LIKE '%sup-1%'"))(lambda g, f, s: explore.search_flows(f, s, "SUP-1"))
_PAIR = f"pair AS (SELECT DISTINCT service AS source, coalesce(targetService, {LOG}) AS target FROM f_calls), svc AS (SELECT id FROM f_services UNION ALL SELECT {LOG})"
chain_query("qry_22_service_detail", walked("SELECT id AS service, (SELECT count(*) FROM f_consumers c WHERE c.service = s.id) AS consumes, (SELECT count(*) FROM pair WHERE source = s.id) AS calls, (SELECT count(*) FROM f_publishes p WHERE p.service = s.id) AS publishes, (SELECT count(*) FROM pair WHERE target = s.id) AS inbound, 0::BIGINT AS issues, (SELECT count(DISTINCT flow_id) FROM st WHERE st.service = s.id) AS flows FROM svc s", _PAIR))(lambda g, f, s: explore.service_detail(g, f, s))
chain_query("qry_24_impact_rows", f"WITH {TABLES}, done AS (SELECT * FROM {DONE}) SELECT e.service || '#' || e.id AS endpoint, 'http-detail:' || c.service || ':' || c.id AS id, 'http-detail' AS kind, coalesce(c.targetService, {LOG}) AS target_service FROM f_endpoints e JOIN done d ON d.entry = e.handler JOIN f_calls c ON c.service = e.service AND c.fromHandler = d.handler UNION ALL SELECT e.service || '#' || e.id, 'publish:' || p.service || ':' || p.id, 'publish', 'topic:kafka:' || p.topic FROM f_endpoints e JOIN done d ON d.entry = e.handler JOIN f_publishes p ON p.service = e.service AND p.fromHandler = d.handler")(
    lambda g, f, s: explore.impact_rows(explore.endpoint_impact(g)[1], explore.target_services(g.edges, g.endpoints, g.handlers)).select("endpoint", "id", "kind", "target_service")
)

# --- sequences

_ARROWS = """arrow AS (SELECT flow_id, step_no, ref, txt, CASE WHEN step_no = 1 THEN service ELSE frm END AS a_from, CASE WHEN kind = 'publish' THEN ref ELSE service END AS a_to,
 CASE WHEN step_no = 1 THEN 'self' WHEN kind = 'publish' THEN 'publish' WHEN kind = 'consumer' THEN 'consume' WHEN kind = 'external' THEN 'external' ELSE 'http' END AS drawn,
 CASE WHEN step_no = 1 AND kind = 'endpoint' THEN split_part(ref, '#', 2) WHEN kind = 'publish' THEN substr(ref, 13) WHEN step_no > 1 AND kind = 'endpoint' THEN txt || ' · ' || split_part(ref, '#', 2) ELSE txt END AS label,
 CASE WHEN step_no = 1 THEN NULL WHEN kind = 'publish' THEN 'publish:' || service || ':p' WHEN kind = 'consumer' THEN ref ELSE 'http:' || frm || '->' || service END AS edge FROM st)"""
drawn = lambda g, f, s: sequence.arrows(f, s, g.edges, g.services, g.topics)
chain_query("seq_01_arrows", walked('SELECT flow_id, step_no, a_from AS "from", a_to AS "to", label, drawn AS kind, edge, txt AS description FROM arrow', _ARROWS))(drawn)
chain_query("seq_04_edges", walked("SELECT flow_id, step_no, edge FROM arrow WHERE edge IS NOT NULL", _ARROWS))(lambda g, f, s: drawn(g, f, s).filter("edge is not null").select("flow_id", "step_no", "edge"))
_FIRST = "ends AS (SELECT flow_id, node, min(step_no) AS step_no FROM (SELECT flow_id, a_from AS node, step_no FROM arrow UNION ALL SELECT flow_id, a_to, step_no FROM arrow UNION ALL SELECT flow_id, service, 1 FROM flow) t GROUP BY ALL)"
chain_query("seq_06_first_steps", walked("SELECT * FROM ends", _ARROWS, _FIRST))(lambda g, f, s: sequence.first_steps(drawn(g, f, s), f))
chain_query("seq_06_edge_notes", walked("SELECT flow_id, edge, max(step_no) AS step_no, max_by(txt, step_no) AS description FROM arrow WHERE edge IS NOT NULL GROUP BY ALL", _ARROWS))(lambda g, f, s: sequence.edge_notes(drawn(g, f, s)))
_NODE = f"node AS (SELECT id, name AS label, 'service' AS kind, layer FROM f_services UNION ALL SELECT {LOG}, 'log.example.com', 'service', 'external' UNION ALL SELECT DISTINCT 'topic:kafka:' || topic, topic, 'topic', 'topic' FROM (SELECT topic FROM f_publishes UNION SELECT topic FROM f_consumers))"
_LINES = f"""life AS (SELECT e.flow_id, e.node, n.label, n.kind, n.layer, e.step_no, {tw.layer_index('n.layer')} AS l, (SELECT min_by(a_from, step_no) FROM arrow a WHERE a.flow_id = e.flow_id AND a.drawn = 'publish' AND a.a_to = e.node) AS by_ FROM ends e JOIN node n ON n.id = e.node),
placed AS (SELECT x.*, CASE WHEN x.kind = 'service' THEN [x.l, x.step_no, 0, 0] WHEN h.node IS NOT NULL THEN [h.l, h.step_no, 1, -x.step_no] ELSE [99, 0, 1, x.step_no] END AS sort FROM life x LEFT JOIN life h ON h.flow_id = x.flow_id AND h.node = x.by_ AND h.kind = 'service')"""
chain_query("seq_05_lifelines", walked("SELECT flow_id, node, label, kind, layer, row_number() OVER (PARTITION BY flow_id ORDER BY sort, node) AS place FROM placed", _ARROWS, _FIRST, _NODE, _LINES))(lambda g, f, s: sequence.lifelines(drawn(g, f, s), f, g.services, g.topics))

# --- reports

_ID = lambda x: f"'n_' || {tw.sub(x, '[^A-Za-z0-9]', '_')}"
_DIAGRAM = f"""who AS (SELECT flow_id, p, min(pl) AS pl FROM (SELECT flow_id, CASE WHEN kind = 'publish' THEN ref ELSE service END AS p, step_no AS pl FROM st UNION ALL SELECT flow_id, service, 0 FROM flow) t GROUP BY ALL),
heads AS (SELECT flow_id, string_agg('  participant ' || {_ID('p')} || ' as ' || CASE WHEN n.kind = 'topic' THEN 'kafka:' || n.label ELSE n.label END || chr(10), '' ORDER BY pl, p) AS head FROM who JOIN node n ON n.id = who.p GROUP BY 1),
bodies AS (SELECT flow_id, string_agg(CASE WHEN step_no = 1 THEN '  Note over ' || {_ID('service')} || ': ' WHEN kind = 'publish' THEN '  ' || {_ID('service')} || '-)' || {_ID('ref')} || ': ' WHEN kind = 'consumer' THEN '  ' || {_ID('frm')} || '-)' || {_ID('service')} || ': ' ELSE '  ' || {_ID('frm')} || '->>' || {_ID('service')} || ': ' END || txt || chr(10), '' ORDER BY step_no) AS body FROM st GROUP BY 1),
diagram AS (SELECT flow_id, 'sequenceDiagram' || chr(10) || head || body AS text FROM heads JOIN bodies USING (flow_id))"""
chain_query("snk_05_sequences", walked("SELECT flow_id, text FROM diagram", _NODE, _DIAGRAM))(lambda g, f, s: docs.sequences(g, f, s))
_NL = "chr(10)"
_PAGE = f"SELECT f.flow_id, 'flows/' || f.flow_id || '.md' AS path, '# ' || f.name || {_NL} || {_NL} || 'Entry: `' || f.service || '` ' || f.kind || ' `' || split_part(f.ref, '#', -1) || '`' || {_NL} || {_NL} || '```mermaid' || {_NL} || d.text || '```' || {_NL} || {_NL} || '## Steps' || {_NL} || {_NL} || (SELECT string_agg(step_no || '. **' || service || '** ' || kind || ' — ' || txt || {_NL}, '' ORDER BY step_no) FROM st WHERE st.flow_id = f.flow_id) AS text FROM flow f JOIN diagram d ON d.flow_id = f.flow_id"
chain_query("snk_03_flow_pages", walked(_PAGE, _NODE, _DIAGRAM))(lambda g, f, s: docs.flow_pages(g, f, s))


def _table(*names: str) -> str:
    return "'| " + " | ".join(names) + f" |' || {_NL} || '" + "|---" * len(names) + f"|' || {_NL}"


def _cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"coalesce({x}, '')" for x in cells) + f" || ' |' || {_NL}"


def _section(title: str, head: str, line: str, rows: str, order: str) -> str:
    return f"coalesce({_NL} || '## {title}' || {_NL} || {_NL} || {head + ' || ' if head else ''}(SELECT string_agg({line}, '' ORDER BY {order}) FROM {rows}), '')"


_SERVICE = (
    f"SELECT s.id AS service, 'services/' || replace(s.id, ':', '-') || '.md' AS path, '# ' || s.name || {_NL} || {_NL} || '- **Id**: `' || s.id || '`' || {_NL} || '- **Layer**: ' || s.layer || {_NL} || CASE WHEN s.layer = 'external' THEN {_NL} || 'External system at log.example.com' || {_NL} ELSE '' END || "
    + " || ".join([
        _section("Endpoints", _table("Method", "Path", "Handler", "Summary"), _cells("e.method", "'`' || e.path || '`'", "e.handler", "NULL"), "f_endpoints e WHERE e.service = s.id", "e.i_ord"),
        _section("Consumes", _table("Topic", "Broker", "Routing key / group", "Handler"), _cells("c.topic", "c.broker", 'c."group"', "c.handler"), "f_consumers c WHERE c.service = s.id", "c.i_ord"),
        _section("Outbound HTTP calls", _table("From handler", "Method", "URL", "Target", "Resolution", "Confidence"), _cells("c.fromHandler", "c.method", "'`' || c.url || '`'", f"CASE WHEN c.targetService IS NULL THEN {LOG} ELSE c.targetService || ' `GET /at/' || c.targetService || '`' END", "CASE WHEN c.targetService IS NULL THEN 'literal-host' ELSE 'declared' END", "CASE WHEN c.targetService IS NULL THEN '0.90' ELSE '1.00' END"), "f_calls c WHERE c.service = s.id", "c.i_ord"),
        _section("Publishes", _table("Topic", "Broker", "Routing key", "From handler"), _cells("p.topic", "p.broker", "p.routingKey", "p.fromHandler"), "f_publishes p WHERE p.service = s.id", "p.i_ord"),
        _section("Called by", "", f"'- ' || x.service || ' (declared)' || {_NL}", f"(SELECT service, min([m_ord, i_ord]) AS o FROM f_calls c WHERE coalesce(c.targetService, {LOG}) = s.id GROUP BY 1) x", "x.o"),
    ])
    + f" AS text FROM (SELECT id, name, layer FROM f_services UNION ALL SELECT {LOG}, 'log.example.com', 'external') s"
)
chain_query("snk_03_service_pages", f"WITH {TABLES} {_SERVICE}")(lambda g, f, s: docs.service_pages(g))
_ALL = f"(SELECT id, name, layer, m_ord FROM f_services UNION ALL SELECT {LOG}, 'log.example.com', 'external', 1048576)"
_MAP = f"""subs AS (SELECT layer, {tw.layer_index('layer')} AS l, '  subgraph ' || layer || {_NL} || string_agg('    ' || {_ID('id')} || '["' || name || '"]' || {_NL}, '' ORDER BY m_ord) || '  end' || {_NL} AS line FROM {_ALL} s GROUP BY 1),
tops AS (SELECT topic, min(o) AS o FROM (SELECT topic, [0, m_ord, 0, i_ord] AS o FROM f_publishes UNION ALL SELECT topic, [0, m_ord, 1, i_ord] FROM f_consumers) t GROUP BY 1),
lines AS (SELECT [1, m_ord, 0, i_ord] AS o, service AS a, '-.->' AS arrow, 'topic:kafka:' || topic AS b FROM f_publishes UNION ALL SELECT [1, m_ord, 1, i_ord], 'topic:kafka:' || topic, '-.->', service FROM f_consumers UNION ALL SELECT min([2, m_ord, i_ord, 0]), service, '-->', coalesce(targetService, {LOG}) FROM f_calls GROUP BY service, coalesce(targetService, {LOG})),
map AS (SELECT 'flowchart LR' || {_NL} || (SELECT string_agg(line, '' ORDER BY l) FROM subs) || (SELECT string_agg('  ' || {_ID("'topic:kafka:' || topic")} || '>"kafka: ' || topic || '"]' || {_NL}, '' ORDER BY o) FROM tops) || (SELECT string_agg('  ' || {_ID('a')} || ' ' || arrow || ' ' || {_ID('b')} || {_NL}, '' ORDER BY o) FROM lines) AS text)"""
chain_query("snk_04_service_map", f"WITH {TABLES}, {_MAP} SELECT text FROM map")(lambda g, f, s: docs.service_map(g))
_ISSUES = "orphan AS (SELECT 'topic:no-publisher' AS code, 'No publisher found in the estate for kafka topic ''' || topic || ''' (external producer?)' AS message FROM (SELECT DISTINCT topic FROM f_consumers) c WHERE topic NOT IN (SELECT topic FROM f_publishes) UNION ALL SELECT 'topic:no-consumer', 'No consumer found in the estate for kafka topic ''' || topic || ''' (external consumer?)' FROM (SELECT DISTINCT topic FROM f_publishes) p WHERE topic NOT IN (SELECT topic FROM f_consumers))"
_count = lambda table, column: f"(SELECT count(*) FROM {table} x WHERE x.{column} = s.id)"
_INDEX = (
    f"SELECT 'index.md' AS path, '# Application flow map' || {_NL} || {_NL} || 'Generated ' || {_NL} || {_NL} || {_table('Metric', 'Count')} || '| Services | ' || (SELECT count(*) + 1 FROM f_services) || ' |' || {_NL} || '| Endpoints | ' || (SELECT count(*) FROM f_endpoints) || ' |' || {_NL} || '| Topics | ' || (SELECT count(*) FROM tops) || ' |' || {_NL} || '| Flows | ' || (SELECT count(*) FROM flow) || ' |' || {_NL} || '| Issues | ' || (SELECT count(*) FROM orphan) || ' |' || {_NL} || {_NL} || '## Service map' || {_NL} || {_NL} || '```mermaid' || {_NL} || (SELECT text FROM map) || '```' || {_NL} || {_NL} || "
    f"(SELECT string_agg('## ' || upper(layer[1]) || layer[2:] || {_NL} || {_NL} || {_table('Service', 'Owner', 'Endpoints', 'Consumers', 'Calls', 'Publishes')} || body || {_NL}, '' ORDER BY l) FROM (SELECT layer, {tw.layer_index('layer')} AS l, string_agg({_cells(chr(39) + '[' + chr(39) + ' || name || ' + chr(39) + '](services/' + chr(39) + ' || replace(id, ' + chr(39) + ':' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ') || ' + chr(39) + '.md)' + chr(39), 'NULL', _count('f_endpoints', 'service') + '::VARCHAR', _count('f_consumers', 'service') + '::VARCHAR', _count('f_calls', 'service') + '::VARCHAR', _count('f_publishes', 'service') + '::VARCHAR')}, '' ORDER BY m_ord) AS body FROM {_ALL} s GROUP BY 1)) || '## Flows' || {_NL} || {_NL} || {_table('Flow', 'Use case', 'Entry', 'Steps', 'Services')} || "
    f"(SELECT string_agg({_cells(chr(39) + '[' + chr(39) + ' || name || ' + chr(39) + '](flows/' + chr(39) + ' || flow_id || ' + chr(39) + '.md)' + chr(39), 'NULL', 'service', 'n_steps::VARCHAR', '(SELECT count(DISTINCT st.service) FROM st WHERE st.flow_id = flow.flow_id)::VARCHAR')}, '' ORDER BY n_steps DESC, name, flow_id) FROM flow) || {_NL} || '## Issues' || {_NL} || {_NL} || {_table('Level', 'Code', 'Service', 'Message')} || (SELECT string_agg({_cells(chr(39) + 'info' + chr(39), 'code', 'NULL', 'message')}, '' ORDER BY code, message) FROM orphan) AS text"
)
chain_query("snk_03_index_page", walked(_INDEX, _MAP, _ISSUES))(lambda g, f, s: docs.index_page(g, f, s))


@query("snk_01_graph_document", walked(f"SELECT (SELECT count(*) FROM f_services) + 1 AS services, (SELECT count(*) FROM tops) AS topics, (SELECT count(*) FROM lines) + (SELECT count(*) FROM f_calls) + (SELECT count(*) FROM f_handlers h, unnest(h.calls)) AS edges, (SELECT count(*) FROM flow) AS flows, (SELECT count(*) FROM st) AS steps, (SELECT count(*) FROM orphan) AS issues", _MAP, _ISSUES))
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document, parsed again: how much of everything it holds."""
    g, f, s = chain_graph(spark, sf_dir)
    shape = "services array<struct<id:string>>, topics array<struct<id:string>>, edges array<struct<id:string>>, flows array<struct<id:string,steps:array<struct<ref:string>>>>, issues array<struct<code:string>>"
    d = docs.graph_document(g, f, s).select(F.from_json("json", shape).alias("d")).select("d.*")
    steps = F.aggregate("flows", F.lit(0).cast("long"), lambda a, x: a + F.size(x["steps"]))
    return d.select(*(F.size(c).cast("long").alias(c) for c in ("services", "topics", "edges", "flows", "issues")), steps.alias("steps"))


_PARTS = """SELECT 'services' AS section, id, 1::BIGINT AS n FROM svc UNION ALL SELECT 'topics', 'topic:kafka:' || topic, 1 FROM tops UNION ALL SELECT 'flows', flow_id, n_steps FROM flow UNION ALL SELECT 'issues', code, count(*) FROM orphan GROUP BY code
 UNION ALL SELECT 'edges', kind, count(*) FROM (SELECT 'publish' AS kind FROM f_publishes UNION ALL SELECT 'consume' FROM f_consumers UNION ALL SELECT 'http' FROM pair UNION ALL SELECT 'http-detail' FROM f_calls UNION ALL SELECT 'internal' FROM f_handlers h, unnest(h.calls)) t GROUP BY kind"""


@query("snk_01_graph_parts", walked(_PARTS, _MAP, _ISSUES, _PAIR))
def snk_01_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document in parts, written and read back: services, topics and flows by id (with steps), edges by kind, issues by code."""
    folder = f"{shared_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    docs.write_graph(*chain_graph(spark, sf_dir), folder)
    held = lambda name, shape, id, n: documents.read_items(spark, folder, name, shape).select(F.lit(name).alias("section"), F.col(id).alias("id"), n.cast("long").alias("n"))
    one = F.lit(1)
    few = [held("services", "id string", "id", one), held("topics", "id string", "id", one), held("flows", "id string, steps array<struct<ref:string>>", "id", F.size("steps"))]
    many = [held("edges", "kind string", "kind", one), held("issues", "code string", "code", one)]
    return reduce(DataFrame.union, [*few, *(df.groupBy("section", "id").agg(F.sum("n").alias("n")) for df in many)])

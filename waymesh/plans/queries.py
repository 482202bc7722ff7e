"""Registered queries over the estate, each with its twin for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import build, diff, docs, enrich, explore, flows, reach, resolve, sequence, traces, validate
from ..operators.estate import Config, conform
from ..sources import manifests as src
from . import estate as est
from . import twins as tw
from .session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


# --- scalar functions: one string column s in, x out

URLS = "SELECT DISTINCT s FROM (SELECT url AS s FROM pages UNION ALL SELECT concat('{base}/v1//parts/', replace(lower(p_brand), '#', '-'), '/:id/', CAST(p_partkey AS STRING), '?x=1') AS s FROM part UNION ALL SELECT concat('https://H', CAST(s_suppkey AS STRING), '.Example.com:8080/a//b/{id:int}/*/') FROM supplier UNION ALL SELECT concat(' wss://', s_name, '/x/{**rest:y}/<int:id>/:k(a) ') FROM supplier UNION ALL SELECT concat('api/orders/', CAST(n_nationkey AS STRING), '/') FROM nation) t"
NAMES = "SELECT DISTINCT s FROM (SELECT concat(p_name, ' ', p_type) AS s FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT concat('my', replace(p_name, ' ', 'Web-'), 'Service.Api') FROM part UNION ALL SELECT concat('@scope/', lower(s_name), '.worker') FROM supplier UNION ALL SELECT concat('ORDERS_', n_name, '_API_URL') FROM nation UNION ALL SELECT concat('orders-', lower(r_name), '-', CASE WHEN r_regionkey % 2 = 0 THEN 'bff' ELSE 'core' END) FROM region UNION ALL SELECT concat(CASE WHEN n_nationkey % 3 = 0 THEN 'get' WHEN n_nationkey % 3 = 1 THEN 'MapPost' ELSE 'asyncDelete' END, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'Async' END) FROM nation UNION ALL SELECT 'del' UNION ALL SELECT 'any') t"
CODE = "SELECT DISTINCT s FROM (SELECT concat('process.env.', n_name, '_URL') AS s FROM nation UNION ALL SELECT concat('import.meta.env.VITE_', n_name) FROM nation UNION ALL SELECT concat('config[ \"Services:', n_name, '\" ]') FROM nation UNION ALL SELECT concat('$\"', n_name, '/{id}\"') FROM nation UNION ALL SELECT concat('this._http.', lower(n_name)) FROM nation UNION ALL SELECT concat('builder.Configuration.GetValue<string>(\"', n_name, '\")') FROM nation UNION ALL SELECT concat('@Value(\"${', lower(n_name), '.url:http://x}\")') FROM nation UNION ALL SELECT concat('List<', n_name, '>?') FROM nation UNION ALL SELECT concat('__', n_name, '[]') FROM nation UNION ALL SELECT concat('a, \"', n_name, '\",, ''b'' ,') FROM nation UNION ALL SELECT concat('`', n_name, '`') FROM nation UNION ALL SELECT concat('f(', n_name, ')') FROM nation) t"
REFS = "SELECT DISTINCT s FROM (SELECT concat('nation-', CAST(user_id % 25 AS STRING), '#GET /', event_type) AS s FROM events UNION ALL SELECT concat('topic:kafka:', event_type) FROM events UNION ALL SELECT concat('consume:svc', CAST(user_id AS STRING), ':', event_type, ':on') FROM events UNION ALL SELECT concat('POST /', event_type) FROM events) t"
TEXTS = "SELECT doc_id, text AS s FROM documents"


def scalar(key: str, source: str, ours: Callable[[Column], Column], theirs: str, keep: str = "s") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return est.run(spark, sf_dir, source).select(keep, ours(F.col("s")).alias("x"))

    QUERIES[key], ORACLE[key] = run, f"SELECT {keep}, {theirs} AS x FROM ({tw.duck(source)}) src"


_call = tw.call_parts("s")
PATH = "concat('/v1/', replace(s, ' ', '/'), '/{p}')"
scalar("fn_01_normalise_path", URLS, fn.normalise_path, tw.norm("s"))
scalar("fn_02_call_url_host", URLS, lambda s: fn.call_url(s)["host"], _call["host"])
scalar("fn_02_call_url_path", URLS, lambda s: fn.call_url(s)["path"], _call["path"])
scalar("fn_02_call_url_dynamic", URLS, lambda s: fn.call_url(s)["dynamic"], _call["dynamic"])
scalar("fn_05_tokens", NAMES, lambda s: F.array_join(fn.tokens(s), ","), f"array_to_string({tw.toks('s')}, ',')")
scalar("fn_06_flow_slug", NAMES, fn.flow_slug, tw.sub(tw.sub("lower(s)", "[^a-z0-9]+", "-"), "^-+|-+$"))
scalar("fn_07_service_slug", NAMES, fn.service_slug, tw.type_slug(tw.sub(tw.sub("s", "^@[^/]+/", "", ""), r"\.(csproj|Api|Web|Service|App|Worker)$", "", "i")))
scalar("fn_08_type_slug", NAMES, fn.type_slug, tw.type_slug("s"))
scalar("fn_09_route_path", URLS, fn.route_path, tw.route("s"))
scalar("fn_10_join_paths", URLS, lambda s: fn.join_paths(F.lit("api/"), s), tw.route(f"('api/' || '/' || {tw.trim('s')})"))
scalar("fn_11_method_from_word", NAMES, fn.method_from_word, tw.verb("s"))
scalar("fn_12_host_of", URLS, fn.host_of, f"lower({tw.found(tw.trim('s'), '(?i)^(?:https?|wss?)://([^/:?#{}]+)')})")
scalar("fn_13_is_url_like", URLS, fn.is_url_like, rf"regexp_matches({tw.trim('s')}, '^(https?://|/|\{{)') OR regexp_matches(s, '\{{[^}}]+\}}/')")
scalar("fn_14_config_key", CODE, fn.config_key, tw.config_key("s"))
scalar("fn_15_split_list", CODE, lambda s: F.array_join(fn.split_list(s), "|"), f"array_to_string(list_filter(list_transform(string_split(s, ','), lambda y: {tw.sub(tw.trim('y'), '^[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$')}), lambda y: y <> ''), '|')")
scalar("fn_16_strip_generics", CODE, fn.strip_generics, tw.trim(tw.sub(tw.sub(tw.sub("s", "<.*>$", "", ""), r"\?$", "", ""), r"\[\]$", "", "")))
scalar("fn_16_norm_ident", CODE, fn.norm_ident, f"lower({tw.sub('s', '^_+', '', '')})")
scalar("fn_17_unquote", CODE, fn.unquote, f"(SELECT CASE WHEN length(t) >= 2 AND (t LIKE '\"%\"' OR t LIKE '''%''' OR t LIKE '`%`') THEN substr(t, 2, length(t) - 2) ELSE t END FROM (SELECT {tw.sub(tw.trim('s'), '^(?:[$]@|@[$]|[$]|@)', '', '')} AS t))")
scalar("fn_17_placeholder", CODE, fn.placeholder, f"'{{' || coalesce(nullif({tw.sub(tw.found(tw.trim('s'), r'^(?:this\.)?(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)$'), '^_+', '', '')}, ''), {tw.found(tw.trim('s'), '\\[[ \\t\\n\\r]*[\"' + chr(39) + ']([^\"' + chr(39) + ']+)[\"' + chr(39) + '][ \\t\\n\\r]*\\]$')}, 'expr') || '}}'")
scalar("fn_18_substitute_tokens", NAMES, lambda s: fn.substitute_tokens(F.lit("/[Controller]/[action]/[area]"), s, F.lit("Go")), f"'/' || {tw.sub('s', 'Controller$', '', '')} || '/Go/area'")
scalar("fn_19_body_hash", TEXTS, fn.body_hash, f"substr(sha256({tw.trim(tw.sub('s', tw.WS + '+', ' '))}), 1, 16)", "doc_id")
scalar("fn_20_cache_key", NAMES, lambda s: fn.cache_key(F.lit("handler"), s), "substr(sha256('[\"handler\",\"' || s || '\"]'), 1, 24)")
scalar("fn_21_infer_layer", NAMES, fn.infer_layer, tw.layer_of("s"))
scalar("fn_22_node_ids", NAMES, lambda s: F.concat_ws("|", fn.endpoint_node(F.lit("svc"), s), fn.handler_node(F.lit("svc"), s), fn.topic_node(F.lit("kafka"), s), fn.external_node(s)), "concat('svc#', s, '|', CASE WHEN contains(s, '#') THEN s ELSE 'svc#' || s END, '|topic:kafka:', s, '|external:', lower(s))")
scalar("fn_23_ref_label", REFS, fn.ref_label, tw.label("s"))
scalar("fn_23_endpoint_path", REFS, fn.endpoint_path, tw.sub(tw.label("s"), "^[A-Z]+ ", "", ""))
scalar("fn_23_qualify_ref", REFS, lambda s: fn.qualify_ref(F.lit("nation-1"), s), "CASE WHEN contains(s, '#') OR regexp_matches(s, '^(topic|consume|publish|http|external):') THEN s ELSE 'nation-1#' || s END")
scalar("fn_23_bare_handler", REFS, lambda s: fn.bare_handler(F.lit("nation-1"), s), "CASE WHEN starts_with(s, 'nation-1#') THEN substr(s, 10) ELSE s END")
scalar("fn_24_source_link", NAMES, lambda s: fn.source_link(F.lit("https://github.com/a/b.git"), s, F.lit(7)), "'https://github.com/a/b/blob/HEAD/' || s || '#L7'")
scalar("fn_25_layer", "SELECT DISTINCT s FROM (SELECT 'ui' AS s UNION ALL SELECT 'processor' UNION ALL SELECT r_name FROM region) t", lambda s: F.concat(fn.layer_index(s).cast("string"), F.lit(":"), fn.layer_label(s)), f"concat({tw.layer_index('s')}, ':', {tw.layer_label('s')})")
scalar("fn_26_confidence_band", "SELECT l_discount AS s FROM lineitem", lambda s: fn.confidence_band(s * 10), "CASE WHEN s * 10 >= 0.8 THEN 'hi' WHEN s * 10 >= 0.6 THEN 'mid' ELSE 'low' END")
scalar("fn_27_mermaid", NAMES, lambda s: F.concat_ws("~", fn.mermaid_id(s), fn.mermaid_text(s), fn.file_name(s), fn.capitalised(s), fn.truncated(s, 12)), f"concat('n_', {tw.sub('s', '[^A-Za-z0-9]', '_')}, '~', {tw.mermaid('s')}, '~', {tw.sub('s', '[^A-Za-z0-9._-]+', '-')}, '~', upper(substr(s, 1, 1)), substr(s, 2), '~', CASE WHEN length(s) > 12 THEN substr(s, 1, 11) || '…' ELSE s END)")
scalar("fn_28_token_estimate", TEXTS, lambda s: fn.token_estimate(F.length(s)), "CAST(floor(length(s) / 4.0 + 0.5) AS BIGINT)", "doc_id")
scalar("src_11_grammar", "SELECT DISTINCT concat(p_name, CASE p_size % 6 WHEN 0 THEN '.cs' WHEN 1 THEN '.Java' WHEN 2 THEN '.tsx' WHEN 3 THEN '.mts' WHEN 4 THEN '.cjs' ELSE '.py' END) AS s FROM part", fn.parsed_language, "CASE WHEN lower(s) LIKE '%.cs' THEN 'csharp' WHEN lower(s) LIKE '%.java' THEN 'java' WHEN lower(s) LIKE '%.tsx' THEN 'tsx' WHEN lower(s) LIKE '%.mts' THEN 'typescript' WHEN lower(s) LIKE '%.cjs' THEN 'javascript' END")

PAIRS = "SELECT DISTINCT concat('/', a, '/{p}') AS c, concat('/v1/', b, CASE WHEN k % 2 = 0 THEN '/{p}' ELSE '/{id}' END) AS e FROM (SELECT DISTINCT replace(p_name, ' ', '/') AS a FROM part) x JOIN (SELECT DISTINCT upper(replace(p_name, ' ', '/')) AS b, p_size % 4 AS k FROM part) y ON substr(a, 1, 1) = lower(substr(b, 1, 1))"


@query("fn_03_path_matches", f"SELECT c, e, {tw.matches('cs', 'es')} AS x FROM (SELECT c, e, {tw.segs('c')} AS cs, {tw.segs('e')} AS es FROM ({PAIRS}) s) t")
def fn_03(spark, sf_dir):
    return est.run(spark, sf_dir, PAIRS).select("c", "e", fn.path_matches("c", "e").alias("x"))


@query("fn_04_match_score", f"SELECT c, e, {tw.score('cs', 'es')} AS x FROM (SELECT c, e, {tw.segs('c')} AS cs, {tw.segs('e')} AS es FROM ({PAIRS}) s) t")
def fn_04(spark, sf_dir):
    return est.run(spark, sf_dir, PAIRS).select("c", "e", fn.match_score("c", "e").alias("x"))


# --- the graph

EDGE = ("id", "kind", "source", "target", "fromHandler", "endpoint", "routingKey", "method", "url", "status", "resolution", "confidence")
ISSUE = ("level", "code", "service", "message")


def graph_query(key: str, sql: str | None = None):
    def add(f):
        return query(key, sql)(lambda spark, sf_dir: f(est.graph(spark, sf_dir)))

    return add


NO = "NULL::VARCHAR"


def edge_sql(id: str, kind: str, source: str, target: str, handler=NO, endpoint=NO, key=NO, method=NO, url=NO, status="'declared'", resolution="'static'", confidence="0.9::DOUBLE") -> str:
    return ", ".join(f"{v} AS {n}" for n, v in zip(EDGE, (id, f"'{kind}'", source, target, handler, endpoint, key, method, url, status, resolution, confidence)))


INTERNAL = f"SELECT {edge_sql(chr(39) + 'internal:' + chr(39) + ' || service || ' + chr(39) + ':' + chr(39) + ' || id || ' + chr(39) + '->' + chr(39) + ' || c', 'internal', 'service || ' + chr(39) + '#' + chr(39) + ' || id', 'service || ' + chr(39) + '#' + chr(39) + ' || c')} FROM (SELECT service, id, unnest(calls) AS c FROM handlers) t"
LISTENED = "CASE WHEN broker = 'rabbitmq' AND exchange IS NOT NULL THEN exchange ELSE topic END"
PUBLISH = "SELECT " + edge_sql("'publish:' || service || ':' || id", "publish", "service", "'topic:' || broker || ':' || topic", "service || '#' || fromHandler", key="routingKey", confidence="0.95::DOUBLE") + " FROM publishes"
CONSUME = "SELECT " + edge_sql("'consume:' || service || ':' || id", "consume", f"'topic:' || broker || ':' || {LISTENED}", "service", "service || '#' || handler", key='coalesce(routingKey, "group")', confidence="0.95::DOUBLE") + " FROM consumers"
HTTP = "SELECT " + edge_sql("'http:' || service || '->' || target", "http", "service", "target", resolution="first(resolution ORDER BY confidence DESC, i_ord)", confidence="max(confidence)") + " FROM resolved GROUP BY service, target"
DETAIL = "SELECT " + edge_sql("'http-detail:' || service || ':' || id", "http-detail", "service || '#' || fromHandler", "CASE WHEN ep IS NULL THEN target ELSE target || '#' || ep END", "service || '#' || fromHandler", "target || '#' || ep", method="method", url="url", resolution="resolution", confidence="confidence") + " FROM resolved"
KNOWN = "(d.dep_service IN (SELECT id FROM services) OR EXISTS (SELECT 1 FROM resolved r WHERE r.target = d.dep_service AND starts_with(r.target, 'external:') AND r.m_ord <= d.m_ord))"
DECLARED = "SELECT " + edge_sql("'declared:' || service || '->' || dep_service", "declared", "service", "dep_service", resolution="'config'", confidence="1::DOUBLE") + f" FROM declared d WHERE {KNOWN} AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.service = d.service AND r.target = d.dep_service)"
EDGES = "edges AS MATERIALIZED (" + " UNION ALL ".join((INTERNAL, PUBLISH, CONSUME, HTTP, DETAIL, DECLARED)) + ")"
TOPICS = f"topics AS (SELECT DISTINCT 'topic:' || broker || ':' || name AS id, broker, name FROM (SELECT broker, topic AS name FROM publishes UNION ALL SELECT broker, {LISTENED} FROM consumers) t)"
EXTERNAL = "outer_nodes AS (SELECT DISTINCT target AS id FROM resolved WHERE starts_with(target, 'external:'))"


def kinds(key: str, kind: str, sql: str, resolved: bool = True) -> None:
    full = tw.over_resolved(sql) if resolved else tw.over_estate(sql)
    graph_query(key, full)(lambda g: g.edges.filter(F.col("kind") == kind).select(*EDGE))


@query("agg_01_ignored", tw.over_estate("SELECT service, id FROM endpoints WHERE service NOT IN ('nation-3', 'nation-4')"))
def agg_01(spark, sf_dir):
    return est.estate(spark, sf_dir).without(("nation-3", "nation-4")).endpoints.select("service", "id")


COUNTS = ", ".join(f"(SELECT count(*) FROM {n} x WHERE x.service = s.id) AS n_{n}" for n in ("endpoints", "consumers", "calls", "publishes"))


@query("agg_02_service_nodes", tw.over_estate(f"SELECT id, name, layer, owner, {COUNTS} FROM services s"))
def agg_02(spark, sf_dir):
    return build.service_nodes(est.estate(spark, sf_dir)).select("id", "name", "layer", "owner", "n_endpoints", "n_consumers", "n_calls", "n_publishes")


graph_query("agg_03_endpoint_nodes", tw.over_estate("SELECT service || '#' || id AS node, method, path, handler FROM endpoints"))(lambda g: g.endpoints.select("node", "method", "path", "handler"))
graph_query("agg_04_nodes", tw.over_resolved("SELECT id, max_by(kind, k) AS kind FROM (SELECT id, 'service' AS kind, 0 AS k FROM services UNION ALL SELECT id, 'service', 0 FROM outer_nodes UNION ALL SELECT service || '#' || id, 'endpoint', 1 FROM endpoints UNION ALL SELECT service || '#' || id, 'handler', 2 FROM handlers UNION ALL SELECT id, 'topic', 0 FROM topics) t GROUP BY id", TOPICS, EXTERNAL))(build.nodes)
kinds("agg_05_internal_edges", "internal", INTERNAL, False)
graph_query("agg_06_passed_issues", tw.over_estate("SELECT level, 'extract:' || code AS code, service, message FROM issues"))(lambda g: build.passed_issues(g.estate).select(*ISSUE))
graph_query("agg_07_topics", f"WITH {tw.ESTATE}, {TOPICS} SELECT * FROM topics")(lambda g: g.topics.select("id", "broker", "name"))
kinds("agg_08_publish_edges", "publish", PUBLISH, False)
kinds("agg_09_consume_edges", "consume", CONSUME, False)
_orphan = "SELECT 'info' AS level, 'topic:no-{0}' AS code, NULL::VARCHAR AS service, 'No {0} found in the estate for ' || broker || ' topic \"' || name || '\" (external {1}?)' AS message FROM topics WHERE id NOT IN (SELECT {2} FROM ({3}) e)"
graph_query("agg_10_orphan_topics", f"WITH {tw.ESTATE}, {TOPICS} " + _orphan.format("publisher", "producer", "target", PUBLISH) + " UNION ALL " + _orphan.format("consumer", "consumer", "source", CONSUME))(lambda g: build.orphan_topics(g.topics, g.edges).select(*ISSUE))
_unresolved = "SELECT 'warn' AS level, 'call:unresolved' AS code, service, 'Could not resolve target of ' || coalesce(method, 'HTTP') || ' ' || url || CASE WHEN targetHint IS NULL THEN '' ELSE ' (hint: ' || targetHint || ')' END || ' from ' || fromHandler AS message FROM ruled WHERE rule IS NULL"
graph_query("agg_11_unresolved", tw.over_resolved(_unresolved))(lambda g: g.issues.filter("code = 'call:unresolved'").select(*ISSUE))
kinds("agg_12_http_edges", "http", HTTP)
kinds("agg_13_detail_edges", "http-detail", DETAIL)
graph_query("agg_14_unmatched", tw.over_resolved("SELECT 'info' AS level, 'call:endpoint-unmatched' AS code, service, 'Resolved ' || coalesce(method, 'HTTP') || ' ' || url || ' to ' || target || ' but no endpoint matched its path' AS message FROM resolved WHERE ep IS NULL AND NOT starts_with(target, 'external:')"))(lambda g: g.issues.filter("code = 'call:endpoint-unmatched'").select(*ISSUE))
kinds("agg_15_declared_edges", "declared", DECLARED)
graph_query("agg_15_unknown_services", tw.over_resolved(f"SELECT 'warn' AS level, 'declared:unknown-service' AS code, service, 'Declared dependency on unknown service \"' || dep_service || '\"' AS message FROM declared d WHERE NOT {KNOWN}"))(lambda g: g.issues.filter("code = 'declared:unknown-service'").select(*ISSUE))
graph_query("agg_16_external_nodes", tw.over_resolved("SELECT id, CASE id WHEN 'external:vendor5' THEN 'Vendor Five' ELSE substr(id, 10) END AS name, CASE id WHEN 'external:vendor5' THEN 'buyers' END AS owner, CASE id WHEN 'external:stripe' THEN 'Payments' ELSE 'External system at ' || substr(id, 10) END AS description FROM outer_nodes", EXTERNAL))(lambda g: g.services.filter("layer = 'external'").select("id", "name", "owner", "description"))
graph_query("agg_17_finalised", tw.over_resolved("SELECT kind, count(*) AS n FROM edges GROUP BY kind", EDGES))(lambda g: g.edges.groupBy("kind").agg(F.count("*").alias("n")))
graph_query("agg_18_aggregate", tw.over_resolved("SELECT * FROM edges WHERE kind <> 'http-detail'", EDGES))(lambda g: g.edges.filter("kind <> 'http-detail'").select(*EDGE))

RULES = {"res_a_declared": ("declared",), "res_av_named_outside": ("declared-external", "config-external"), "res_b_config": ("config",), "res_c_hint": ("hint",), "res_ct_hint_path": ("hint+path",), "res_d_own_host": ("host-match",), "res_dl_literal_host": ("literal-host",), "res_e_path": ("path-match",)}
FOUND = "service, id, target, resolution, confidence, ep AS endpoint"


def found_rows(df: DataFrame) -> DataFrame:
    return df.select("service", "id", "target", "resolution", "confidence", F.col("ep.id").alias("endpoint"))


for _key, _names in RULES.items():
    graph_query(_key, tw.over_resolved(f"SELECT {FOUND} FROM resolved WHERE resolution IN ({', '.join(map(tw.q, _names))})"))(lambda g, names=_names: found_rows(g.resolved.filter(F.col("resolution").isin(*names))))
graph_query("res_ep_endpoints", tw.over_resolved(f"SELECT {FOUND} FROM resolved WHERE ep IS NOT NULL"))(lambda g: found_rows(g.resolved.filter("ep is not null")))
def many_targets() -> dict[str, str]:
    """10,000 target keys by a rule: settings, hint names in capitals, and a pattern in every hundred."""
    key = lambda i: f"/brand-{i // 100}\\D/" if i % 100 == 50 else f"CFG_{i // 2}" if i % 2 else f"nation_{i // 2}_url"
    return {key(i): f"nation-{i % 25}" for i in range(10_000)}


_MANY = f"""keys AS (SELECT i, CASE WHEN i % 100 = 50 THEN 'brand-' || (i // 100) || '\\D' WHEN i % 2 = 1 THEN 'cfg_' || (i // 2) ELSE 'nation_' || (i // 2) || '_url' END AS k FROM range(10000) t(i)),
asked AS (SELECT service, id, i_ord, targetHint AS x FROM c UNION ALL SELECT service, id, i_ord, host FROM c UNION ALL SELECT service, id, i_ord, url FROM c),
texts AS (SELECT DISTINCT x FROM asked WHERE x <> ''),
hit AS (SELECT x, min(i) AS i FROM (SELECT x, i FROM texts JOIN keys ON lower(x) = k WHERE i % 100 <> 50 UNION ALL SELECT x, i FROM texts JOIN keys ON i % 100 = 50 AND regexp_matches(x, k, 'i')) t GROUP BY x)"""


@query("res_b_many_targets", f"WITH {tw.ESTATE}, c AS (SELECT *, {tw.call_parts('url')['host']} AS host FROM calls), {_MANY} SELECT service, id, i_ord, 'nation-' || (min(i) % 25) AS value FROM asked JOIN hit ON hit.x = asked.x GROUP BY service, id, i_ord")
def res_b_many(spark, sf_dir):
    calls = cut(resolve.parsed_calls(est.estate(spark, sf_dir).calls).select("service", "id", "i_ord", "hint", "host", "url"))
    found = resolve.with_config_value(calls, Config(many_targets()))
    return found.filter("value is not null").select("service", "id", "i_ord", "value")


_hint = "SELECT 'warn' AS level, 'call:ambiguous-hint' AS code, service, 'Hint \"' || targetHint || '\" matches several services: ' || array_to_string(tops, ', ') AS message FROM ruled WHERE targetService IS NULL AND value IS NULL AND len(tops) > 1 AND won IS NULL"
graph_query("res_ct_ambiguous_hints", tw.over_resolved(_hint))(lambda g: g.issues.filter("code = 'call:ambiguous-hint'").select(*ISSUE))
_paths = "SELECT 'warn' AS level, 'call:ambiguous-path' AS code, service, 'Path ' || path || ' matches endpoints in several services: ' || array_to_string(who, ', ') || '; add a targets entry' AS message FROM ruled WHERE rule IS NULL AND n > 1"
graph_query("res_e_ambiguous_paths", tw.over_resolved(_paths))(lambda g: g.issues.filter("code = 'call:ambiguous-path'").select(*ISSUE))

# --- traces, over the sparse graph

STATIC = f"({tw.duck(est.SQL['graph'])})"
SEEN = f"({tw.duck(est.SQL['observed']).replace('source', 'o_source').replace('target', 'o_target')})"


@query("src_03_traces", f"SELECT o_source AS source, o_target AS target, count FROM {SEEN} o")
def src_03(spark, sf_dir):
    raw = est.run(spark, sf_dir, est.SQL["observed"])
    return src.observed(raw.select("ord", F.lit(None).cast("string").alias("source"), F.col("source").alias("parent"), F.lit(None).cast("string").alias("client"), "target", F.lit(None).cast("string").alias("child"), F.lit(None).cast("string").alias("server"), F.lit(None).cast("double").alias("count"), F.col("count").cast("double").alias("callCount"))).select("source", "target", "count")


NAMED = f"""allsvc AS (SELECT id, {tw.toks('id')} AS st FROM (SELECT id FROM services UNION ALL SELECT id FROM outer_nodes) x),
nm AS (SELECT DISTINCT n, {tw.toks('n')} AS nt FROM (SELECT o_source AS n FROM {SEEN} a UNION ALL SELECT o_target FROM {SEEN} b) t),
hit AS (SELECT n, min(a.id) AS one FROM nm JOIN allsvc a ON len(nt) > 0 AND len(list_filter(nt, lambda y: list_contains(a.st, y))) = len(nt) GROUP BY n HAVING count(*) = 1),
named AS (SELECT nm.n AS name, CASE WHEN nm.n = 'trace-7' THEN 'nation-7' WHEN nm.n = 'trace-14' THEN 'gone-14' WHEN nm.n IN (SELECT id FROM services) THEN nm.n ELSE coalesce(one, 'external:' || lower(nm.n)) END AS id FROM nm LEFT JOIN hit ON hit.n = nm.n)"""
PAIRED = f"p AS (SELECT source, target, count(*) AS seen FROM (SELECT x.id AS source, y.id AS target FROM {SEEN} o JOIN named x ON x.name = o_source JOIN named y ON y.name = o_target) t WHERE source <> target GROUP BY ALL)"


@query("trc_01_names", tw.over_resolved("SELECT * FROM named", EXTERNAL, NAMED))
def trc_01(spark, sf_dir):
    return traces.resolve_names(est.graph(spark, sf_dir), est.run(spark, sf_dir, est.SQL["observed"])).select("name", "id")


@query("trc_02_pairs", tw.over_resolved("SELECT * FROM p", EXTERNAL, NAMED, PAIRED))
def trc_02(spark, sf_dir):
    return traces.observed_pairs(est.graph(spark, sf_dir), est.run(spark, sf_dir, est.SQL["observed"])).select("source", "target", "seen")


@query("trc_03_drift", tw.over_resolved("SELECT coalesce(st.source, p.source) AS source, coalesce(st.target, p.target) AS target, CASE WHEN st.source IS NULL THEN CASE WHEN seen > 1 THEN 'both' ELSE 'observed' END WHEN p.source IS NULL THEN 'declared' ELSE 'both' END AS status FROM st FULL JOIN p ON st.source = p.source AND st.target = p.target", EXTERNAL, NAMED, PAIRED, f"st AS (SELECT src AS source, dst AS target FROM {STATIC} g)"))
def trc_03(spark, sf_dir):
    static = est.run(spark, sf_dir, est.SQL["graph"]).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return traces.drift(static, traces.observed_pairs(est.graph(spark, sf_dir), est.run(spark, sf_dir, est.SQL["observed"]))).select("source", "target", "status")


def merged(spark, sf_dir):
    return traces.merge_traces(est.graph(spark, sf_dir), est.run(spark, sf_dir, est.SQL["observed"]))


@query("trc_04_merged_edges", tw.over_resolved("SELECT coalesce(e.source, p.source) AS source, coalesce(e.target, p.target) AS target, CASE WHEN p.source IS NULL THEN e.status WHEN e.source IS NULL AND seen = 1 THEN 'observed' ELSE 'both' END AS status, CASE WHEN p.source IS NULL THEN e.confidence WHEN e.source IS NULL AND seen = 1 THEN 0.85::DOUBLE ELSE 1::DOUBLE END AS confidence FROM (SELECT * FROM edges WHERE kind IN ('http', 'declared')) e FULL JOIN p ON p.source = e.source AND p.target = e.target", EDGES, EXTERNAL, NAMED, PAIRED))
def trc_04(spark, sf_dir):
    return merged(spark, sf_dir).edges.filter("kind in ('http', 'declared')").select("source", "target", "status", "confidence")


@query("trc_05_drift_issues", tw.over_resolved("SELECT code, count(*) AS n FROM (SELECT CASE WHEN e.source IS NULL THEN 'drift:observed-only' WHEN p.source IS NULL AND NOT starts_with(e.target, 'external:') THEN 'drift:declared-only' END AS code FROM (SELECT * FROM edges WHERE kind IN ('http', 'declared')) e FULL JOIN p ON p.source = e.source AND p.target = e.target) t WHERE code IS NOT NULL GROUP BY code", EDGES, EXTERNAL, NAMED, PAIRED))
def trc_05(spark, sf_dir):
    return merged(spark, sf_dir).issues.filter("code like 'drift:%'").groupBy("code").agg(F.count("*").alias("n"))


# --- validation, over an estate with planted faults

FAULTS = {
    "handlers": "SELECT m_ord, i_ord, service, CASE WHEN i_ord = 3 THEN 'Client.0' ELSE id END AS id, kind, name, CASE WHEN i_ord = 5 THEN array('gone') ELSE calls END AS calls, CASE WHEN i_ord = 1 THEN NULL ELSE named_struct('file', 'f', 'line', i_ord) END AS loc FROM ({0}) t",
    "endpoints": "SELECT m_ord, i_ord, service, CASE WHEN i_ord = 2 THEN 'twice' WHEN i_ord = 4 THEN 'twice' ELSE id END AS id, CASE WHEN i_ord = 6 THEN 'FETCH' ELSE method END AS method, CASE WHEN i_ord = 7 THEN 'v1' ELSE path END AS path, CASE WHEN i_ord = 8 THEN 'nobody' ELSE handler END AS handler, named_struct('file', 'f', 'line', CASE WHEN i_ord = 5 THEN NULL ELSE i_ord END) AS loc FROM ({0}) t",
    "consumers": "SELECT m_ord, i_ord, service, id, CASE WHEN i_ord = 1 THEN 'pigeon' ELSE broker END AS broker, CASE WHEN i_ord = 0 THEN '' ELSE topic END AS topic, exchange, routingKey, handler, named_struct('file', 'f', 'line', 1) AS loc FROM ({0}) t",
    "calls": "SELECT m_ord, i_ord, service, id, CASE WHEN i_ord = 3 THEN 'FETCH' ELSE method END AS method, CASE WHEN i_ord = 4 THEN NULL ELSE url END AS url, CASE WHEN i_ord = 5 THEN 'nobody' ELSE fromHandler END AS fromHandler, named_struct('file', 'f', 'line', 1) AS loc FROM ({0}) t",
    "publishes": "SELECT m_ord, i_ord, service, id, CASE WHEN i_ord = 1 THEN 'pigeon' ELSE broker END AS broker, CASE WHEN i_ord = 0 THEN '' ELSE topic END AS topic, routingKey, CASE WHEN i_ord = 2 THEN 'nobody' ELSE fromHandler END AS fromHandler, named_struct('file', 'f', 'line', 1) AS loc FROM ({0}) t",
}


def faulty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return conform(est.run(spark, sf_dir, FAULTS[name].format(est.SQL[name]) if "{0}" in FAULTS[name] else FAULTS[name]), name)


def fault_sql(name: str) -> str:
    return "(" + tw.duck(FAULTS[name].replace("{0}", est.SQL[name])).replace("named_struct('file', 'f', 'line', ", "struct_pack(file := 'f', line := ") + ")"


def val(key: str, f, sql: str) -> None:
    QUERIES[key], ORACLE[key] = (lambda spark, sf_dir: f(lambda n: faulty(spark, sf_dir, n))), sql


_at = "'{0}[' || i_ord || '].{1}'"
_unknown = "SELECT m_ord, " + _at + " AS path, 'unknown handler ' || {2} AS message FROM {3} x WHERE NOT EXISTS (SELECT 1 FROM {4} h WHERE h.m_ord = x.m_ord AND h.id = x.{2})"
_dup = "SELECT m_ord, " + _at.format("{0}", "id") + " AS path, {1} AS message FROM (SELECT *, row_number() OVER (PARTITION BY m_ord, id ORDER BY i_ord) AS n FROM {2} y) x WHERE n > 1"
_bad = "SELECT m_ord, " + _at + " AS path, '{2}' AS message FROM {3} x WHERE {4}"
val("val_04_handler_ids", lambda t: validate.handler_ids(t("handlers")), _dup.format("handlers", "'duplicate handler id ' || id", fault_sql("handlers")))
val("val_05_callees", lambda t: validate.unknown_callees(t("handlers")), f"SELECT m_ord, 'handlers[' || i_ord || '].calls[' || (j - 1) || ']' AS path, 'unknown handler ' || calls[j] AS message FROM (SELECT *, unnest(range(1, len(calls) + 1)) AS j FROM {fault_sql('handlers')} y) x WHERE NOT EXISTS (SELECT 1 FROM {fault_sql('handlers')} h WHERE h.m_ord = x.m_ord AND h.id = x.calls[x.j])")
val("val_06_endpoints", lambda t: validate.endpoint_shape(t("endpoints")).union(validate.unknown_handlers(t("endpoints"), t("handlers"), "handler", "endpoints")), " UNION ALL ".join([_bad.format("endpoints", "method", "invalid http method", fault_sql("endpoints"), "method NOT IN ('GET', 'POST')"), _bad.format("endpoints", "path", "must start with /", fault_sql("endpoints"), "NOT starts_with(path, '/')"), _dup.format("endpoints", "'duplicate endpoint id'", fault_sql("endpoints")), _unknown.format("endpoints", "handler", "handler", fault_sql("endpoints"), fault_sql("handlers"))]))
for _n, _k in (("consumers", "val_07_consumers"), ("publishes", "val_09_publishes")):
    _h = "handler" if _n == "consumers" else "fromHandler"
    val(_k, lambda t, n=_n, h=_h: validate.message_shape(t(n), n).union(validate.unknown_handlers(t(n), t("handlers"), h, n)), " UNION ALL ".join([_bad.format(_n, "broker", "invalid broker", fault_sql(_n), "broker NOT IN ('kafka', 'rabbitmq')"), _bad.format(_n, "topic", "required string", fault_sql(_n), "topic = ''"), _unknown.format(_n, _h, _h, fault_sql(_n), fault_sql("handlers"))]))
val("val_08_calls", lambda t: validate.call_shape(t("calls")).union(validate.unknown_handlers(t("calls"), t("handlers"), "fromHandler", "calls")), " UNION ALL ".join([_bad.format("calls", "url", "required string", fault_sql("calls"), "url IS NULL"), _bad.format("calls", "method", "invalid http method", fault_sql("calls"), "method NOT IN ('GET', 'POST')"), _unknown.format("calls", "fromHandler", "fromHandler", fault_sql("calls"), fault_sql("handlers"))]))
val("val_10_locations", lambda t: validate.gathered(t("handlers"), ["m_ord"], *validate.located("handlers")).union(validate.gathered(t("endpoints"), ["m_ord"], *validate.located("endpoints"))), _bad.format("handlers", "location", "location must be an object", fault_sql("handlers"), "loc IS NULL") + " UNION ALL " + _bad.format("endpoints", "location.line", "must be a number", fault_sql("endpoints"), "loc.line IS NULL"))

_SHAPES = "SELECT CAST(n_nationkey AS INT) AS m_ord, CASE WHEN n_nationkey % 5 = 0 THEN '2' ELSE '1' END AS version, CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE lower(n_name) END AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'middle' ELSE 'ui' END AS layer, n_nationkey % 7 = 0 AS bare FROM nation"


@query("val_01_structure", f"SELECT m_ord, unnest(list_filter([CASE WHEN version <> '1' THEN 'schemaVersion' END, CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9._-]*$') THEN 'service.id' END, CASE WHEN name IS NULL THEN 'service.name' END, CASE WHEN layer = 'middle' THEN 'service.layer' END, CASE WHEN bare THEN 'calls' END], lambda y: y IS NOT NULL)) AS path FROM ({_SHAPES}) s")
def val_01(spark, sf_dir):
    return shapes_checked(spark, sf_dir).select("m_ord", "path")


def shapes_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = est.run(spark, sf_dir, _SHAPES)
    full = F.array().cast("array<string>")
    arrays = [full.alias(a) if a != "calls" else F.when(~F.col("bare"), full).alias(a) for a in validate.ARRAYS]
    return validate.structural(s.select("m_ord", F.col("version").alias("schemaVersion"), F.struct("id", "name", "layer").alias("service"), *arrays))


@query("val_02_services", f"SELECT m_ord, path, message FROM (SELECT m_ord, unnest(list_filter([CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9._-]*$') THEN {{'path': 'service.id', 'message': 'must match ^[a-z0-9][a-z0-9._-]*$'}} END, CASE WHEN name IS NULL THEN {{'path': 'service.name', 'message': 'required string'}} END, CASE WHEN layer = 'middle' THEN {{'path': 'service.layer', 'message': 'must be one of ui, experience, capability, domain, processor, external, unknown'}} END], lambda y: y IS NOT NULL), recursive := true) FROM ({_SHAPES}) s) t")
def val_02(spark, sf_dir):
    return shapes_checked(spark, sf_dir).filter("path like 'service.%'").select("m_ord", "path", "message")


@query("val_03_arrays", f"SELECT m_ord, 'calls' AS path, 'required array' AS message FROM ({_SHAPES}) s WHERE bare")
def val_03(spark, sf_dir):
    return shapes_checked(spark, sf_dir).filter("path not like 'service%' and path <> 'schemaVersion'").select("m_ord", "path", "message")


# --- diff, enrichment and planning

_parts = {"before": "ts < TIMESTAMP '2024-01-16'", "after": "ts >= TIMESTAMP '2024-01-16'"}
_facet = "SELECT DISTINCT concat('nation-', CAST(user_id % 25 AS STRING)) AS service, 'publishes' AS facet, concat('kafka:', event_type, ' (', {0}, ')') AS key FROM events WHERE {1}"


def facet_estate(spark: SparkSession, sf_dir: str, when: str):
    rows = est.run(spark, sf_dir, f"SELECT concat('nation-', CAST(user_id % 25 AS STRING)) AS service, concat('p', CAST(event_id AS STRING)) AS id, 'kafka' AS broker, event_type AS topic, get_json_object(props, '$.k') AS routingKey FROM events WHERE {_parts[when]}")
    h = est.run(spark, sf_dir, f"SELECT concat('nation-', CAST(user_id % 25 AS STRING)) AS service, event_type AS id, CAST(min(event_id) AS STRING) AS hash, 0 AS i_ord FROM events WHERE {_parts[when]} AND {'user_id % 3 > 0' if when == 'before' else 'user_id % 4 > 0'} GROUP BY 1, 2")
    from ..operators.estate import estate_of

    return estate_of(spark, publishes=rows, handlers=h)


_k = "json_extract_string(props, '$.k')"


@query("dif_01_facet_keys", tw.duck(_facet.format(_k, _parts["after"])))
def dif_01(spark, sf_dir):
    return diff.facet_keys(facet_estate(spark, sf_dir, "after"))


_b, _a = (f"({_facet.format(_k, _parts[w])})" for w in ("before", "after"))


@query("dif_02_changes", f"SELECT *, 'added' AS change FROM ({_a} EXCEPT {_b}) x UNION ALL SELECT *, 'removed' FROM ({_b} EXCEPT {_a}) y")
def dif_02(spark, sf_dir):
    return diff.changes(*(diff.facet_keys(facet_estate(spark, sf_dir, w)) for w in ("before", "after")))


_hs = lambda w: f"(SELECT concat('nation-', user_id % 25) AS service, event_type AS id, CAST(min(event_id) AS VARCHAR) AS hash FROM events WHERE {_parts[w]} AND {'user_id % 3 > 0' if w == 'before' else 'user_id % 4 > 0'} GROUP BY 1, 2)"
_CHURN = f"SELECT coalesce(b.service, a.service) AS service, count(*) FILTER (b.id IS NULL) AS added, count(*) FILTER (a.id IS NULL) AS removed, count(*) FILTER (a.hash <> b.hash) AS changed FROM {_hs('before')} b FULL JOIN {_hs('after')} a ON a.service = b.service AND a.id = b.id GROUP BY 1"


@query("dif_03_handler_churn", _CHURN)
def dif_03(spark, sf_dir):
    return diff.handler_churn(*(facet_estate(spark, sf_dir, w).handlers for w in ("before", "after")))


@query("dif_04_flags", f"SELECT c.service, added + removed + changed > 0 OR d.service IS NOT NULL AS has_changes, coalesce(new, false) AS new_dependencies FROM ({_CHURN}) c LEFT JOIN (SELECT service, bool_or(change = 'added') AS new FROM ({ORACLE['dif_02_changes']}) z GROUP BY 1) d ON d.service = c.service")
def dif_04(spark, sf_dir):
    b, a = (facet_estate(spark, sf_dir, w) for w in ("before", "after"))
    return diff.summary(diff.changes(diff.facet_keys(b), diff.facet_keys(a)), diff.handler_churn(b.handlers, a.handlers))


_ADVICE = "> ⚠️ This change introduces a new outbound dependency. Make sure the aggregation targets can resolve it, or it will show as unresolved in the flow map."
_REPORT = f"""SELECT s.id AS service, '### service graph: ' || s.id || CASE WHEN coalesce(f.has_changes, false) THEN
 coalesce(chr(10) || chr(10) || '**Publishes**' || chr(10) || (SELECT string_agg(CASE change WHEN 'added' THEN '- ➕ `' ELSE '- ➖ `' END || key || '`', chr(10) ORDER BY change, key) FROM ({ORACLE['dif_02_changes']}) d WHERE d.service = s.id), '')
 || chr(10) || chr(10) || 'Handlers: ' || coalesce(added, 0) || ' added, ' || coalesce(changed, 0) || ' changed, ' || coalesce(removed, 0) || ' removed.' || CASE WHEN f.new_dependencies THEN chr(10) || chr(10) || {tw.q(_ADVICE)} ELSE '' END
 ELSE chr(10) || chr(10) || 'No changes to endpoints, consumers, outbound calls or publishes.' END AS text FROM services s LEFT JOIN ({ORACLE['dif_04_flags']}) f ON f.service = s.id LEFT JOIN ({_CHURN}) c ON c.service = s.id"""


@query("dif_05_markdown", tw.over_estate(_REPORT))
def dif_05(spark, sf_dir):
    b, a = (facet_estate(spark, sf_dir, w) for w in ("before", "after"))
    services = conform(est.run(spark, sf_dir, est.SQL["services"]), "services")
    return diff.markdown(b, a.replace(services=services))


_ENRICH = "SELECT concat('nation-', CAST(n_nationkey AS STRING)) AS service, CASE WHEN n_nationkey % 2 = 0 THEN concat('about ', n_name) ELSE '' END AS description, n_nationkey AS k FROM nation"


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = est.run(spark, sf_dir, _ENRICH)
    note = lambda text, h: F.struct(F.concat(F.lit(text), "service").alias("summary"), h.alias("hash"))
    h = F.create_map(F.lit("Client.0"), note("zero of ", F.concat(F.lit("h"), F.col("k").cast("string"), F.lit("Client.0"))), F.lit("Client.1"), note("stale of ", F.lit("old")), F.lit("Client.2"), note("free of ", F.lit(None).cast("string")))
    e = F.create_map(F.lit("GET /v1/parts/brand-1/{partKey}"), F.struct(F.concat(F.lit("one of "), "service").alias("summary"), F.lit("use").alias("useCase")))
    return d.select("service", "description", h.alias("handlers"), e.alias("endpoints"))


@query("enr_01_descriptions", tw.over_estate("SELECT id, CASE WHEN m_ord % 2 = 0 AND starts_with(id, 'nation-') THEN 'about ' || name END AS description FROM services"))
def enr_01(spark, sf_dir):
    return enrich.enrich(est.estate(spark, sf_dir), enrichment(spark, sf_dir)).services.select("id", "description")


@query("enr_02_handler_summaries", tw.over_estate("SELECT service, id, CASE WHEN id = 'Client.0' THEN 'zero of ' || service WHEN id = 'Client.1' AND hash IS NULL THEN 'stale of ' || service WHEN id = 'Client.2' THEN 'free of ' || service END AS summary FROM handlers"))
def enr_02(spark, sf_dir):
    return enrich.enrich(est.estate(spark, sf_dir), enrichment(spark, sf_dir)).handlers.select("service", "id", "summary")


@query("enr_03_endpoint_summaries", tw.over_estate("SELECT service, id, CASE WHEN id = 'GET /v1/parts/brand-1/{partKey}' THEN 'one of ' || service END AS summary FROM endpoints"))
def enr_03(spark, sf_dir):
    return enrich.enrich(est.estate(spark, sf_dir), enrichment(spark, sf_dir)).endpoints.select("service", "id", "summary")


_CONV = "SELECT concat('flow-', CAST(conv_id AS STRING)) AS flow_id, CAST(turn + 1 AS INT) AS step_no, role AS service, role AS ref, CASE WHEN turn % 3 = 1 THEN 'publish' WHEN turn % 3 = 2 THEN 'consumer' ELSE 'endpoint' END AS kind, CAST(NULL AS STRING) AS `from`, substr(text, 1, 20) AS description FROM conversations"
_CONV_SQL = tw.duck(_CONV).replace("`from`", '"from"')


@query("enr_04_flow_texts", f"SELECT flow_id, step_no, CASE WHEN step_no = 2 THEN 'told ' || flow_id ELSE description END AS description FROM ({_CONV_SQL}) t")
def enr_04(spark, sf_dir):
    steps = est.run(spark, sf_dir, _CONV)
    f = steps.select("flow_id").distinct().withColumns({c: F.lit(None).cast("string") for c in ("name", "useCase", "description")})
    told = f.select(F.create_map("flow_id", F.struct(F.lit("n").alias("name"), F.lit("u").alias("useCase"), F.lit("").alias("description"), F.create_map(F.lit("1"), F.concat(F.lit("told "), "flow_id")).alias("steps"))).alias("flows"))
    return enrich.enrich_flows(f, steps, told)[1].select("flow_id", "step_no", "description")


_REACH = "WITH RECURSIVE {0}, up AS (SELECT DISTINCT service, c AS src, id AS dst FROM (SELECT service, id, unnest(calls) AS c FROM handlers) t), r(service, id) AS (SELECT DISTINCT service, fromHandler FROM calls UNION SELECT DISTINCT service, fromHandler FROM publishes UNION SELECT up.service, up.dst FROM r JOIN up ON up.service = r.service AND up.src = r.id) "


@query("llm_01_interesting_handlers", _REACH.format(tw.ESTATE) + "SELECT service, id FROM r UNION SELECT service, handler FROM endpoints UNION SELECT service, handler FROM consumers")
def llm_01(spark, sf_dir):
    return enrich.interesting_handlers(est.estate(spark, sf_dir))


_LINES = "SELECT coalesce(source, 'none') AS service, CAST(doc_id AS STRING) AS id, concat(coalesce(source, 'none'), '/', CAST(CAST(floor((n - 1) / 100) AS INT) AS STRING)) AS file, CAST((n - 1) % 100 * 5 + 5 AS INT) AS line, text FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) d"


def source_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a handler, a hundred to a file, one each five lines."""
    d = est.run(spark, sf_dir, _LINES)
    return d.select("service", "id", F.lit(0).alias("i_ord"), F.struct("file", "line").alias("loc"), F.lit(None).cast("string").alias("hash"), "text")


@query("llm_02_slices", f"SELECT service, id, line AS start_line, least(coalesce(lead(line) OVER (PARTITION BY service, file ORDER BY line) - 1, size), line + 119, size) AS end_line, line || '..' || least(coalesce(lead(line) OVER (PARTITION BY service, file ORDER BY line) - 1, size), line + 119, size) AS ends FROM (SELECT *, max(line) OVER (PARTITION BY service, file) + 130 AS size FROM ({_LINES}) t) u")
def llm_02(spark, sf_dir):
    h = source_handlers(spark, sf_dir).drop("text")
    files = h.groupBy("service", F.col("loc.file").alias("file")).agg((F.max("loc.line") + 130).alias("size"))
    files = files.select("service", "file", F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: i.cast("string")), "\n").alias("text"))
    ends = F.concat(F.substring_index("text", "\n", 1), F.lit(".."), F.substring_index("text", "\n", -1))
    return enrich.slices(h, files).select("service", "id", "start_line", "end_line", ends.alias("ends"))


@query("llm_03_cache_split", "SELECT doc_id, doc_id % 3 = 0 AS cached, substr(sha256('[\"handler\",\"1\",\"m\",\"' || source || '\",\"' || doc_id || '\",\"h\"]'), 1, 24) AS key FROM documents")
def llm_03(spark, sf_dir):
    cut = source_handlers(spark, sf_dir).withColumn("hash", F.lit("h"))
    keys = enrich.split_cached(cut, spark.createDataFrame([], "key string"), "1", "m")
    out = enrich.split_cached(cut, keys.filter(F.col("id").cast("long") % 3 == 0).select("key"), "1", "m")
    return out.select(F.col("id").cast("long").alias("doc_id"), "cached", "key")


_PACK = "SELECT source AS service, doc_id AS ord, CAST(n_chars AS BIGINT) AS chars FROM documents"


@query("llm_04_chunks", f"WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ord) AS n FROM ({_PACK}) t), p(service, ord, n, chunk, size) AS (SELECT service, ord, n, 0, chars FROM d WHERE n = 1 UNION ALL SELECT d.service, d.ord, d.n, CASE WHEN p.size + d.chars > 60000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.size + d.chars > 60000 THEN d.chars ELSE p.size + d.chars END FROM p JOIN d ON d.service = p.service AND d.n = p.n + 1) SELECT service, ord, chunk FROM p")
def llm_04(spark, sf_dir):
    return enrich.packed(est.run(spark, sf_dir, _PACK)).select("service", "ord", "chunk")


_agg = lambda line, rows, order: f"(SELECT string_agg({line}, chr(10) ORDER BY {order}) FROM {rows})"
_part = lambda title, body: f"coalesce(chr(10) || chr(10) || '## {title}' || chr(10) || {body}, '')"
_PROMPT = "SELECT s.id AS service, 0 AS chunk, '# Service: ' || s.id || ' (' || s.name || '), layer=' || s.layer || " + " || ".join([
    _part("Outbound HTTP", _agg("'- ' || fromHandler || ': ' || coalesce(method, 'HTTP') || ' ' || url || CASE WHEN targetService IS NOT NULL THEN ' -> ' || targetService WHEN targetHint IS NOT NULL THEN ' (hint ' || targetHint || ')' ELSE '' END", "calls c WHERE c.service = s.id AND fromHandler LIKE 'Client.%'", "i_ord")),
    _part("Publishes", _agg("'- ' || fromHandler || ': ' || broker || ' ' || topic || ' (' || routingKey || ')'", "publishes c WHERE c.service = s.id", "i_ord")),
    _part("Handler call graph", _agg("'- ' || id || ' -> ' || array_to_string(calls, ', ')", "handlers h WHERE h.service = s.id AND id LIKE 'Client.%'", "i_ord")),
    _part("Source slices (handler id, then code)", _agg("chr(10) || '### ' || id || ' (f:1-2)' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```'", "handlers h WHERE h.service = s.id AND id LIKE 'Client.%'", "i_ord")),
]) + " || chr(10) || chr(10) || 'Summarise every handler id listed above and every endpoint id listed above.' AS prompt FROM services s WHERE starts_with(s.id, 'nation-')"


@query("llm_05_prompts", tw.over_estate(_PROMPT))
def llm_05(spark, sf_dir):
    e = est.estate(spark, sf_dir)
    w = e.handlers.filter("id like 'Client.%'").select("service", "id", F.lit("f").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("code").alias("text"), "i_ord")
    return enrich.prompts(e, w.withColumn("ord", F.col("i_ord")).withColumn("chunk", F.lit(0)))


@query("llm_06_merged_summaries", "SELECT 'nation-' || k AS service, max(CASE WHEN e = 0 THEN 'd' || first_id END) AS description FROM (SELECT user_id % 25 AS k, min(event_id) AS first_id, 0 AS e FROM events GROUP BY 1) t GROUP BY 1")
def llm_06(spark, sf_dir):
    rows = est.run(spark, sf_dir, "SELECT concat('nation-', CAST(user_id % 25 AS STRING)) AS service, event_id AS part, concat('d', CAST(event_id AS STRING)) AS description FROM events")
    one = F.array(F.struct(F.lit("h").alias("id"), F.col("description").alias("summary")))
    parts = rows.withColumn("handlers", one).withColumn("endpoints", F.array(F.struct(F.lit("e").alias("id"), F.col("description").alias("summary"), F.lit("u").alias("useCase"))))
    return enrich.merge_summaries(parts, est.estate(spark, sf_dir).handlers)[0]


@query("llm_07_batches", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 25 AS INT) AS batch FROM documents")
def llm_07(spark, sf_dir):
    return enrich.batches(est.run(spark, sf_dir, "SELECT doc_id FROM documents"), "doc_id").select("doc_id", "batch")


# --- exploration

E_ALL = [EDGES, TOPICS, EXTERNAL]
SVC = "svc AS (SELECT id, name, layer, owner FROM services UNION ALL SELECT id, NULL, 'external', NULL FROM outer_nodes)"
MAPPED = "m AS MATERIALIZED (SELECT * FROM edges WHERE kind IN ('http', 'publish', 'consume', 'declared'))"


def shown(select: str, *more: str) -> str:
    return tw.over_resolved(select, *E_ALL, SVC, MAPPED, *more)


def plain_edges(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "source", "target")


P = "id, kind, source, target"
graph_query("qry_01_index", shown("SELECT id AS service, (SELECT count(*) FROM edges e WHERE e.source = s.id) AS n_out, (SELECT count(*) FROM edges e WHERE e.target = s.id) AS n_in, (SELECT count(*) FROM endpoints e WHERE e.service = s.id) AS n_endpoints, (SELECT count(*) FROM handlers e WHERE e.service = s.id) AS n_handlers FROM svc s"))(lambda g: explore.index(g).drop("n_issues"))
graph_query("qry_01_owners", shown("SELECT DISTINCT owner FROM services UNION SELECT 'buyers' FROM outer_nodes WHERE id = 'external:vendor5'"))(lambda g: explore.owners(g.services))
graph_query("qry_02_lookups", shown(f"SELECT {P} FROM edges WHERE source = 'nation-3' OR target = 'nation-3'"))(lambda g: plain_edges(g.edges.filter("source = 'nation-3' or target = 'nation-3'")))
graph_query("qry_03_map_edges", shown(f"SELECT {P} FROM m"))(lambda g: plain_edges(explore.map_edges(g.edges)))
graph_query("qry_05_detail_edges", shown(f"SELECT {P} FROM edges WHERE kind = 'http-detail' AND starts_with(source, 'nation-3#') AND (target = 'nation-5' OR starts_with(target, 'nation-5#'))"))(lambda g: plain_edges(explore.detail_edges(g.edges, g.handlers, "nation-3", "nation-5")))
graph_query("qry_06_target_services", shown("SELECT id, split_part(target, '#', 1) AS target_service FROM edges"))(lambda g: explore.target_services(g.edges, g.endpoints, g.handlers))
_ENTRY = "WITH RECURSIVE {0}, st AS (SELECT DISTINCT service || '#' || id AS src, service || '#' || c AS dst FROM (SELECT service, id, unnest(calls) AS c FROM handlers) t), rh(entry, handler) AS (SELECT DISTINCT service || '#' || handler, service || '#' || handler FROM endpoints UNION SELECT rh.entry, st.dst FROM rh JOIN st ON st.src = rh.handler)"
graph_query("qry_08_reachable_handlers", _ENTRY.format(tw.ESTATE) + " SELECT entry, handler FROM rh")(lambda g: explore.reachable_handlers(g.edges.filter("kind = 'internal'"), g.endpoints.select(fn.handler_node("service", "handler").alias("entry")).distinct()))
graph_query("qry_08_reachable_counts", _ENTRY.format(tw.ESTATE) + " SELECT entry, count(*) AS n FROM rh GROUP BY entry")(lambda g: explore.reachable_counts(g.edges.filter("kind = 'internal'"), g.endpoints.select(fn.handler_node("service", "handler").alias("entry"))))
_OUT = "ob AS (SELECT rh.entry, e.* FROM rh JOIN edges e ON (e.kind IN ('http', 'publish', 'declared') AND e.fromHandler = rh.handler) OR (e.kind = 'http-detail' AND e.source = rh.handler))"
_IMPACT = _ENTRY.format(", ".join([tw.RESOLVED, *E_ALL])) + f", {_OUT}"


@query("qry_09_outbound", _IMPACT + " SELECT entry, kind, count(*) AS n FROM ob GROUP BY ALL")
def qry_09(spark, sf_dir):
    g = est.graph(spark, sf_dir)
    return explore.outbound_counts(g.edges, g.endpoints.select(fn.handler_node("service", "handler").alias("entry")))


@query("qry_10_endpoint_impact", _IMPACT + " SELECT p.service || '#' || p.id AS endpoint, ob.kind, count(*) AS n FROM endpoints p JOIN ob ON ob.entry = p.service || '#' || p.handler GROUP BY ALL")
def qry_10(spark, sf_dir):
    g = est.graph(spark, sf_dir)
    entries = g.endpoints.select(F.col("node").alias("endpoint"), fn.handler_node("service", "handler").alias("entry"))
    return entries.join(explore.outbound_counts(g.edges, entries), "entry").select("endpoint", "kind", "n")


_G = f"g AS (SELECT src AS source, dst AS target, src || '>' || dst AS id FROM {STATIC} x)"
_HOPS = f"""WITH {_G}, n0 AS (SELECT DISTINCT source AS origin, source AS node, 0 AS depth FROM g),
o1 AS (SELECT DISTINCT n.origin, g.target AS node, 1 AS depth FROM n0 n JOIN g ON g.source = n.node WHERE g.target <> n.origin),
v1 AS (SELECT * FROM n0 UNION ALL SELECT * FROM o1),
o2 AS (SELECT DISTINCT n.origin, g.target AS node, 2 AS depth FROM o1 n JOIN g ON g.source = n.node WHERE (n.origin, g.target) NOT IN (SELECT origin, node FROM v1)),
v2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM o2),
i1 AS (SELECT DISTINCT n.origin, g.source AS node, 1 AS depth FROM n0 n JOIN g ON g.target = n.node WHERE (n.origin, g.source) NOT IN (SELECT origin, node FROM v2))
SELECT * FROM v2 UNION ALL SELECT * FROM i1"""


@query("qry_11_neighbourhood", _HOPS)
def qry_11(spark, sf_dir):
    e = est.run(spark, sf_dir, est.SQL["graph"]).select(F.concat_ws(">", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return explore.neighbourhood(e, e.select(F.col("source").alias("origin")).distinct(), 1, 2)[0]


@query("qry_11_reach", f"WITH RECURSIVE {_G}, r(seed, node) AS (SELECT DISTINCT source, source FROM g UNION SELECT r.seed, g.target FROM r JOIN g ON g.source = r.node) SELECT seed, node FROM r")
def qry_11_reach(spark, sf_dir):
    e = est.run(spark, sf_dir, est.SQL["graph"])
    return reach.reach(e, e.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()).select("seed", "node")


_KEPT = "n AS (SELECT id FROM svc WHERE layer IN ('ui', 'domain')), w AS (SELECT * FROM m WHERE (source IN (SELECT id FROM n) OR source IN (SELECT id FROM topics)) AND (target IN (SELECT id FROM n) OR target IN (SELECT id FROM topics)))"
graph_query("qry_13_visible_edges", shown(f"SELECT {P} FROM w", _KEPT))(lambda g: plain_edges(explore.visible(g, explore.GraphQuery(layers=frozenset({"ui", "domain"})))[1]))
graph_query("qry_13_visible_nodes", shown("SELECT id, 'service' AS kind FROM n UNION ALL SELECT id, 'topic' FROM topics WHERE id IN (SELECT source FROM w) OR id IN (SELECT target FROM w)", _KEPT))(lambda g: explore.visible(g, explore.GraphQuery(layers=frozenset({"ui", "domain"})))[0])
graph_query("qry_14_collapsed_topics", shown("SELECT 'via:' || p.id || '>' || c.id AS id, p.source, c.target, regexp_replace(p.target, '^[^:]*:[^:]*:', '') AS url FROM m p JOIN m c ON p.kind = 'publish' AND c.kind = 'consume' AND c.source = p.target"))(lambda g: explore.collapsed_topics(g.edges).select("id", "source", "target", "url"))
graph_query("qry_15_focus", shown("SELECT id FROM svc WHERE id = 'nation-3' OR id IN (SELECT target FROM m WHERE source = 'nation-3') OR id IN (SELECT source FROM m WHERE target = 'nation-3') UNION SELECT t.id FROM topics t WHERE EXISTS (SELECT 1 FROM m WHERE (m.source = 'nation-3' AND m.target = t.id) OR (m.target = 'nation-3' AND m.source = t.id))"))(lambda g: explore.visible(g, explore.GraphQuery(focus="nation-3"))[0].select("id"))
graph_query("qry_16_search", shown("SELECT id FROM svc s WHERE id LIKE '%brand-1%' OR lower(name) LIKE '%brand-1%' OR EXISTS (SELECT 1 FROM endpoints e WHERE e.service = s.id AND e.path LIKE '%brand-1%') UNION SELECT id FROM topics WHERE name LIKE '%brand-1%'"))(lambda g: explore.search_nodes(g, "BRAND-1"))
graph_query("qry_17_dimmed", shown("SELECT id, id <> 'nation-3' AND id NOT IN (SELECT target FROM m WHERE source = 'nation-3') AS dim FROM svc"))(lambda g: explore.dimmed(g.services, near=g.edges.filter("kind in ('http', 'declared', 'publish', 'consume') and source = 'nation-3'").select(F.col("target").alias("id")).union(g.services.filter("id = 'nation-3'").select("id"))))
graph_query("qry_18_endpoint_table", _IMPACT + " SELECT p.service || '#' || p.id AS node, s.name AS service_name, s.layer, (SELECT count(DISTINCT target) FROM ob WHERE ob.entry = p.service || '#' || p.handler AND ob.kind <> 'http') AS downstream FROM endpoints p JOIN services s ON s.id = p.service")(lambda g: explore.endpoint_table(g, no_flows(g)).select("node", "service_name", "layer", "downstream"))
graph_query("qry_19_drill_targets", tw.over_estate("SELECT service || '#' || id AS node, 'map' AS view, service AS target FROM endpoints"))(lambda g: explore.drill_targets(g.endpoints, no_flows(g)))
graph_query("qry_20_issues", tw.over_resolved(f"SELECT level, code, count(*) AS n FROM ({_hint} UNION ALL {_paths} UNION ALL {_unresolved}) t GROUP BY ALL"))(lambda g: explore.issue_table(g.issues, ("warn",), "", "nation").filter("code like 'call:%'").groupBy("level", "code").agg(F.count("*").alias("n")))
graph_query("qry_23_calls_with_details", shown("SELECT e.id AS edge, e.source, e.target, (SELECT count(*) FROM edges d WHERE d.kind = 'http-detail' AND starts_with(d.source, e.source || '#') AND split_part(d.target, '#', 1) = e.target) AS n FROM edges e WHERE kind IN ('http', 'declared')"))(lambda g: explore.calls_with_details(g).select("edge", "source", "target", F.size("details").cast("long").alias("n")))
graph_query("qry_25_topic_detail", shown("SELECT t.id AS topic, coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM m WHERE kind = 'publish' AND target = t.id), '') AS publishers, coalesce((SELECT string_agg(DISTINCT target, ',' ORDER BY target) FROM m WHERE kind = 'consume' AND source = t.id), '') AS consumers FROM topics t"))(lambda g: explore.topic_detail(g).select("topic", F.array_join("publishers", ",").alias("publishers"), F.array_join("consumers", ",").alias("consumers")))
graph_query("qry_26_edge_detail", shown("SELECT id, split_part(source, '#', 1) AS source_service, split_part(target, '#', 1) AS target_service FROM edges"))(explore.edge_detail)
graph_query("qry_27_layers", shown(f"SELECT DISTINCT layer, {tw.layer_index('layer')} AS place FROM svc"))(lambda g: explore.present_layers(g.services))
graph_query("qry_29_topic_ranks", shown(f"SELECT id, 2 * {tw.layer_index('layer')} AS rank FROM svc UNION ALL SELECT id, coalesce((SELECT max(2 * {tw.layer_index('layer')}) FROM svc JOIN m ON m.kind = 'publish' AND m.source = svc.id AND m.target = t.id) + 1, greatest(0, (SELECT min(2 * {tw.layer_index('layer')}) FROM svc JOIN m ON m.kind = 'consume' AND m.target = svc.id AND m.source = t.id) - 1), 7) FROM topics t"))(explore.topic_ranks)


def no_flows(g) -> DataFrame:
    return g.topics.sparkSession.createDataFrame([], "flow_id string, entry_service string, entry_ref string, rank int")


# --- as-of joins over conversations

@query("seq_02_callers", f"WITH t AS ({_CONV_SQL}) SELECT a.flow_id, a.step_no, max_by(b.service, b.step_no) AS caller FROM t a JOIN t b ON b.flow_id = a.flow_id AND b.step_no < a.step_no AND b.service <> a.service AND b.kind <> 'publish' WHERE a.kind = 'endpoint' GROUP BY ALL")
def seq_02(spark, sf_dir):
    steps = est.run(spark, sf_dir, _CONV)
    roles = steps.agg(F.collect_set("service").alias("roles"))  # a handful: every role may call every other
    e = roles.select("roles", F.explode("roles").alias("source")).select("source", F.explode("roles").alias("target")).filter("source <> target").withColumn("kind", F.lit("http"))
    return sequence.inferred_callers(steps, e)


@query("seq_03_topics", f"WITH t AS ({_CONV_SQL}) SELECT a.flow_id, a.step_no, coalesce(max_by(b.ref, b.step_no) FILTER (b.ref = 'topic-' || a.service), max_by(b.ref, b.step_no)) AS topic FROM (SELECT * FROM t WHERE kind = 'consumer') a LEFT JOIN (SELECT flow_id, step_no, 'topic-' || service AS ref FROM t WHERE kind = 'publish') b ON b.flow_id = a.flow_id AND b.step_no < a.step_no GROUP BY ALL")
def seq_03(spark, sf_dir):
    steps = est.run(spark, sf_dir, _CONV)
    steps = steps.withColumn("ref", F.when(F.col("kind") == "publish", F.concat(F.lit("topic-"), "service")).otherwise(F.col("ref")))
    heard = steps.select("service").distinct().select(F.lit("consume").alias("kind"), F.concat(F.lit("topic-"), "service").alias("source"), F.col("service").alias("target"))
    return sequence.inferred_topics(steps, heard)


@query("src_06_build_files", "SELECT page_id, dep AS dependency FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dep FROM pages) t GROUP BY ALL")
def src_06(spark, sf_dir):
    files = est.run(spark, sf_dir, "SELECT concat(CAST(page_id AS STRING), '/pom.xml') AS file, regexp_replace(html, 'href=\"([^\"]+)\"', '<artifactId>$1</artifactId>') AS text FROM pages")
    return src.build_dependencies(files).select(F.split("file", "/")[0].cast("long").alias("page_id"), "dependency")


_GATE = f"SELECT level FROM issues UNION ALL SELECT level FROM ({_hint} UNION ALL {_paths} UNION ALL {_unresolved}) t"


@query("snk_06_gate", tw.over_resolved(f"SELECT 'warn' AS level, bool_or(level IN ('warn', 'error')) AS failed FROM ({_GATE}) a UNION ALL SELECT 'error', bool_or(level = 'error') FROM ({_GATE}) b"))
def snk_06(spark, sf_dir):
    issues = est.graph(spark, sf_dir).issues
    return spark.createDataFrame([(level, docs.gate(issues, level)) for level in ("warn", "error")], "level string, failed boolean")

"""The same computations as SQL for an independent engine (DuckDB), written from the definitions, not from our plans."""

from __future__ import annotations

from ..functions.text import CONFIG_KEYS, GENERIC, LAYER_LABELS, LAYERS, VERBS
from .estate import CONFIG, SQL

WS = r"[ \t\n\r\f\v]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, replacement: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, {q(flags)})"


def found(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def trim(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def slash(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, '/') THEN {x} ELSE '/' || {x} END)"


def norm(x: str) -> str:
    s = sub(sub(sub(sub(trim(x), r"\{[^}]*\}", "{p}"), r":[A-Za-z_][A-Za-z0-9_]*", "{p}"), r"\*+", "{p}"), "/{2,}", "/")
    return sub(slash(s), "(.)/$", r"\1", "")


def route(x: str) -> str:
    s = sub(sub(trim(x), "^https?://[^/]+", "", "i"), r"\?.*$", "", "s")
    s = sub(slash(s), "/{2,}", "/")
    s = sub(s, r":([A-Za-z_]\w*)(?:\([^)]*\))?", r"{\1}")
    s = sub(s, r"\{\*{1,2}([^}:?]+)[^}]*\}", r"{\1}")
    s = sub(s, r"\{([^}:?]+)[^}]*\}", r"{\1}")
    s = sub(s, "<(?:[a-z]+:)?([^>]+)>", r"{\1}")
    return f"(SELECT CASE WHEN length(r) > 1 THEN {sub('r', '/+$', '', '')} ELSE r END FROM (SELECT {s} AS r))"


def call_parts(x: str) -> dict[str, str]:
    u = sub(trim(x), r"^\{[^}]*\}", "", "")
    absolute = f"regexp_matches({u}, '^https?://', 'i')"
    rest = sub(u, "^https?://", "", "i")
    h = f"lower({sub(f'regexp_extract({rest}, {q('^[^/]*')})', r':[0-9]+$', '', '')})"
    raw = sub(f"(CASE WHEN {absolute} THEN {sub(rest, '^[^/]*', '', '')} ELSE {u} END)", r"\?.*$", "", "s")
    return {"host": f"(CASE WHEN {absolute} AND NOT regexp_matches({h}, '[{{}}]') THEN {h} END)", "path": f"(SELECT CASE WHEN w = '' THEN '' ELSE {norm('w')} END FROM (SELECT {raw} AS w))", "dynamic": f"regexp_matches({trim(x)}, {q(r'^\{[^}]*\}')})"}


def segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda y: y <> '')"


def matches(c: str, e: str) -> str:
    """c, e: lists of segments."""
    return f"(len({c}) BETWEEN 1 AND len({e}) AND len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] = '{{p}}' OR {e}[len({e}) - len({c}) + i] = '{{p}}' OR lower({c}[i]) = lower({e}[len({e}) - len({c}) + i]))) = len({c}))"


def score(c: str, e: str) -> str:
    return f"(CASE WHEN len({c}) <= len({e}) THEN len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] <> '{{p}}' AND {e}[len({e}) - len({c}) + i] <> '{{p}}' AND lower({c}[i]) = lower({e}[len({e}) - len({c}) + i]))) ELSE 0 END)"


def toks(x: str) -> str:
    generic = ", ".join(map(q, GENERIC))
    return f"list_filter(string_split_regex(lower({sub(x, '([a-z0-9])([A-Z])', r'\1 \2')}), '[^a-z0-9]+'), lambda y: y <> '' AND y NOT IN ({generic}))"


def type_slug(x: str) -> str:
    return sub(sub(f"lower({sub(x, '([a-z0-9])([A-Z])', r'\1-\2')})", "[^a-z0-9._-]+", "-"), "^-+|-+$")


def verb(x: str) -> str:
    v = "|".join(VERBS)
    return f"CASE WHEN lower({x}) = 'del' THEN 'DELETE' WHEN lower({x}) IN ('all', 'any') THEN 'ANY' ELSE upper(coalesce({found(f'lower({x})', f'^({v})')}, {found(f'lower({x})', f'({v})$')})) END"


def layer_of(x: str) -> str:
    words = [("ui", "ui|web|frontend|spa|portal|app"), ("experience", "experience|exp|bff|gateway"), ("capability", "capability|cap"), ("domain", "domain|core"), ("processor", "processor|worker|consumer|handler|listener|job|daemon")]
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {q(rf'(^|[-_.])({w})([-_.]|$)')}) THEN {q(n)}" for n, w in words) + " ELSE 'unknown' END"


def label(x: str) -> str:
    message = "^(?:consume|publish):[^:]+:([^:]+):(.+)$"
    return f"(CASE WHEN contains({x}, '#') THEN substr({x}, instr({x}, '#') + 1) WHEN regexp_matches({x}, {q(message)}) THEN {sub(x, message, r'\1 \2', '')} ELSE {sub(x, '^topic:[^:]+:', '', '')} END)"


def layer_index(x: str) -> str:
    return "(CASE " + x + " " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(LAYERS[:-1])) + f" ELSE {len(LAYERS) - 1} END)"


def layer_label(x: str) -> str:
    return "(CASE " + x + " " + " ".join(f"WHEN {q(n)} THEN {q(v)}" for n, v in zip(LAYERS[:-1], LAYER_LABELS)) + f" ELSE {q(LAYER_LABELS[-1])} END)"


def config_key(x: str) -> str:
    return "coalesce(" + ", ".join(found(x, p) for p in CONFIG_KEYS) + ")"


def duck(sql: str) -> str:
    return sql.replace("array(", "list_value(").replace("`group`", '"group"')


def mermaid(x: str) -> str:
    return sub(sub(sub(x, '"', "'"), r"\|", "/"), r"[\r\n]+", " ")


ESTATE = ",\n".join(f"{n} AS ({duck(s)})" for n, s in SQL.items() if n not in ("graph", "observed"))


def _config_value() -> str:
    tests = []
    for key, value in CONFIG.targets.items():
        for p in ("targetHint", "host", "url"):
            hit = f"regexp_matches({p}, {q(key[1:-1])}, 'i')" if len(key) > 2 and key[0] == key[-1] == "/" else f"lower({p}) = {q(key.lower())}"
            tests.append(f"WHEN {hit} THEN {q(value)}")
    return "CASE " + " ".join(tests) + " END"


def _best(probes: str) -> str:
    """Best endpoint for distinct (service, method, path) of a table."""
    return f"""SELECT p.service, p.method, p.path, first(e.id ORDER BY {score('p.c', 'e.s')} DESC, e.i_ord) AS ep_id, max({score('p.c', 'e.s')}) AS ep_score
 FROM (SELECT DISTINCT service, method, path, {segs('path')} AS c FROM {probes} WHERE path <> '') p JOIN ep e ON e.service = p.service
 WHERE (p.method IS NULL OR p.method = 'ANY' OR e.method = 'ANY' OR p.method = e.method) AND {matches('p.c', 'e.s')} GROUP BY ALL"""


_u = call_parts("url")
RESOLVED = f"""{ESTATE},
ep AS (SELECT *, {segs('path')} AS s FROM endpoints),
c0 AS MATERIALIZED (SELECT *, {_u['host']} AS host, {_u['path']} AS path FROM calls),
c1 AS MATERIALIZED (SELECT *, {_config_value()} AS value FROM c0),
hints AS MATERIALIZED (SELECT service, hint, list(id ORDER BY m_ord) AS tops FROM (SELECT *, max(n) OVER (PARTITION BY service, hint) AS top FROM (
  SELECT h.service, h.hint, s.id, s.m_ord, len(list_intersect(h.ht, list_concat({toks('s.id')}, {toks('s.name')}))) AS n FROM (SELECT DISTINCT service, targetHint AS hint, list_distinct({toks('targetHint')}) AS ht FROM c1 WHERE targetService IS NULL AND value IS NULL AND targetHint IS NOT NULL) h JOIN services s ON s.id <> h.service) WHERE n > 0) WHERE n = top GROUP BY ALL),
c2 AS MATERIALIZED (SELECT c1.*, tops FROM c1 LEFT JOIN hints ON hints.service = c1.service AND hints.hint = c1.targetHint),
tie0 AS (SELECT c.service AS caller, c.id, c.i_ord, c.method, c.path, unnest(tops) AS service FROM c2 c WHERE targetService IS NULL AND value IS NULL AND len(tops) > 1),
tie1 AS ({_best('tie0')}),
tie AS (SELECT caller, id, i_ord, min(t.service) AS won FROM tie0 t JOIN tie1 b ON b.service = t.service AND b.method IS NOT DISTINCT FROM t.method AND b.path = t.path GROUP BY ALL HAVING count(*) = 1),
c3 AS MATERIALIZED (SELECT c.*, won FROM c2 c LEFT JOIN tie ON tie.caller = c.service AND tie.id = c.id AND tie.i_ord = c.i_ord),
hosts AS (SELECT service, host, first(sid ORDER BY m_ord) AS owner FROM (SELECT h.service, h.host, s.id AS sid, s.m_ord, {toks('s.id')} AS ts FROM (SELECT DISTINCT service, host FROM c3 WHERE host IS NOT NULL) h JOIN services s ON s.id <> h.service) WHERE len(ts) > 0 AND len(list_filter(ts, lambda y: contains(host, y))) = len(ts) GROUP BY ALL),
c4 AS MATERIALIZED (SELECT c.*, h.owner FROM c3 c LEFT JOIN hosts h ON h.service = c.service AND h.host = c.host),
pathp AS (SELECT DISTINCT s.id AS service, c.service AS caller, c.method, c.path FROM c4 c JOIN services s ON s.id <> c.service WHERE targetService IS NULL AND value IS NULL AND coalesce(len(tops), 0) <> 1 AND won IS NULL AND host IS NULL AND path <> ''),
pathb AS ({_best('pathp')}),
paths AS MATERIALIZED (SELECT caller, method, path, count(*) AS n, list(service ORDER BY ep_score DESC, m_ord) AS who, list(ep_id ORDER BY ep_score DESC, m_ord) AS eps, list(ep_score ORDER BY ep_score DESC) AS scores FROM (SELECT p.caller, p.method, p.path, b.service, b.ep_id, b.ep_score, s.m_ord FROM pathp p JOIN pathb b ON b.service = p.service AND b.method IS NOT DISTINCT FROM p.method AND b.path = p.path JOIN services s ON s.id = p.service) GROUP BY ALL),
c5 AS MATERIALIZED (SELECT c.*, n, who, eps, scores FROM c4 c LEFT JOIN paths p ON p.caller = c.service AND p.method IS NOT DISTINCT FROM c.method AND p.path = c.path),
ruled AS MATERIALIZED (SELECT *, coalesce(targetService, value) AS named, CASE
  WHEN targetService IS NOT NULL OR value IS NOT NULL THEN 'named' WHEN len(tops) = 1 THEN 'hint' WHEN won IS NOT NULL THEN 'hint+path' WHEN host IS NOT NULL AND owner IS NOT NULL THEN 'host-match' WHEN host IS NOT NULL THEN 'literal-host' WHEN n = 1 OR n > 1 AND scores[1] > scores[2] THEN 'path-match' END AS rule FROM c5),
aimed AS MATERIALIZED (SELECT *, CASE rule WHEN 'named' THEN CASE WHEN starts_with(named, 'external:') THEN 'external:' || lower(substr(named, 10)) WHEN named IN (SELECT id FROM services) THEN named ELSE 'external:' || lower(named) END WHEN 'hint' THEN tops[1] WHEN 'hint+path' THEN won WHEN 'host-match' THEN owner WHEN 'literal-host' THEN 'external:' || host WHEN 'path-match' THEN who[1] END AS target FROM ruled),
aimb AS ({_best("(SELECT target AS service, method, path FROM aimed WHERE rule IN ('named', 'hint', 'hint+path', 'host-match'))")}),
r0 AS (SELECT a.*, CASE WHEN rule = 'path-match' THEN eps[1] ELSE b.ep_id END AS ep, CASE WHEN rule = 'named' THEN CASE WHEN targetService IS NOT NULL THEN 'declared' ELSE 'config' END || CASE WHEN NOT starts_with(named, 'external:') AND starts_with(target, 'external:') THEN '-external' ELSE '' END ELSE rule END AS resolution FROM aimed a LEFT JOIN aimb b ON rule IN ('named', 'hint', 'hint+path', 'host-match') AND b.service = a.target AND b.method IS NOT DISTINCT FROM a.method AND b.path = a.path),
resolved AS MATERIALIZED (SELECT m_ord, i_ord, service, id, method, url, fromHandler, target, resolution, ep, CASE WHEN rule = 'named' AND targetService IS NULL AND starts_with(named, 'external:') THEN 0.95::DOUBLE WHEN rule = 'named' AND starts_with(named, 'external:') THEN 1::DOUBLE WHEN resolution LIKE '%-external' THEN 0.9::DOUBLE WHEN rule = 'literal-host' THEN 0.9::DOUBLE WHEN rule = 'path-match' THEN CASE WHEN n = 1 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END
  ELSE CASE WHEN ep IS NULL THEN base ELSE least(1::DOUBLE, base + 0.05::DOUBLE) END END AS confidence FROM (SELECT *, CASE resolution WHEN 'declared' THEN 1::DOUBLE WHEN 'config' THEN 0.95::DOUBLE WHEN 'host-match' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS base FROM r0) WHERE rule IS NOT NULL)"""


def over_estate(select: str) -> str:
    return f"WITH {ESTATE} {select}"


def over_resolved(select: str, *more: str) -> str:
    return f"WITH {', '.join([RESOLVED, *more])} {select}"

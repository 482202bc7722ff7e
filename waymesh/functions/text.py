"""Scalar building blocks of service-graph analytics, as Column expressions (all inside whole-stage code, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"

#: Words that say nothing about a service.
GENERIC = ["api", "service", "services", "svc", "client", "url", "baseurl", "base", "http", "https", "host", "uri", "endpoint", "address", "vite", "env", "app", "config", "v1", "v2"]
#: Layers in display order, and their labels.
LAYERS = ["ui", "experience", "capability", "domain", "processor", "external", "unknown"]
LAYER_LABELS = ["UI", "Experience", "Capability", "Domain", "Processors", "External", "Unknown"]
VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column | str, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col(c), pattern, replacement)


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def truthy(c: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(col(c), F.lit(""))


def trimmed(c: Column | str) -> Column:
    return sub(c, f"^{SPACE}+|{SPACE}+$")


def normalise_path(c: Column | str) -> Column:
    """A route for matching: parameters as {p}, one leading slash, no doubled or trailing slash."""
    s = sub(sub(sub(trimmed(c), r"\{[^}]*\}", "{p}"), r":[A-Za-z_][A-Za-z0-9_]*", "{p}"), r"\*+", "{p}")
    s = sub(sub(s, "/{2,}", "/"), "^(?!/)", "/")
    return sub(s, "(?<=.)/$", "")


def route_path(c: Column | str) -> Column:
    """A route as extracted: parameter names stay."""
    s = sub(sub(trimmed(c), r"(?i)^https?://[^/]+"), r"\?(?s:.)*$")
    s = sub(sub(s, "^(?!/)", "/"), "/{2,}", "/")
    s = sub(s, r":([A-Za-z_]\w*)(?:\([^)]*\))?", r"{$1}")
    s = sub(s, r"\{\*{1,2}([^}:?]+)[^}]*\}", r"{$1}")
    s = sub(s, r"\{([^}:?]+)[^}]*\}", r"{$1}")
    s = sub(s, r"<(?:[a-z]+:)?([^>]+)>", r"{$1}")
    return F.when(F.length(s) > 1, sub(s, "/+$")).otherwise(s)


def join_paths(prefix: Column | str, path: Column | str) -> Column:
    a, b = F.coalesce(trimmed(prefix), F.lit("")), F.coalesce(trimmed(path), F.lit(""))
    return F.when(b.startswith("/") & (a == ""), route_path(b)).otherwise(route_path(F.concat(a, F.lit("/"), b)))


def call_url(c: Column | str) -> dict[str, Column]:
    """host (null unless the URL is absolute with a fixed host), path ('' if there is none) and dynamic of a call's URL."""
    u = trimmed(c)
    dynamic = u.rlike(r"^\{[^}]*\}")
    u = sub(u, r"^\{[^}]*\}")
    absolute = u.rlike("(?i)^https?://")
    rest = sub(u, "(?i)^https?://")
    host = F.lower(sub(F.regexp_extract(rest, "^([^/]*)", 1), r":\d+$"))
    path = F.when(absolute, sub(rest, "^[^/]*")).otherwise(u)
    path = sub(path, r"\?(?s:.)*$")
    # most calls are relative, which a plain search tells
    return {"host": F.when(col(c).contains("://") & absolute & ~host.rlike("[{}]"), host), "path": F.when(path == "", "").otherwise(normalise_path(path)), "dynamic": dynamic}


def segments(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "/"), lambda x: x != "")


def _aligned(call: Column | str, endpoint: Column | str):
    a, b = segments(call), segments(endpoint)
    return a, b, F.slice(b, F.greatest(F.lit(1), F.size(b) - F.size(a) + 1), F.greatest(F.lit(1), F.size(a)))


def path_matches(call: Column | str, endpoint: Column | str) -> Column:
    """The call's segments are the endpoint's last ones; {p} on either side matches any."""
    a, b, tail = _aligned(call, endpoint)
    same = F.zip_with(a, tail, lambda x, y: (x == "{p}") | (y == "{p}") | (F.lower(x) == F.lower(y)))
    return (F.size(a) > 0) & (F.size(a) <= F.size(b)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def match_score(call: Column | str, endpoint: Column | str) -> Column:
    """Segments that are equal and fixed on both sides, aligned at the end; for paths that match."""
    a, b, tail = _aligned(call, endpoint)
    same = F.zip_with(a, tail, lambda x, y: (x != "{p}") & (y != "{p}") & (F.lower(x) == F.lower(y)))
    return F.when(F.size(a) <= F.size(b), F.size(F.filter(same, lambda x: F.coalesce(x, F.lit(False))))).otherwise(0)


def tokens(c: Column | str) -> Column:
    """Lower-case words of an identifier without the generic ones; repeats stay."""
    words = F.split(F.lower(sub(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(words, lambda x: (x != "") & ~x.isin(GENERIC))


def flow_slug(c: Column | str) -> Column:
    return sub(sub(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$")


def type_slug(c: Column | str) -> Column:
    return sub(sub(F.lower(sub(c, "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9._-]+", "-"), "^-+|-+$")


def service_slug(c: Column | str) -> Column:
    return type_slug(sub(sub(c, "^@[^/]+/"), r"(?i)\.(csproj|Api|Web|Service|App|Worker)$"))


def method_from_word(c: Column | str) -> Column:
    w = F.lower(col(c))
    verb = F.upper(F.coalesce(found(w, f"^({'|'.join(VERBS)})"), found(w, f"({'|'.join(VERBS)})$")))
    return F.when(w == "del", "DELETE").when(w.isin("all", "any"), "ANY").otherwise(verb)


def host_of(c: Column | str) -> Column:
    return F.lower(found(trimmed(c), r"(?i)^(?:https?|wss?)://([^/:?#{}]+)"))


def is_url_like(c: Column | str) -> Column:
    return trimmed(c).rlike(r"^(https?://|/|\{)") | col(c).rlike(r"\{[^}]+\}/")


#: How sources refer to configuration, in order of precedence.
CONFIG_KEYS = [
    r"process\.env\.([A-Za-z_]\w*)",
    r"import\.meta\.env\.([A-Za-z_]\w*)",
    r"GetEnvironmentVariable\([ \t\n\r]*[\"']([^\"']+)[\"']",
    r"System\.getenv\([ \t\n\r]*[\"']([^\"']+)[\"']",
    r"\[[ \t\n\r]*[\"']([^\"']+)[\"'][ \t\n\r]*\]",
    r"\.(?:GetValue|GetSection|getProperty|GetConnectionString)(?:<[^>]+>)?\([ \t\n\r]*[\"']([^\"']+)[\"']",
    r"\$\{([^}:]+)(?::[^}]*)?\}",
]


def config_key(c: Column | str) -> Column:
    return F.coalesce(*(found(c, p) for p in CONFIG_KEYS))


def split_list(c: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: sub(trimmed(x), "^[\"']|[\"']$"))
    return F.filter(parts, lambda x: x != "")


def strip_generics(c: Column | str) -> Column:
    return trimmed(sub(sub(sub(c, r"<.*>$"), r"\?$"), r"\[\]$"))


def norm_ident(c: Column | str) -> Column:
    return F.lower(sub(c, "^_+"))


def unquote(c: Column | str) -> Column:
    t = sub(trimmed(c), r"^(?:\$@|@\$|\$|@)")
    whole = lambda q: t.startswith(q) & t.endswith(q) & (F.length(t) >= 2 * len(q))
    inner = lambda k: F.substring(t, F.lit(k + 1), F.length(t) - 2 * k)
    return F.when(whole('"""'), trimmed(inner(3))).when(whole('"') | whole("'") | whole("`"), inner(1)).otherwise(t)


def placeholder(c: Column | str) -> Column:
    t = trimmed(c)
    name = sub(found(t, r"^(?:this\.)?(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)$"), "^_+")
    key = found(t, r"\[[ \t\n\r]*[\"']([^\"']+)[\"'][ \t\n\r]*\]$")
    return F.concat(F.lit("{"), F.coalesce(name, key, F.lit("expr")), F.lit("}"))


def substitute_tokens(template: Column | str, type_name: Column | str, action: Column | str) -> Column:
    """[controller], [action] and [area] of a route template."""
    quoted = lambda c: sub(c, r"([$\\])", r"\\$1")
    s = F.regexp_replace(col(template), F.lit(r"(?i)\[controller\]"), quoted(sub(type_name, "Controller$")))
    s = F.regexp_replace(s, F.lit(r"(?i)\[action\]"), quoted(action))
    return F.regexp_replace(s, F.lit(r"(?i)\[area\]"), F.lit("area"))


def body_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(trimmed(sub(c, f"{SPACE}+", " ")), 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 24)


def infer_layer(c: Column | str) -> Column:
    n = F.lower(col(c))
    word = lambda w: n.rlike(rf"(^|[-_.])({w})([-_.]|$)")
    out = F.when(word("ui|web|frontend|spa|portal|app"), "ui").when(word("experience|exp|bff|gateway"), "experience").when(word("capability|cap"), "capability")
    return out.when(word("domain|core"), "domain").when(word("processor|worker|consumer|handler|listener|job|daemon"), "processor").otherwise("unknown")


def endpoint_node(service: Column | str, id: Column | str) -> Column:
    return F.concat(col(service), F.lit("#"), col(id))


def handler_node(service: Column | str, id: Column | str) -> Column:
    return F.when(col(id).contains("#"), col(id)).otherwise(F.concat(col(service), F.lit("#"), col(id)))


def topic_node(broker: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("topic:"), col(broker), F.lit(":"), col(name))


def external_node(host: Column | str) -> Column:
    return F.concat(F.lit("external:"), F.lower(col(host)))


def bare_handler(service: Column | str, ref: Column | str) -> Column:
    prefix = F.concat(col(service), F.lit("#"))
    return F.when(F.startswith(col(ref), prefix), F.substring(col(ref), F.length(prefix) + 1, F.length(col(ref)))).otherwise(truthy(ref))


def qualify_ref(service: Column | str, ref: Column | str) -> Column:
    own = col(ref).contains("#") | col(ref).rlike("^(topic|consume|publish|http|external):")
    return F.when(own, col(ref)).otherwise(F.concat(col(service), F.lit("#"), col(ref)))


def ref_label(c: Column | str) -> Column:
    c = col(c)
    message = r"^(?:consume|publish):[^:]+:([^:]+):(.+)$"
    plain = F.when(c.rlike(message), F.regexp_replace(c, message, "$1 $2")).otherwise(sub(c, "^topic:[^:]+:"))
    return F.when(c.contains("#"), sub(c, "^[^#]*#")).otherwise(plain)


def endpoint_path(c: Column | str) -> Column:
    return sub(ref_label(c), "^[A-Z]+ ")


def source_link(repo: Column | str, file: Column | str, line: Column | str) -> Column:
    r = sub(sub(repo, r"\.git$"), "/$")
    line = col(line)
    at = F.concat(F.lit("/HEAD/"), col(file), F.lit("#L"), line.cast("string"))
    # the form encoding of spaces and of the marks that URI components leave alone is undone
    coded = F.url_encode(col(file))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    azure = F.concat(r, F.lit("?path=/"), coded, F.lit("&line="), line.cast("string"), F.lit("&lineEnd="), (line + 1).cast("string"), F.lit("&lineStartColumn=1&lineEndColumn=1"))
    link = F.when(r.rlike(r"github\.com"), F.concat(r, F.lit("/blob"), at)).when(r.rlike(r"gitlab\.com"), F.concat(r, F.lit("/-/blob"), at)).when(r.rlike(r"dev\.azure\.com|visualstudio\.com"), azure).otherwise(r)
    return F.when(col(repo).rlike("^https?://"), link)


def layer_index(c: Column | str) -> Column:
    at = F.array_position(F.array(*map(F.lit, LAYERS)), col(c)).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(LAYERS) - 1)


def layer_label(c: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, LAYER_LABELS)), layer_index(c) + 1)


def confidence_band(c: Column | str) -> Column:
    return F.when(col(c) >= 0.8, "hi").when(col(c) >= 0.6, "mid").otherwise("low")


def mermaid_id(c: Column | str) -> Column:
    return F.concat(F.lit("n_"), sub(c, "[^A-Za-z0-9]", "_"))


def mermaid_text(c: Column | str) -> Column:
    return sub(sub(sub(c, '"', "'"), r"\|", "/"), r"[\r\n]+", " ")


def file_name(c: Column | str) -> Column:
    return sub(c, "[^A-Za-z0-9._-]+", "-")


def capitalised(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 1 << 30))


def truncated(c: Column | str, size: int) -> Column:
    return F.when(F.length(col(c)) > size, F.concat(F.substring(col(c), 1, size - 1), F.lit("…"))).otherwise(col(c))


def token_estimate(chars: Column | str) -> Column:
    """A quarter of the characters, halves rounded up."""
    return F.floor(col(chars) / 4 + 0.5).cast("long")


def parsed_language(path: Column | str) -> Column:
    """Grammar of a source file by its extension; null if none parses it."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))
    return F.when(ext == ".cs", "csharp").when(ext == ".java", "java").when(ext == ".tsx", "tsx").when(ext.isin(".ts", ".mts", ".cts"), "typescript").when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript")

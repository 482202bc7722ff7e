"""Manifests from source facts: endpoints, outbound calls, messages and handler graphs found by joins over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.session import cut, numbered
from ..sources.parsing.facts import Facts
from .estate import Estate, estate_of
from .reach import reach

c = F.col


def arg(i: int, field: str = "text") -> Column:
    return F.get("args", F.lit(i))[field]


def named(name: str, field: str = "text") -> Column:
    return F.try_element_at("named", F.lit(name))[field]


def constants(f: Facts) -> DataFrame:
    """(service, name, value): constants by Type.NAME and by bare NAME, the first of each."""
    k = f.constants.select("service", "file", "ord", c("name").alias("bare"), "value", F.concat_ws(".", "type", "name").alias("whole"))
    both = k.select("service", "file", "ord", c("whole").alias("name"), "value").union(k.select("service", "file", "ord", "bare", "value"))
    return both.groupBy("service", "name").agg(F.min_by("value", F.struct("file", "ord")).alias("value"))


def resolved(rows: DataFrame, value: str, f: Facts, name: str) -> DataFrame:
    """Adds the text of a value struct: literals as they are, names by constants (as written, or by their last part)."""
    ks = constants(f)
    whole, last = ks.select("service", c("name").alias("__w"), c("value").alias("__v1")), ks.select("service", c("name").alias("__l"), c("value").alias("__v2"))
    rows = rows.withColumn("__w", fn.sub(f"{value}.raw", r"^this\.")).withColumn("__l", F.substring_index("__w", ".", -1)).withColumn("__own", F.concat_ws(".", "type", "__w"))
    own = ks.select("service", c("name").alias("__own"), c("value").alias("__v0"))
    rows = rows.join(own, ["service", "__own"], "left").join(whole, ["service", "__w"], "left").join(last, ["service", "__l"], "left")
    text = F.when(c(f"{value}.kind").isin("string", "template"), c(f"{value}.text")).otherwise(F.coalesce("__v0", "__v1", "__v2"))
    return rows.withColumn(name, text).withColumn(f"{name}_known", text.isNotNull()).drop("__w", "__l", "__own", "__v0", "__v1", "__v2")


# --- HTTP servers

VERB_ATTRS = {"aspnet": "^Http(Get|Post|Put|Patch|Delete|Head|Options)$", "spring": "^(?:(Get|Post|Put|Patch|Delete)Mapping|(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS))$", "nest": "^(Get|Post|Put|Patch|Delete|Head|Options|All)$", "client": "^(Get|Post|Put|Patch|Delete)(?:Mapping|Exchange)$", "refit": "^(Get|Post|Put|Patch|Delete|Head|Options)$"}


def verb_of(name: str) -> Column:
    return F.coalesce(*(fn.found("attr", VERB_ATTRS[name], i) for i in range(1, VERB_ATTRS[name].count("(") - VERB_ATTRS[name].count("(?:") + 1)))


def attribute_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select("service", "file", "language", *keys, F.explode("attrs").alias("a")).select("service", "file", "language", *keys, c("a.name").alias("attr"), c("a.args").alias("args"), c("a.named").alias("named"))


def attr_texts(*names: str) -> Column:
    """The texts of an attribute: positional, or those of the given names; one empty text if there is none."""
    texts = [F.transform("args", lambda x: x["text"]), *(F.transform(F.try_element_at("named", F.lit(n)), lambda x: x["text"]) for n in names)]
    full = F.coalesce(*(F.when(F.size(t) > 0, t) for t in texts))
    return F.coalesce(full, F.array(F.lit("")))


def controllers(f: Facts) -> DataFrame:
    """Endpoints of controller classes (ASP.NET Core, Spring, JAX-RS, NestJS): class prefixes times method templates."""
    t = attribute_rows(f.types, "name", "kind").withColumnRenamed("name", "type")
    route = t.filter(c("attr").isin("Route", "RequestMapping", "Controller", "Path")).select("service", "type", F.explode(attr_texts("value", "path")).alias("prefix"))
    nest = t.filter((c("attr") == "Controller") & c("language").isin("typescript", "javascript")).select("service", "type").distinct()
    clients = t.filter(c("attr").isin("FeignClient", "HttpExchange")).select("service", "type").distinct()
    u = attribute_rows(f.units, "id", "name", "type", "line")
    by_lang = F.when(c("language") == "csharp", verb_of("aspnet")).when(c("language") == "java", verb_of("spring")).otherwise(verb_of("nest"))
    of_mapping = F.transform(F.try_element_at("named", F.lit("method")), lambda x: fn.found(x["raw"], r"(\w+)$"))
    verbs = F.when(c("attr") == "RequestMapping", F.coalesce(F.when(F.size(of_mapping) > 0, of_mapping), F.array(F.lit("ANY")))).otherwise(F.when(by_lang.isNotNull(), F.array(by_lang)))
    m = u.withColumn("verb", F.explode(verbs)).filter("type is not null").join(clients, ["service", "type"], "left_anti")
    m = m.select("service", "file", "language", "id", "name", "type", "line", "attr", F.when(F.upper("verb") == "ALL", "ANY").otherwise(F.upper("verb")).alias("method"), attr_texts("value", "path").alias("templates"))
    jax = u.filter("language = 'java' and attr = 'Path'").select("service", "id", attr_texts("value").alias("paths"))
    m = m.join(jax, ["service", "id"], "left").withColumn("template", F.explode(F.when((c("attr") == F.upper("attr")) & c("paths").isNotNull(), c("paths")).otherwise(c("templates")))).drop("attr", "templates", "paths")
    m = m.filter(~c("language").isin("typescript", "javascript")).unionByName(m.filter(c("language").isin("typescript", "javascript")).join(nest, ["service", "type"], "left_semi"))
    m = m.join(route, ["service", "type"], "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    whole = f.calls.filter((c("method") == "setGlobalPrefix") & arg(0, "kind").isin("string", "template")).groupBy("service").agg(F.max_by(arg(0), F.struct("file", "line", "c_ord")).alias("global"))
    m = m.join(whole, "service", "left")
    prefix = F.when(c("language").isin("typescript", "javascript") & c("global").isNotNull(), fn.join_paths("global", "prefix")).otherwise(c("prefix"))
    absolute = (c("language") == "csharp") & c("template").rlike("^~?/")
    path = F.when(absolute, fn.route_path(fn.sub("template", "^~"))).otherwise(fn.join_paths(prefix, "template"))
    path = F.when(c("language") == "csharp", fn.substitute_tokens(path, "type", "name")).otherwise(path)
    return m.select("service", "method", path.alias("path"), c("id").alias("handler"), "file", "line")


def handler_of(calls: DataFrame, last: str, f: Facts) -> DataFrame:
    """Adds handler: the unit that a registration's last argument is; else the one it names, in its own file, as a member of the named type, or as the only one of the name; else the registering unit."""
    u = f.units.filter("name is not null").select("service", c("file").alias("__f"), c("name").alias("__n"), c("type").alias("__t"), c("id").alias("__id"), "ord")
    alone = u.groupBy("service", "__n").agg(F.min("__id").alias("__only"), F.count("*").alias("__k")).filter("__k = 1").drop("__k")
    own = u.groupBy("service", c("__f").alias("file"), "__n").agg(F.min_by("__id", "ord").alias("__own"))
    member = u.filter("__t is not null").groupBy("service", F.lower("__t").alias("__owner"), "__n").agg(F.min("__id").alias("__member"), F.count("*").alias("__k")).filter("__k = 1").drop("__k")
    out = calls.withColumn("__n", F.substring_index(f"{last}.raw", ".", -1)).withColumn("__owner", F.lower(F.substring_index(F.substring_index(f"{last}.raw", ".", -2), ".", 1)))
    out = out.join(own, ["service", "file", "__n"], "left").join(member, ["service", "__owner", "__n"], "left").join(alone, ["service", "__n"], "left")
    plain = ~F.contains(f"{last}.raw", F.lit("."))
    found = F.when(c(f"{last}.kind") == "function", c(f"{last}.text")).when(plain, F.coalesce("__own", "__only")).otherwise(F.coalesce("__member", "__only"))
    return out.withColumn("handler", F.coalesce(found, "unit")).drop("__n", "__owner", "__own", "__member", "__only")


def minimal_routes(f: Facts) -> DataFrame:
    """Registrations of ASP.NET Core minimal APIs: method, path (null where it is no constant), handler."""
    groups = f.fields.withColumn("group", fn.found("value", r'MapGroup\(\s*"([^"]*)"')).filter("group is not null").select("service", "file", c("name").alias("receiver"), "group").dropDuplicates(["service", "file", "receiver"])
    k = f.calls.filter("language = 'csharp'").withColumn("verb", fn.found("method", "^Map(Get|Post|Put|Patch|Delete|Methods)$")).filter("verb is not null and size(args) > 1").withColumn("route", F.get("args", F.lit(0))).withColumn("last", F.element_at("args", -1))
    listed = fn.found(arg(1, "raw"), r"""["'](\w+)["']""")
    verb = F.when(c("verb") == "Methods", F.coalesce(F.upper(listed), F.lit("ANY"))).otherwise(F.upper("verb"))
    k = resolved(handler_of(k.withColumn("http", verb), "last", f), "route", f, "path").join(groups, ["service", "file", "receiver"], "left")
    return k.select("service", c("http").alias("method"), F.when(c("path_known"), fn.join_paths("group", "path")).alias("path"), "handler", "file", "line", "unit", c("method").alias("by"))


def minimal_apis(f: Facts) -> DataFrame:
    """ASP.NET Core minimal APIs with their group prefixes."""
    return minimal_routes(f).filter("path is not null").select("service", "method", "path", "handler", "file", "line")


def dynamic_routes(f: Facts) -> DataFrame:
    """Issues of minimal APIs whose path is no constant."""
    message = F.concat("unit", F.lit(": "), "by", F.lit(" with non-literal path"))
    return minimal_routes(f).filter("path is null").select("service", F.lit("warn").alias("level"), F.lit("dynamic-route").alias("code"), message.alias("message"), "file", "line")


JS_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "all")


#: What a relative import may stand for, in this order.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".mjs", ".cjs", "/index.ts", "/index.js")


def imported_files(f: Facts) -> DataFrame:
    """(service, file, local, imported, target): the file of each relative import, the first candidate that exists."""
    parts = F.split(F.concat(fn.sub("file", "[^/]*$"), "source"), "/")
    up = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))
    base = fn.sub(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"), r"\.(js|mjs|cjs)$")
    wanted = f.imports.filter(c("source").startswith(".")).withColumn("base", base).select("service", "file", "ord", "local", "imported", F.posexplode(F.transform(F.array(*map(F.lit, CANDIDATES)), lambda x: F.concat("base", x))).alias("rank", "target"))
    return wanted.join(f.files.select("service", c("file").alias("target")), ["service", "target"]).groupBy("service", "file", "local", "imported").agg(F.min_by("target", F.struct("ord", "rank")).alias("target"))


def script_routes(f: Facts) -> DataFrame:
    """Express-like routes with their mount prefixes (routers mounted in routers, five levels at most)."""
    routers = f.fields.filter(c("value").rlike(r"^(express|Router|express\.Router|new Router|new Koa|fastify|Fastify)\s*\(")).select("service", "file", "name").distinct()
    k = f.calls.filter(c("language").isin("typescript", "javascript"))
    regs = k.filter(c("method").isin(*JS_VERBS) & (F.size("args") > 1) & arg(0, "kind").isin("string", "template")).join(routers.withColumnRenamed("name", "receiver"), ["service", "file", "receiver"])
    uses = k.filter(c("method").isin("use", "register")).join(routers.withColumnRenamed("name", "receiver"), ["service", "file", "receiver"])
    prefix = F.when(arg(0, "kind") == "string", arg(0)).otherwise("")
    uses = uses.select("service", "file", "receiver", prefix.alias("prefix"), F.element_at("args", -1)["raw"].alias("mounted"))
    found = imported_files(f).select("service", "file", c("local").alias("mounted"), "target", "imported")
    mounts = uses.join(found, ["service", "file", "mounted"], "left").select("service", c("file").alias("p_file"), c("receiver").alias("p_name"), "prefix", F.coalesce("target", "file").alias("file"), F.coalesce("imported", "mounted").alias("receiver"))
    prefixes = routers.select("service", "file", c("name").alias("receiver"), F.lit("").alias("full")).join(mounts.select("service", "file", "receiver"), ["service", "file", "receiver"], "left_anti")
    level = prefixes
    for _ in range(5):
        level = mounts.join(level.select("service", c("file").alias("p_file"), c("receiver").alias("p_name"), "full"), ["service", "p_file", "p_name"]).select("service", "file", "receiver", F.concat("full", F.lit("/"), "prefix").alias("full"))
        prefixes = prefixes.union(level)
    k = handler_of(regs.withColumn("last", F.element_at("args", -1)), "last", f).join(prefixes, ["service", "file", "receiver"])
    verb = F.when(c("method") == "all", "ANY").otherwise(F.upper("method"))
    return k.select("service", verb.alias("method"), fn.join_paths("full", arg(0)).alias("path"), "handler", "file", "line")


# --- HTTP clients

NET = "^(Get|Post|Put|Patch|Delete)Async$|^Get(String|Stream|ByteArray|FromJson)Async$|^(Post|Put|Patch)AsJsonAsync$|^DeleteFromJsonAsync$|^Send(Async)?$"
JAVA = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "patchForObject": "PATCH", "put": "PUT", "delete": "DELETE", "headForHeaders": "HEAD", "optionsForAllow": "OPTIONS", "exchange": "ANY", "execute": "ANY"}
#: What the declared type, or else the name, of an HTTP client looks like; types that are clients by their own name; scripts whose free functions are.
CLIENT_TYPE = "HttpClient|HttpService|AxiosInstance|RestTemplate|WebClient|RestClient|OkHttpClient|IHttpClientFactory|Got|KyInstance"
CLIENT_NAME = "(?i)rest|http|client|web"
CLIENT_OWN_NAME = "Client|Gateway|Proxy|Api$|ApiService$|Connector|Adapter"
CLIENT_SCRIPT = r"(?i)(client|gateway|api|sdk)s?\.[jt]sx?$"
LITERAL = r"""^(?:[$]@|@[$]|[$]|@)?"(.*)"$|^`(.*)`$|^'(.*)'$"""


def receiver_types(calls: DataFrame, f: Facts) -> DataFrame:
    """Adds rtype: the declared type of the receiver, from the unit's parameters or the type's members."""
    name = lambda x: fn.norm_ident(F.substring_index(x, ".", -1))
    p = f.units.select("service", c("id").alias("unit"), F.explode("params").alias("p")).select("service", "unit", fn.norm_ident("p.name").alias("__r"), fn.strip_generics("p.of").alias("__pt")).filter("__pt <> ''").dropDuplicates(["service", "unit", "__r"])
    m = f.fields.filter("of <> ''").groupBy("service", "type", fn.norm_ident("name").alias("__r")).agg(F.min_by(fn.strip_generics("of"), F.struct("file", "ord")).alias("__mt"))
    return calls.withColumn("__r", name("receiver")).join(p, ["service", "unit", "__r"], "left").join(m, ["service", "type", "__r"], "left").withColumn("rtype", F.coalesce("__pt", "__mt")).drop("__r", "__pt", "__mt")


#: A variable that is given a value, and the value; the next declaration may lie inside it.
DECLARED = r"\b(?:var|string|const|let|final\s+String|String)\s+(\w+)\s*=\s*(?=([^;]+);)"


def local_urls(f: Facts) -> DataFrame:
    """(service, unit, name, url): for each variable that a unit's body declares the value of its first declaration there: the literal, with its placeholders by their last names, or the variable as a placeholder. Other units' variables of that name are others."""
    group = lambda i: F.regexp_extract_all("body", F.lit(DECLARED), F.lit(i))
    told = f.units.filter(F.col("body").rlike(DECLARED)).select("service", c("id").alias("unit"), F.posexplode(F.arrays_zip(group(1).alias("name"), group(2).alias("value"))).alias("at", "x"))
    first = told.groupBy("service", "unit", c("x.name").alias("name")).agg(F.min_by(fn.trimmed("x.value"), "at").alias("value"))
    inner = F.coalesce(*(fn.found("value", LITERAL, i) for i in (1, 2, 3)))
    last = r"\$?\{(?:[^{}]*?[.])?_*(\w+)[^{}.]*\}"
    return first.select("service", "unit", "name", F.coalesce(fn.sub(inner, last, "{$1}"), F.concat(F.lit("{"), "name", F.lit("}"))).alias("url"))


def registrations(f: Facts) -> DataFrame:
    """(service, who, key): what a registered client, by type or name, is configured with.

    The key comes from the registration's own lambda, or from the ConfigureHttpClient that follows it most closely;
    without one it is the client's name.
    """
    told = F.coalesce(fn.config_key("raw"), fn.host_of(fn.found("raw", r'"(https?://[^"]+)"')))
    name = F.when(arg(0, "kind") == "string", arg(0))
    types = F.filter(F.split("targs", r"\s*,\s*"), lambda x: x != "")
    reg = f.calls.filter(c("method").isin("AddHttpClient", "AddRefitClient", "AddHttpApi")).select("service", "file", "unit", "c_ord", "line", told.alias("own"), name.alias("name"), types.alias("types"))
    conf = f.calls.filter(c("method").isin("ConfigureHttpClient", "ConfigurePrimaryHttpMessageHandler") & c("receiver").rlike("AddHttpClient|AddRefitClient")).select("service", "unit", c("c_ord").alias("at"), c("line").alias("at_line"), told.alias("later")).filter("later is not null")
    near = conf.join(reg.select("service", "unit", "c_ord", "line"), ["service", "unit"]).filter("line <= at_line and c_ord < at").groupBy("service", "unit", "at").agg(F.max_by("c_ord", F.struct("line", "c_ord")).alias("c_ord"), F.first("later").alias("later"))
    near = near.groupBy("service", "unit", "c_ord").agg(F.max_by("later", "at").alias("later"))
    reg = reg.join(near, ["service", "unit", "c_ord"], "left").withColumn("key", F.coalesce("later", "own", "name"))
    who = F.concat("types", F.when(c("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    out = reg.select("service", "file", "c_ord", F.explode(who).alias("who"), "key")
    return out.groupBy("service", "who").agg(F.max_by(F.coalesce("key", fn.type_slug(fn.sub("who", "^I(?=[A-Z])"))), F.struct("file", "c_ord")).alias("key"))


def requests(f: Facts) -> DataFrame:
    """(service, unit, r_verb, r_url): the first request message that a unit makes."""
    made = f.calls.filter(c("new") & (c("method") == "HttpRequestMessage") & (F.size("args") > 1))
    url = F.when(arg(1, "kind").isin("string", "template"), arg(1)).otherwise(F.concat(F.lit("{"), fn.sub(arg(1, "raw"), r"\W"), F.lit("}")))
    return made.groupBy("service", "unit").agg(F.min_by(F.struct(F.upper(F.substring_index(arg(0, "raw"), ".", -1)).alias("verb"), url.alias("url")), "c_ord").alias("r")).select("service", "unit", c("r.verb").alias("r_verb"), c("r.url").alias("r_url"))


def outbound_rows(f: Facts) -> DataFrame:
    """Calls of fetch, axios, .NET HttpClient, RestTemplate and WebClient: service, method, url, targetHint, fromHandler, file, line, dynamic (an issue's text, or null)."""
    none = F.lit(None).cast("string")
    k = receiver_types(f.calls.filter(~c("new")), f)
    script = c("language").isin("typescript", "javascript")
    option = F.upper(F.coalesce(named("method"), F.lit("GET")))
    made = f.fields.filter(c("value").rlike(r"axios\.create|\.extend\(|got\.extend")).select("service", "file", c("name").alias("client"), fn.found("value", r"(?:baseURL|prefixUrl|baseUrl)\s*:\s*([^,}]+)").alias("base")).distinct()
    fetched = k.filter(script & (c("method") == "fetch") & (c("receiver").isin("", "window", "globalThis", "global", "self")) & (F.size("args") > 0)).select("*", option.alias("verb"), none.alias("base"))
    plain = k.filter(script & (c("method") == "axios") & (c("receiver") == "") & (F.size("args") > 0) & arg(0, "kind").isin("string", "template", "ident")).select("*", option.alias("verb"), none.alias("base"))
    axios = k.filter(script & c("method").isin(*JS_VERBS, "request") & (F.size("args") > 0)).withColumn("client", F.substring_index("receiver", ".", -1)).join(made, ["service", "file", "client"], "left")
    known = c("client").isin("axios", "got", "ky", "superagent", "needle", "request", "undici", "$http") | c("base").isNotNull() | F.coalesce(c("rtype").rlike(CLIENT_TYPE), F.lit(False))
    named_so = c("client").rlike("(?i)client|http|api|gateway|proxy|rest|fetcher") & fn.is_url_like(arg(0))
    axios = axios.filter((known | named_so) & ~F.exists("args", lambda x: x["kind"] == "function") & arg(0, "kind").isin("string", "template", "ident")).drop("client").select("*", F.when(c("method") == "request", F.coalesce(F.upper(named("method")), F.lit("ANY"))).otherwise(F.upper("method")).alias("verb"))
    is_client = F.coalesce(c("rtype"), F.lit("HttpClient")).rlike("HttpClient|RestClient|Client$")
    net = k.filter((c("language") == "csharp") & c("method").rlike(NET) & is_client & (F.size("args") > 0)).select("*", F.upper(F.coalesce(fn.found("method", "^(Get|Post|Put|Patch|Delete)"), F.lit("ANY"))).alias("verb"), none.alias("base"))
    root = fn.found("receiver", r"^(?:this\.)?([A-Za-z_$][\w$]*)")
    chained = k.filter((c("language") == "java") & (c("method") == "uri") & F.contains("receiver", F.lit("("))).drop("rtype").withColumn("whole", c("receiver")).withColumn("receiver", root)
    chained = receiver_types(chained, f)
    restish = F.coalesce(c("rtype").rlike(CLIENT_TYPE), F.lit(False)) | c("receiver").rlike(CLIENT_NAME)
    given = F.transform(F.filter("args", lambda x: F.contains(x["raw"], F.lit("HttpMethod."))), lambda x: F.upper(F.substring_index(x["raw"], ".", -1)))
    asked = k.filter((c("language") == "java") & (c("method") == "method") & F.contains(arg(0, "raw"), F.lit("HttpMethod."))).groupBy("service", "unit").agg(F.min_by(F.upper(F.substring_index(arg(0, "raw"), ".", -1)), "c_ord").alias("asked"))
    step = fn.found("whole", r"(?i)\.(get|post|put|patch|delete|head|options|method)\(\)[^()]*$")
    web = chained.filter(restish & (F.size("args") > 0)).join(asked, ["service", "unit"], "left").select("*", F.when(step == "method", F.coalesce("asked", F.lit("ANY"))).otherwise(F.coalesce(F.upper(step), F.lit("ANY"))).alias("verb"), none.alias("base")).drop("whole", "asked")
    by_name = F.element_at(F.create_map(*(F.lit(x) for p in JAVA.items() for x in p)), c("method"))
    rest = k.filter((c("language") == "java") & c("method").isin(*JAVA) & restish & (F.size("args") > 0)).select("*", F.when(by_name == "ANY", F.coalesce(F.get(given, F.lit(0)), F.lit("ANY"))).otherwise(by_name).alias("verb"), none.alias("base"))
    rows = reduce(DataFrame.unionByName, [fetched, plain, axios, net, web, rest]).withColumn("target", F.get("args", F.lit(0)))
    rows = cut(resolved(rows, "target", f, "url"))
    # URLs: literals and constants; a local variable's literal; a name as a placeholder; request messages; else dynamic
    rows = rows.withColumn("name", F.substring_index("target.raw", ".", -1)).join(local_urls(f).withColumnRenamed("url", "local_url"), ["service", "unit", "name"], "left").join(requests(f), ["service", "unit"], "left")
    sent = c("method").isin("Send", "SendAsync") & (c("language") == "csharp")
    url = F.when(sent & c("r_url").isNotNull(), c("r_url")).otherwise(F.coalesce("url", "local_url", F.when(c("target.kind") == "ident", F.concat(F.lit("{"), fn.sub("name", "^_+"), F.lit("}")))))
    rows = rows.withColumn("verb", F.when(sent, F.coalesce("r_verb", "verb")).otherwise(c("verb"))).withColumn("url", url)
    lost = F.when(c("url").isNull() & (c("language") == "csharp"), F.concat("unit", F.lit(": "), "method", F.lit(" with non-literal URL")))
    rows = rows.withColumn("dynamic", lost).withColumn("url", F.coalesce("url", F.lit("{dynamic}")))
    rows = cut(rows.drop("name", "local_url", "r_url", "r_verb"))
    # hints: the client's base, the registration of a typed or named client, the interpolated expression's configuration key, a @Value field
    first = F.get("target.refs", F.lit(0))
    values = f.fields.groupBy("service", c("name").alias("__f")).agg(F.min_by("value", F.struct("file", "ord")).alias("__v"), F.min_by(F.to_json("attrs"), F.struct("file", "ord")).alias("__a"))
    rows = rows.withColumn("__f", fn.sub(F.substring_index(first, ".", -1), "^_")).join(values, ["service", "__f"], "left")
    made_by = f.fields.withColumn("__c", fn.found("value", r'CreateClient\(\s*"([^"]+)"')).filter("__c is not null").groupBy("service", "file", c("name").alias("__rv")).agg(F.min_by("__c", "ord").alias("__c"))
    rows = rows.withColumn("__rv", F.substring_index("receiver", ".", -1)).join(made_by, ["service", "file", "__rv"], "left")
    rows = rows.withColumn("__who", F.coalesce("__c", "type")).join(registrations(f).select("service", c("who").alias("__who"), c("key").alias("__key")), ["service", "__who"], "left")
    bases = f.calls.filter(c("type").isNotNull() & c("method").isin("baseUrl", "rootUri", "create", "baseURL") & (F.size("args") > 0)).withColumn("__b", F.coalesce(fn.host_of(arg(0)), fn.config_key(arg(0, "raw")))).filter("__b is not null").groupBy("service", "type").agg(F.min_by("__b", F.struct("file", "line", "c_ord")).alias("__base"))
    rows = rows.join(bases, ["service", "type"], "left")
    host = fn.host_of("url")
    of_type = F.when(c("language") == "java", c("__base"))
    hint = F.coalesce(fn.config_key("base"), host, fn.config_key(first), fn.config_key("__v"), fn.found("__a", r"\$\{([^}:]+)"), fn.host_of(fn.found("__v", r"[\"'](https?://[^\"']+)")), "__key", "__c", of_type, F.when(c("base").isNotNull(), fn.sub("base", "^.*[.]")))
    return rows.select("service", c("verb").alias("method"), "url", hint.alias("targetHint"), c("unit").alias("fromHandler"), "file", "line", "dynamic")


def outbound(f: Facts) -> DataFrame:
    """All outbound calls, those of declared Feign and Refit clients too: service, method, url, targetHint, fromHandler, file, line."""
    return outbound_rows(f).drop("dynamic").unionByName(feign(f)).unionByName(refit(f))


def refit(f: Facts) -> DataFrame:
    """Calls that C# interfaces declare by verb attributes; the hint is what the interface is registered with, or its name."""
    of = f.types.filter("kind = 'interface' and language = 'csharp'").select("service", c("name").alias("type")).distinct()
    u = attribute_rows(f.units.filter("abstract and language = 'csharp'"), "id", "type", "line").withColumn("verb", verb_of("refit")).filter("verb is not null").withColumn("url", F.get("args", F.lit(0))["text"]).filter("url is not null")
    rows = u.join(of, ["service", "type"]).join(registrations(f).withColumnRenamed("who", "type"), ["service", "type"], "left")
    return rows.select("service", F.upper("verb").alias("method"), "url", F.coalesce("key", fn.type_slug(fn.sub("type", "^I(?=[A-Z])"))).alias("targetHint"), c("id").alias("fromHandler"), "file", "line")


def with_targets(calls: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Adds targetService: what a service's own settings (service, key, target) say of the hint, in any case of letters."""
    if targets is None:
        return calls.withColumn("targetService", F.lit(None).cast("string"))
    t = targets.groupBy("service", F.lower("key").alias("__hint")).agg(F.min("target").alias("targetService"))
    return calls.withColumn("__hint", F.lower("targetHint")).join(t, ["service", "__hint"], "left").drop("__hint")


def feign(f: Facts) -> DataFrame:
    t = attribute_rows(f.types, "name").filter(c("attr").isin("FeignClient", "HttpExchange")).withColumnRenamed("name", "type")
    url = F.try_element_at("named", F.lit("url"))[0]["text"]
    hint = F.coalesce(fn.host_of(url), fn.config_key(url), F.try_element_at("named", F.lit("name"))[0]["text"], F.get("args", F.lit(0))["text"])
    t = t.select("service", "type", hint.alias("targetHint"), F.coalesce(F.when(fn.host_of(url).isNotNull(), url), F.lit("")).alias("base"))
    u = attribute_rows(f.units, "id", "type", "line").withColumn("verb", verb_of("client")).filter("verb is not null").select("service", "file", "id", "type", "line", F.upper("verb").alias("method"), F.explode(attr_texts("value", "path", "url")).alias("path"))
    return u.join(t, ["service", "type"]).select("service", "method", F.concat("base", "path").alias("url"), "targetHint", c("id").alias("fromHandler"), "file", "line")


# --- messages


def messages(f: Facts) -> tuple[DataFrame, DataFrame]:
    """(consumers, publishes) of Kafka and RabbitMQ clients: service, broker, topic, exchange, routingKey, group, handler, file, line."""
    none, k = F.lit(None).cast("string"), f.calls.filter(~c("new"))
    script = c("language").isin("typescript", "javascript")
    out = ["service", "type", "broker", "value", "exchange", "routingKey", "group", "handler", "file", "line"]

    def shape(df: DataFrame, broker: str, value: Column, handler: Column, exchange: Column = none, key: Column = none, group: Column = none) -> DataFrame:
        return df.select("service", "type", F.lit(broker).alias("broker"), value.alias("value"), exchange.alias("exchange"), key.alias("routingKey"), group.alias("group"), handler.alias("handler"), "file", "line").select(*out)

    a = attribute_rows(f.units, "id", "type", "line")
    listed = lambda n: F.try_element_at("named", F.lit(n))
    kl = a.filter("attr = 'KafkaListener'").withColumn("v", F.explode(F.coalesce(listed("topics"), listed("topicPattern"), c("args"))))
    consumers = [shape(kl, "kafka", c("v"), c("id"), group=listed("groupId")[0]["text"])]
    rl = a.filter("attr = 'RabbitListener'").withColumn("binding", F.array_join(F.transform(listed("bindings"), lambda x: x["raw"]), " "))
    inside = lambda pattern: fn.found("binding", pattern)
    bound = inside(r'@Queue\s*\(\s*(?:value\s*=\s*|name\s*=\s*)?"([^"]+)"')
    literal = lambda x: F.struct(F.lit("string").alias("kind"), x.alias("text"), F.array(x).alias("refs"), x.alias("raw"))
    rl = rl.withColumn("v", F.explode(F.coalesce(listed("queues"), F.when(F.size("args") > 0, c("args")), F.when(bound.isNotNull(), F.array(literal(bound))))))
    consumers.append(shape(rl, "rabbitmq", c("v"), c("id"), exchange=F.when(c("v.text") == bound, inside(r'@Exchange\s*\(\s*(?:value\s*=\s*|name\s*=\s*)?"([^"]+)"')), key=F.when(c("v.text") == bound, inside(r'key\s*=\s*(?:\{\s*)?"([^"]+)"'))))
    heard = f.types.select("service", c("name").alias("type"), F.explode("bases").alias("base")).withColumn("message", fn.found("base", "^IConsumer<(.+)>$")).filter("message is not null")
    mass = f.units.filter("name = 'Consume' and language = 'csharp'").select("service", "file", "id", "type", "line").join(heard, ["service", "type"])
    consumers.append(shape(mass, "unknown", literal(c("message")), c("id")))
    given = F.coalesce(*(F.try_element_at("named", F.lit(n))["raw"] for n in ("eachMessage", "eachBatch")))
    running = k.filter(script & c("method").isin("run")).withColumn("body", given).filter("body is not null").groupBy("service", "file", "receiver").agg(F.min_by("body", F.struct("line", "c_ord")).alias("body"))
    anon = f.units.filter("kind = 'anonymous'").select("service", "file", c("id").alias("anon"), c("body").alias("a_body"))
    each = running.join(anon, ["service", "file"]).filter(F.contains("body", "a_body")).groupBy("service", "file", "receiver").agg(F.max_by("anon", F.length("a_body")).alias("each"))
    groups = f.fields.withColumn("g", fn.found("value", r"groupId\s*:\s*['\"]([^'\"]+)")).filter("g is not null").select("service", "file", c("name").alias("receiver"), "g").distinct()
    items = F.filter(F.split(fn.sub(named("topics", "raw"), r"^\[|\]$"), r"\s*,\s*"), lambda x: x != "")
    raw = lambda x: F.struct(F.when(x.rlike("^['\"]"), "string").otherwise("ident").alias("kind"), fn.unquote(x).alias("text"), F.array(x).alias("refs"), x.alias("raw"))
    js = k.filter(script & (c("method") == "subscribe") & (named("topics", "raw").isNotNull() | named("topic", "raw").isNotNull()))
    js = js.withColumn("v", F.explode(F.when(named("topics", "raw").isNotNull(), F.transform(items, raw)).otherwise(F.array(raw(named("topic", "raw")))))).join(groups, ["service", "file", "receiver"], "left").join(each, ["service", "file", "receiver"], "left")
    consumers.append(shape(js, "kafka", c("v"), F.coalesce("each", "unit"), group=c("g")))
    cs = receiver_types(k.filter((c("language") == "csharp") & (c("method") == "Subscribe") & (F.size("args") > 0)), f)
    consumers.append(shape(cs, "kafka", F.get("args", F.lit(0)), c("unit")))
    typed = receiver_types(k, f)
    amqp = typed.filter(F.substring_index("receiver", ".", -1).rlike("(?i)channel|rabbit|amqp|model|bus") | F.coalesce(c("rtype").rlike("IModel|IChannel|RabbitTemplate|AmqpTemplate|Channel"), F.lit(False)))
    at = lambda name, i: F.coalesce(F.try_element_at("named", F.lit(name)), F.when(F.size("named") == 0, F.get("args", F.lit(i))))
    binds = typed.filter(c("method").isin("QueueBind", "bindQueue", "queueBind")).select("service", "file", "c_ord", at("queue", 0)["raw"].alias("q"), F.coalesce(at("exchange", 1)["text"], at("source", 1)["text"]).alias("exchange"), F.coalesce(at("routingKey", 2)["text"], at("pattern", 2)["text"]).alias("routingKey"))
    binds = binds.groupBy("service", "file", "q").agg(F.max_by(F.struct("exchange", "routingKey"), "c_ord").alias("b")).select("service", "file", "q", "b.*")
    received = f.units.filter("kind = 'anonymous'").groupBy("service", "file").agg(F.min("id").alias("lambda"))
    bc = amqp.filter(c("method").isin("BasicConsume", "consume")).withColumn("v", at("queue", 0)).withColumn("q", c("v.raw")).join(binds, ["service", "file", "q"], "left").join(received, ["service", "file"], "left")
    passed = F.get(F.filter("args", lambda x: x["kind"] == "function"), F.lit(0))["text"]
    consumers.append(shape(bc, "rabbitmq", c("v"), F.coalesce(passed, F.when(c("language") == "csharp", c("lambda")), "unit"), exchange=c("exchange"), key=c("routingKey")))

    kt = receiver_types(k.filter((c("language") == "java") & c("method").isin("send", "convertAndSend") & (F.size("args") > 0)), f)
    publishes = [shape(kt.filter("method = 'send' and rtype like 'KafkaTemplate%'"), "kafka", F.get("args", F.lit(0)), c("unit"))]
    rt = kt.filter(c("rtype").rlike("Rabbit|Amqp") | F.substring_index("receiver", ".", -1).rlike("(?i)rabbit|amqp")).filter("method = 'convertAndSend' or rtype rlike 'Rabbit|Amqp'")
    body = F.array_position(F.transform("args", lambda x: x["kind"] == "other"), True)
    ahead = F.when(body > 0, body - 1).otherwise(F.size("args"))
    publishes.append(shape(rt.filter(ahead >= 1), "rabbitmq", F.get("args", F.lit(0)), c("unit"), key=F.when(ahead >= 2, arg(1))))
    sent = k.filter((c("language") == "csharp") & c("method").isin("Publish", "Send") & F.substring_index("receiver", ".", -1).rlike("(?i)publish|bus|endpoint")).withColumn("message", F.coalesce(F.when(c("targs") != "", F.substring_index("targs", ",", 1)), fn.found(arg(0, "raw"), r"^new\s+(\w+)"))).filter("message is not null")
    publishes.append(shape(sent, "unknown", literal(c("message")), c("unit")))
    publishes.append(shape(k.filter((c("language") == "csharp") & c("method").isin("ProduceAsync", "Produce") & (F.size("args") > 0)), "kafka", F.get("args", F.lit(0)), c("unit")))
    bp = amqp.filter(c("method").isin("BasicPublish", "BasicPublishAsync") | script & (c("method") == "publish")).withColumn("x", at("exchange", 0)).withColumn("r", at("routingKey", 1))
    unnamed = F.coalesce(c("x.kind").isin("string", "template") & (c("x.text") == ""), c("x").isNull())
    publishes.append(shape(bp, "rabbitmq", F.when(unnamed, c("r")).otherwise(c("x")), c("unit"), key=F.when(~unnamed, c("r.text"))))
    publishes.append(shape(amqp.filter((c("method") == "sendToQueue") & (F.size("args") > 0)), "rabbitmq", F.get("args", F.lit(0)), c("unit")))
    publishes.append(shape(k.filter(script & (c("method") == "send") & named("topic", "raw").isNotNull()), "kafka", raw(named("topic", "raw")), c("unit")))
    both = []
    for parts in (consumers, publishes):
        both.append(resolved(reduce(DataFrame.unionByName, parts), "value", f, "topic"))
    return both[0], both[1]


# --- call graph and assembly


#: Names that libraries mostly have; never found by the bare name.
NOISY = """get post put patch delete send subscribe publish consume run connect log json status map filter forEach push then catch toString ToString Add add set has keys values Ok NotFound BadRequest use listen require
resolve reject Parse parse stringify Select Where First FirstOrDefault ToList ToArray Any Count Equals GetType Dispose Start Stop ReadAsync WriteAsync Subscribe Produce ProduceAsync Consume""".split()


def linearised(types: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(service, type, owner, key): each type and all that it is built on, in the order of a walk into the first base and all its bases before the second.

    The key holds the places of bases from the type on; keys sort like the walk, a prefix first. Of several ways to one
    owner the first counts, and a way that returns to a type already on it ends.
    """
    bases = types.groupBy("service", "name").agg(F.min_by("bases", F.struct("file", "ord")).alias("bases"))
    steps = cut(bases.select("service", c("name").alias("of"), F.posexplode("bases").alias("place", "b")).select("service", "of", "place", fn.strip_generics("b").alias("base")))
    known = cut(bases.select("service", c("name").alias("type"), c("name").alias("owner"), F.array().cast("array<int>").alias("key"), F.array("name").alias("way")))
    frontier = known
    for _ in range(max_rounds):
        on = (frontier["service"] == steps["service"]) & (frontier["owner"] == steps["of"])
        new = frontier.join(steps, on).filter(~F.array_contains("way", c("base"))).select(frontier["service"], "type", c("base").alias("owner"), F.concat("key", F.array("place")).alias("key"), F.concat("way", F.array("base")).alias("way"))
        new = new.groupBy("service", "type", "owner").agg(F.min(F.struct("key", "way")).alias("x")).select("service", "type", "owner", "x.key", "x.way")
        before = known.select("service", "type", "owner", c("key").alias("__key"))
        frontier = cut(new.join(before, ["service", "type", "owner"], "left").filter("__key is null or key < __key").drop("__key"))
        if not frontier.limit(1).count():
            return known.select("service", "type", "owner", "key")
        known = cut(known.union(frontier).groupBy("service", "type", "owner").agg(F.min(F.struct("key", "way")).alias("x")).select("service", "type", "owner", "x.key", "x.way"))
    raise RuntimeError(f"still growing after {max_rounds} rounds")


def methods_of_types(f: Facts) -> DataFrame:
    """(service, type, method, callee): what a method of a type is: its own, or that of the first type with one in the order of :func:`linearised`."""
    own = f.units.filter("type is not null and name is not null").select("service", c("type").alias("owner"), c("name").alias("method"), c("id").alias("callee"), "abstract", "file", "ord")
    return linearised(f.types).join(own, ["service", "owner"]).groupBy("service", "type", "method").agg(F.min_by("callee", F.struct("key", "abstract", "file", "ord")).alias("callee"))


def typed_methods(f: Facts, methods: DataFrame) -> DataFrame:
    """(service, type, method, callee) for a declared type: of the first type that implements it, else of its name without I, else its own."""
    t = f.types.select("service", "name", "kind", "file", "ord", "bases")
    built = t.filter("kind <> 'interface'").select("service", "file", "ord", c("name").alias("impl"), F.explode("bases").alias("b")).select("service", fn.strip_generics("b").alias("type"), "impl", F.struct(F.lit(0).alias("k"), "file", "ord").alias("rank"))
    bare = t.filter("name rlike '^I[A-Z]'").select("service", c("name").alias("type"), F.expr("substring(name, 2)").alias("impl"), F.struct(F.lit(1).alias("k"), "file", "ord").alias("rank"))
    own = t.select("service", c("name").alias("type"), c("name").alias("impl"), F.struct(F.lit(2).alias("k"), "file", "ord").alias("rank"))
    candidates = built.union(bare).union(own).join(methods.withColumnRenamed("type", "impl"), ["service", "impl"])
    return candidates.groupBy("service", "type", "method").agg(F.min_by("callee", "rank").alias("callee"))


def call_graph(f: Facts) -> DataFrame:
    """(service, caller, callee): nested functions, functions passed by name, and for each invocation the callee that the first rule with one finds."""
    own = methods_of_types(f)
    typed = cut(typed_methods(f, own))
    own = cut(own)
    functions = f.units.filter("type is null and name is not null and kind = 'function'").select("service", "file", "name", "id", "ord")
    in_file = functions.groupBy("service", "file", c("name").alias("method")).agg(F.min("id").alias("callee"), F.count("*").alias("n")).filter("n = 1").drop("n")
    by_name = functions.groupBy("service", c("name").alias("method")).agg(F.min_by("id", F.struct("file", "ord")).alias("callee"), F.count("*").alias("n"))
    named_so = f.units.filter("name is not null").groupBy("service", c("name").alias("method")).agg(F.min("id").alias("callee"), F.count("*").alias("n")).filter("n = 1").drop("n")
    any_in_file = f.units.filter("name is not null").groupBy("service", "file", c("name").alias("method")).agg(F.min("id").alias("callee"), F.count("*").alias("n")).filter("n = 1").drop("n")
    imports = f.imports.select("service", "file", "local").distinct()
    refs = f.fields.withColumn("made", fn.found("value", r"^new\s+([A-Za-z_]\w*)")).filter("made is not null")
    by_file = refs.groupBy("service", "file", c("name").alias("r")).agg(F.min_by("made", "ord").alias("made_here"))
    anywhere = refs.groupBy("service", c("name").alias("r")).agg(F.min_by("made", F.struct("file", "ord")).alias("made_there"))
    k = receiver_types(f.calls.filter(~c("new")), f).select("service", "file", c("unit").alias("caller"), "type", "receiver", "method", "rtype", "c_ord", F.substring_index("receiver", ".", -1).alias("r"))
    k = cut(k.join(by_file, ["service", "file", "r"], "left").join(anywhere, ["service", "r"], "left").withColumn("made", F.coalesce("made_here", "made_there")).drop("made_here", "made_there"))
    calm = ~c("method").isin(*NOISY)
    bare = k.filter(c("receiver").isin("", "this", "super", "base"))
    some = k.filter(~c("receiver").isin("", "this", "super", "base"))
    free, held = some.filter("rtype is null"), some.filter("rtype is not null")
    capital = F.concat(F.upper(F.substring("r", 1, 1)), F.expr("substring(r, 2)"))
    brought = free.join(imports.withColumnRenamed("local", "r"), ["service", "file", "r"])
    of_type = lambda df, column, table: df.withColumn("__t", column).join(table.withColumnRenamed("type", "__t"), ["service", "__t", "method"])
    rules = [
        of_type(bare, c("type"), own),
        bare.join(in_file, ["service", "file", "method"]),
        bare.filter(calm).join(imports.withColumnRenamed("local", "method"), ["service", "file", "method"]).join(by_name, ["service", "method"]),
        bare.filter(calm).join(by_name.filter("n = 1"), ["service", "method"]),
        of_type(held, c("rtype"), typed),
        of_type(free, c("r"), own),
        of_type(free, c("made"), typed),
        brought.join(named_so, ["service", "method"]),
        of_type(brought, capital, own),
        of_type(free.filter(calm), capital, own),
        of_type(free.filter(calm), F.concat(F.upper(F.substring(fn.sub("r", "^_+"), 1, 1)), F.expr("substring(regexp_replace(r, '^_+', ''), 2)")), own),
        free.filter(calm).join(any_in_file, ["service", "file", "method"]).filter("callee <> caller"),
    ]
    found = reduce(DataFrame.unionByName, [r.select("service", "caller", "c_ord", "callee", F.lit(i).alias("rule")) for i, r in enumerate(rules)])
    best = found.groupBy("service", "caller", "c_ord").agg(F.min_by("callee", F.struct("rule", "callee")).alias("callee")).select("service", "caller", "callee")
    passed = f.calls.select("service", "file", c("unit").alias("caller"), F.explode("args").alias("a")).filter("a.kind = 'ident'").select("service", "file", "caller", c("a.raw").alias("method")).join(in_file, ["service", "file", "method"]).select("service", "caller", "callee")
    nested = f.units.select("service", c("id").alias("caller"), F.explode("children").alias("callee"))
    return best.union(passed).union(nested).filter("caller <> callee").distinct()


def client_types(f: Facts) -> DataFrame:
    """(service, type): types that call other services: by their name, as declared clients (Feign, Refit), or because they are registered as typed clients."""
    controller = F.exists("attrs", lambda a: a["name"] == "Controller")
    by_name = f.types.filter(c("name").rlike(CLIENT_OWN_NAME) & ~c("name").rlike("Controller") & ~controller).select("service", c("name").alias("type"))
    declared = attribute_rows(f.types, "name").filter(c("attr").isin("FeignClient", "HttpExchange")).select("service", c("name").alias("type"))
    refits = refit(f).select("service", F.element_at(F.split("fromHandler", r"\."), -2).alias("type"))
    typed = f.calls.filter(c("method").isin("AddHttpClient", "AddRefitClient", "AddHttpApi")).select("service", F.get(F.filter(F.split("targs", r"\s*,\s*"), lambda x: x != ""), F.lit(0)).alias("type"))
    return reduce(DataFrame.union, [by_name, declared, refits, typed]).filter("type is not null").distinct()


#: What extractors find, by the table that they give; every one of them can be left out or added to.
EXTRACTORS = {
    "endpoints": {"controllers": controllers, "minimal-apis": minimal_apis, "script-routes": script_routes},
    "calls": {"http-clients": outbound_rows, "feign": feign, "refit": refit},
    "consumers": {"messages": lambda f: messages(f)[0]},
    "publishes": {"messages": lambda f: messages(f)[1]},
}
_MESSAGE = "service string, type string, broker string, exchange string, routingKey string, group string, handler string, file string, line int, topic string, topic_known boolean"
FOUND = {"endpoints": "service string, method string, path string, handler string, file string, line int", "calls": "service string, method string, url string, targetHint string, fromHandler string, file string, line int, dynamic string", "consumers": _MESSAGE, "publishes": _MESSAGE}


def extracted(f: Facts, extractors: dict = EXTRACTORS, disabled: DataFrame | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """(rows by table, failures (extractor, message)). Each extractor runs by itself: one that fails gives no rows, and the others' stay. ``disabled``: (service, name), whose rows go."""
    spark, found, failed = f.files.sparkSession, {}, {}
    for table, columns in FOUND.items():
        names = [x.split(" ")[0] for x in columns.split(", ")]
        parts = [spark.createDataFrame([], columns)]
        for name, extract in extractors.get(table, {}).items():
            try:
                rows = extract(f)
                rows = cut(rows.select(*(F.col(f"`{n}`") if n in rows.columns else F.lit(None).alias(n) for n in names)))
            except Exception as e:  # whatever an extractor does wrong is told, and costs only its own rows
                failed.setdefault(name, f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:300])
                continue
            if disabled is not None:
                rows = rows.join(disabled.filter(c("name") == name).select("service").distinct(), "service", "left_anti").select(*rows.columns)
            parts.append(rows)
        found[table] = cut(reduce(DataFrame.unionByName, parts))
    return found, list(failed.items())


def assemble(f: Facts, services: DataFrame, prune: bool = True, targets: DataFrame | None = None, extractors: dict = EXTRACTORS, settings: DataFrame | None = None) -> Estate:
    """An estate (tables of manifests) from facts. Handlers are kept if they begin something, do something outside, or lie between.

    ``targets``: (service, key, target) that name the service behind a hint. ``settings``: rows of ``trees.read_settings``,
    by service id; they add targets, declared dependencies and extractors that are left out.
    """
    told, disabled = None, None
    if settings is not None:
        own = settings.select("service", F.explode("targets").alias("key", "target"))
        targets = own if targets is None else targets.select("service", "key", "target").union(own)
        disabled = settings.select("service", F.explode("disable").alias("name"))
        told = settings.select("service", F.posexplode("declared").alias("i_ord", "d")).select("service", "i_ord", c("d.service").alias("dep_service"), c("d.reason").alias("reason"))
    found, failed = extracted(f, extractors, disabled)
    endpoints, plain, consumers, publishes = (found[t] for t in FOUND)
    calls = cut(with_targets(plain.drop("dynamic"), targets))
    graph = cut(call_graph(f))
    node = lambda x: F.concat_ws("\0", "service", x)
    steps = graph.select(node("caller").alias("src"), node("callee").alias("dst"))
    entries = endpoints.select("service", "handler").union(consumers.select("service", "handler")).distinct()
    effects = calls.select("service", c("fromHandler").alias("handler")).union(publishes.select("service", "handler")).distinct()
    seeds = lambda df: df.select(F.lit(0).alias("seed"), node("handler").alias("node"))
    down = reach(steps, seeds(entries)).select("node")
    up = reach(steps.select(c("dst").alias("src"), c("src").alias("dst")), seeds(effects)).select("node")
    keep = down.intersect(up).union(seeds(entries).select("node")).union(seeds(effects).select("node")).distinct()
    flag = lambda df, name: df.select(node("handler").alias("node")).distinct().withColumn(name, F.lit(True))
    u = f.units.withColumn("node", node("id"))
    if prune:
        u = u.join(keep, "node", "left_semi")
    u = u.join(flag(endpoints, "is_http"), "node", "left").join(flag(consumers, "is_message"), "node", "left")
    u = u.join(client_types(f).withColumn("is_client", F.lit(True)), ["service", "type"], "left")
    free = c("type").isNull() & ~c("kind").isin("module", "anonymous")
    client = c("is_client") | free & c("file").rlike(CLIENT_SCRIPT)
    kind = F.when(c("is_http"), "http").when(c("is_message"), "message").when(client, "client").when(c("kind").isin("module", "anonymous"), "other").otherwise("service")
    known = u.select("service", c("id").alias("callee"))
    to = graph.join(known, ["service", "callee"], "left_semi").groupBy("service", c("caller").alias("id")).agg(F.sort_array(F.collect_set("callee")).alias("to"))
    loc = F.struct("file", c("line").cast("int").alias("line")).alias("loc")
    order = services.select(c("id").alias("service"), "m_ord")
    number = lambda df, by: df.join(order, "service").withColumn("i_ord", F.row_number().over(Window.partitionBy("service").orderBy(*by)) - 1)
    handlers = number(u.join(to, ["service", "id"], "left").withColumn("calls", F.coalesce("to", F.array().cast("array<string>"))), ["id"]).select("m_ord", "i_ord", "service", "id", kind.alias("kind"), "name", loc, "calls", fn.body_hash("body").alias("hash"))

    def unique(df: DataFrame, name: Column) -> DataFrame:
        df = df.withColumn("id", name)
        n = F.row_number().over(Window.partitionBy("service", "id").orderBy("file", "line"))
        return df.withColumn("n", n).withColumn("id", F.when(c("n") > 1, F.concat_ws("#", "id", "n")).otherwise(c("id"))).drop("n")

    eps = number(unique(endpoints, F.concat_ws(" ", "method", "path")), ["id"])
    outs = number(unique(calls, F.concat_ws(" ", "fromHandler", "method", "url")), ["id"])
    cons = number(unique(consumers.filter("topic_known"), F.concat_ws(":", "broker", "topic")), ["id"])
    pubs = number(unique(publishes.filter("topic_known"), F.concat_ws(":", "handler", "broker", "topic")), ["id"]).withColumnRenamed("handler", "fromHandler")
    open_ = lambda df, what: df.filter("not topic_known").select("service", "file", "line", "handler", F.when(c("broker") == "rabbitmq", F.lit(f"unresolved-{what}")).otherwise(F.lit("unresolved-topic")).alias("code"))
    unresolved = open_(consumers, "queue").union(open_(publishes, "exchange"))
    bad = f.files.filter("issue is not null").select("service", F.when(c("issue").rlike("^(parse|read)-failed"), "warn").otherwise("info").alias("level"), F.split_part("issue", F.lit(":"), F.lit(1)).alias("code"), c("issue").alias("message"), "file", F.lit(1).alias("line"))
    issues = bad.unionByName(unresolved.select("service", F.lit("warn").alias("level"), "code", F.concat(F.lit("topic of "), "handler", F.lit(" is not a constant")).alias("message"), "file", "line"))
    issues = issues.unionByName(dynamic_routes(f)).unionByName(plain.filter("dynamic is not null").select("service", F.lit("info").alias("level"), F.lit("dynamic-url").alias("code"), c("dynamic").alias("message"), "file", "line"))
    if failed:
        why = F.explode(F.array(*(F.lit(f"{name}: {message}") for name, message in failed))).alias("message")
        issues = issues.unionByName(services.select(c("id").alias("service"), F.lit("error").alias("level"), F.lit("plugin-failed").alias("code"), why, F.lit("").alias("file"), F.lit(0).alias("line")))
    issues = number(issues, ["file", "line", "code"])
    more = {} if told is None else {"declared": told.join(order, "service")}
    return estate_of(handlers.sparkSession, services=services, handlers=handlers, **more, **{n: df.withColumn("loc", F.struct("file", c("line").cast("int").alias("line"))) for n, df in (("endpoints", eps), ("calls", outs), ("consumers", cons), ("publishes", pubs), ("issues", issues))})


def identified(df: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """``df`` with the id of each service in place of its repository's name: that of the settings, or else made from the name."""
    if settings is None:
        return df.withColumn("service", fn.service_slug("service"))
    ids = settings.select(c("service").alias("__s"), c("id").alias("__id"))
    return df.join(ids, df["service"] == ids["__s"], "left").withColumn("service", F.coalesce(fn.truthy("__id"), fn.service_slug("service"))).drop("__s", "__id")


def infer_services(f: Facts, settings: DataFrame | None = None) -> DataFrame:
    """(m_ord, id, name, layer, language) for each service of the files: its layer from its name, its language from most of its files. What ``settings`` (by service id) say comes first, and adds owner, repo, description, tags and frameworks."""
    out = inferred_services(f)
    if settings is None:
        return out
    s = settings.select(c("service").alias("id"), *(c(x).alias(f"__{x}") for x in ("name", "layer", "language", "owner", "repo", "description", "tags", "frameworks")))
    out = out.join(s, "id", "left")
    layer = F.when(c("__layer").isNull(), c("layer")).when(c("__layer").isin(*fn.LAYERS), c("__layer")).otherwise("unknown")
    given = [c(f"__{x}").alias(x) for x in ("owner", "repo", "description", "tags", "frameworks")]
    return out.select("m_ord", "id", F.coalesce("__name", "name").alias("name"), layer.alias("layer"), F.coalesce("__language", "language").alias("language"), *given)


def inferred_services(f: Facts) -> DataFrame:
    n = f.files.filter("language <> ''").groupBy("service", "language").agg(F.count("*").alias("k"))
    top = n.groupBy("service").agg(F.max_by("language", F.struct("k", "language")).alias("language"))
    return numbered(top, "place", "service").select((F.col("place") - 1).alias("m_ord"), fn.service_slug("service").alias("id"), c("service").alias("name"), fn.infer_layer("service").alias("layer"), "language")


def drop_dangling(e: Estate) -> Estate:
    """Items whose handler the service doesn't have go, each leaving a warning."""
    known, issues, kept = e.handlers.select("service", c("id").alias("__h")).distinct(), [e.issues], {}
    for name, column in (("endpoints", "handler"), ("consumers", "handler"), ("calls", "fromHandler"), ("publishes", "fromHandler")):
        rows = getattr(e, name).withColumn("__h", c(column))
        kept[name] = rows.join(known, ["service", "__h"], "left_semi").drop("__h")
        message = F.concat(F.lit(f"{name} item "), "id", F.lit(" refers to missing handler "), F.coalesce("__h", F.lit("undefined")))
        issues.append(rows.join(known, ["service", "__h"], "left_anti").select("m_ord", "i_ord", "service", F.lit("warn").alias("level"), F.lit("dangling-handler").alias("code"), message.alias("message"), "loc"))
    return e.replace(**kept, issues=reduce(DataFrame.unionByName, issues))

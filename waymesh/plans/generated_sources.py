"""Extraction over sources written from the parts: one file for each part, of twelve kinds, so that twins compute what must be found.

A part's key names its classes, its brand and size are its routes, queues and topics, and the parity of its size changes
the file, so that rules with a choice have to choose.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..operators.estate import Estate
from ..sources import trees
from ..sources.parsing.facts import Facts, parse_sources
from . import estate as est
from .queries import query
from .session import cut, shared_dir

#: (file, text) by part key modulo 12, for even and odd sizes; $K is the key, $B the brand, $S the size.
TEMPLATES = [
    [("a/Part$KController.java", '@RestController\n@RequestMapping("/$B")\npublic class Part$KController {\n  @GetMapping("/{id}/$S") public int one$K(String id) { return 1; }\n  @RequestMapping(value = "/all", method = RequestMethod.PATCH) public void all$K() { }\n}\n')] * 2,
    [(f"a/part$K.ts", f"@Controller('$B')\nexport class Part$K {{\n  @{verb}('$S/:id') async one$K(@Param('id') id: string) {{ return 1; }}\n}}\n") for verb in ("Post", "All")],
    [("a/Part$KRes.java", '@Path("/$B") public class Part$KRes {\n  @PUT @Path("/$S/{id}") public void put$K(String id) { }\n}\n')] * 2,
    [
        ("Part$KSetup.cs", 'public class Part$KSetup { void Go$K() { services.AddHttpClient<Part$KClient>(c => c.BaseAddress = new Uri(cfg["Urls:$B"])); } }\npublic class Part$KClient { private readonly HttpClient _http; public async Task Ask$K() { await _http.GetAsync("/$S"); } }\n'),
        ("Part$KSetup.cs", 'public class Part$KSetup { void Go$K() { services.AddHttpClient<Part$KClient>().ConfigureHttpClient(c => c.BaseAddress = new Uri("https://$B.example.com/")); } }\npublic class Part$KClient { private readonly HttpClient _http; public async Task Ask$K() { await _http.GetAsync("/$S"); } }\n'),
    ],
    [(f"IPart$K.cs", f'public interface IPart$K {{ [{verb}("/$B/{{id}}/$S")] Task<int> One$K(string id); }}\n') for verb in ("Get", "Delete")],
    [
        ("Part$KRest.java", 'public class Part$KRest { private final RestTemplate rest; Part$KRest(RestTemplate rest) { this.rest = rest; } public void go$K() { rest.postForObject("https://$B.example.com/p/$S", x, Y.class); } }\n'),
        ("Part$KRest.java", 'public class Part$KRest { private final WebClient web; Part$KRest(WebClient web) { this.web = web; } public void go$K() { web.delete().uri("https://$B.example.com/p/$S").retrieve(); } }\n'),
    ],
    [
        ("src/two$K.ts", "export async function a$K() { const url = '/a/$S'; return fetch(url); }\nexport async function b$K() { const url = `/b/${x.id}/$B`; return fetch(url, { method: 'POST' }); }\n"),
        ("src/two$K.ts", "export async function a$K(url: string) { return fetch(url); }\nexport async function b$K() { const url = '/$B/$S'; return fetch(url, { method: 'POST' }); }\n"),
    ],
    [
        ("src/queue$K.ts", 'export function put$K() { channel.sendToQueue("q.$B.$S", 1); }\n'),
        ("Part$KHeard.java", '@Component public class Part$KHeard { @RabbitListener(bindings = @QueueBinding(value = @Queue("q.$B.$S"), exchange = @Exchange("ex.$B"), key = "k.$S")) void on$K(Item i) { } }\n'),
    ],
    [
        ("Part$KBases.cs", "public class Base$K { public void Save$K() { } }\npublic class Mid$K : Base$K { }\npublic class Other$K { public void Save$K() { } }\npublic class Leaf$K : Mid$K, Other$K { public void Do$K() { Save$K(); } }\n"),
        ("Part$KBases.cs", "public class Base$K { public void Save$K() { } }\npublic class Mid$K : Base$K { }\npublic class Other$K { public void Save$K() { } }\npublic class Leaf$K : Other$K, Mid$K { public void Do$K() { Save$K(); } }\n"),
    ],
    [(f"src/worker$K.ts", f"const consumer$K = kafka.consumer({{ groupId: 'g.$S' }});\nexport async function start$K() {{\n  await consumer$K.subscribe({{ topics: ['$B.in', '$B.$S'] }});\n  await consumer$K.run({{ {each}: async (x) => {{ await producer.send({{ topic: '$B.out', messages: [] }}); }} }});\n}}\n") for each in ("eachMessage", "eachBatch")],
    [(f"src/app$K.ts", f"import express from 'express';\nconst app$K = express();\napp$K.get('/$B/$S', (q, r) => r.end());\napp$K.{verb}('/$B/$S', (q, r) => r.end());\n") for verb in ("get", "post")],
    [("src/part$KApi.ts", "export async function call$K() { return fetch('/$B'); }\n"), ("src/part$K.ts", "export async function call$K() { return fetch('/$B'); }\n")],
]

_kept: dict = {}


def forget() -> None:
    """Drop the kept facts, so that the next query parses its own."""
    _kept.clear()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = est.run(spark, sf_dir, "SELECT p_partkey AS k, CAST(p_size AS INT) AS s, replace(lower(p_brand), '#', '-') AS b FROM part")
    table = F.array(*(F.array(*(F.struct(F.lit(file).alias("file"), F.lit(text).alias("text")) for file, text in pair)) for pair in TEMPLATES))
    t = F.get(F.get(table, (F.col("k") % 12).cast("int")), F.col("s") % 2)
    fill = lambda x: F.replace(F.replace(F.replace(x, F.lit("$K"), F.col("k").cast("string")), F.lit("$S"), F.col("s").cast("string")), F.lit("$B"), F.col("b"))
    return parts.select(F.concat(F.lit("yard-"), (F.col("k") % 97).cast("string")).alias("service"), fill(t["file"]).alias("file"), fill(t["text"]).alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept.clear()
        _kept[key] = {"facts": parse_sources(sources(spark, sf_dir))}
    return _kept[key]["facts"]


def assembled(spark: SparkSession, sf_dir: str) -> Estate:
    f = facts(spark, sf_dir)
    held = _kept[spark.sparkContext.applicationId, sf_dir]
    if "estate" not in held:
        held["estate"] = extract.assemble(f, extract.infer_services(f)).written()
    return held["estate"]


P = "p AS (SELECT p_partkey AS k, CAST(p_size AS INT) AS s, replace(lower(p_brand), '#', '-') AS b, p_partkey % 12 AS kind, p_size % 2 = 1 AS odd, 'yard-' || (p_partkey % 97) AS service FROM part)"


def over_parts(*selects: str) -> str:
    return f"WITH {P} " + " UNION ALL ".join(selects)


def fact_query(key: str, *selects: str):
    return lambda f: query(key, over_parts(*selects))(lambda spark, sf_dir: f(facts(spark, sf_dir)))


def estate_query(key: str, *selects: str):
    return lambda f: query(key, over_parts(*selects))(lambda spark, sf_dir: f(assembled(spark, sf_dir)))


_routes = lambda suffix: lambda f: extract.controllers(f).filter(F.col("file").rlike(suffix)).select("service", "method", "path", "handler")
_calls = lambda file: lambda f: extract.outbound(f).filter(F.col("file").rlike(file)).select("service", "method", "url", "targetHint", "fromHandler")
fact_query("src_05_generated_files", "SELECT service, CASE WHEN kind IN (3, 4, 8) THEN 'csharp' WHEN kind IN (0, 2, 5) OR kind = 7 AND odd THEN 'java' ELSE 'typescript' END AS language, count(*) AS n FROM p GROUP BY ALL")(lambda f: f.files.groupBy("service", "language").agg(F.count("*").alias("n")))
fact_query("plg_08_spring", "SELECT service, 'GET' AS method, '/' || b || '/{id}/' || s AS path, 'Part' || k || 'Controller.one' || k AS handler FROM p WHERE kind = 0", "SELECT service, 'PATCH', '/' || b || '/all', 'Part' || k || 'Controller.all' || k FROM p WHERE kind = 0")(_routes("Controller.java$"))
fact_query("plg_08_jax_rs", "SELECT service, 'PUT' AS method, '/' || b || '/' || s || '/{id}' AS path, 'Part' || k || 'Res.put' || k AS handler FROM p WHERE kind = 2")(_routes("Res.java$"))
fact_query("plg_11_nest", "SELECT service, CASE WHEN odd THEN 'ANY' ELSE 'POST' END AS method, '/' || b || '/' || s || '/{id}' AS path, 'Part' || k || '.one' || k AS handler FROM p WHERE kind = 1")(_routes("ts$"))
fact_query("plg_12_registrations", "SELECT service, 'Part' || k || 'Client' AS who, CASE WHEN odd THEN b || '.example.com' ELSE 'Urls:' || b END AS key FROM p WHERE kind = 3")(extract.registrations)
fact_query("plg_12_typed_clients", "SELECT service, 'GET' AS method, '/' || s AS url, CASE WHEN odd THEN b || '.example.com' ELSE 'Urls:' || b END AS targetHint, 'Part' || k || 'Client.Ask' || k AS fromHandler FROM p WHERE kind = 3")(_calls("Setup.cs$"))
fact_query("plg_14_refit", "SELECT service, CASE WHEN odd THEN 'DELETE' ELSE 'GET' END AS method, '/' || b || '/{id}/' || s AS url, 'part' || k AS targetHint, 'IPart' || k || '.One' || k AS fromHandler FROM p WHERE kind = 4")(_calls("IPart"))
fact_query("plg_15_java_clients", "SELECT service, CASE WHEN odd THEN 'DELETE' ELSE 'POST' END AS method, 'https://' || b || '.example.com/p/' || s AS url, b || '.example.com' AS targetHint, 'Part' || k || 'Rest.go' || k AS fromHandler FROM p WHERE kind = 5")(_calls("Rest.java$"))
fact_query("plg_17_scoped_urls", "SELECT service, 'GET' AS method, CASE WHEN odd THEN '{url}' ELSE '/a/' || s END AS url, 'src/two' || k || '.ts:a' || k AS fromHandler FROM p WHERE kind = 6", "SELECT service, 'POST', CASE WHEN odd THEN '/' || b || '/' || s ELSE '/b/{id}/' || b END, 'src/two' || k || '.ts:b' || k FROM p WHERE kind = 6")(lambda f: _calls("src/two")(f).drop("targetHint"))
fact_query("plg_20_rabbit_publishes", "SELECT service, 'rabbitmq' AS broker, 'q.' || b || '.' || s AS topic, 'src/queue' || k || '.ts:put' || k AS handler FROM p WHERE kind = 7 AND NOT odd")(lambda f: extract.messages(f)[1].filter("broker = 'rabbitmq'").select("service", "broker", "topic", "handler"))
fact_query("plg_20_rabbit_consumers", "SELECT service, 'q.' || b || '.' || s AS topic, 'ex.' || b AS exchange, 'k.' || s AS routingKey, 'Part' || k || 'Heard.on' || k AS handler FROM p WHERE kind = 7 AND odd")(lambda f: extract.messages(f)[0].filter("broker = 'rabbitmq'").select("service", "topic", "exchange", "routingKey", "handler"))
fact_query("plg_19_each_batch", "SELECT service, b || '.in' AS topic, 'g.' || s AS grp, true AS own FROM p WHERE kind = 9", "SELECT service, b || '.' || s, 'g.' || s, true FROM p WHERE kind = 9")(lambda f: extract.messages(f)[0].filter("broker = 'kafka'").select("service", "topic", F.col("group").alias("grp"), F.contains("handler", F.lit("anon@")).alias("own")))
fact_query("cgr_03_inherited", "SELECT service, 'Leaf' || k || '.Do' || k AS caller, CASE WHEN odd THEN 'Other' ELSE 'Base' END || k || '.Save' || k AS callee FROM p WHERE kind = 8")(lambda f: extract.call_graph(f).filter("caller like 'Leaf%'"))
fact_query("cgr_03_base_order", "SELECT service, 'Leaf' || k AS type, CASE WHEN odd THEN 'Leaf' || k || ' Other' || k || ' Mid' || k || ' Base' || k ELSE 'Leaf' || k || ' Mid' || k || ' Base' || k || ' Other' || k END AS owners FROM p WHERE kind = 8")(lambda f: extract.linearised(f.types).filter("type like 'Leaf%'").groupBy("service", "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "owner"))), lambda x: x["owner"]), " ").alias("owners")))
_ROUTES = "SELECT service, 'GET /' || b || '/' || s AS id FROM p WHERE kind = 10 UNION ALL SELECT service, CASE WHEN odd THEN 'POST' ELSE 'GET' END || ' /' || b || '/' || s FROM p WHERE kind = 10"
estate_query("asm_01_unique_ids", f"SELECT service, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY service, id) AS n FROM ({_ROUTES}) r) t")(lambda e: e.endpoints.filter(F.col("loc.file").rlike("src/app")).select("service", "id"))
estate_query("asm_04_kinds", "SELECT service, CASE WHEN odd THEN 'src/part' || k || '.ts:call' ELSE 'src/part' || k || 'Api.ts:call' END || k AS id, CASE WHEN odd THEN 'service' ELSE 'client' END AS kind FROM p WHERE kind = 11", "SELECT service, 'Part' || k || 'Client.Ask' || k, 'client' FROM p WHERE kind = 3", "SELECT service, 'IPart' || k || '.One' || k, 'client' FROM p WHERE kind = 4", "SELECT service, 'Part' || k || 'Rest.go' || k, 'service' FROM p WHERE kind = 5", "SELECT service, 'Part' || k || 'Res.put' || k, 'http' FROM p WHERE kind = 2", "SELECT service, 'Part' || k || 'Heard.on' || k, 'message' FROM p WHERE kind = 7 AND odd")(lambda e: e.handlers.filter(F.col("loc.file").rlike(r"src/part\d|Setup\.cs$|IPart|Rest\.java$|Res\.java$|Heard\.java$") & ~F.col("id").rlike("anon@|<init>|<module>")).select("service", "id", "kind"))


# --- the same sources as trees of files


def planted(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a tree with a repository for each service: its sources, its settings, and what must not be read."""
    root = f"{trees.qualified(spark, shared_dir(spark))}/tree-{uuid.uuid4().hex}"
    files = sources(spark, sf_dir)
    own = files.groupBy("service").agg(F.count("*").alias("n"))
    name = F.concat(F.lit("plot-"), F.substring_index("service", "-", -1))
    yaml = F.concat(F.lit("service:\n  id: "), name, F.lit("\n  layer: domain\n  owner: team-"), F.col("n").cast("string"), F.lit("\ntargets:\n  PARTS_URL: stock\n  SIZE_"), F.col("n").cast("string"), F.lit(": sizes\n"))
    settings = own.select("service", F.lit("waymesh.yaml").alias("file"), yaml.alias("text"))
    skipped = own.select("service", F.lit("node_modules/lib/index.ts").alias("file"), F.lit("not read").alias("text"))

    def put(batches):
        for b in batches:
            for service, file, text in zip(*(c.to_pylist() for c in b.columns)):
                store, top = trees.opened(root)
                folder = f"{top}/{service}/{file}".rpartition("/")[0]
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{top}/{service}/{file}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    cut(files.union(settings).union(skipped).repartition("service").mapInArrow(put, "n long"))
    return root


@query("src_05_source_tree", over_parts("SELECT service, count(*) AS files, 0::BIGINT AS issues FROM p GROUP BY service"))
def src_05_tree(spark, sf_dir):
    found = trees.read_sources(spark, planted(spark, sf_dir))
    return found.groupBy(F.split("file", "/")[0].alias("service")).agg(F.count("*").alias("files"), F.count("issue").alias("issues"))


@query("src_07_settings", over_parts("SELECT service, 'plot-' || (k % 97) AS id, 'domain' AS layer, 'team-' || count(*) AS owner, 'PARTS_URL=stock,SIZE_' || count(*) || '=sizes' AS targets FROM p GROUP BY service, k % 97"))
def src_07(spark, sf_dir):
    files = trees.read_sources(spark, planted(spark, sf_dir), suffixes=[".yaml"])
    s = trees.read_settings(files.select(F.split("file", "/")[0].alias("service"), F.substring_index("file", "/", -1).alias("file"), "text"))
    return s.select("service", "id", "layer", "owner", F.array_join(F.array_sort(F.transform(F.map_entries("targets"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("targets"))


@query("src_08_repositories", over_parts("SELECT DISTINCT service FROM p"))
def src_08(spark, sf_dir):
    return trees.find_repositories(spark, [planted(spark, sf_dir)]).select(F.element_at(F.split("folder", "/"), -1).alias("service"))

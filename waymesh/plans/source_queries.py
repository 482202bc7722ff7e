"""Extraction over sources made from the nations: one small service of four languages for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, flows
from ..operators.estate import Estate
from ..sources import manifests as src
from ..sources import sinks
from ..sources.parsing.facts import Facts, parse_sources
from . import estate as est
from . import twins as tw
from .queries import fault_sql, faulty, query
from .session import cut

SOURCES = {
    "Orders$NController.cs": """using X.Y;
namespace Shop;
[ApiController]
[Route("api/[controller]")]
public class Orders$NController : ControllerBase
{
    private readonly IOrder$NService _orders;
    public Orders$NController(IOrder$NService orders) { _orders = orders; }
    [HttpPost] public async Task<ActionResult<Order>> Create([FromBody] Request request) { return await _orders.Place(request); }
    [HttpGet("{id}")] public Task<Order> Get(string id) => _orders.Find(id);
    [HttpDelete("/v2/gone/{id}")] public void Gone(string id) { }
}
""",
    "Order$NService.cs": """public static class Topics { public const string Created = "order$N.created"; }
public class Order$NService : IOrder$NService
{
    private readonly HttpClient _http;
    private readonly IProducer<string, string> _producer;
    public Order$NService(HttpClient http, IProducer<string, string> producer) { _http = http; _producer = producer; }
    public async Task<Order> Place(Request r) { await _http.PostAsJsonAsync($"/pay/{r.Id}", r); await Tell(r); return Find("x"); }
    private async Task Tell(Request r) { await _producer.ProduceAsync(Topics.Created, new Message<string, string> { Key = r.Id }); }
    public Order Find(string id) { /* nothing(1) */ return null; }
}
""",
    "StockController.java": """package a.b;
@RestController
@RequestMapping("/stock$N")
public class StockController {
    private final RestTemplate rest;
    public StockController(RestTemplate rest) { this.rest = rest; }
    @GetMapping("/{sku}") public int get(@PathVariable String sku) { return rest.getForObject("https://wms$N.example.com/v2/" + sku, Integer.class); }
    @KafkaListener(topics = "order$N.created", groupId = "stock") public void on(Event event) { log(event); }
    private void log(Event event) { }
}
""",
    "src/routes/items.ts": """import { Router } from 'express';
import { load } from '../load';
export const items = Router();
items.get('/:id', async (req, res) => { res.json(await load(req.params.id)); });
items.post('/', (req, res) => res.end());
""",
    "src/load.ts": """const BASE = process.env.ITEMS_$N_URL ?? 'http://localhost';
export async function load(id: string) { const r = await fetch(`${BASE}/items/${id}`, { method: 'PUT' }); return r.json(); }
""",
    "src/server.ts": """import express from 'express';
import { items } from './routes/items';
const app = express();
app.use('/v$N/items', items);
app.get('/healthz', (_req, res) => res.send('ok'));
""",
}

_facts: dict = {}


def forget() -> None:
    """Drop the kept facts, so that the next query parses its own."""
    _facts.clear()


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _facts:
        _facts.clear()
        files = spark.createDataFrame(list(SOURCES.items()), "file string, text string")
        n = est.run(spark, sf_dir, "SELECT CAST(n_nationkey AS STRING) AS n FROM nation")
        rows = n.join(F.broadcast(files), F.lit(True)).select(F.concat(F.lit("shop-"), "n").alias("service"), F.replace("file", F.lit("$N"), F.col("n")).alias("file"), F.replace("text", F.lit("$N"), F.col("n")).alias("text"))
        _facts[key] = parse_sources(rows)
    return _facts[key]


def each(*rows: str) -> str:
    """Rows of SQL over every nation's number n."""
    return " UNION ALL ".join(f"SELECT 'shop-' || n AS service, {r} FROM (SELECT n_nationkey AS n FROM nation) t" for r in rows)


def fact_query(key: str, *rows: str):
    def add(f):
        return query(key, each(*rows) if rows else None)(lambda spark, sf_dir: f(facts(spark, sf_dir)))

    return add


fact_query("src_05_sources", *(f"{n} AS file, '{lang}' AS language" for n, lang in (("'Orders' || n || 'Controller.cs'", "csharp"), ("'Order' || n || 'Service.cs'", "csharp"), ("'StockController.java'", "java"), ("'src/routes/items.ts'", "typescript"), ("'src/load.ts'", "typescript"), ("'src/server.ts'", "typescript"))))(lambda f: f.files.select("service", "file", "language"))
_units = lambda cls, names: [f"{cls} || '.{x}' AS id" for x in names]
fact_query("ext_01_csharp_units", *_units("'Orders' || n || 'Controller'", ("<init>", "Create", "Get", "Gone")), *_units("'Order' || n || 'Service'", ("<init>", "Place", "Tell", "Find")))(lambda f: f.units.filter("language = 'csharp'").select("service", "id"))
fact_query("ext_02_java_units", *_units("'StockController'", ("<init>", "get", "on", "log")))(lambda f: f.units.filter("language = 'java'").select("service", "id"))
fact_query("ext_03_script_units", "'src/load.ts:load' AS id")(lambda f: f.units.filter("language = 'typescript' and kind = 'function'").select("service", "id"))
fact_query("ext_05_invocations", "'Place' AS method, 1::BIGINT AS k", "'Find', 2::BIGINT", "'PostAsJsonAsync', 1::BIGINT", "'Tell', 1::BIGINT", "'ProduceAsync', 1::BIGINT")(lambda f: f.calls.filter("language = 'csharp' and not new").groupBy("service", "method").agg(F.count("*").alias("k")))
fact_query("ext_06_nested_units", *("1 AS one",) * 3)(lambda f: f.units.filter("kind = 'anonymous'").select("service", F.lit(1).alias("one")))
fact_query("plg_01_constants", "'Created' AS name, 'order' || n || '.created' AS value", "'Topics.Created', 'order' || n || '.created'")(lambda f: extract.constants(f).filter("name like '%Created'"))
fact_query("plg_06_controllers", "'POST' AS method, '/api/Orders' || n AS path, 'Orders' || n || 'Controller.Create' AS handler", "'GET', '/api/Orders' || n || '/{id}', 'Orders' || n || 'Controller.Get'", "'DELETE', '/v2/gone/{id}', 'Orders' || n || 'Controller.Gone'", "'GET', '/stock' || n || '/{sku}', 'StockController.get'")(lambda f: extract.controllers(f).select("service", "method", "path", "handler"))
fact_query("plg_09_script_routes", "'GET' AS method, '/v' || n || '/items/{id}' AS path", "'POST', '/v' || n || '/items'", "'GET', '/healthz'")(lambda f: extract.script_routes(f).select("service", "method", "path"))
fact_query("plg_13_http_clients", "'POST' AS method, '/pay/{Id}' AS url, NULL::VARCHAR AS targetHint, 'Order' || n || 'Service.Place' AS fromHandler", "'GET', 'https://wms' || n || '.example.com/v2/{sku}', 'wms' || n || '.example.com', 'StockController.get'", "'PUT', '{BASE}/items/{id}', 'ITEMS_' || n || '_URL', 'src/load.ts:load'")(lambda f: extract.outbound(f).select("service", "method", "url", "targetHint", "fromHandler"))
fact_query("plg_19_consumers", "'kafka' AS broker, 'order' || n || '.created' AS topic, 'stock' AS \"group\", 'StockController.on' AS handler")(lambda f: extract.messages(f)[0].select("service", "broker", "topic", "group", "handler"))
fact_query("plg_19_publishes", "'kafka' AS broker, 'order' || n || '.created' AS topic, 'Order' || n || 'Service.Tell' AS handler")(lambda f: extract.messages(f)[1].select("service", "broker", "topic", "handler"))
fact_query("cgr_02_call_graph", *(f"'Order{a}' AS caller, 'Order{b}' AS callee".replace("#", "' || n || '") for a, b in (("s#Controller.Create", "#Service.Place"), ("s#Controller.Get", "#Service.Find"), ("#Service.Place", "#Service.Tell"), ("#Service.Place", "#Service.Find"))), "'StockController.on', 'StockController.log'")(lambda f: extract.call_graph(f).filter("caller not like 'src/%'"))
fact_query("asm_02_handlers", *(f"{i} AS id, '{k}' AS kind" for i, k in (("'Orders' || n || 'Controller.Create'", "http"), ("'Orders' || n || 'Controller.Get'", "http"), ("'Orders' || n || 'Controller.Gone'", "http"), ("'Order' || n || 'Service.Place'", "service"), ("'Order' || n || 'Service.Tell'", "service"), ("'StockController.get'", "http"), ("'StockController.on'", "message"), ("'src/load.ts:load'", "service"))))(lambda f: extract.assemble(f, extract.infer_services(f)).handlers.filter("id not like '%anon@%'").select("service", "id", "kind"))
fact_query("asm_06_services", "'shop-' || n AS id, 'typescript' AS language, 'unknown' AS layer")(lambda f: extract.infer_services(f).select(F.col("name").alias("service"), "id", "language", "layer"))


# --- documents and dangling items of the estate

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate's manifests, written as documents and parsed again, one row per part."""
    e = est.estate(spark, sf_dir)
    parsed = src.parsed_documents(cut(sinks.manifest_documents(e)))
    return parsed.join(cut(e.services.select(F.col("id").alias("__id"), "m_ord")), F.col("service.id") == F.col("__id"), "left").drop("__id")


@query("src_01_manifests", tw.over_estate("SELECT m_ord, CAST(row_number() OVER (PARTITION BY service ORDER BY i_ord) - 1 AS INT) AS i_ord, service, id, method, url, targetHint, fromHandler FROM calls"))
def src_01(spark, sf_dir):
    return src.estate(documents(spark, sf_dir)).calls.select("m_ord", "i_ord", "service", "id", "method", "url", "targetHint", "fromHandler")


@query("snk_02_manifest_sizes", tw.over_estate("SELECT id, (SELECT count(*) FROM handlers h WHERE h.service = s.id) AS handlers, (SELECT count(*) FROM declared d WHERE d.service = s.id) AS declared FROM services s"))
def snk_02(spark, sf_dir):
    parts = documents(spark, sf_dir).select(F.col("service.id").alias("id"), F.size("handlers").alias("handlers"), F.size("declaredDependencies").alias("declared"))
    return parts.groupBy("id").agg(F.sum("handlers").alias("handlers"), F.sum("declared").alias("declared"))


_lost = " UNION ALL ".join(f"SELECT service, '{n} item ' || id || ' refers to missing handler ' || {h} AS message FROM {fault_sql(n)} x WHERE NOT EXISTS (SELECT 1 FROM {fault_sql('handlers')} y WHERE y.service = x.service AND y.id = x.{h})" for n, h in (("endpoints", "handler"), ("consumers", "handler"), ("calls", "fromHandler"), ("publishes", "fromHandler")))


@query("asm_05_dangling", _lost)
def asm_05(spark, sf_dir):
    e = est.estate(spark, sf_dir)
    broken = Estate(e.services, *(faulty(spark, sf_dir, n) for n in ("handlers", "endpoints", "consumers", "calls", "publishes")), e.declared, e.issues.limit(0))
    return extract.drop_dangling(broken).issues.select("service", "message")


@query("flw_06_consumer_roots", tw.over_estate("SELECT service, 'consume:' || service || ':' || id AS ref FROM consumers WHERE (broker, CASE WHEN broker = 'rabbitmq' AND exchange IS NOT NULL THEN exchange ELSE topic END) NOT IN (SELECT broker, topic FROM publishes)"))
def flw_06(spark, sf_dir):
    return flows.roots(est.graph(spark, sf_dir)).filter("kind = 'consumer'").select("service", "ref")


@query("flw_07_ui_roots", tw.over_resolved("SELECT DISTINCT service, service || '#' || fromHandler AS ref FROM resolved WHERE service IN (SELECT id FROM services WHERE layer = 'ui')"))
def flw_07(spark, sf_dir):
    return flows.roots(est.graph(spark, sf_dir)).filter("kind = 'handler'").select("service", "ref")


_WALKED = """walked(service, entry, path, sort) AS (SELECT DISTINCT service, handler, [handler], []::BIGINT[] FROM endpoints UNION ALL SELECT w.service, w.entry, list_append(w.path, h.c), list_append(w.sort, h.j) FROM walked w JOIN (SELECT service, id, unnest(calls) AS c, unnest(range(1, len(calls) + 1)) AS j FROM handlers) h ON h.service = w.service AND h.id = w.path[-1] WHERE NOT list_contains(w.path, h.c)),
met AS (SELECT service, entry, path[-1] AS handler, min(sort) AS sort FROM walked GROUP BY ALL)"""


@query("flw_02_walks", f"WITH RECURSIVE {tw.ESTATE}, {_WALKED} SELECT service, entry, CAST(row_number() OVER (PARTITION BY service, entry ORDER BY sort) - 1 AS INT) AS pos, handler FROM met")
def flw_02(spark, sf_dir):
    e = est.estate(spark, sf_dir)
    return flows.walks(e.handlers, e.endpoints.select("service", F.col("handler").alias("entry")))

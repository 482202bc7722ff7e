"""Sources of four languages to manifests: parsing, patterns, call graph and assembly."""

import pytest

from waymesh.operators import extract
from waymesh.operators.build import build_graph
from waymesh.plans.source_queries import SOURCES
from waymesh.sources.parsing.facts import parse_sources
from waymesh.sources.parsing.structure import Parser, place

MORE = {
    "Program.cs": 'var app = builder.Build();\nbuilder.Services.AddHttpClient<PayClient>(c => c.BaseAddress = new Uri(builder.Configuration["Pay:Url"]!));\nvar g = app.MapGroup("/customers");\ng.MapGet("/{id}", (string id, Repo repo) => { return repo.Find(id); });\napp.MapGet("/health", () => Results.Ok());\n',
    "PayClient.cs": 'public class PayClient { private readonly HttpClient _http; public PayClient(HttpClient http) { _http = http; } public async Task Go() { await _http.GetFromJsonAsync<X>("/pay"); } }',
    "Worker.cs": 'public class Worker { private const string Queue = "q.pay"; void Run() { channel.QueueBind(queue: Queue, exchange: "pay", routingKey: "k"); consumer.Received += async (_, ea) => { await Done(ea); }; channel.BasicConsume(queue: Queue, autoAck: true, consumer: consumer); } async Task Done(Args a) { channel.BasicPublish(exchange: "out", routingKey: "done", body: a); } }',
    "Stripe.java": '@FeignClient(name = "stripe", url = "https://api.stripe.com")\npublic interface Stripe { @PostMapping("/v1/pay/{id}") Map<String, Object> pay(@RequestBody Map<String, Object> body); }',
    "orders.ts": "import axios from 'axios';\nconst api = axios.create({ baseURL: process.env.CAP_URL });\n@Controller('v1/orders')\nexport class Orders {\n  constructor(private readonly svc: Svc) {}\n  @Get(':id')\n  async one(@Param('id') id: string) { return this.svc.load(id); }\n}\nexport class Svc {\n  async load(id: string) { return api.get(`/api/${id}`); }\n}\n",
    "worker.ts": "import { T } from './topics';\nconst consumer = kafka.consumer({ groupId: 'g1' });\nexport async function start() {\n  await consumer.subscribe({ topics: [T, 'b'] });\n  await consumer.run({ eachMessage: async ({ topic }) => { await producer.send({ topic: 'out', messages: [] }); } });\n}\n",
    "topics.ts": "export const T = 'a.b';\n",
    "broken.ts": "class {{{ ((( `",
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("shop-0", n.replace("$N", "0"), t.replace("$N", "0")) for n, t in SOURCES.items()] + [("more-api", n, t) for n, t in MORE.items()] + [("more-api", "large.ts", None)]
    return parse_sources(spark.createDataFrame(rows, "service string, file string, text string").repartition(3))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_patterns(facts):
    assert rows(extract.minimal_apis(facts), "method", "path") == {("GET", "/customers/{id}"), ("GET", "/health")}
    assert ("more-api", "GET", "/v1/orders/{id}", "Orders.one") in rows(extract.controllers(facts), "service", "method", "path", "handler")
    calls = rows(extract.outbound(facts).filter("service = 'more-api'"), "method", "url", "targetHint", "fromHandler")
    assert calls == {("GET", "/pay", "Pay:Url", "PayClient.Go"), ("POST", "https://api.stripe.com/v1/pay/{id}", "api.stripe.com", "Stripe.pay"), ("GET", "/api/{id}", "CAP_URL", "Svc.load")}
    consumers, publishes = extract.messages(facts)
    assert rows(consumers.filter("service = 'more-api'"), "broker", "topic", "exchange", "routingKey", "group") == {("kafka", "a.b", None, None, "g1"), ("kafka", "b", None, None, "g1"), ("rabbitmq", "q.pay", "pay", "k", None)}
    assert rows(publishes.filter("service = 'more-api'"), "broker", "topic", "routingKey") == {("kafka", "out", None), ("rabbitmq", "out", "done")}


def test_assembly(facts):
    e = extract.assemble(facts, extract.infer_services(facts))
    kinds = {r.id: r.kind for r in e.handlers.filter("service = 'more-api'").collect()}
    assert kinds["Orders.one"] == "http" and kinds["Svc.load"] == "service" and kinds["PayClient.Go"] == "client"
    assert {r.id: r.calls for r in e.handlers.collect()}["Orders.one"] == ["Svc.load"]
    assert ("more-api", "file-skipped") in rows(e.issues, "service", "code")
    g = build_graph(e)
    assert rows(g.edges.filter("kind = 'http'"), "target") == {("external:api.stripe.com",), ("external:wms0.example.com",)}


def test_values():
    assert [place(x) for x in ("this.a._b", "x", 'cfg["K"]', "f(1)")] == ["{b}", "{x}", "{K}", "{expr}"]
    p = Parser("a.java", 'class A { String f(Map<String, Object> body, int x) { return a.b("x" + (y + 1) + "/z", new B("k")); } }').parse()
    assert p.units[0].params == [("body", "Map<String, Object>"), ("x", "int")]
    assert [(c["method"], [a["text"] for a in c["args"]]) for c in p.units[0].calls] == [("b", ["x{expr}/z", "{expr}"]), ("B", ["k"])]


PATTERNS = {
    "Pay.cs": 'public interface IPay { [Get("/pay/{id}")] Task<X> Fetch(string id); } public class Setup { void Go() { services.AddRefitClient<IPay>().ConfigureHttpClient(c => c.BaseAddress = new Uri(cfg["Pay:Url"])); app.MapMethods("/m", new[] { "PATCH" }, () => 1); app.MapGet(Compute(), () => 2); } }',
    "Moved.cs": 'public class OnMoved : IConsumer<BoxMoved> { private readonly HttpClient _http; private readonly IPublishEndpoint _publishEndpoint; public async Task Consume(ConsumeContext<BoxMoved> c) { await _publishEndpoint.Publish(new BoxSeen()); var r = new HttpRequestMessage(HttpMethod.Put, $"/boxes/{c.Id}"); await _http.SendAsync(r); } }',
    "Base.cs": "public class Root { public void Save() { } } public class Leaf : Root { public void Run() { Save(); } }",
    "Stock.java": '@Path("/stock") public class Stock { private final WebClient web; Stock(WebClient web) { this.web = web; } @GET @Path("/{id}") public Item one(String id) { return web.patch().uri("/items/{id}", id).retrieve(); } @RabbitListener(bindings = @QueueBinding(value = @Queue("q.stock"), exchange = @Exchange("ex.stock"), key = "moved")) void heard(Item i) { } }',
    "lib/pipe.ts": 'import { go } from "../util/go";\nchannel.sendToQueue("q.out", 1);\nexport function start() { go(); }\n',
    "util/go.ts": "export function go() { return 1; }\n",
}


def test_more_patterns(spark):
    f = parse_sources(spark.createDataFrame([("yard", n, t) for n, t in PATTERNS.items()], "service string, file string, text string"))
    assert rows(extract.minimal_apis(f), "method", "path") == {("PATCH", "/m")}
    assert rows(extract.dynamic_routes(f), "code") == {("dynamic-route",)}
    assert rows(extract.controllers(f), "method", "path", "handler") == {("GET", "/stock/{id}", "Stock.one")}
    assert rows(extract.outbound(f), "method", "url", "targetHint", "fromHandler") >= {("GET", "/pay/{id}", "Pay:Url", "IPay.Fetch"), ("PATCH", "/items/{id}", None, "Stock.one")}
    assert ("PUT", "/boxes/{Id}", "OnMoved.Consume") in rows(extract.outbound(f), "method", "url", "fromHandler")
    consumers, publishes = extract.messages(f)
    assert rows(consumers, "broker", "topic", "exchange", "routingKey", "handler") == {("unknown", "BoxMoved", None, None, "OnMoved.Consume"), ("rabbitmq", "q.stock", "ex.stock", "moved", "Stock.heard")}
    assert rows(publishes, "broker", "topic") == {("unknown", "BoxSeen"), ("rabbitmq", "q.out")}
    graph = rows(extract.call_graph(f), "caller", "callee")
    assert ("Leaf.Run", "Root.Save") in graph and ("lib/pipe.ts:start", "util/go.ts:go") in graph
    targets = spark.createDataFrame([("yard", "PAY:URL", "payments")], "service string, key string, target string")
    assert ("payments",) in rows(extract.with_targets(extract.refit(f), targets), "targetService")


SCOPES = {
    "Calls.cs": 'public class Calls { private readonly HttpClient _http; async Task A() { var url = $"/a/{x.Id}"; await _http.GetAsync(url); } async Task B() { var url = "/b"; await _http.GetAsync(url); } async Task C(string url) { await _http.PutAsync(url, 1); } async Task D() { string url = Make(); var go = () => { var inner = "/d"; }; await _http.DeleteAsync(url); } }',
    "two.ts": "export async function one() { const path = `/one/${a.b.id}`; return fetch(path); }\nexport async function two() { const path = '/two'; return fetch(path, { method: 'POST' }); }\nexport async function three(path: string) { return fetch(path, { method: 'PUT' }); }\n",
}


def test_variables_of_one_name_in_several_units(spark):
    f = parse_sources(spark.createDataFrame([("s", n, t) for n, t in SCOPES.items()], "service string, file string, text string"))
    assert rows(extract.outbound(f), "fromHandler", "method", "url") == {
        ("Calls.A", "GET", "/a/{Id}"), ("Calls.B", "GET", "/b"), ("Calls.C", "PUT", "{url}"), ("Calls.D", "DELETE", "{url}"),
        ("two.ts:one", "GET", "/one/{id}"), ("two.ts:two", "POST", "/two"), ("two.ts:three", "PUT", "{path}"),
    }
    assert ("Calls.D", "inner", "/d") in rows(extract.local_urls(f), "unit", "name", "url")


def test_bases_in_their_order(spark):
    """The first base and all its bases come before the second, whatever the depth; circles end."""
    text = """public class A : Deep { } public class Deep { public void Save() { } public void Load() { } } public class B { public void Save() { } public void Gone() { } }
    public class C : A, B { public void Run() { Save(); Load(); Gone(); } } public class D : B, A { public void Run() { Save(); } }
    public class X : Y { public void Run() { Save(); Other(); } } public class Y : X, B { void Other() { } }"""
    f = parse_sources(spark.createDataFrame([("s", "All.cs", text)], "service string, file string, text string"))
    graph = rows(extract.call_graph(f), "caller", "callee")
    assert graph == {("C.Run", "Deep.Save"), ("C.Run", "Deep.Load"), ("C.Run", "B.Gone"), ("D.Run", "B.Save"), ("X.Run", "B.Save"), ("X.Run", "Y.Other")}
    order = {r.owner: r.key for r in extract.linearised(f.types).filter("type = 'C'").collect()}
    assert sorted(order, key=order.get) == ["C", "A", "Deep", "B"]


KINDS = {
    "PayGateway.cs": 'public class PayGateway { private readonly HttpClient _http; public async Task Go() { await _http.GetAsync("/p"); } }',
    "Helper.cs": 'public class Helper { private readonly HttpClient _http; public async Task Go() { await _http.GetAsync("/h"); } } public class Start { void S() { services.AddHttpClient<Typed>(); } } public class Typed { private readonly HttpClient _http; public async Task Go() { await _http.GetAsync("/t"); } }',
    "src/ordersApi.ts": "export async function load() { return fetch('/o'); }\nexport class Loader { async all() { return fetch('/all'); } }\n[1].map(async () => { await fetch('/anon'); });\n",
    "src/view.tsx": "export async function View() { return fetch('/v'); }\n",
    "src/batch.ts": "const consumer = kafka.consumer({ groupId: 'g' });\nexport async function start() {\n  await consumer.subscribe({ topic: 'in' });\n  await consumer.run({ eachBatch: async ({ batch }) => { await producer.send({ topic: 'out', messages: [] }); } });\n}\n",
}


def test_kinds_of_handlers(spark):
    f = parse_sources(spark.createDataFrame([("s", n, t) for n, t in KINDS.items()], "service string, file string, text string"))
    e = extract.assemble(f, extract.infer_services(f))
    kinds = {r.id: r.kind for r in e.handlers.collect()}
    named = {k: v for k, v in kinds.items() if "anon@" not in k}
    assert named == {"PayGateway.Go": "client", "Helper.Go": "service", "Typed.Go": "client", "src/ordersApi.ts:load": "client", "Loader.all": "service", "src/view.tsx:View": "service"} | {k: "other" for k in named if k.endswith("<module>")}
    lambdas = {k: v for k, v in kinds.items() if "anon@" in k}
    assert sorted(lambdas.values()) == ["message", "other"]
    consumers, publishes = extract.messages(f)
    assert rows(consumers, "topic", "group", "handler") == {("in", "g", next(k for k, v in lambdas.items() if v == "message"))} and rows(publishes, "topic") == {("out",)}

"""Trees of sources, settings of repositories, and extractors that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from waymesh.operators import extract
from waymesh.sources import trees
from waymesh.sources.parsing.facts import parse_sources

FILES = {
    "shop/.git/config": "x", "shop/src/a.ts": "export async function go() { return fetch('/pay'); }", "shop/src/deep/er/b.TS": "const x = 1;", "shop/node_modules/lib/c.ts": "no", "shop/src/dist/d.js": "no", "shop/readme.md": "no", "shop/big.ts": "y" * 500,
    "shop/waymesh.yaml": "service: {id: shop-one, layer: ui, owner: team, tags: [a, b]}\ntargets: {PAY_URL: payments, 7: seven}\ndeclaredDependencies: [{service: ledger, reason: nightly}, 3]\nplugins: {disable: [script-routes]}\n",
    "shop/waymesh.json": json.dumps({"service": {"id": "not-this"}}),
    "group/pay/waymesh.yaml": "a: [broken", "group/pay/waymesh.json": json.dumps({"service": {"name": "Pay", "layer": "odd"}}), "group/pay/Api.cs": 'app.MapGet("/pay", () => 1);',
    "group/plain/App.java": "class App { }", ".hidden/repo/.git/x": "x", "group/pay/inner/.git/x": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for name, text in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return top


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_only_wanted_files_are_read(spark, root):
    if os.geteuid():
        os.chmod(root / "shop/node_modules", 0)  # listing it would fail
    got = {r.file: (r.service, r.text, r.issue) for r in trees.read_sources(spark, [str(root / "shop")], max_chars=100).collect()}
    assert set(got) == {"src/a.ts", "src/deep/er/b.TS", "big.ts"}
    assert got["src/a.ts"] == ("shop", FILES["shop/src/a.ts"], None)
    assert got["big.ts"] == ("shop", None, "file-skipped: too large")
    listed = spark.createDataFrame([(trees.qualified(spark, str(root / "shop")), "gone.ts", 3, None), (trees.qualified(spark, str(root / "shop")), "src/a.ts", 9, None)], "root string, file string, size long, issue string")
    assert [(r.file, r.text is None, (r.issue or "").split(":")[0]) for r in trees.texts(listed).orderBy("file").collect()] == [("gone.ts", True, "read-failed"), ("src/a.ts", False, "")]
    none = trees.read_sources(spark, str(root / "nowhere")).collect()
    assert [(r.text, r.issue.split(":")[0]) for r in none] == [(None, "read-failed")]
    f = parse_sources(trees.read_sources(spark, str(root / "shop"), max_chars=100).unionByName(trees.texts(listed.filter("file = 'gone.ts'")).withColumn("service", F.lit("shop"))))
    e = extract.assemble(f, extract.infer_services(f))
    assert {("warn", "read-failed"), ("info", "file-skipped")} <= rows(e.issues, "level", "code")


def test_repositories(spark, root):
    at = lambda df: {r.folder.split(root.name + "/")[-1] for r in df.collect()}
    assert at(trees.find_repositories(spark, [str(root)])) == {"shop", "group/pay"}
    assert at(trees.find_repositories(spark, [str(root)], depth=1)) == {"shop"}
    assert at(trees.find_repositories(spark, [str(root), str(root / "group")], depth=1, configured_only=True)) == {"shop", "group/pay"}


def test_settings(spark, root):
    both = [str(root / "shop"), str(root / "group/pay")]
    files = trees.read_sources(spark, both, suffixes=[*trees.SOURCE_SUFFIXES, ".yaml", ".json"])
    settings = trees.read_settings(files)
    got = {r.service: r for r in settings.collect()}
    assert (got["shop"].id, got["shop"].targets, got["shop"].tags) == ("shop-one", {"PAY_URL": "payments", "7": "seven"}, ["a", "b"])
    assert (got["pay"].id, got["pay"].name) == (None, "Pay")  # YAML that can't be read gives way to JSON
    by_id = extract.identified(settings, settings)
    f = parse_sources(extract.identified(files, settings).filter("file rlike '[.](ts|cs)$'"))
    services = extract.infer_services(f, by_id)
    assert rows(services, "id", "name", "layer", "owner") == {("shop-one", "shop-one", "ui", "team"), ("pay", "Pay", "unknown", None)}
    e = extract.assemble(f, services, settings=by_id)
    assert rows(e.declared, "service", "dep_service", "reason") == {("shop-one", "ledger", "nightly")}
    assert rows(e.endpoints, "service", "path") == {("pay", "/pay")}


def test_one_failing_extractor(spark):
    def broken(f):
        raise ValueError("no such thing\nmore")

    def late(f):
        return f.files.selectExpr("service", "raise_error('at run time') as method")

    text = "import express from 'express';\nconst app = express();\napp.get('/x', (q, r) => r.end());\nexport async function go() { return fetch('/y'); }\n"
    f = parse_sources(spark.createDataFrame([("s", "a.ts", text), ("t", "b.ts", text)], "service string, file string, text string"))
    more = {k: dict(v) for k, v in extract.EXTRACTORS.items()}
    more["endpoints"] |= {"own": broken, "slow": late}
    e = extract.assemble(f, extract.infer_services(f), extractors=more)
    assert rows(e.endpoints, "service", "path") == {("s", "/x"), ("t", "/x")} and rows(e.calls, "service", "url") == {("s", "/y"), ("t", "/y")}
    issues = rows(e.issues.filter("code = 'plugin-failed'"), "service", "level", "message")
    assert len(issues) == 4 and ("s", "error", "own: ValueError: no such thing") in issues and any("slow:" in m for *_, m in issues)
    off = spark.createDataFrame([("s", "script-routes")], "service string, name string")
    found, failed = extract.extracted(f, disabled=off)
    assert rows(found["endpoints"], "service") == {("t",)} and not failed

"""Manifests as documents in parts: each part is a small manifest, and together they hold every item in its place."""

import json

import pytest
from pyspark.sql import functions as F

from waymesh.operators.estate import estate_of
from waymesh.plans.queries import QUERIES
from waymesh.plans import source_queries  # noqa: F401  (registers its queries)
from waymesh.plans.session import cut
from waymesh.sources import manifests as src
from waymesh.sources import sinks

N = 2_500


@pytest.fixture(scope="module")
def tables(spark):
    services = spark.createDataFrame([(0, 0, "big", 'Big "one"'), (1, 0, "small", "Small"), (2, 0, "bare", None)], "m_ord int, i_ord int, id string, name string")
    # places with a gap and a double one; items of a service that isn't there
    calls = spark.range(N).select(F.lit(0).alias("m_ord"), (F.col("id") + F.when(F.col("id") >= 2_000, 7_777).otherwise(0)).cast("int").alias("i_ord"), F.lit("big").alias("service"), F.concat(F.lit('c"],'), F.col("id").cast("string")).alias("id"), F.lit("/a\n{b}").alias("url"))
    calls = calls.union(spark.createDataFrame([(0, 5, "big", "z", "/q"), (1, 3, "small", "s1", "/x"), (1, 1, "small", "s0", "/y"), (9, 0, "gone", "g", "/z")], calls.schema))
    declared = spark.createDataFrame([(1, 1, "small", "big"), (1, 0, "small", "bare")], "m_ord int, i_ord int, service string, dep_service string")
    return estate_of(spark, services=services, calls=calls.repartition(5), declared=declared)


@pytest.fixture(scope="module")
def docs(tables):
    return cut(sinks.manifest_documents(tables, 'to"day'))


def test_no_document_holds_more_than_its_range(docs):
    parts = {}
    for r in docs.collect():
        parts.setdefault(r.service, {})[r.part] = json.loads(r.json)
    assert {s: sorted(p) for s, p in parts.items()} == {"big": [0, 1, 9, 10], "small": [0], "bare": [0]}
    assert all(len(d["calls"]) <= sinks.PART + 1 for p in parts.values() for d in p.values())
    assert parts["big"][0]["service"] == {"id": "big", "name": 'Big "one"'} and parts["big"][9]["service"] == {"id": "big"}
    whole = [c["id"] for _, d in sorted(parts["big"].items()) for c in d["calls"]]
    assert whole == [f'c"],{i}' for i in range(6)] + ["z"] + [f'c"],{i}' for i in range(6, N)]
    small = parts["small"][0]
    assert [c["id"] for c in small["calls"]] == ["s0", "s1"] and small["declaredDependencies"] == [{"service": "bare"}, {"service": "big"}]
    assert list(small) == ["schemaVersion", "generatedAt", "service", *sinks.ARRAYS.values()] and small["handlers"] == [] and small["generatedAt"] == 'to"day'


def test_written_manifests_are_parts_in_order(tables, tmp_path):
    folder = tmp_path / "out"
    sinks.write_manifests(tables, str(folder))
    lines = [json.loads(x) for p in sorted((folder / "service=big").glob("part-*")) for x in p.read_text().splitlines()]
    assert [c["id"] for d in lines for c in d["calls"]] == [f'c"],{i}' for i in range(6)] + ["z"] + [f'c"],{i}' for i in range(6, N)]


def test_sizes_are_summed_over_parts(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 3)
    got = QUERIES["snk_02_manifest_sizes"](spark, "/root/testdata/sf0.001").collect()
    e = source_queries.est.estate(spark, "/root/testdata/sf0.001")
    count = lambda df: dict(map(tuple, df.groupBy("service").count().collect()))
    handlers, declared = count(e.handlers), count(e.declared)
    assert {r.id: (r.handlers, r.declared) for r in got} == {r.id: (handlers.get(r.id, 0), declared.get(r.id, 0)) for r in e.services.collect()}
    assert len(got) == e.services.count()

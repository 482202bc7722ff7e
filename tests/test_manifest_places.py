"""Items of manifests in parts keep their places in the whole manifest, and documents are parsed once."""

from waymesh.plans import estate as est
from waymesh.plans import source_queries  # noqa: F401  (registers its queries)
from waymesh.plans.queries import QUERIES
from waymesh.sources import manifests as src
from waymesh.sources import sinks

SF = "/root/testdata/sf0.001"


def test_places_run_on_over_parts(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 7)
    back = src.estate(source_queries.documents(spark, SF))
    made = est.estate(spark, SF)
    for name, columns in (("calls", ("id", "url", "targetHint")), ("handlers", ("id", "hash")), ("publishes", ("id", "topic")), ("declared", ("dep_service",))):
        want = {}
        for r in getattr(made, name).collect():
            want.setdefault(r.service, []).append((r.i_ord, *(r[c] for c in columns)))
        want = {(s, i, *row[1:]) for s, rows in want.items() for i, row in enumerate(sorted(rows, key=lambda x: x[0]))}
        rows = getattr(back, name).collect()
        assert {(r.service, r.i_ord, *(r[c] for c in columns)) for r in rows} == want and len(rows) == len(want)
    assert sorted(r.id for r in back.services.collect()) == sorted(r.id for r in made.services.collect())


def test_parts_are_parsed_once(spark):
    df = QUERIES["src_01_manifests"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan()
    assert "size(from_json" not in plan.toString() and "l_orderkey" not in plan.toString()
    assert df.count() == est.estate(spark, SF).calls.count()

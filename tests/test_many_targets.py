"""Targets of settings over many texts: patterns that begin alike, letters beyond ASCII, and calls that are computed once."""

from waymesh.functions import text as fn
from waymesh.operators import resolve
from waymesh.operators.estate import Config
from waymesh.plans.queries import QUERIES


def test_patterns_that_begin_alike(spark):
    # each text holds the literals of one or two of 300 patterns, which all begin with the same letters
    sought = [(i, f"(?i)brand-{i}\\D", f"brand-{i}") for i in range(300)]
    texts = [f"/Parts/BRAND-{i}/{{id}}" for i in range(10, 300)] + ["", "br", "bra", "key", "KEY", "keys"]
    got = resolve.tried_targets(spark.createDataFrame([(t,) for t in texts], "text string"), [(900, "key"), (901, "bra")], sought).collect()
    want = [(t, at, regex) for t in texts for at, regex, literal in sought if literal in t.lower()]
    want += [("bra", 901, None), ("key", 900, None), ("KEY", 900, None)]
    assert sorted(map(str, got)) == sorted(f"Row(text={t!r}, t_ord={at}, regex={regex!r})" for t, at, regex in want)
    assert len(got) < 4 * len(texts)


def test_letters_whose_lower_case_depends_on_their_place(spark):
    calls = spark.createDataFrame([(1, "xaΣΣb", None, None), (2, None, "aΣΣ", None), (3, None, None, "aσσ")], "n int, hint string, host string, url string")
    assert {r.n: r.value for r in resolve.with_config_value(calls, Config({"/aΣΣ/": "greek"})).collect()} == {1: "greek", 2: "greek", 3: None}


def test_calls_are_computed_once(spark):
    plan = QUERIES["res_b_many_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_host_of_relative_calls(spark):
    urls = ["https://A.example:80/x", " {base}HTTP://b/y?z", "/x://y", "x://y", "http:/x", "https://{h}.c/x", "", None]
    got = [r.host for r in spark.createDataFrame([(u,) for u in urls], "url string").select(fn.call_url("url")["host"].alias("host")).collect()]
    assert got == ["a.example", "b", None, None, None, None, None, None]

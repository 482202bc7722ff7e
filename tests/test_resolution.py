"""Targets of settings as a table, the best services of a path, and chunks of very large services."""

import random
import re

import pytest

from waymesh.operators import enrich, resolve
from waymesh.operators.estate import Config


def test_required_literal():
    told = {r"^CFG\.regex\.1": "cfg.regex.1", "abc|def": "", "(abc|def)ghi": "ghi", "ab?cd": "cd", "ab+cd": "ab", "[abc]xyz": "xyz", r"a\d+bcd": "bcd", "x{2}yz": "yz", ".*": "", "(never)?seen": "seen", r"\.net$": ".net", "[]x]yes": "yes"}
    for pattern, literal in told.items():
        assert resolve.required_literal(pattern) == literal
        if literal and pattern != "[]x]yes":
            for text in ("cfg.regex.1", "abcghi", "defghi", "acd", "abbcd", "axyz", "a12bcd", "xxyz", "neverseen", "seen", "w.net"):
                assert not re.search(pattern, text, re.I) or literal in text


def first_target(config, *probes):
    for key, value in config.targets.items():
        for p in probes:
            if p and (re.search(key[1:-1], p, re.I) if len(key) > 2 and key[0] == key[-1] == "/" else p.lower() == key.lower()):
                return value
    return None


def test_first_target_in_key_order(spark):
    rnd = random.Random(1)
    keys = [f"Key_{i}" for i in range(9_000)] + [f"/host-{i}\\./" for i in range(900)] + ["/^x$/", "/(a|b)zz/", "//", "/./" if False else "/q.|w/", "api.example.com"]
    rnd.shuffle(keys)
    config = Config({k: f"v{i}" for i, k in enumerate(keys)})
    texts = ["key_5", "KEY_8999", "https://HOST-7.example/x", "host-77.", "host-8", "x", "xx", "azz", "q1", "w", "//", "api.example.com", "", None, "none of these"]
    rows = [(i, rnd.choice(texts), rnd.choice(texts), rnd.choice(texts)) for i in range(120)]
    calls = spark.createDataFrame(rows, "n int, hint string, host string, url string")
    got = {r.n: r.value for r in resolve.with_config_value(calls, config).collect()}
    assert got == {n: first_target(config, a, b, c) for n, a, b, c in rows}
    assert resolve.with_config_value(calls, Config({})).filter("value is null").count() == len(rows)


def test_best_services_of_a_path(spark):
    rnd = random.Random(2)
    services = [(f"s{i}", i) for i in range(12)]
    rows = [(m, p, s, (f"e{p}", 0, rnd.randrange(3))) for m in ("GET", None) for p in ("/a", "/b", "/c", "/d") for s, _ in services if rnd.random() < {"/a": 0.9, "/b": 0.3, "/c": 0.1, "/d": 0.5}[p]]
    rows += [("GET", "/one", "s3", ("e", 0, 1)), ("GET", "/two", "s3", ("e", 0, 1)), ("GET", "/two", "s5", ("e", 0, 1))]
    candidates = spark.createDataFrame(rows, f"method string, path string, target string, ep {resolve.EP}")
    table = spark.createDataFrame(services, "id string, m_ord int")
    probes = [(s, m, p) for s, _ in services for m in ("GET", None) for p in ("/a", "/b", "/c", "/d", "/one", "/two", "/none")]
    found = resolve.ranked_paths(spark.createDataFrame(probes, "service string, method string, path string"), candidates, table).collect()
    got = {(r.service, r.method, r.path): (r.n_found, [x.target for x in r.found]) for r in found}
    order = dict(services)
    for s, m, p in probes:
        others = sorted((-ep[2], order[t], t) for a, b, t, ep in rows if (a, b) == (m, p) and t != s)
        assert got.get((s, m, p)) == ((len(others), [t for *_, t in others[:2]]) if others else None)
    names = {(r.method, r.path): r.names for r in resolve.named_paths(spark.createDataFrame(probes[:5], "service string, method string, path string"), candidates, table).collect()}
    assert names["GET", "/a"] == [t for *_, t in sorted((-ep[2], order[t], t) for a, b, t, ep in rows if (a, b) == ("GET", "/a"))]


@pytest.mark.parametrize("limit", [1, 50, 1000])
def test_chunks_of_large_services(spark, limit):
    rnd = random.Random(limit)
    rows = [("big", i, rnd.choice([0, 1, 7, 49, 50, 51, 120, None])) for i in range(260)] + [("one", 1, 5), (None, 1, 30), (None, 2, 30)] + [("small", i, rnd.randrange(40)) for i in range(20)]
    rows += [("big", 7, 3), ("big", 7, 3), ("big", 9, 0)]  # the same place again
    df = spark.createDataFrame(rows, "service string, ord int, chars int").repartition(5)
    want, last = {}, (0,)
    for g, o, n in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2] or 0)):
        if (g,) != last:
            last, chunk, size, held = (g,), 0, 0, False
        if held and size + (n or 0) > limit:
            chunk, size = chunk + 1, 0
        size, held = size + (n or 0), True
        want[g, o] = chunk
    for most in (enrich.FOLD_ROWS, 15):
        got = enrich.packed(df, limit, fold_rows=most).collect()
        assert len(got) == len(rows) and {(r.service, r.ord): r.chunk for r in got} == want

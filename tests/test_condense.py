"""Condensed reachability against brute force."""

import random

import pytest

from waymesh.operators import condense


def brute_reach(edges, nodes):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for y in to.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[n] = seen
    return out


def graphs():
    rnd = random.Random(4)
    name = lambda i: f"s{i // 30}#h{i:03d}"
    yield [(name(rnd.randrange(90)), name(rnd.randrange(90))) for _ in range(110)], [name(200), name(3)]  # cycles of all sizes, and nodes apart
    chain = [(name(i), name(i + 1)) for i in range(25)] + [(name(9), name(5)), (name(20), name(18)), (name(12), name(12))]
    yield chain + chain[:4] + [(name(80), name(i)) for i in range(70, 90)] + [(name(i), name(81)) for i in range(70, 90)], []
    yield [(None, "a"), ("a", None)], ["a", "b", None]


@pytest.mark.parametrize("edges, more", list(graphs()), ids=["random", "chains", "none"])
def test_condensed(spark, edges, more):
    e = spark.createDataFrame(edges, "src string, dst string")
    c = condense.condensed(e, spark.createDataFrame([(m,) for m in more], "node string"))
    plain = [(a, b) for a, b in edges if a and b]
    nodes = {x for p in plain for x in p} | {m for m in more if m}
    want = brute_reach(plain, nodes)
    comp = {r.node: r.comp for r in c.nodes.collect()}
    assert set(comp) == nodes
    for a in nodes:
        for b in nodes:
            assert (comp[a] == comp[b]) == (a in want[b] and b in want[a])
    sets = c.reach()
    sizes = {r.comp: r.n for r in c.sizes(sets).collect()}
    assert all(sizes[comp[n]] == len(want[n]) for n in nodes)
    asked = sorted(nodes)[::3]
    got = c.pairs(spark.createDataFrame([(n,) for n in asked], "seed string"), sets).collect()
    assert sorted(map(tuple, got)) == sorted((n, y) for n in asked for y in want[n])
    rnd = random.Random(5)
    weights = [(n, rnd.choice("xy"), rnd.randrange(1, 9)) for n in sorted(nodes) for _ in range(rnd.randrange(3))]
    got = {(r.comp, r.kind): r.n for r in c.weigh(spark.createDataFrame(weights, "node string, kind string, n long").groupBy("node", "kind").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), sets, "kind").collect()}
    for n in nodes:
        for kind in "xy":
            assert got.get((comp[n], kind), 0) == sum(w for m, k, w in weights if m in want[n] and k == kind)
    items = [(n, f"t{rnd.randrange(80)}") for n in sorted(nodes) for _ in range(rnd.randrange(3))]
    got = {r.comp: r.n for r in c.union(spark.createDataFrame(items, "node string, item string")).collect()}
    assert all(got.get(comp[n], 0) == len({t for m, t in items if m in want[n]}) for n in nodes)


def test_no_edges(spark):
    e = spark.createDataFrame([], "src string, dst string")
    c = condense.condensed(e)
    assert c.nodes.count() == 0 and c.reach().count() == 0

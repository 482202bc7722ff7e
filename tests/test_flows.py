"""Shared sub-flows against a plain recursion."""

import random

import pytest

from waymesh.operators import flows


def expanded(acts, at, depth, way=()):
    """Acts under a node in order, by plain recursion."""
    for act, _, to in sorted((a[1:] for a in acts if a[0] == at), key=lambda a: a[1]):
        yield act
        if to is not None and depth and to not in (*way, at):
            yield from expanded(acts, to, depth - 1, (*way, at))


@pytest.mark.parametrize("seed,nodes,depth", [(1, 5, 4), (2, 9, 6), (3, 30, 3), (4, 4, 0)])
def test_same_steps_as_a_recursion(spark, seed, nodes, depth):
    r = random.Random(seed)
    acts = [(at, 100 * at + i, [0, i], r.choice([None, *range(nodes)])) for at in range(nodes) for i in range(r.randint(1, 3))]
    df = spark.createDataFrame(acts, "at long, act long, k array<int>, next_at long")
    entries = spark.createDataFrame([(f"f{i}", i) for i in range(nodes)] + [("again", 0)], "flow_id string, at long")
    levels, sizes = flows.shared(df, entries, depth)
    want = {i: list(expanded(acts, i, depth)) for i in range(nodes)}
    assert {x.at: x.n for x in sizes.collect()} == {i: len(w) for i, w in want.items()}
    got = {}
    for x in flows.placed(levels, entries).orderBy("flow_id", "step_no").collect():
        got.setdefault(x.flow_id, []).append((x.step_no, x.act))
    assert got == {name: list(enumerate(want[i], 2)) for name, i in [(f"f{i}", i) for i in range(nodes)] + [("again", 0)]}


def test_ways_that_cannot_matter_share(spark):
    # a ladder: two ways from each rung to the next, so ways double with every hop while sub-flows don't
    acts = [(i, 2 * i + j, [0, j], i + 1) for i in range(9) for j in range(2)]
    df = spark.createDataFrame(acts, "at long, act long, k array<int>, next_at long")
    entry = spark.createDataFrame([("f", 0)], "flow_id string, at long")
    levels, sizes = flows.shared(df, entry, 8)
    assert [x.count() for x in levels] == [2] * 9
    assert sizes.first().n == 2 ** 10 - 2 == flows.placed(levels, entry).count()


def test_only_short_cycles_are_kept(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 2), (5, 5)], "src long, dst long")
    held = {x.at: x.back for x in flows.returns(edges, 2).collect()}
    assert held == {0: {0: 0b11}, 1: {0: 0b11}, 5: {0: 1 << 5}}
    assert {x.at for x in flows.returns(edges, 3).select("at").collect()} == {0, 1, 2, 3, 4, 5}


def test_nothing_to_expand(spark):
    none = spark.createDataFrame([], "at long, act long, k array<int>, next_at long")
    entry = spark.createDataFrame([], "flow_id string, at long")
    levels, sizes = flows.shared(none, entry, 3)
    assert not sizes.count() and not flows.placed(levels, entry).count()

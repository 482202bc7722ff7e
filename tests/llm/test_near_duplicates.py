"""Near copies with a few words changed: the pipeline's stage against all pairs by brute force."""

import random

import corpus_pipeline
from waymesh.llm import jaccard


def brute(texts: dict[int, str]) -> set[int]:
    """The smallest id of each group that pairs of 5-word similarity 0.8 connect."""
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    sets, root = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return set(root.values())


def test_changed_words(spark):
    rnd = random.Random(4)
    say = lambda n: [rnd.choice("abcdefghijklm") + rnd.choice("nopqrstuvwxyz") + rnd.choice("aeiou") for _ in range(n)]
    line, texts = say(12), {}
    for k in range(40):
        base = say(rnd.choice([3, 6, 40, 90, 200])) + (line if k % 2 else [])
        for copy in range(rnd.choice([1, 2, 6])):
            words = list(base)
            for at in rnd.sample(range(len(words)), min(len(words) - 1, copy * len(words) // 90)):
                words[at] = "changed" + str(rnd.random())
            texts[k * 10 + copy] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert len(want) < len(texts)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == want


def test_components_of_a_group():
    rnd = random.Random(8)
    sets = []
    for _ in range(6):
        base = rnd.sample(range(10_000), 50)
        sets += [jaccard.np.array(sorted({*base[: rnd.randint(38, 50)], *rnd.sample(range(10_000), rnd.randint(0, 6))}), jaccard.np.uint64) for _ in range(12)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 9 * len({*sets[a].tolist()} & {*sets[b].tolist()}) >= 4 * (len(sets[a]) + len(sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert jaccard.components(list(sets)) == root


def test_large_groups_in_pieces_and_blocks(spark):
    """Bounds so small that groups go on unparted and chains are cut into blocks give the same components."""
    rnd = random.Random(5)
    say = lambda n: [rnd.choice("abcdefghijklm") + rnd.choice("nopqrstuvwxyz") + rnd.choice("aeiou") for _ in range(n)]
    texts, long = {}, say(3000)
    for k, n in enumerate((60, 60, 200, 1500)):
        base = say(n)
        for copy in range(14):
            for at in rnd.sample(range(n), n // 60):
                base[at] = "w" + str(rnd.random())
            texts[k * 100 + copy] = " ".join(base)  # each changes the one before it, so the ends of a chain are far apart
    texts |= {900 + i: " ".join(long[: 2900 + 20 * i]) for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert 4 <= len(want) < len(texts)
    for held, size in ((jaccard.HELD, jaccard.CHAIN_BYTES), (3, 6000), (5, 2000)):
        found = jaccard.near_duplicates(docs, held=held, chain_bytes=size).collect()
        assert len(found) == len(texts) and {r.component_id for r in found} == want


def test_bitmaps_fold():
    rnd = random.Random(6)
    a, b = (jaccard.np.unique(jaccard.np.array([rnd.getrandbits(64) for _ in range(n)], jaccard.np.uint64)) for n in (1000, 1100))
    wide, narrow = (jaccard.np.frombuffer(jaccard.bitmap(x), jaccard.np.uint64).reshape(1, -1) for x in (b, a))
    assert wide.shape[1] == 2 * narrow.shape[1]
    one = (jaccard.np.bincount((b & jaccard.np.uint64(2047)).astype(int), minlength=2048) & 1).astype(jaccard.np.uint8)
    assert (jaccard.folded(wide)[0] == jaccard.np.frombuffer(jaccard.np.packbits(one).tobytes(), jaccard.np.uint64)).all()

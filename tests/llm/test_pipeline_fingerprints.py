"""The pipeline's near-duplicate stage takes operator 7's links and those of the shingle sets, against all pairs by brute force."""

import random

import xxhash

import corpus_pipeline


def fingerprint(text: str) -> int:
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def similar(a: str, b: str) -> bool:
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return 5 * len(one & two) >= 4 * len(one | two)


def test_links_of_both_kinds(spark):
    rnd = random.Random(3)
    say = lambda n: [rnd.choice("abcdefghijklm") + rnd.choice("nopqrstuvwxyz") + rnd.choice("aeiou") for _ in range(n)]
    texts = {}
    for k in range(12):  # the part that repeats decides the bits, the rest most of the set
        phrase = say(11) * (8 + k % 6)
        texts[k * 10] = " ".join(phrase + say(20))
        texts[k * 10 + 1] = " ".join(phrase + say(20))
        texts[k * 10 + 2] = texts[k * 10 + 1] + " more"
        texts[k * 10 + 3] = texts[k * 10].upper()
    for k in range(12, 60):  # a stretch of words differs
        base = say(150)
        at = rnd.randrange(100)
        texts[k * 10], texts[k * 10 + 1] = " ".join(base), " ".join(base[:at] + say(k % 20) + base[at + k % 20 :])
    bits = {i: fingerprint(t) for i, t in texts.items()}
    near = {(a, b): (bits[a] ^ bits[b]).bit_count() for a in texts for b in texts if a < b}
    like = {p for p in near if similar(texts[p[0]], texts[p[1]])}
    assert {near[p] for p in near if near[p] <= 2 and p not in like} == {0, 1, 2} and any(near[p] > 2 for p in like)
    root = {i: i for i in texts}
    for a, b in near:
        if near[a, b] <= 2 or (a, b) in like:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))

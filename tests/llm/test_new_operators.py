"""Importance resampling, substring removal and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymesh.llm import fim, resample, substrings

SCHEMA = "doc_id long, text string, row string, at string, base string, anchor string, feature string, weight string"
LINES = ["one two", "  ", "", "A < B", "été straße", "<P", "S>", "x" * 70, "日本語のテキスト"]


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, "r", "a", "b", "c", "f", "w") for i, t in rows], SCHEMA).repartition(4)


def lines(rnd, n):
    return "\n".join(rnd.choice(LINES) for _ in range(n)) + rnd.choice(["", "\n"])


# --- fill in the middle


def slow_fim(doc_id, text, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim(spark):
    rnd = random.Random(3)
    rows = [(i, lines(rnd, rnd.randint(0, 40))) for i in range(150)]
    rows += [(None, "a\nb\nc"), (None, None), (900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "has <M> in it\nx"), (905, "long " * 200_000 + "\n" + "b\n" * 50_000), rows[3], rows[3]]
    df = with_clashes(spark, rows)
    got = [tuple(r) for r in fim.transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=repr) == sorted(((i, *slow_fim(i, t)) for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digest_columns(fim.transform(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert back == {(i, sha(slow_fim(i, t)[4]), sha(t or "")) for i, t in rows}
    assert fim.digest_columns(fim.transform(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=2000))
def test_rank_and_select(bits):
    marks = fim.Boundaries(np.array(bits, bool))
    ones = [i for i, b in enumerate(bits) if b]
    places = np.arange(len(bits) + 1)
    assert marks.rank(places).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]
    if ones:
        assert marks.select(np.arange(len(ones))).tolist() == ones


def test_markers_that_overlap():
    with pytest.raises(ValueError):
        fim.Forms(prefix="<<", suffix="<S>", middle="<M>")
    with pytest.raises(ValueError):
        fim.Forms(prefix="<P>", suffix="<P>", middle="<M>")


# --- substring removal


def slow_dedup(rows, window):
    """(n_words, n_removed, kept) of each row; a doc_id is a document, null the last."""
    key = lambda i: (i is None, i or 0)
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for at in range(len(w) - window + 1):
            x = tuple(w[at : at + window])
            first[x] = min(first.get(x, (key(i), at)), (key(i), at))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < (key(i), at):
                gone |= set(range(at, at + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def repeats(rnd):
    say = lambda n: [rnd.choice("abcdef") + rnd.choice("ghijkl") + rnd.choice("aeiou") for _ in range(n)]
    shared = [say(n) for n in (20, 21, 25, 60, 150)]
    rows = []
    for i in range(60):
        w = say(rnd.randint(0, 80))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 4)
            at = rnd.randint(0, len(w))
            w[at:at] = s[a : len(s) - rnd.randint(0, len(s) // 4)]
        rows.append((rnd.randint(-5, 1000), rnd.choice([" ", "  ", "\n"]).join(w)))
    loop = "la " * 70
    return rows + [(2000, loop), (2001, "x " + loop), (-7, " ".join(shared[4])), (None, " ".join(shared[4])), (None, None), (2002, None), (2003, ""), (2004, " \t\n"), (2005, "B" * 300_000 + " " + " ".join(shared[3])), (2006, "B" * 300_000 + " " + " ".join(shared[3]))]


@pytest.mark.parametrize("most", [substrings.MAX_ROWS, 0])
def test_substring_removal(spark, most):
    rnd = random.Random(11)
    rows = repeats(rnd)
    assert len({i for i, _ in rows}) < len(rows)
    again = rows + [rows[5], rows[5], (rows[7][0], rows[8][1])]  # repeated rows, and other texts of one doc_id
    unique = list({i: (i, t) for i, t in rows if i is not None}.values())
    for some in (unique, again):
        got = [tuple(r) for r in substrings.deduplicate(with_clashes(spark, some), 20, most).collect()]
        assert sorted(got, key=repr) == slow_dedup(some, 20)
    assert substrings.deduplicate(with_clashes(spark, rows).limit(0), 20, most).count() == 0


def test_ids_far_apart(spark):
    rnd = random.Random(12)
    far = [(i if i is None else (i * 7_000_000_000_000_001) % (1 << 63) - (1 << 62), t) for i, t in repeats(rnd)]
    for window in (5, 20):
        got = [tuple(r) for r in substrings.deduplicate(with_clashes(spark, far), window).collect()]
        assert sorted(got, key=repr) == slow_dedup(far, window)


def test_paths_compact(spark):
    """A passage that several documents share is one path, however long."""
    rnd = random.Random(13)
    say = lambda n: " ".join(rnd.choice("abcdefgh") + rnd.choice("ijklmno") + str(rnd.randint(0, 99)) for _ in range(n))
    shared = say(400)
    docs, step = substrings.coordinates(spark.createDataFrame([(i, f"{say(30)} {shared} {say(30)}") for i in range(6)], "doc_id long, text string"))
    found = substrings.edges(substrings.windows(docs, substrings.anchor_counts(docs, 20), 20, 1000))
    assert found.count() == 381
    path = substrings.paths(found, step).collect()
    assert [(r["size"], r["first"]) for r in path] == [(381, 30)]


# --- importance resampling


def slow_draw(docs, target, how):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, how.ngram + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % how.buckets
    s = Counter(bucket(f) for _, t in docs for f in grams(words(t)))
    t = Counter(bucket(f) for x in target for f in grams(words(x)))
    all_s, all_t = s.total() + how.buckets, t.total() + how.buckets
    gain = [math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((s[b] + 1) * all_t))) for b in range(how.buckets)]
    rows = []
    for i, text in docs:
        w = words(text)
        f = grams(w)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= how.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(fit[: how.percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("how", [resample.Draw(), resample.Draw(ngram=2, buckets=97, percent=50, min_words=3), resample.Draw(ngram=3, buckets=7, percent=100, min_words=1)])
def test_draw(spark, how):
    rnd = random.Random(21)
    vocabulary = ["the", "THE", "of", "d'or", "x1", "straße", "É", "日本", "a-b", "_", "42", "nul\0l"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(120)]
    docs += [(None, text(30)), (None, None), (500, None), (501, ""), (502, " _ "), (503, text(30_000)), docs[2], docs[2]]
    target = [text(20) for _ in range(5)] + [None, ""]
    source = with_clashes(spark, docs)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in resample.draw(source, goal, how).collect()]
    assert sorted(got, key=repr) == slow_draw(docs, target, how)
    assert resample.draw(source.limit(0), goal, how).count() == 0
    alone = [tuple(r) for r in resample.draw(source, goal.limit(0), how).collect()]
    assert sorted(alone, key=repr) == slow_draw(docs, [], how)

"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import io
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from waymesh.llm import components, decontam, htmltext, imi, langid, mixing, secrets, simhash, tokencount, tokenfile, warc

RND = random.Random(7)
VOCAB = ["the", "of", "erth", "tion", "house", "green", "Walks", "été", "straße", "über", "naïve", "x1", "42", "don't", "of,", "a"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, component_id string, cell string, start string, key string"


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) + (str(rnd.randint(0, 60)) if rnd.random() < 0.5 else "") for _ in range(n))


def corpus():
    """Copies, near copies, short, empty, null and long texts; repeated rows; null ids; and columns that clash with internal names."""
    base = [prose(RND.randint(5, 120)) for _ in range(40)]
    near = [b + " end" for b in base[:12]]
    texts = base + base[:6] + near + [None, "", " ", "one", "two words", "\t\n", "²", "é" * 300, "A" * 5000, prose(4000)] + ["same text for all of these rows"] * 25
    docs = [(i, t, RND.choice(["en", "de", None]), RND.choice(["src0", "src0", "src1", None]), 0) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (None, "no id here at all", "en", "src1", 0), (None, None, None, None, None)]
    return [d + ("r", "f", "c", "e", "s", "k") for d in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- near duplicates


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(items):
    """items: (id, fingerprint); the smallest id that each reaches over links of at most two bits."""
    best = {}
    for f in {f for _, f in items}:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for y in {f for _, f in items} - seen:
                if (x ^ y).bit_count() <= 2:
                    seen.add(y)
                    todo.append(y)
        best[f] = min((i for i, g in items if g in seen and i is not None), default=None)
    return best


def test_simhash_components(spark, docs, empty):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    best = slow_components(rows)
    got = plain(simhash.digest_columns(simhash.near_duplicates(docs)))
    assert got == sorted(((i, f"{f:016x}", best[f]) for i, f in rows), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("spread", [3, 6, 40])
def test_index_finds_every_near_pair(spread):
    rnd = np.random.default_rng(spread)
    base = rnd.integers(0, 2**63, 5, np.uint64)
    fps = np.unique([int(rnd.choice(base)) ^ sum(1 << int(b) for b in rnd.choice(spread, 3)) for _ in range(600)]).astype(np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    found = {(int(a), int(b)) for x, y in simhash.near_pairs(fps) for a, b in zip(x, y)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    a, b = simhash.spanning_links(fps)
    degree = np.bincount(np.r_[a, b], minlength=len(fps))
    assert degree.max(initial=0) <= 3


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 20)
    rnd = random.Random(1)
    fps = sorted({(rnd.getrandbits(48) & 0xFF) ^ (1 << rnd.randint(0, 63)) for _ in range(400)})
    rows = list(enumerate(fps))
    classes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in rows], "fp long, rep long")
    comp = {r.node: r.component for r in components.connected_components(simhash.links(classes)).collect()}
    best = slow_components(rows)
    assert {i: comp.get(i, i) for i, _ in rows} == {i: best[f] for i, f in rows}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (0, 59), (0, 59)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# --- decontamination


def slow_hits(docs, items, size=10):
    low = lambda t: decontam.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(str(i), w[k : k + size]) for i, t in items if (w := low(t)) for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [decontam.MAX_INDEX_BYTES, 0])
def test_decontamination(spark, docs, empty, limit):
    rows = docs.collect()
    long = [r.text for r in rows if r.text and len(r.text.split()) > 30]
    items = [(0, " ".join(long[0].split()[3:25])), (1, " ".join(long[1].split()[:10]).upper()), (2, "two words"), (3, None), (4, ""), (5, "..."), (6, " ".join(long[0].split()[3:25])), (7, prose(14)), (8, "same text for all of these rows"), (9, "the of the of the of the of the of the of")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert plain(decontam.decontaminate(docs, table, max_index_bytes=limit)) == slow_hits([(r.doc_id, r.text) for r in rows], items)
    assert decontam.decontaminate(empty, table, max_index_bytes=limit).count() == 0
    assert not decontam.decontaminate(docs, table.limit(0), max_index_bytes=limit).filter("contaminated").count()


# --- token files


def test_token_files(spark, docs, empty):
    enc = tokenfile.Encoder(tokenfile.tokenizer_path())
    at, want = 0, []
    for i, t in sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.frombuffer(enc.whole([t])[0], np.uint32).tolist() + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for mode in ("byte", "bit"):
        assert sorted(plain(tokenfile.round_trip(docs, mode)), key=repr) == sorted(want, key=repr)
    assert tokenfile.round_trip(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**40), 2**40)), st.lists(st.integers(0, 2**32 - 1), max_size=40)), max_size=8), st.sampled_from(["byte", "bit"]))
def test_file_format(docs, mode):
    out = io.BytesIO()
    w = tokenfile.Writer(out, mode, block=16)
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4").tobytes())
    w.close()
    r = tokenfile.Reader(out)
    assert [(i, ids.tolist()) for i, _, ids in r.documents()] == docs
    flat = [x for _, ids in docs for x in ids]
    assert r.read(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 :][: len(flat) // 2]


PIECES = ["a", "B", "é", "ß", "'", " ", "  ", "\n", "\t", "1", "9", "²", "!", "...", "'s", "'re", "'ll", "don't", "'S", "中", "ñ", "-", "'ve'd", " 's", "\n's", "½", "\0", "😀", "<|endoftext|>", "\x1f", "\x85"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_encoder_equals_library(texts):
    e = tokenfile.encoder(tokenfile.tokenizer_path())
    assert e.encode(texts) == [e.whole([t])[0] for t in texts]


def test_encoder_forgets_and_cuts(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 50)
    monkeypatch.setattr(tokenfile, "PIECE_CHARS", 300)
    e = tokenfile.Encoder(tokenfile.tokenizer_path())
    texts = [prose(n, random.Random(n)) for n in (0, 3, 30, 40, 500, 700)]
    assert e.encode(texts) == [e.whole([t])[0] for t in texts]


# --- language ID


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    known = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(8), 2).T)

    def slow(word, lang):
        if not word:
            return 1.0
        return sum(np.exp(logp[pieces.index(word[:k]), lang]) * slow(word[k:], lang) for k in range(1, len(word) + 1) if word[:k] in pieces) or np.exp(logp[-1, lang]) * slow(word[1:], lang)

    words = ["▁abab", "▁ba", "aba", "▁aabba"]
    assert np.allclose(langid.forward(words, logp, known), [[np.log(slow(w, g)) for g in (0, 1)] for w in words])
    counts = langid.expected_counts(words, np.array([0, 1, 0, 1]), np.ones(4), logp, known)
    lengths = np.array([len(p) for p in pieces] + [1])
    assert np.isclose((counts * lengths).sum(), sum(map(len, words)))


def test_language_id(spark, empty):
    words = {"en": "the house of green walks and they were there with this".split(), "de": "das haus der grünen wege und sie waren nicht über straße".split(), "fr": "la maison été avec une forêt où elle marche près du château".split()}
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(20)), g) for i in range(300) for g in [rnd.choice(list(words))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 ² !", "de"), (None, "das haus der wege", "de"), (903, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("clash"))
    model = langid.train(langid.learnable(df))
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify(df, model, keep=("doc_id",)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", langid.F.col("score").alias("p")).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows if i is not None and i < 300)
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "und", "de"] and got[900].p == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.p <= 1 for i, r in got.items() if i is not None)
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(df, none, keep=("doc_id",)).collect()} == {"und"}


def test_word_cache_changes_nothing(monkeypatch):
    path = langid.vocabulary_path()
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(langid.pieces(path)) + 1), 2).T + 1e-9)
    texts = [prose(n, random.Random(n)) for n in range(0, 60, 7)]
    want = langid.Model(["a", "b"], logp, path).scorer()(texts)
    monkeypatch.setattr(langid, "CACHE_WORDS", 7)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 50)
    got = langid.Model(["a", "b"], logp, path).scorer()(texts)
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


# --- token counts


def test_token_counts(spark, docs, empty):
    known = tokencount.scores(tokencount.vocabulary_path())
    want = [(r.doc_id, len(w), sum(tokencount.count_alone("▁" + x, known) for x in w), len((r.text or "").encode())) for r in docs.collect() for w in [(r.text or "").split()]]
    assert plain(tokencount.count_tokens(docs)) == sorted(want, key=repr)
    assert tokencount.count_tokens(empty).count() == 0


def test_best_segmentation():
    known = {"a": -1.0, "b": -1.2, "ab": -2.2, "ba": -1.5, "aba": -3.0, "c": None}

    def slow(word):
        if not word:
            return (0.0, 0)
        ways = [(s + known[word[:k]], n - 1) for k in range(1, len(word) + 1) if known.get(word[:k]) is not None for s, n in [slow(word[k:])]]
        if known.get(word[0]) is None:
            s, n = slow(word[1:])
            ways.append((s + tokencount.BYTE_SCORE * len(word[0].encode()), n - len(word[0].encode())))
        return max(ways)

    trie = tokencount.Trie({**known, **{p[k:]: None for p in known for k in range(1, len(p)) if p[k:] not in known}}, max_nodes=9)
    for word in ("abab", "ba", "aab", "abaab", "cé", "abcab", "bbbb", "abab"):
        assert trie.count(word) == -slow(word)[1], word


# --- secrets


def slow_spans(text):
    out = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(spark, docs, empty):
    rnd = random.Random(5)
    some = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rnd.choice(a) for _ in range(n))
    hexa = lambda n: some(n, "0123456789abcdef")
    rows = [(i, f"{prose(30)} password={hexa(18)} and é {prose(3)} token = \"{hexa(40)}\" {prose(20)} AKIA{some(16, 'ABCDEFGHIJ0123456789')}", "x") for i in range(60)]
    rows += [(100, f"{prose(20)} {some(40)} {prose(20)}", "x"), (101, None, "x"), (102, "", "x"), (103, "PASSWORD:'abc' secret=token:abcdef toſen=abcdefg AKIAAKIA" + "A" * 30, "x"), (104, "internationalization_of_the_houses/of/walks", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.digest_columns(secrets.scan(df, secrets.train(df))).collect()}
    for i, text, _ in rows:
        base = slow_spans(text or "")
        text_of = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text_of.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert set(filter(None, text_of.split(","))) <= set(got[i].spans.split(","))
    assert got[100].n_markov == 1 and got[104].n_markov == 0 and got[101].spans == "" and sum(r.n_markov for r in got.values()) == 1
    assert secrets.scan(empty, secrets.train(empty)).count() == 0
    assert secrets.scan(docs, secrets.train(docs)).count() == docs.count()


# --- mixing


def slow_shares(children, budget):
    """Water filling: {name: (weight, capacity)} to shares."""
    left, got = dict(children), {}
    while left:
        rate = (budget - sum(got.values())) / sum(w for w, _ in left.values())
        full = {n: c for n, (w, c) in left.items() if c <= rate * w + 1e-9}
        if not full:
            return got | {n: int(rate * w + 1e-6) for n, (w, _) in left.items()}
        got |= full
        left = {n: x for n, x in left.items() if n not in full}
    return got


@pytest.mark.parametrize("budget,epochs", [(None, 4), (500, 2), (10**9, 3), (0, 2)])
def test_mixing(spark, docs, empty, budget, epochs):
    rows = [tuple(r) for r in mixing.allocation(docs, budget, epochs).collect()]
    assert len(rows) == docs.count()
    leaves = {r[1:4]: r[5] for r in rows}
    w = lambda sql, name, v: spark.range(1).select(mixing.F.lit(v).alias(name)).selectExpr(f"{sql} w").first().w
    weight = {k: tuple(w(mixing.WEIGHTS[n], n, v) for n, v in zip(mixing.WEIGHTS, k)) for k in leaves}
    share = {(): min(sum(leaves.values()) if budget is None else budget, sum(leaves.values()) * epochs)}
    for depth in (1, 2, 3):
        nodes = {}
        for k, s in leaves.items():
            nodes.setdefault(k[: depth - 1], {}).setdefault(k[:depth], [weight[k][depth - 1], 0])[1] += s * epochs
        share |= {n: v for parent, kids in nodes.items() for n, v in slow_shares(kids, share[parent]).items()}
    taken = {}
    for r in rows:
        assert abs(r[6] - share[r[1:4]]) <= 1
        assert r[8] in (r[7], r[7] + 1) and r[8] <= epochs
        taken[r[1:4]] = taken.get(r[1:4], 0) + r[4] * r[8]
    for k, n in taken.items():
        most = next(r[6] for r in rows if r[1:4] == k)
        assert n <= most and most - n <= max(r[4] for r in rows if r[1:4] == k) * 3  # repeated rows go together
    mixed = mixing.mix(docs, budget, epochs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[8] for r in rows)
    assert mixing.mix(empty, budget, epochs).count() == 0 and mixing.allocation(empty, budget, epochs).count() == 0


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class=top><h1>Site</h1></header><nav><ul><li><a href="/x">Menu item</a></ul></nav>
%s<h1>Big &amp; <b>bo</b>ld</h1><p>First
 para&nbsp;graph.<br>next<p>Second one is here <i>with</i> inline.<script>x()</script><div class="ad">Buy this now</div><p>Short.</p>
<form><input value=1>Subscribe</form><aside>See also</aside><!-- gone --><ul><li>one<li>two</ul>%s
<div id="comments"><p>A reader says a long thing that should never be shown at all, not even a bit of it.</p></div>
<footer>&copy; foot</footer></body></html>"""
WANT = "Big & bold First para graph. next Second one is here with inline. Short. one two"


def test_html_main_text(spark):
    assert htmltext.main_text(PAGE % ("<article>", "</article>")) == WANT
    assert htmltext.main_text((PAGE % ("<article>", ""))[:-30]) == WANT
    long = "<p>" + "Many words make a paragraph long enough to count as text. " * 4 + "</p>"
    text = htmltext.main_text("<body><div class=menu><a>x</a></div><p>Hi</p>" + "<div class=ad></div>" * 5 + long * 3 + "<div class='page-footer'>bye</div></body>")
    assert text.startswith("Many words") and text.count("Many") == 12 and "bye" not in text and "Hi" not in text
    rows = [(1, "u", PAGE % ("<main>", "</main>"), "a"), (2, None, None, "b"), (3, "u", "", "c"), (4, "u", "<p>&am &amp", "d"), (4, "u", "<p>&am &amp", "d")]
    got = plain(htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, WANT, len(WANT)), (2, "", 0), (3, "", 0), (4, "&am &", 5), (4, "&am &", 5)]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_derivatives(spark):
    rows = [(1, "http://a.example/x", PAGE % ("<article>", "</article>"), "m"), (2, None, None, "m"), (3, "http://b.example/", "<a href='/q?a=1&amp;b=2' title=t>go</a><img src=i.png>", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, metadata string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for key, url, page, _ in rows:
        source, block = warc.parse(warc.response(str(key), url or "", page or ""))
        r = got[key]
        assert r.response_id == source["WARC-Record-ID"] == r.metadata_refers_to == r.conversion_refers_to
        assert r.response_digest == source["WARC-Payload-Digest"] == warc.digest(block.split(b"\r\n\r\n", 1)[1])
        meta, text = warc.derive(warc.response(str(key), url or "", page or ""))
        fields, body = warc.parse(text)
        assert fields["WARC-Target-URI"] == (url or "") and fields["WARC-Refers-To-Payload-Digest"] == r.response_digest and r.n_chars == len(body.decode())
    assert got[3].n_links == 2 and got[1].title == "T" and "Menu item\nBig & bold" in warc.parse(warc.derive(warc.response("1", "u", PAGE % ("", "")))[1])[1].decode()
    links = json.loads(warc.parse(warc.derive(warc.response("3", "u", rows[2][2]))[0])[1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    assert links[0] == {"path": "A@/href", "url": "/q?a=1&b=2", "title": "t"}
    assert warc.round_trip(df.limit(0)).count() == 0


# --- nearest neighbours


def test_walk_is_in_order():
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=7), rnd.normal(size=9)
    sizes = rnd.integers(0, 3, 63)
    got = imi.walk(a, b, sizes, int(sizes.sum()))
    total = (a[:, None] + b).ravel()
    assert got == [c for c in np.argsort(-total) if sizes[c]]


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(imi, "SHARD_ROWS", 100)
    monkeypatch.setattr(imi, "QUERY_ROWS", 10)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(700, 8))
    x[100:400] = x[100]  # a very common vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(800, None, "c"), (820, [0.0] * 8, "c"), (840, [float("nan")] * 8, "c"), (860, [1.0, None] * 4, "c"), (880, [float("inf")] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got: dict = {}
    for r in imi.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:20]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([v for _, _, v in found], s[[i for _, i, _ in found]])
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = imi.search(df.filter("vec_id < 5"), df.filter("vec_id = 0")).collect()
    assert len(few) == 4 and imi.search(df.limit(0), df.limit(0)).count() == 0

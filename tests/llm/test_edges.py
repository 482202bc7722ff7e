"""Nulls, repeated rows, clashing columns, long inputs and hot keys of single operators, against brute force."""

import base64
import gzip
import hashlib
import json
import random
import zlib
from email.parser import BytesParser

import corpus_pipeline
import numpy as np
import pytest
from test_operators import slow_components, slow_fingerprint, slow_hits

from waymesh.llm import components, decontam, imi, jaccard, langid, secrets, simhash, tokenfile, warc


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    """B and C differ by three bits; only A, which has no id, is near both."""
    prints = {"a": 0b1111000, "b": 0b1111001, "c": 0b1111110, "far": 0b1 << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n=3: docs.replace({k: str(v) for k, v in prints.items()}, subset=["text"]).selectExpr("doc_id", "cast(text as long) as fp"))
    docs = spark.createDataFrame([(None, "a"), (7, "b"), (5, "c"), (9, "far"), (None, "far"), (None, "a")], "doc_id long, text string")
    assert plain(simhash.near_duplicates(docs).select("doc_id", "component_id")) == sorted([(None, 5), (None, 5), (7, 5), (5, 5), (9, 9), (None, 9)], key=repr)
    rows = [(r.doc_id, prints[r.text]) for r in docs.collect()]
    assert slow_components(rows)[prints["a"]] == 5


def test_common_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY", 3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 141)} | {200: 200, 201: 200}


@pytest.mark.parametrize("limit", [decontam.MAX_INDEX_BYTES, 0])
def test_decontamination_of_odd_items(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "SHARE", 10**6)
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice("abcdefg") * rnd.randint(1, 2) for _ in range(n))
    texts = [say(rnd.randint(0, 60)) for _ in range(60)] + [None, "", "a", "a a", say(3000)]
    docs = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] * 2
    items = [(None, texts[3]), (None, "g"), ("b", "a b"), ("c", "a b"), ("d", texts[5]), ("e", texts[3]), ("f", "aa")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, s string, __k1 int")
    table = spark.createDataFrame(items, "item_id string, text string")
    named = [(i, t) for i, t in items if i is not None]
    want = [(a[:2] + b[2:3] + a[3:5] + b[5:]) for a, b in zip(slow_hits([(k, d[1]) for k, d in enumerate(docs)], named), slow_hits([(k, d[1]) for k, d in enumerate(docs)], [(i or "none", t) for i, t in items]))]
    want = sorted(((docs[k][0], *rest) for k, *rest in want), key=repr)
    assert plain(decontam.decontaminate(frame, table, max_index_bytes=limit)) == want
    kept = decontam.marked(frame, table, max_index_bytes=limit)
    assert kept.columns == [*frame.columns, decontam.MARK] and kept.count() == len(docs)


def test_queries_of_one_id_have_each_their_result(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(40, x[7].tolist())], "vec_id long, embedding array<double>")
    got = imi.search(df, df.filter("vec_id % 20 = 0"), target=1.0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 40 if i == 40 else 20 for i in range(0, 200, 20)}


def test_clusters_make_the_index_selective():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(60, 32))
    x = centres[rnd.integers(0, 60, 6000)] + 0.25 * rnd.normal(size=(6000, 32))
    index = imi.Index(x[:3000], len(x))
    assert index.share < 0.15
    assert np.allclose(index.turn @ index.turn.T, np.eye(32))
    cells = index.cells(x)
    sizes = np.bincount(cells, minlength=len(index.books[0]) * len(index.books[1]))
    found = 0
    for i in range(3000, 6000, 60):
        one, two = index.scores(x[i : i + 1])
        walked = set(imi.walk(one[0], two[0], sizes, int(np.ceil(index.share * len(x)))))
        best = np.argsort(-(x @ x[i]), kind="stable")[:20]
        found += sum(cells[j] in walked for j in best.tolist())
    assert found >= 0.9 * 20 * 50


def test_a_common_id_does_not_flood_the_sample(spark, monkeypatch):
    from waymesh.llm.common import hashed_share

    df = spark.range(20_000).selectExpr("cast(1 as long) as id", "id as v").repartition(5)
    assert 1500 < hashed_share(df, "id", 2000).count() < 2500


def test_long_words_are_summed_over_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "abba"]
    known = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(10), 2).T)
    rnd = random.Random(3)
    words = ["▁" + "".join(rnd.choice("ab") for _ in range(n)) for n in (1, 62, 63, 64, 65, 127, 128, 129, 300, 1000)]

    def slow(word, g):
        alpha = [0.0]
        for e in range(1, len(word) + 1):
            ways = [alpha[e - k] + logp[pieces.index(word[e - k : e]), g] for k in range(1, min(4, e) + 1) if word[e - k : e] in pieces]
            alpha.append(np.logaddexp.reduce(ways))
        return alpha[-1]

    for reach in (4, 9):
        assert np.allclose(langid.forward(words, logp, known, reach), [[slow(w, g) for g in (0, 1)] for w in words])
    counts = langid.expected_counts(words, np.arange(len(words)) % 2, np.ones(len(words)), logp, known, 4)
    assert np.isclose((counts * np.array([len(p) for p in pieces] + [1])).sum(), sum(map(len, words)))


def test_identifiers_are_ordinary_and_random_strings_are_not():
    """Held out: none of these identifiers is made of two words of the list alone."""
    flat = secrets.log_ratio({}).reshape(-1)
    names = "getElementsByClassName XMLHttpRequestEventTarget https_proxy_settings addEventListenerOnce org/apache/commons/lang MAX_RETRY_ATTEMPTS_EXCEEDED kubernetes_deployment_status internationalization NullPointerException dangerouslySetInnerHTML SQLAlchemyError spring-boot-starter-web readFileSync_utf8 ThreadPoolExecutor ArrayIndexOutOfBoundsException node_modules/webpack/bin numpy_float64_array unordered_multimap getattr_static_lookup wp-content/uploads/images ________________________ ------------------------ AAAAAAAAAAAAAAAAAAAAAAAA Donaudampfschifffahrtsgesellschaft".split()
    assert not [n for n in names if secrets.is_random(n, flat)]
    rnd = random.Random(3)
    for alphabet in (secrets.ALPHABET[:62], secrets.ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789"):
        made = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([20, 24, 32, 40]))) for _ in range(300)]
        assert sum(secrets.is_random(m, flat) for m in made) >= 0.95 * len(made)


def http(head: str, body: bytes) -> bytes:
    block = head.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body
    return warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Date": "d", "WARC-Target-URI": "u", "WARC-Payload-Digest": "p"}, block)


def test_source_headers_and_codings():
    page = b"<title>T &amp; t</title><p>Gr\xc3\xbcn</p><a href=/x>go</a>"
    packed = gzip.compress(page)
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    for head, body in (("Content-Encoding: gzip\nTransfer-Encoding: chunked", chunked), ("content-encoding: deflate", zlib.compress(page)), ("Content-Encoding: deflate", raw), ("Content-Encoding: identity", page), ("X: y", page)):
        meta, text = warc.derive(http(f"HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\nSet-Cookie: a=1\n{head}\nset-cookie: b=2", body))
        told = json.loads(warc.parse(meta)[1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert told["Headers"]["Set-Cookie"] == ["a=1", "b=2"]
        assert told["HTML-Metadata"]["Head"]["Title"] == "T & t" and [x["url"] for x in told["HTML-Metadata"]["Links"]] == ["/x"]
        assert warc.parse(text)[1].decode().endswith("Grün\ngo")
        assert told["Entity-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert warc.parse(warc.derive(http("HTTP/1.1 200 OK\nContent-Encoding: br", b"\x0b\x02"))[1])[1] == b""
    assert warc.parse(warc.derive(http("SSH-2.0", b"x"))[1])[1] == b""


def records_of(data: bytes):
    """Records of an uncompressed file, by an independent reader: header lines as mail headers, blocks by length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        version, _, head = data[at:stop].partition(b"\r\n")
        assert version == b"WARC/1.1"
        fields = BytesParser().parsebytes(head)
        size = int(fields["Content-Length"])
        assert data[stop + size : stop + size + 4] == b"\r\n\r\n"
        yield fields, data[stop : stop + size]
        at = stop + size + 4


def test_files_by_an_independent_reader(spark, tmp_path):
    long = "<p>word</p>" * 60_000
    rows = [(1, "http://a.example/x", "<title>A</title><p>one<p>two", "m"), (1, "http://a.example/x", "<title>A</title><p>one<p>two", "m"), (2, None, None, "m"), (3, "http://b.example/", "<a href='x y'>go</a>" + '<a href="x ' * 20_000, "m"), (4, "http://c.example/", long, "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(2)
    index = warc.write_derivatives(warc.responses(df), str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in index) == [1, 1, 2, 3, 4]
    seen = {}
    for name in {r.file for r in index}:
        for fields, block in records_of(gzip.decompress((tmp_path / "w" / name).read_bytes())):
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            seen.setdefault((fields["WARC-Target-URI"], fields["WARC-Type"]), []).append((fields, block))
    assert {k: len(v) for k, v in seen.items()} == {(u or "", t): n for u, n in (("http://a.example/x", 2), (None, 1), ("http://b.example/", 1), ("http://c.example/", 1)) for t in ("metadata", "conversion")}
    for (url, kind), found in seen.items():
        page = next(p or "" for _, u, p, _ in rows if (u or "") == url)
        for fields, block in found:
            other = seen[url, "conversion" if kind == "metadata" else "metadata"][0][0]
            assert fields["WARC-Refers-To"] == other["WARC-Refers-To"] != fields["WARC-Record-ID"]
            if kind == "conversion":
                assert fields["WARC-Refers-To-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
            else:
                assert json.loads(block)["Envelope"]["WARC-Header-Metadata"]["WARC-Record-ID"] == fields["WARC-Refers-To"]
    assert seen["http://a.example/x", "conversion"][0][1].endswith(b"one\ntwo") and seen["http://c.example/", "conversion"][0][1].count(b"word") == 60_000


def test_token_files_of_one_very_common_id(spark):
    rows = [(5, f"text {i % 7}") for i in range(50)] + [(None, "no id")] * 20 + [(6, "z")]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.start for r in got.collect())[0] == 0 and got.count() == 71
    order = [r.doc_id for r in got.orderBy("start").collect()]
    assert order == [None] * 20 + [5] * 50 + [6]


# --- the pipeline


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, component string, row long, key string, __text string"


def brute_first(rows):
    """Rows kept of (doc_id, text): the smallest id of each group of 5-word similarity 0.8, once."""
    cut = lambda t: frozenset(tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)))
    sets = [cut(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    groups = {}
    for (i, _), r in zip(rows, root):
        groups.setdefault(r, []).append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)


def test_near_duplicates_without_ids(spark):
    rnd = random.Random(12)
    say = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(n))
    rows = []
    for i in range(25):
        base = say(rnd.choice([2, 5, 60, 120]))
        for copy in range(rnd.choice([1, 3, 4])):
            rows.append((rnd.choice([None, 1000 - i * 10 - copy, i]), base + (" more words" * (copy > 1 and len(base) > 200))))
    rows += [rows[0]] * 5 + [(None, None), (3, ""), (None, " "), (None, "only one"), (None, "only one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", "c", 1, "k", "t") for i, t in rows], SCHEMA).repartition(4)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute_first(rows)
    assert jaccard.near_duplicates(docs).count() == len(rows)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Columns that clash with the operators' own, null ids, repeated rows; then no rows at all."""
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(["the", "house", "walks", "green"]) + rnd.choice(["ly", "ing", "ed", "s"]) + rnd.choice("abcdefgh") for _ in range(n))
    item = say(12)
    rows = [(i, say(50)) for i in range(30)] + [(None, say(40)), (None, f"{say(20)} {item} {say(9)}"), (70, None)]
    rows += [rows[0], rows[30]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", "c", 1, "k", "t") for i, t in rows], SCHEMA)
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted([*range(30), None], key=repr)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
        if k == 2:
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == want
    assert {r.doc_id for r in docs.collect()} <= set(want)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

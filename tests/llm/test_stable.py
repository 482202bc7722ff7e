"""Samples that don't depend on how a table is split, paths without a scheme, crossed nulls, and names that decide nothing by themselves."""

import json
import random

from waymesh.llm import common, decontam, htmltext, imi, langid, secrets, tokenfile, warc


def test_same_sample_over_any_split(spark):
    rows = [(i % 700, f"text {i % 5000}") for i in range(20_000)] + [(None, "same for all")] * 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    taken = [sorted(map(tuple, common.hashed_share(df.repartition(n), "doc_id", 1000).collect()), key=repr) for n in (3, 7)]
    assert taken[0] == taken[1] and 800 < len(taken[0]) < 1200 and len(set(taken[0])) == len(taken[0])
    assert common.hashed_share(df.limit(50), "doc_id", 50).count() == 50


def test_same_models_over_any_split(spark):
    rnd = random.Random(2)
    docs = [(i, f"password = {rnd.getrandbits(90):x} some Words{i} here", rnd.choice(["en", "de"])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flat = [secrets.train(df.repartition(n), rows=300) for n in (2, 5)]
    assert (flat[0] == flat[1]).all()
    told = [sorted(map(tuple, langid.identify(df, langid.train(df.repartition(n), rows=300, rounds=1)).select("doc_id", "lang_pred").collect())) for n in (2, 5)]
    assert told[0] == told[1]
    vectors = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(3000)], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, imi.search(vectors.repartition(n), vectors.filter("vec_id % 100 = 0"), target=0.5).collect())) for n in (2, 5)]
    assert found[0] == found[1]


def test_path_without_scheme(spark, tmp_path):
    """Such a path is in Spark's default file system, not on each executor's disk."""
    assert common.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.here.link./data", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://here/")
    try:
        assert common.qualified(spark, "/data/x") == "viewfs://here/data/x"
        assert common.qualified(spark, f"file://{tmp_path}").startswith("file:")
    finally:
        conf.set("fs.defaultFS", before)
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    files = tokenfile.write_tokens(docs, str(tmp_path / "tokens"))
    assert [r.doc_id for r in tokenfile.read_tokens(spark, str(tmp_path / "tokens"), files).orderBy("start").collect()] == [1, 2]


def test_crossed_nulls(spark):
    """(null, '5') and (5, null) are two documents, also where the items are too many for the executors."""
    docs = spark.createDataFrame([(None, "5"), (5, None), (6, "5 5"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "5")], "item_id long, text string")
    want = [(None, 0, 0, False), (None, 1, 1, True), (5, 0, 0, False), (6, 2, 2, True)]
    for most in (decontam.MAX_INDEX_BYTES, 0):
        got = decontam.decontaminate(docs, items, max_index_bytes=most).select("doc_id", "n_words", "n_hit", "contaminated").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_copies_under_the_query_id(spark):
    """Every row but the query's own is a candidate, also one of the same id, and one of the same id and vector."""
    one, two, far = [1.0, 0.0], [0.9, 0.1], [-1.0, 0.0]
    df = spark.createDataFrame([(20, one), (20, one), (20, two), (3, far), (40, far)], "vec_id long, embedding array<double>")
    got = imi.search(df, df.filter("vec_id % 20 = 0"), k=3)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by[20]) == sorted([(1, 20, 1.0), (2, 20, 0.9), (3, 3, -1.0)] * 2 + [(1, 20, 0.9), (2, 20, 0.9), (3, 3, -0.9)])
    assert by[40] == [(1, 3, 1.0), (2, 20, -0.9), (3, 20, -1.0)]


def test_names_inside_an_article():
    prose = "<p>" + "The harbour was quiet in the morning, and the boats lay still. " * 3 + "</p>"
    for kept in ('<p class="related">Related work is discussed here.</p>', '<div id="overlay">The overlay shows the chart.</div>', '<section id="menu"><p>Soup of the day</p><p>Fish</p></section>', '<table class="share"><tr><td>Share of votes</td></tr></table>'):
        text = htmltext.main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{prose}{kept}{prose}</article></body>")
        words = " ".join("".join(c if c not in "<>" else " " for c in kept).split())
        assert all(w in text for w in words.split() if w.isalpha() and w[0].isupper())
    for gone in ('<div class="ad">Buy this now.</div>', '<div class="related"><a href=/a>Another story</a><a href=/b>One more</a></div>', '<div class="cookie-notice">We use cookies.</div>', '<ul class="share"><li><a href=/t>Post it</a></li></ul>', '<div class="comments"><p>First! I was here, and I liked it a lot.</p></div>', "<aside>Side matter</aside>"):
        text = htmltext.main_text(f"<body><article><h1>Title</h1>{prose}{gone}{prose}</article></body>")
        assert text == htmltext.main_text(f"<body><article><h1>Title</h1>{prose}{prose}</article></body>")


def test_conversion_reads_markup_as_browsers_do():
    read = warc.plain_text
    assert read("<html><head><title>x</title><body><p>Text of the page.</p>") == "Text of the page."
    assert read("<html><head><title>x</title><meta charset=a><p>Text of the page.</p>") == "Text of the page."
    assert read('<p title="a>b">Text</p>') == "Text"
    assert read("<script>if (a</b>) x()</script><p>one<br>two <!-- <p>no --> three<style>p{}</style></p><nav>menu</nav>") == "one\ntwo three\nmenu"
    assert read("a &lt;b&gt; &amp; c < d") == "a <b> & c < d"
    block = "<p>word</p>" * 3
    meta, text = warc.derive(warc.response("1", "http://a.example/", f"<head><title>T</title><body>{block}"))
    assert warc.parse(text)[1] == b"word\nword\nword"
    assert json.loads(warc.parse(meta)[1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Head"]["Title"] == "T"


def test_elements_left_out_of_conversions():
    read = warc.plain_text
    assert read("<div><object>in</div>after<object>x<object>y</object>z</object>end") == "after\nend".replace("after\nend", "afterend")
    assert read("<noscript><p>no</p></noscript><p>a</p><template><div>t</div></template>b<svg><title>s</title><text>u</text></svg>c") == "a\nbc"
    assert read("<TITLE>a <p> b</TITLE><P>x</P><select><option>o<p>y</select>") == "x\ny"
    assert read("<p>a<textarea>t<p></textarea>b</p><script>never closed <p>c") == "a b"
    assert read("<head><style>p{}</style><script>'<p>'</script>") == ""

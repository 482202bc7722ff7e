"""The pipeline's stages, one after another, on a small corpus with planted cases."""

import random

import numpy as np

import corpus_pipeline
from waymesh.llm import tokenfile
from waymesh.llm.queries import ORACLE, QUERIES


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    words = {"en": [f"{a}{b}" for a in ("th", "st", "wh", "gr", "pl") for b in ("ing", "e", "ough", "ey", "as")], "de": [f"{a}{b}" for a in ("sch", "gr", "ver", "üb", "str") for b in ("ung", "ein", "keit", "er", "aß")]}
    say = lambda g, n: " ".join(rnd.choice(words[g]) + rnd.choice(words[g]) for _ in range(n))
    rows = [(i, say(g, 80), g, f"src{i % 3}", 0) for i in range(60) for g in [rnd.choice(["en", "de"])]]
    copies = [(100 + i, rows[i][1], rows[i][2], "src0", 0) for i in range(5)]
    item = say("en", 15)
    leaked = [(200, say("en", 40) + " " + item + " " + say("en", 40), "en", "src1", 0)]
    odd = [(300, None, "en", "src0", 0), (301, "123 456", None, None, 0), (302, "", "de", "src1", 0)]
    spark.createDataFrame(rows + copies + leaked + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.doc_id for r in docs.collect()]
    own = {r[0] for r in rows}
    assert set(seen["language_id"]) == own | {100, 101, 102, 103, 104, 200}
    assert sorted(seen["simhash_near_dedup"]) == sorted(own | {200})
    assert sorted(seen["decontamination"]) == sorted(own)
    assert set(seen["source_mixing"]) <= own and len(seen["source_mixing"]) >= len(own) // 3
    assert sorted(seen["token_output"]) == sorted(seen["source_mixing"])
    e = tokenfile.encoder(tokenfile.tokenizer_path())
    sizes = {r[0]: len(np.frombuffer(e.whole([r[1]])[0], np.uint32)) + 1 for r in rows}
    assert all(sizes[r.doc_id] == r.n_tokens for r in docs.collect())


def test_registry():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"} and set(ORACLE) <= set(QUERIES)

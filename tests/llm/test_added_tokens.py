"""Texts that hold the literal of an added token, against a fresh tokenizer with the library's defaults."""

import numpy as np
from tokenizers import Tokenizer

from waymesh.llm import tokenfile


def test_added_tokens(monkeypatch):
    path = tokenfile.tokenizer_path()
    lib = Tokenizer.from_file(path)
    added = [t.content for t in lib.get_added_tokens_decoder().values()]
    assert added
    texts = ["plain words", "", *(x for a in added for x in (f"a {a} b", a, a + a, f"it's{a}'s", f"x{a[:-1]} y", f"ä {a} ก z"))]
    ids = lambda e: [np.frombuffer(x, np.uint32).tolist() for x in e.encode(texts)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(tokenfile.Encoder(path)) == want
    texts.append(f"one two, three {added[0]} " * 40)
    want.append(lib.encode(texts[-1], add_special_tokens=False).ids)
    monkeypatch.setattr(tokenfile, "PIECE_CHARS", 100)
    assert ids(tokenfile.Encoder(path)) == want

"""Token counts under a unigram vocabulary, by trie-shared dynamic programming.

A text's pre-tokens are its runs without white space, each with the word-start mark before it. A pre-token's count is
the number of pieces of its most probable segmentation; characters that no piece covers count one token for each
UTF-8 byte. Distinct pre-tokens go into a trie; every node keeps the best forward score and the number of pieces of the
best path to it, so a prefix that many pre-tokens share is scored once, and terminal counts are read off the nodes.
Each worker has a trie of its own, so nothing is shuffled; it is started anew when it exceeds ``MAX_NODES``, which
changes no count.

The public vocabulary has ranks, not probabilities, so a piece's probability is taken from its rank by the
Zipf-Mandelbrot law. Equal scores prefer fewer pieces.

Defined cases: a null or blank text has no token; pre-tokens of over ``LONG`` characters run the same recurrence
outside the trie; repeated rows, null ids and an empty table need no special care; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, resident, small_batches, strings
from .langid import MARK, pieces, vocabulary_path

BYTE_SCORE = -20.0
LONG = 64
MAX_NODES = 700_000
MAX_WORDS = 900_000


@lru_cache(maxsize=4)
def scores(path: str) -> dict[str, float | None]:
    """Log probability of each piece, and None for other suffixes of pieces."""
    names = pieces(path)
    total = math.log(sum(1 / (r + 2.7) for r in range(1, len(names) + 1)))
    out: dict[str, float | None] = {}
    for r, p in enumerate(names, 1):
        for k in range(1, len(p)):
            out.setdefault(p[k:], None)
        out[p] = -math.log(r + 2.7) - total
    return out


def extend(word: str, d: int, best: list, known: dict) -> tuple[float, int]:
    """The best (score, -pieces) of word[:d], from those of its shorter prefixes."""
    top = None
    for k in range(1, d + 1):
        piece = word[d - k : d]
        if piece not in known:
            break
        p = known[piece]
        if p is not None:
            s, n = best[d - k]
            if top is None or (s + p, n - 1) > top:
                top = (s + p, n - 1)
    if known.get(word[d - 1]) is None:  # no piece covers this character alone
        s, n = best[d - 1]
        size = len(word[d - 1].encode())
        top = max(top or (-math.inf, 0), (s + BYTE_SCORE * size, n - size))
    return top


def count_alone(word: str, known: dict) -> int:
    """Tokens of one pre-token, without a trie."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        best.append(extend(word, d, best, known))
    return -best[-1][1]


class Trie:
    def __init__(self, known: dict, max_nodes: int = MAX_NODES):
        self.known, self.max_nodes = known, max_nodes
        self.clear()

    def clear(self):
        self.next: dict[int, int] = {}
        self.best = [(0.0, 0)]

    def count(self, word: str) -> int:
        if len(word) > LONG:
            return count_alone(word, self.known)
        if len(self.best) > self.max_nodes:
            self.clear()
        best, get, node = self.best, self.next.get, 0
        path = [best[0]]
        add = path.append
        for d, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            node = get(key)
            if node is None:
                node = self.next[key] = len(best)
                best.append(extend(word, d, path, self.known))
            add(best[node])
        return -path[-1][1]


def count_texts(texts: list[str], trie: Trie, counts: dict[str, int]) -> list[tuple[int, int]]:
    """(pre-tokens, tokens) of each text. What a worker remembers is bounded by forgetting what it learned last."""
    words = [t.split() for t in texts]
    new = set().union(*words).difference(counts)
    if counts and len(counts) + len(new) > MAX_WORDS:
        for w in list(islice(counts, len(counts) // 2, None)):
            del counts[w]
        new = set().union(*words).difference(counts)
    for w in sorted(new):
        counts[w] = trie.count(MARK + w)
    return [(len(w), sum(map(counts.__getitem__, w))) for w in words]


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_pretokens, n_tokens, n_bytes."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def count(batches):
        trie, counts = resident(("tokencount", path), lambda: (Trie(scores(path)), {}))
        for b in batches:
            texts = strings(b.column(1))
            rows = [(n, t, len(x.encode())) for (n, t), x in zip(count_texts(texts, trie, counts), texts)]
            yield batch_of(schema, b.column(0), *(list(zip(*rows)) or [[]] * 3))

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(count, "key long, n_pretokens long, n_tokens long, n_bytes long").withColumnRenamed("key", key)

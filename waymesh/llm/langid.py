"""Language ID by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. Each language has a unigram probability for every piece, fitted by
expectation maximisation on labelled texts. A word (a run of letters, lower-cased, with the word-start mark before it)
is scored by the forward algorithm, which sums over all its segmentations into pieces; a text is the product of its
words, and the posterior over languages follows with equal priors. Words repeat, so each worker keeps the score vector
of words it has seen, in a cache of bounded size that changes no result.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is everything if no labelled text
was given; a null doc_id is not held out and is not learned from; ties go to the language that sorts first; a word of
any length is summed over all its segmentations; repeated rows stay; an empty table gives an empty result; extra
columns are ignored, or kept where asked for, under any name.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, hashed_share, resident, small_batches, strings, written

LETTERS = regex.compile(r"\p{L}+")
PLAIN = re.compile("[a-z]+")
GAP = re.compile("[ -@]")
BLOCK_CHARS = 800_000
#: Letters that the forward algorithm takes on at once; it then carries on from the last ones.
PART = 64
MARK = "▁"
#: Log probability of a character that no piece covers, the same in each language.
UNKNOWN = -16.0
#: Parameters: about so many labelled rows are learned from at most; rounds of expectation maximisation; cached words in a worker.
TRAIN_ROWS = 6000
ROUNDS = 3
CACHE_WORDS = 250_000
SMOOTH = 1e-7


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces; control, unknown and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


@lru_cache(maxsize=4)
def prefixes(path: str) -> dict[str, int]:
    """Each prefix of a piece: the piece's number, or -1 if it is none itself."""
    out: dict[str, int] = {}
    for i, p in enumerate(pieces(path)):
        for k in range(1, len(p)):
            out.setdefault(p[:k], -1)
        out[p] = i
    return out


def words_of(text: str) -> list[str]:
    text = text.lower()
    return PLAIN.findall(text) if text.isascii() else LETTERS.findall(text)


def parts(text: str):
    """A text, or a very long one in parts that end between words."""
    at = 0
    while len(text) - at > 2 * BLOCK_CHARS:
        m = GAP.search(text, at + BLOCK_CHARS)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def longest_piece(path: str) -> int:
    return max(map(len, pieces(path)), default=1)


def arcs(words: list[str], known: dict[str, int], unknown: int, reach: int, base: int = 0, size: int | None = None):
    """The arcs of the words' segmentation lattices that end in the ``size`` letters after ``base`` (None: all): (end, word, start, piece), sorted.

    Places are counted from ``base - reach``, where ``reach`` is the longest piece. ``unknown`` is the piece of
    characters that none covers.
    """
    longest = max(map(len, words), default=0)
    short = reach + (longest - base if size is None else min(longest - base, size)) < 256 and len(words) < 1 << 24
    packed: list[int] = []
    found: list[tuple[int, int, int, int]] = []
    get = known.get
    move = reach - base
    if short:  # end, word, start and piece in one number, which sorts faster
        add = packed.append
    for w, word in enumerate(words):
        n = len(word) if size is None else min(len(word), base + size)
        for s in range(max(0, base - reach + 1), n):
            i = get(word[s], unknown)
            row = w << 32 | (s + move) << 24 if short else 0
            if s >= base:
                p = i if i >= 0 else unknown
                add((s + 1 + move) << 56 | row | p) if short else found.append((s + 1 + move, w, s + move, p))
            if i != unknown:
                for e in range(s + 2, min(n, s + reach) + 1):
                    i = get(word[s:e])
                    if i is None:
                        break
                    if i >= 0 and e > base:
                        add((e + move) << 56 | row | i) if short else found.append((e + move, w, s + move, i))
    if short:
        x = np.sort(np.array(packed, np.uint64))
        return (x >> np.uint64(56)).astype(np.int64), (x >> np.uint64(32)).astype(np.int64) & 0xFFFFFF, (x >> np.uint64(24)).astype(np.int64) & 0xFF, x.astype(np.int64) & 0xFFFFFF
    x = np.array(found, np.int64).reshape(-1, 4)
    return x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))].T


def log_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of summed exponentials of the runs of rows that begin at ``at``."""
    top = np.maximum.reduceat(x, at)
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.r_[at, len(x)]), axis=0)), at))


def forward(words: list[str], logp: np.ndarray, known: dict[str, int], reach: int = 32) -> np.ndarray:
    """(words x languages) log of the summed probability of all segmentations.

    Words go ``PART`` letters at a time; the sums at the last ``reach`` places (no piece is longer) are carried on.
    """
    out = np.zeros((len(words), logp.shape[1]))
    length = np.fromiter(map(len, words), np.int64, len(words))
    left, carried, base = np.flatnonzero(length), None, 0
    while len(left):
        some = [words[i] for i in left]
        end, w, s, piece = arcs(some, known, len(logp) - 1, reach, base, PART)
        alpha = np.zeros((reach + PART + 1, len(some), logp.shape[1]))
        if carried is not None:
            alpha[: reach + 1] = carried
        cuts = np.searchsorted(end, np.arange(reach + 1, reach + PART + 2))
        for d in range(PART):
            a, b = cuts[d], cuts[d + 1]
            if a == b:
                break
            at = np.flatnonzero(np.r_[True, w[a + 1 : b] != w[a : b - 1]])
            alpha[reach + 1 + d, w[a:b][at]] = log_sums(alpha[s[a:b], w[a:b]] + logp[piece[a:b]], at)
        done = length[left] <= base + PART
        out[left[done]] = alpha[length[left[done]] - base + reach, np.flatnonzero(done)]
        carried, left, base = alpha[PART:][:, ~done], left[~done], base + PART
    return out


def expected_counts(words: list[str], lang: np.ndarray, weight: np.ndarray, logp: np.ndarray, known: dict[str, int], reach: int = 32) -> np.ndarray:
    """(languages x pieces) expected uses of each piece, from the posterior over each word's segmentations in its own language. Words are taken together by length."""
    out = np.zeros((logp.shape[1], len(logp)))
    length = np.fromiter(map(len, words), np.int64, len(words))
    for tall in np.unique(np.ceil(np.log2(np.maximum(length, PART)))):
        k = np.flatnonzero((length > 0) & (np.ceil(np.log2(np.maximum(length, PART))) == tall))
        if len(k):
            _add_counts(out, [words[i] for i in k], length[k], lang[k], weight[k], logp, known, reach)
    return out


def _add_counts(out, words, length, lang, weight, logp, known, reach) -> None:
    end, w, s, piece = arcs(words, known, len(logp) - 1, reach)
    end, s = end - reach, s - reach
    longest = int(length.max())
    lp = logp[piece, lang[w]]
    alpha, beta = np.zeros((longest + 1, len(words))), np.full((longest + 1, len(words)), -np.inf)
    cuts = np.searchsorted(end, np.arange(1, longest + 2))
    for d in range(1, longest + 1):
        a, b = cuts[d - 1], cuts[d]
        at = np.flatnonzero(np.r_[True, w[a + 1 : b] != w[a : b - 1]])
        alpha[d, w[a:b][at]] = log_sums(alpha[s[a:b], w[a:b]] + lp[a:b], at)
    beta[length, np.arange(len(words))] = 0
    order = np.lexsort((w, s))
    cuts = np.searchsorted(s[order], np.arange(longest + 1))
    for d in range(longest - 1, -1, -1):
        o = order[cuts[d] : cuts[d + 1]]
        at = np.flatnonzero(np.r_[True, w[o][1:] != w[o][:-1]])
        beta[d, w[o][at]] = log_sums(beta[end[o], w[o]] + lp[o], at)
    share = np.exp(alpha[s, w] + lp + beta[end, w] - alpha[length[w], w]) * weight[w]
    np.add.at(out, (lang[w], piece), share)


class Model:
    """Languages and per-language log probabilities (pieces + 1 for unknown characters, languages)."""

    def __init__(self, langs: list[str], logp: np.ndarray, path: str):
        self.langs, self.logp, self.path = langs, logp, path
        self.number = uuid.uuid4().hex

    def scorer(self):
        """A function from texts to (language, score) pairs, with its own word cache."""
        known, reach, width = prefixes(self.path), longest_piece(self.path), len(self.langs)
        cache: dict[str, int] = {}
        rows = np.empty((CACHE_WORDS, width))

        def learn(words: list[str]) -> None:
            nonlocal cache, rows
            first = len(cache)
            if first + len(words) > len(rows):  # one block of texts has more words than the cache
                rows = np.concatenate((rows[:first], np.empty((len(words), width))))
            for i in range(0, len(words), 4096):
                part = [MARK + x for x in words[i : i + 4096]]
                rows[first + i : first + i + len(part)] = forward(part, self.logp, known, reach)
            cache.update(zip(words, range(first, first + len(words))))

        def totals(some: list[list[str]]) -> np.ndarray:
            """Summed scores of each list of words."""
            nonlocal cache, rows
            new = set().union(*some).difference(cache)
            if cache and len(cache) + len(new) > CACHE_WORDS:  # what came first is the most frequent
                cache = dict(islice(cache.items(), CACHE_WORDS // 2))
                rows = rows[:CACHE_WORDS] if len(rows) > CACHE_WORDS else rows
                new = set().union(*some).difference(cache)
            learn(sorted(new))
            size = np.fromiter(map(len, some), np.int64, len(some))
            out = np.zeros((len(some), width))
            if size.any():
                at = np.fromiter(map(cache.__getitem__, chain.from_iterable(some)), np.int64, int(size.sum()))
                begin = (np.cumsum(size) - size)[size > 0]
                out[size > 0] = np.add.reduceat(rows[at], begin)
            return out

        def predict(texts: list[str]) -> list[tuple[str, float]]:
            total, count = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
            held: list[tuple[int, list[str]]] = []
            size = 0

            def flush():
                if held and width:
                    np.add.at(total, [i for i, _ in held], totals([w for _, w in held]))
                held.clear()

            for i, t in enumerate(texts):
                for part in parts(t):
                    words = words_of(part)
                    count[i] += len(words)
                    held.append((i, words))
                    size += len(part)
                    if size > BLOCK_CHARS:
                        flush()
                        size = 0
            flush()
            out = []
            for n, row in zip(count.tolist(), total):
                if not n or not width:
                    out.append(("und", 0.0))
                    continue
                p = np.exp(row - row.max())
                best = int(p.argmax())
                out.append((self.langs[best], float(p[best] / p.sum())))
            return out

        return predict


def train(samples: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Fit on about ``rows`` labelled rows at most. The driver gets one number for each language and piece of the vocabulary."""
    path = path or vocabulary_path()
    small_batches(samples.sparkSession)
    known, size = prefixes(path), len(pieces(path)) + 1
    labelled = samples.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(key, text, lang)
    share = hashed_share(labelled, key, rows)
    word_schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    count_schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())])

    def split(batches):
        for b in batches:
            counts: dict = {}
            for x, t in zip(b.column(1).to_pylist(), strings(b.column(0))):
                for word in words_of(t):
                    counts[x, word] = counts.get((x, word), 0) + 1
            yield batch_of(word_schema, [x for x, _ in counts], [word for _, word in counts], list(counts.values()))

    words = written(share.select(text, lang).mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}
    logp = np.full((size, len(langs)), -np.log(size))
    logp[-1] = UNKNOWN

    for _ in range(rounds if langs else 0):
        held = samples.sparkSession.sparkContext.broadcast(logp)

        def step(batches, held=held):
            known = prefixes(path)
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.to_pydict()
                total = expected_counts([MARK + w for w in x["word"]], np.array([place[g] for g in x["lang"]]), np.array(x["n"], float), held.value, known, longest_piece(path))
                g, p = np.nonzero(total)
                yield batch_of(count_schema, [langs[i] for i in g], p.astype(np.int32), total[g, p])

        counts = np.zeros((size, len(langs)))
        for r in words.mapInArrow(step, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece, place[r.lang]] = r.n
        counts[-1] = 0
        total = counts.sum(0, keepdims=True)
        logp = np.log(counts / np.maximum(total, 1e-300) + SMOOTH) - np.log(1 + SMOOTH * size)
        logp[-1] = UNKNOWN
    return Model(langs, logp, path)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: labelled, and outside the held-out fifth."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).filter("text is not null and lang is not null")


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns with lang_pred and score (or other ``names``) for each row; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.path))
    number = model.number
    fields = [f for f in docs.select(*(F.col(f"`{c}`") for c in keep)).schema.fields]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    columns = [f.name for f in fields] + list(names)

    def mark(batches):
        predict = resident(number, lambda: Model(*held.value).scorer())
        for b in batches:
            found = predict(strings(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=columns)

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(fresh("__text", list(keep)))).mapInArrow(mark, out)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))

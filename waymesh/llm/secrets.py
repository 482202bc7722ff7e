"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained from labelled samples: one from secrets (random strings), one from
ordinary words and identifiers. The corpus labels its own: what the base patterns find is a secret, and what else is
shaped like words is ordinary; ordinary are also the identifiers that joining common words of code makes (``WORDS``, as
prose holds few identifiers). Each model is the mean of two, so that neither source outweighs the other: random is
trained and uniform, ordinary is trained and joined words. A candidate token is reported when the mean log-likelihood ratio per character and
the total both exceed their thresholds. Neither scan drops or caps anything; every whole text is read once by the
sampler's share and once by the scan.

Defined cases: a null text is the empty text; an empty text has no span; repeated rows give repeated results; a null
doc_id (or one that is no number) is null; an empty table gives an empty result; without labelled secrets or words the
models are the uniform one and that of joined words, so it still works on a table that has none; extra columns are
ignored; very long texts are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, hashed_share, small_batches, strings

#: The base patterns, by kind, in the order of their listing.
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models score.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: What counts as an ordinary identifier or word: runs of one kind, no single letters among them but the first.
ORDINARY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]+))*[+/_=-]*")
#: Common words of code, from which ordinary identifiers are made.
WORDS = """abstract access account action active adapter add address admin agent alert alias all append apply archive array assert async attribute audio author back background base batch before bind bit block body bool border bound branch bridge browser buffer build button byte cache call cancel
case channel char check child class clean clear click client clock close cloud cluster code color column command commit common compare component config connect console const content context control convert copy core count create cursor custom data date debug decode default delete
depth description device dialog disable display document domain double down download draft driver drop dynamic edit element email empty enable encode end engine entity entry environment error event exception execute exit export expression extension factory failed feature fetch field file
filter find first flag float focus folder font format forward frame from function generate get global graph grid group handle hash head header height hide history hook host icon image import index info init input insert instance int internal invalid item iterator java job join key label
language layer layout length level library limit line link list listen load local lock log login loop main manager map mask match max media member memory menu merge message meta method metric min mode model module mouse move name native network next node normal not number object offset on open option order
output owner package page panel param parent parse password path pattern pending play plugin point policy pool port position post prefix primary print private process product profile project property protocol provider proxy public push query queue range rate read record redirect reference register
remote remove render replace report request require reset resource response result return role root route row rule run save scale schema scope screen script scroll search section security select send server service session set settings shape shift show size socket sort source span stack start state static status step
stop storage store stream string style submit support switch sync system table target task template test text theme thread time title toggle token tool top trace transform tree type unit update upload url user util valid value variable vector version view virtual visible wait warning web width window with word work wrapper write""".split()

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(ALPHABET)
SIZE = START + 1
CODE = np.full(128, -1, np.int16)
CODE[[ord(c) for c in ALPHABET]] = range(START)

#: Parameters: at most about so many rows are sampled for training; a reported token needs so much evidence.
TRAIN_ROWS = 20_000
MEAN_LLR = 0.9
TOTAL_LLR = 16.0


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, start and end of the secret itself), leftmost and non-overlapping per kind."""
    out = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), m.start(group), m.end(group)))
    return sorted(out)


def transitions(token: str) -> np.ndarray:
    """Flat transition numbers of a token over ALPHABET, from the start state on."""
    codes = CODE[np.frombuffer(token.encode(), np.uint8)].astype(np.int64)
    return np.concatenate(([START], codes[:-1])) * SIZE + codes


def sample_counts(spans_and_texts) -> dict[int, Counter]:
    """Transition counts of labelled tokens: 1 for secrets found by the base patterns, 0 for identifiers and words elsewhere."""
    tokens = {0: Counter(), 1: Counter()}
    for text in spans_and_texts:
        spans = base_spans(text)
        taken = covered([(s, e) for s, _, e, _, _ in spans])
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{4,}", text):
            if not taken(m.start(), m.end()):
                if ORDINARY.fullmatch(m[0]):
                    tokens[0][m[0]] += 1
        for s, e in {(s, e) for _, _, _, s, e in spans}:
            tokens[1].update(re.findall(r"[A-Za-z0-9+/_=-]{4,}", text[s:e]))
    out = {0: Counter(), 1: Counter()}
    for label, found in tokens.items():
        for token, n in found.items():
            for t in transitions(token).tolist():
                out[label][t] += n
    return out


def joined_words() -> Counter:
    """Transition counts of identifiers of two or three words of WORDS, in the usual ways of writing them, and of runs of one character (rules, padding)."""
    out = Counter(t for c in ALPHABET for t in transitions(c * (40 if c.isalnum() else 2000)).tolist())
    n = len(WORDS)
    for i, a in enumerate(WORDS):
        for step in (37, 101, 211):
            b, c = WORDS[(i + step) % n], WORDS[(i + 2 * step) % n]
            upper, camel = [x.upper() for x in (a, b, c)], [x.capitalize() for x in (a, b, c)]
            for token in (a + camel[1] + camel[2], "".join(camel), upper[0] + camel[1] + camel[2], camel[0] + upper[1], "_".join((a, b, c)), "_".join(upper), "-".join((a, b)), "/".join((a, b, c)), f"{a}{step % 10}", f"{a}_{b}_{step}"):
                out.update(transitions(token).tolist())
    return out


def log_ratio(counts: dict[int, dict[int, float]], prior: float = 0.5) -> np.ndarray:
    """log P(next | previous; random) - log P(next | previous; ordinary), smoothed, over (SIZE x SIZE)."""

    def model(found) -> np.ndarray:
        c = np.full((SIZE, SIZE), prior / 10)
        for k, n in found.items():
            c[k // SIZE, k % SIZE] += n
        c[:, START] = 0
        return c / c.sum(1, keepdims=True)

    uniform = np.full((SIZE, SIZE), 1 / START)
    joined = model(joined_words())
    ordinary = (model(counts[0]) + joined) / 2 if counts.get(0) else joined
    with np.errstate(divide="ignore", invalid="ignore"):
        table = np.log((model(counts.get(1, {})) + uniform) / 2) - np.log(ordinary)
    table[:, START] = 0
    return table


def train(samples: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit both models on a bounded share of ``samples`` (about ``rows`` rows at most). What comes to the driver is one count for each pair of characters and label."""
    schema = pa.schema([("label", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = {0: Counter(), 1: Counter()}
        for b in batches:
            for label, c in sample_counts(strings(b.column(0))).items():
                total[label].update(c)
        flat = [(label, k, n) for label, c in total.items() for k, n in c.items()]
        yield batch_of(schema, *(list(zip(*flat)) or ([], [], [])))

    share = hashed_share(samples.select(key, text), key, rows).select(text)
    found = share.mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for label, pair, n in found:
        counts[label][pair] = n
    return log_ratio(counts)


def covered(spans: list[tuple[int, int]]):
    """A test whether (start, end) overlaps any of the spans, in logarithmic time."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def test(s: int, e: int) -> bool:
        i = bisect.bisect_right(ends, s)
        return i < len(starts) and starts[i] < e

    return test


def is_random(token: str, flat: np.ndarray) -> bool:
    total = float(flat[transitions(token)].sum())
    return total >= TOTAL_LLR and total >= MEAN_LLR * len(token)


def scan(docs: DataFrame, ratio: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, spans array<struct<start,kind,end,secret>> with all spans by start and kind; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    flat = ratio.reshape(-1)
    known: dict[str, bool] = {}
    item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("secret", pa.string())])
    schema = pa.schema([("key", pa.int64()), ("spans", pa.list_(item))])

    def random(token: str) -> bool:
        if token not in known:
            if len(known) > 200_000:
                known.clear()
            known[token] = is_random(token, flat)
        return known[token]

    def find(batches):
        for b in batches:
            out = []
            for t in strings(b.column(1)):
                base = base_spans(t)
                spans = [(s, k, e) for s, k, e, _, _ in base]
                taken = covered([(s, e) for s, _, e in spans])
                for m in CANDIDATE.finditer(t):
                    if random(m[0]) and not taken(m.start(), m.end()):
                        spans.append((m.start(), 3, m.end()))
                out.append([{"start": s, "kind": KINDS[k], "end": e, "secret": t[s:e]} for s, k, e in sorted(spans)])
            yield batch_of(schema, b.column(0), out)

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(find, "key long, spans array<struct<start:long,kind:string,end:long,secret:string>>").withColumnRenamed("key", key)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of :func:`scan`."""
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(F.filter("spans", lambda x: x["kind"] != "markov"), label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", label)).alias("spans"),
        of("markov").alias("n_markov"),
    )

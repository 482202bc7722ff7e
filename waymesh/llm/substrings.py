"""Removal of repeated word passages by a compacted De Bruijn graph.

A window of ``WINDOW`` words is an edge from the node of its first words to the node of its last ones (all but one), both
known by 64-bit hashes, so an edge is known by 128 bits. Every word has a coordinate: documents in the order of their
ids, words in the order of the text. The work goes in four steps.

1. Anchors: every window has an anchor, its 8-word run of least hash, so equal windows have equal anchors. Only anchors
   (about one word in seven) are counted; a window whose anchor occurs once can't be repeated and is left out.
2. Edges: the windows left are grouped; an edge keeps its count, its first coordinate, and a digest of all its coordinates
   from which that of the coordinates after them follows. Hot edges combine before the shuffle.
3. Compaction: a join on nodes finds each edge's predecessor; the two are one nonbranching path if their counts, first
   coordinates and digests agree, that is if every occurrence of one goes on with the other. Paths are numbered along
   their first coordinates; only the head of each path, with its length, is kept.
4. Verification: documents look up the heads. An occurrence of a head anywhere but at the first coordinate begins a
   repeated span; the nodes at both its ends must be those of the path.

Anchors and heads go to every executor while they are below ``MAX_ROWS`` (checked before). Beyond it anchors meet the
documents' own by a semi-join, documents get the ranges of the windows to take, and heads meet the windows by a join;
the results are the same.

Defined cases: a null or word-free text has no words; documents of fewer words than a window lose none; rows of one
doc_id are one document, so of two windows at the same place in such rows none is later, and repeated rows are alike; a
null doc_id comes after all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, bytes_of, release, small_batches, written

#: Words of a window, and of the runs among which its anchor is chosen.
WINDOW, ANCHOR = 20, 8
#: Anchors, and heads of paths, that go to every executor (at most 8 and 40 bytes each).
MAX_ROWS = 2_000_000
#: Bytes whose words are hashed together.
CHUNK = 1 << 20
#: Bytes between words.
SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))

_random = np.random.default_rng(12).integers(0, 1 << 63, (3, 65536), np.uint64) * np.uint64(2) + np.uint64(1)
BYTE, PLACE, STEP = np.where(SPACE, np.uint64(0), _random[0, :256]), _random[1], int(_random[2, 0])


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, place of the first word of each text and the end); texts are data[begin[i] : begin[i + 1]]."""
    solid = ~SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = begin[:-1][np.diff(begin) > 0]
    starts[heads] = solid[heads]
    starts = np.flatnonzero(starts)
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
        at, end = starts[a:b], starts[b] if b < len(starts) else len(data)
        place = np.arange(end - at[0]) - np.repeat(at - at[0], np.diff(np.r_[at, end]))
        value = BYTE[data[at[0] : end]] * PLACE[place & 0xFFFF]
        if place.max() > 0xFFFF:  # words longer than the table of places
            value ^= np.where(value > 0, mixed((place >> 16).astype(np.uint64)), np.uint64(0))
        out[a:b] = np.add.reduceat(value, at - at[0])
        a = b
    return mixed(out), np.searchsorted(starts, begin)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last n - 1 places are left out."""
    size = max(0, len(words) - n + 1)
    out, done, block, length, step = np.zeros(size, np.uint64), 0, words, 1, STEP
    while n:
        if n & 1:
            out = out * np.uint64(step) + block[done : done + size]
            done += length
        n >>= 1
        if n:
            block = block[:-length] * np.uint64(step) + block[length:] if len(block) > length else block[:0]
            length, step = 2 * length, step * step % (1 << 64)
    return mixed(out)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of ``n`` neighbours from each place on."""
    size, length = max(0, len(x) - n + 1), 1
    while 2 * length <= n:
        x, length = np.minimum(x[:-length], x[length:]) if len(x) > length else x[:0], 2 * length
    return np.minimum(x[:size], x[n - length : n - length + size])


class Texts:
    """Words, nodes and windows of the texts of one Arrow column; places count words over all of them."""

    def __init__(self, column: pa.Array, window: int):
        self.data, self.begin = bytes_of(column)
        words, self.first = word_hashes(self.data, self.begin)
        self.size = np.diff(self.first)
        self.nodes = runs(words, window - 1)
        anchors = runs(words, min(ANCHOR, window))
        reach = window - min(ANCHOR, window) + 1
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.left = self.first[self.text + 1] - np.arange(len(self.text))  # words from each place to the end of its text
        self.at = np.flatnonzero(self.left >= window)  # places where a window begins
        self.anchor = least(anchors, reach)[self.at]
        self.anchors, self.reach = anchors, reach

    def counted(self) -> np.ndarray:
        """The hash of each place that is the anchor of some window."""
        best = np.zeros(len(self.anchors) + self.reach - 1, np.uint64)
        best[self.at + self.reach - 1] = self.anchor  # so that the windows over place p are best[p : p + reach]
        return self.anchors[~least(~best, self.reach) == self.anchors]


def coordinates(docs: DataFrame) -> tuple[DataFrame, int]:
    """(``docs`` as doc_id, base, row, text; places between bases): a word's coordinate is its document's base and its place.

    Bases are doc_ids, less the smallest, times a bound of the words of a document. Where 62 bits don't hold that, they are
    ranks of the doc_ids instead. ``row`` tells texts of one doc_id apart; where no doc_id is repeated, it is zero.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    docs = docs.select("doc_id", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("row"), "text")
    low, high, size = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    low, high, step = low or 0, high or 0, (size or 0) // 2 + 2
    if (high - low + 2) * step < 1 << 62:
        base = F.when(F.col("doc_id").isNull(), F.lit((high - low + 1) * step)).otherwise((F.col("doc_id") - low) * step)
        return docs.select("doc_id", base.cast("long").alias("base"), "row", "text"), step
    order = F.asc_nulls_last("doc_id")
    ids = docs.select("doc_id").distinct().repartitionByRange(order).sortWithinPartitions(order)
    ids = written(ids.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ids.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row for each range
    ranks = ids.join(F.broadcast(starts), "part").select(F.col("doc_id").alias("id"), ((F.col("before") + F.col("at")) * step).cast("long").alias("base"))
    return docs.join(ranks, docs.doc_id.eqNullSafe(ranks.id)).select("doc_id", "base", "row", "text"), step


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """(anchor) of every anchor that occurs twice or more."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def count(batches):
        release()
        for b in batches:
            found, n = np.unique(Texts(b.column(0), window).counted(), return_counts=True)
            yield batch_of(schema, found.view(np.int64), n)

    return docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("at", pa.int64()), ("mark", pa.int64())])
#: A prime and a base: coordinate c is marked by BASE ** c. Marks of coordinates that follow are BASE times these marks.
PRIME, BASE = (1 << 31) - 1, 1_234_567_891


def _powers(base: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % PRIME)
    return np.array(out, np.uint64)


LOW, HIGH = _powers(BASE, 1 << 16), _powers(pow(BASE, 1 << 16, PRIME), 1 << 15)


def marks(at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The mark of each coordinate, times a number of its own for each ``row`` (text of a repeated doc_id)."""
    e, p = (at % (PRIME - 1)).astype(np.uint64), np.uint64(PRIME)
    out = LOW[e & np.uint64(0xFFFF)] * HIGH[e >> np.uint64(16)] % p
    return (out * (row.view(np.uint64) % np.uint64(PRIME - 1) + np.uint64(1)) % p).view(np.int64)


def ranges(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """``docs`` with ``take``: the runs (from, size) of windows whose anchor is in ``anchors``, which is too large for the executors."""
    schema = pa.schema([("anchor", pa.int64()), ("base", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])

    def cut(batches):
        release()
        for b in batches:
            t, base = Texts(b.column(1), window), b.column(0).to_numpy(zero_copy_only=False)
            if len(t.at):
                new = np.flatnonzero(np.r_[True, (t.anchor[1:] != t.anchor[:-1]) | (t.at[1:] != t.at[:-1] + 1)])
                text = t.text[t.at[new]]
                yield batch_of(schema, t.anchor[new].view(np.int64), base[text], t.at[new] - t.first[text], np.diff(np.r_[new, len(t.at)]))

    found = docs.select("base", "text").mapInArrow(cut, "anchor long, base long, start long, size long").join(anchors, "anchor", "left_semi")
    take = found.groupBy(F.col("base").alias("its")).agg(F.collect_set(F.struct("start", "size")).alias("take"))  # as long as the document at most
    return docs.join(take, docs.base == take.its).drop("its")


def windows(docs: DataFrame, anchors: DataFrame | None, window: int, max_rows: int) -> DataFrame:
    """(src, dst, at, mark): every window whose anchor is in ``anchors``, with its coordinate."""
    few = anchors.count() <= max_rows
    held = docs.sparkSession.sparkContext.broadcast(np.sort(anchors.toArrow().column(0).to_numpy().view(np.uint64))) if few else None
    docs = docs.select("base", "row", "text", F.array().cast("array<struct<start:bigint,size:bigint>>").alias("take")) if few else ranges(docs, anchors, window).select("base", "row", "text", "take")

    def take(batches):
        release()
        for b in batches:
            t = Texts(b.column(2), window)
            if few:
                known = held.value
                keep = known[np.minimum(np.searchsorted(known, t.anchor), len(known) - 1)] == t.anchor if len(known) else np.zeros(len(t.at), bool)
            else:
                open_ = np.zeros(int(t.first[-1]) + 1, bool)
                for i, spans in enumerate(b.column(3).to_pylist()):
                    for s in spans:
                        open_[t.first[i] + s["start"] : min(t.first[i] + s["start"] + s["size"], t.first[i + 1])] = True
                keep = open_[t.at]
            at = t.at[keep]
            text = t.text[at]
            base, row = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            place = base[text] + at - t.first[text]
            yield batch_of(EDGE, t.nodes[at].view(np.int64), t.nodes[at + 1].view(np.int64), place, marks(place, row[text]))

    return docs.mapInArrow(take, "src long, dst long, at long, mark long")


def edges(found: DataFrame) -> DataFrame:
    """One row per repeated edge: src, dst, n, first coordinate, and the digest of its coordinates (the sum of their marks)."""
    grouped = found.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("mark").alias("marks"))
    return grouped.filter("n > 1").select("src", "dst", "n", "first", (F.col("marks") % PRIME).alias("marks"))


def paths(edge: DataFrame, step: int) -> DataFrame:
    """One row per nonbranching path: src and dst of its head, its first coordinate, its number of edges, and its last node."""
    before = edge.select(F.col("dst").alias("src"), (F.col("first") + 1).alias("first"), "n", (F.col("marks") * BASE % PRIME).alias("marks"), F.lit(True).alias("linked"))
    both = edge.join(before, ["src", "first", "n", "marks"], "left")
    own = Window.partitionBy(F.expr(f"first div {step}")).orderBy("first", "src", "dst")  # one document
    goes_on = F.coalesce("linked", F.lit(False)) & (F.lag("first").over(own) + 1 == F.col("first")) & (F.lag("dst").over(own) == F.col("src"))
    marked = both.withColumn("head", F.when(goes_on, 0).otherwise(1))
    named = marked.withColumn("path", F.sum("head").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("document", F.expr(f"first div {step}"))
    ends = named.groupBy("document", "path").agg(F.min("first").alias("first"), F.count("*").alias("size"), F.max(F.when(F.col("head") == 1, F.col("src"))).alias("src"), F.max(F.when(F.col("head") == 1, F.col("dst"))).alias("dst"), F.max_by("dst", "first").alias("last"))
    return ends.select("src", "dst", "first", "size", "last")


def looked_up(path: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of ``path``, rising by a key of both nodes; no key twice."""
    table = path.toArrow()
    src, dst, first, size, last = (table.column(c).to_numpy() for c in ("src", "dst", "first", "size", "last"))
    key, at = np.unique(edge_key(src, dst), return_index=True)
    return key, dst[at], first[at], size[at], last[at]


def edge_key(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return mixed(src.view(np.uint64) * np.uint64(STEP) + dst.view(np.uint64))


def deduplicate(docs: DataFrame, window: int = WINDOW, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    small_batches(docs.sparkSession)
    docs, step = coordinates(docs)
    anchors = written(anchor_counts(docs, window), "anchors")
    found = windows(docs, anchors, window, max_rows)
    path = written(paths(written(edges(found), "edges"), step), "paths")
    few = path.count() <= max_rows
    if few:
        held = docs.sparkSession.sparkContext.broadcast(looked_up(path))
        docs = docs.select("doc_id", "base", "text", F.array().cast("array<struct<at:bigint,size:bigint,src:bigint,last:bigint>>").alias("spans"))
    else:
        later = found.join(path, ["src", "dst"]).filter("at <> first")  # an edge is a head once; hot ones are split by the adaptive join
        spans = later.groupBy(F.expr(f"(at div {step}) * {step}").alias("its")).agg(F.collect_set(F.struct(F.expr(f"at % {step}").alias("at"), "size", "src", "last")).alias("spans"))
        docs = docs.join(spans, docs.base == spans.its, "left").select("doc_id", "base", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches):
        release()
        for b in batches:
            t = Texts(b.column(2), window)
            if few:
                key, dst, first, size, last = held.value
                base = b.column(1).to_numpy(zero_copy_only=False)
                src, to = t.nodes[t.at].view(np.int64), t.nodes[t.at + 1].view(np.int64)
                own = edge_key(src, to)
                k = np.minimum(np.searchsorted(key, own), len(key) - 1) if len(key) else np.zeros(0, np.int64)
                hit = np.flatnonzero((key[k] == own) & (dst[k] == to)) if len(key) else np.zeros(0, np.int64)
                at, k = t.at[hit], k[hit]
                text = t.text[at]
                later = base[text] + at - t.first[text] != first[k]
                at, size, last = at[later], size[k[later]], last[k[later]]
            else:
                rows = [(t.first[i] + s["at"], s["size"], s["last"]) for i, spans in enumerate(b.column(3).to_pylist()) for s in spans or () if s["at"] + s["size"] + window - 1 <= t.size[i] and t.nodes[t.first[i] + s["at"]].view(np.int64) == s["src"]]
                at, size, last = (np.array([r[j] for r in rows], np.int64) for j in range(3))
            inside = t.left[at] >= size + window - 1 if len(at) else np.zeros(0, bool)
            at, size, last = at[inside], size[inside], last[inside]
            true = t.nodes[at + size].view(np.int64) == last  # both ends of the span are those of the path
            edge = np.zeros(int(t.first[-1]) + 1, np.int64)
            np.add.at(edge, at[true], 1)
            np.add.at(edge, at[true] + size[true] + window - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            n_gone = np.add.reduceat(np.r_[gone, False], t.first[:-1], dtype=np.int64) * (t.size > 0) if len(t.size) else []
            kept = []
            for i, n in enumerate(n_gone):
                words = t.data[t.begin[i] : t.begin[i + 1]].tobytes().split()
                kept.append(b" ".join(words if not n else [w for w, g in zip(words, gone[t.first[i] : t.first[i + 1]].tolist()) if not g]).decode())
            yield batch_of(schema, b.column(0), t.size, n_gone, kept)

    return docs.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """The digest columns as DuckDB SQL, by hashes of all windows."""
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(words) - {window} + 2)) AS pos, words FROM d WHERE len(words) >= {window}),
    h AS (SELECT doc_id, pos, md5_number(array_to_string(words[pos:pos + {window - 1}], ' ')) AS h FROM w),
    f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM h),
    g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS pos FROM f WHERE k > 1),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
    k AS (SELECT p.doc_id, count(*) AS n, count(g.pos) AS gone, string_agg(word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

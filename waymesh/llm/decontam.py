"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Every benchmark item becomes windows of ``window`` consecutive words (an item of fewer words is one window). A window
is the set of its word shingles; containment of the whole window is asked for (threshold 1), so by the prefix filter
a document can hold a window only if it holds the window's rarest shingle. Shingles are ordered by their count in all
documents. A document position that holds a prefix shingle then passes the positional bound (the shingle's place in
the window fixes where the window would begin), the length bound (the window must end inside the document) and the
exact check of all words.

The item side is the dimension: its index goes to every executor while it is within ``max_index_bytes`` (checked
before). Beyond that (:func:`marked_by_join`) the same prefix shingles meet the documents in a shuffle join. Two Bloom
filters of fixed size keep what leaves the scans small: one of all shingles of the windows, for counting them, and one
of the prefix shingles alone, for their places; only these places, with at most a window's words on either side for
the exact check, go through the shuffle, and a very common prefix shingle is split over tasks.

Defined cases: a null or word-free text has no words and is clean; a null or word-free item has no window; repeated
items all count, by item_id; a window of an item without id counts as a hit, but such an item is not named or counted;
repeated documents each get their row; a doc_id that is no number is null; an empty table on either side gives clean
or no rows; extra columns are ignored, and kept by :func:`marked`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, fresh, release, row_hash, small_batches, strings, written

#: Fixed value: a word, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

WINDOW = 10
#: Words of a shingle that the prefix filter looks up.
SHINGLE = 2
MAX_INDEX_BYTES = 32 << 20


def words(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else text.encode().lower().decode())


def windows(item: str, window: int = WINDOW) -> list[tuple[str, ...]]:
    w = words(item)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


def shingles(w: tuple[str, ...] | list[str], n: int = SHINGLE) -> list[str]:
    """Word shingles of up to n words; a shorter window is its own shingle."""
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id string, win array<string>) for each distinct window of each item."""
    schema = pa.schema([("item_id", pa.string()), ("win", pa.list_(pa.string()))])

    def cut(batches):
        for b in batches:
            found = [(i, list(w)) for i, t in zip(b.column(0).to_pylist(), strings(b.column(1))) for w in dict.fromkeys(windows(t, window))]
            yield batch_of(schema, [i for i, _ in found], [w for _, w in found])

    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text)).mapInArrow(cut, "item_id string, win array<string>").distinct()


def shingle_counts(docs: DataFrame, wanted: frozenset[str], text: str = "text", n: int = SHINGLE) -> dict[str, int]:
    """Counts over all documents of the shingles in ``wanted`` (which is bounded, as the index is)."""
    schema = pa.schema([("s", pa.string()), ("n", pa.int64())])
    firsts = frozenset(s.split(" ", 1)[0] for s in wanted)
    alone = frozenset(s for s in wanted if " " not in s)

    def count(batches):
        release()
        total: Counter = Counter()
        for b in batches:
            for t in strings(b.column(0)):
                w = words(t)
                at = [i for i, x in enumerate(w) if x in firsts]
                total.update(x for x in (" ".join(w[i : i + n]) for i in at) if x in wanted)
                if alone:
                    total.update(w[i] for i in at if w[i] in alone)
        yield batch_of(schema, list(total), list(total.values()))

    return {r.s: r.n for r in docs.select(text).mapInArrow(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}


def rarest(win: tuple[str, ...], counts: dict[str, int]) -> tuple[str, int]:
    """The window's rarest shingle (ties: the smaller one) and its first place."""
    s = shingles(win)
    return min((counts.get(x, 0), x, -i) for i, x in enumerate(s))[1], s.index(min(s, key=lambda x: (counts.get(x, 0), x)))


def build_index(wins: list[tuple[str | None, tuple[str, ...]]], counts: dict[str, int]):
    """first word of the prefix shingle -> its second word (or '') -> [(place in the window, window words, item ids)]."""
    items = defaultdict(set)
    for item, win in wins:
        items[win].update(() if item is None else (item,))
    index: dict = {}
    for win in sorted(items):
        s, at = rarest(win, counts)
        one, _, two = s.partition(" ")
        index.setdefault(one, {}).setdefault(two, []).append((at, win, tuple(sorted(items[win]))))
    return index


def hits(w: list[str], index: dict) -> tuple[int, set[str]]:
    """Words of the document inside any occurrence of a window, and the items of those windows."""
    starts: list[tuple[int, int]] = []
    found: set[str] = set()
    n = len(w)
    for i in [i for i, x in enumerate(w) if x in index]:
        after = index[w[i]]
        for second in ("", w[i + 1]) if i + 1 < n else ("",):
            for at, win, ids in after.get(second, ()):
                b = i - at
                e = b + len(win)
                if b >= 0 and e <= n and tuple(w[b:e]) == win:
                    starts.append((b, e))
                    found.update(ids)
    hit, end = 0, 0
    for b, e in sorted(starts):
        hit += max(0, e - max(b, end))
        end = max(end, e)
    return hit, found


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, max_index_bytes)
    return found.select("doc_id", f"{MARK}.*")


MARK = "__decontam"


def marked(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """All columns of ``docs`` (one of them ``text``) and a struct column ``MARK`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    small_batches(docs.sparkSession)
    wins = written(item_windows(items, window), "windows")
    size = wins.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "win")) + 100), F.lit(0))).first()[0]
    if size > max_index_bytes:
        return marked_by_join(docs, wins)
    pairs = [(r.item_id, tuple(r.win)) for r in wins.collect()]
    counts = shingle_counts(docs, frozenset(s for _, w in pairs for s in shingles(w))) if pairs else {}
    held = docs.sparkSession.sparkContext.broadcast(build_index(pairs, counts))
    result = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    none = digest(())
    names = [*docs.columns, MARK]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {MARK} struct<{FOUND.replace(' long', ':long').replace(' string', ':string').replace(' boolean', ':boolean')}>"

    def scan(batches):
        index = held.value
        for b in batches:
            rows = []
            for t in strings(b.column(b.num_columns - 1)):
                w = words(t)
                hit, found = hits(w, index)
                rows.append({"n_words": len(w), "n_hit": hit, "n_items": len(found), "items_sha256": digest(found) if found else none, "contaminated": hit > 0})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, result)], names=names)

    return docs.select("*", F.col("text").alias(fresh("__text", docs.columns))).mapInArrow(scan, out)


#: Bits of a Bloom filter, and how far a very common shingle is split: one in SHARE of all places, over PARTS tasks.
BLOOM_BITS = 1 << 26
SHARE, PARTS = 1000, 64


def bloom_bits(hashes: np.ndarray) -> np.ndarray:
    """The two bits of each hash."""
    return np.stack([hashes & np.uint64(BLOOM_BITS - 1), hashes >> np.uint64(32) & np.uint64(BLOOM_BITS - 1)])


def bloom(shingle: DataFrame) -> np.ndarray:
    """The filter of a table's column ``s``, as 64-bit words; at most BLOOM_BITS / 64 rows come to the driver."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def cut(batches):
        for b in batches:
            at = np.unique(bloom_bits(np.fromiter(map(xxhash.xxh64_intdigest, b.column(0).to_pylist()), np.uint64)))
            yield batch_of(schema, (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64))

    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    for word, bits in shingle.select("s").mapInArrow(cut, "word long, bits long").groupBy("word").agg(F.bit_or("bits")).collect():
        out[word] = np.int64(bits).view(np.uint64)
    return out


def passing(w: list[str], table: np.ndarray, n: int = SHINGLE):
    """(place, shingle) of each shingle of ``w`` that the filter may hold."""
    for size in dict.fromkeys((1, n)):
        for begin in range(0, max(0, len(w) - size + 1), 65536):
            some = [" ".join(w[i : i + size]) for i in range(begin, min(begin + 65536, len(w) - size + 1))]
            a, b = bloom_bits(np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some)))
            held = (table[a >> np.uint64(6)] >> (a & np.uint64(63))) & (table[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)
            for i in np.flatnonzero(held).tolist():
                yield begin + i, some[i]


def marked_by_join(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """What :func:`marked` gives, where the item side is too large for the executors.

    A document is known by two hashes of its whole row, so equal rows share their hits and each keeps its own row.
    """
    spark, n = docs.sparkSession, SHINGLE
    reach = wins.agg(F.max(F.size("win"))).first()[0] or 0
    cutter = f"array_distinct(transform(sequence(0, greatest(0, size(win) - {n})), i -> array_join(slice(win, i + 1, {n}), ' ')))"
    keyed = wins.groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).withColumn("win_id", F.monotonically_increasing_id())
    keyed = written(keyed, "window-ids")
    shingle = keyed.select("win_id", F.explode(F.expr(cutter)).alias("s"))
    every = spark.sparkContext.broadcast(bloom(shingle.select("s").distinct()))

    def count(batches):
        release()
        for b in batches:
            total: Counter = Counter()
            for t in strings(b.column(0)):
                total.update(s for _, s in passing(words(t), every.value))
            yield batch_of(pa.schema([("s", pa.string()), ("n", pa.int64())]), list(total), list(total.values()))

    counts = docs.select("text").mapInArrow(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    ranked = shingle.join(counts, "s", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "s")).alias("first"))
    prefix = ranked.select("win_id", F.col("first.s").alias("s"), F.col("first.n").alias("n")).join(keyed, "win_id")
    place = f"array_position(transform(sequence(0, greatest(0, size(win) - {n})), i -> array_join(slice(win, i + 1, {n}), ' ')), s) - 1"
    prefix = written(prefix.select("s", "n", "win", "ids", F.expr(place).cast("long").alias("place")), "prefix")
    first = spark.sparkContext.broadcast(bloom(prefix.select("s").distinct()))
    total = prefix.select("s", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = [r.s for r in prefix.filter(F.col("n") > max(10_000, total // SHARE)).select("s").distinct().collect()]  # at most SHARE of them

    row = [row_hash(docs.columns, seed).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]
    base = docs.select(*row, F.col("text").alias("__text"))
    item = pa.struct([("s", pa.string()), ("at", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(item))])

    def places(batches):
        release()
        for b in batches:
            for k1, k2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2))):
                w = words(t)
                found = [{"s": s, "at": i, "left": w[max(0, i - reach) : i], "right": w[i : i + reach]} for i, s in passing(w, first.value)]
                for j in range(0, max(1, len(found)), 4096):
                    yield batch_of(schema, [k1], [k2], [len(w)], [found[j : j + 4096]])

    seen = written(base.mapInArrow(places, "k1 long, k2 long, n_words long, places array<struct<s:string,at:long,left:array<string>,right:array<string>>>"), "places")
    at = seen.select("k1", "k2", F.inline("places"))
    hot = F.col("s").isin(common) if common else F.lit(False)
    at = at.withColumn("part", F.when(hot, F.pmod(F.col("k1"), F.lit(PARTS)).cast("int")).otherwise(0))
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    back = F.expr("slice(left, cast(greatest(1, size(left) - place + 1) as int), cast(place as int))")
    met = at.join(prefix.withColumn("part", F.explode(parts)), ["s", "part"]).filter(F.size("left") >= F.col("place")).filter(F.concat(back, F.expr("slice(right, 1, cast(size(win) - place as int))")) == F.col("win"))
    met = written(met.select("k1", "k2", (F.col("at") - F.col("place")).alias("b"), (F.col("at") - F.col("place") + F.size("win")).alias("e"), "ids").distinct(), "met")
    over = Window.partitionBy("k1", "k2").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = met.groupBy("k1", "k2", "b").agg(F.max("e").alias("e")).withColumn("before", F.coalesce(F.max("e").over(over), F.lit(0)))
    n_hit = spans.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("b", "before"))).cast("long").alias("n_hit"))
    named = met.select("k1", "k2", F.explode("ids").alias("item")).distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sizes = seen.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    told = sizes.join(n_hit, ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
    items, hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    result = F.struct("n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
    keys = [fresh("__k1", docs.columns), fresh("__k2", docs.columns)]
    told = told.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), result.alias(MARK))
    return docs.select("*", *(c.alias(k) for c, k in zip(row, keys))).join(told, keys).select(*(F.col(f"`{c}`") for c in docs.columns), MARK)

"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Equal fingerprints are merged first,
so copies cost one row each and no pair. Two different fingerprints that differ in at most ``2`` bits agree on at
least two of their four 16-bit quarters: every fingerprint goes to six blocks, one for each pair of quarters. In a
block (and, where a block holds more than ``SPLIT_ABOVE`` fingerprints, in six sub-blocks by the bytes of the other
half, so that at most 65,536 fingerprints can ever share one) the fingerprints are sorted by Gray rank and a tree is
built upwards over runs of neighbours: each node keeps the bits on which all its members agree (mask and value). The
self-join walks pairs of nodes from the top; the differences on the bits fixed so far accumulate, and a pair of nodes
is dropped with all its members once they exceed the threshold. Each block hands on a spanning tree of its links of
bounded degree instead of all pairs, which loses no connection.

Defined cases: a null or word-free text has fingerprint zero, linked like any other; fewer words than a shingle give
one shingle of the whole sequence; rows with a null doc_id (or one that is no number) take part and link like others,
and a component's id is its smallest doc_id that is not null (null if there is none); repeated rows stay; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, release, small_batches, written
from .components import connected_components, split_join

SHINGLE_WORDS = 3
SEED = 42
BITS = 2
#: Members of the lowest nodes, and children of each upper node.
FANOUT = 8
SPLIT_ABOVE = 4096


def tally(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    total = max(1, len(words) - n + 1)
    votes = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for i in range(0, total, 65536):
        votes += tally(np.fromiter(hashes, np.uint64, min(65536, total - i)))
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def mark(batches):
        release()
        for b in batches:
            fps = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64)
            yield batch_of(schema, b.column(0), pa.array(fps.view(np.int64)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


ALL = np.uint64(2**64 - 1)


def hierarchy(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (mask, value) from the leaves (full mask) up to one root, over fps in Gray order."""
    levels = [(np.full(len(fps), ALL), fps)]
    while len(levels[-1][0]) > 1:
        mask, value = levels[-1]
        at = np.arange(0, len(mask), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(value & mask, at), np.bitwise_and.reduceat(~value & mask, at)
        levels.append((ones | zeros, ones))
    return levels


def near_pairs(fps: np.ndarray, bits: int = BITS, chunk: int = 1 << 20):
    """Yields arrays (i, j), i < j, of all places in ``fps`` (distinct, in Gray order) that differ in at most ``bits`` bits."""
    levels = hierarchy(fps)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        mask, value = levels[level]
        keep = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= bits
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        size, step = len(levels[level - 1][0]), max(1, chunk // FANOUT**2)
        for i in range(0, len(a), step):
            x = (a[i : i + step, None] * FANOUT + np.arange(FANOUT))[:, :, None] + np.zeros(FANOUT, np.int64)
            y = (b[i : i + step, None] * FANOUT + np.arange(FANOUT))[:, None, :] + np.zeros((FANOUT, 1), np.int64)
            ok = (x < size) & (y < size) & ((x < y) if level == 1 else (x <= y))
            stack.append((level - 1, x[ok], y[ok]))


def spanning_links(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that connect the same places as all near pairs do: in each component, member k to member (k - 1) // 2, so no place has more than three."""
    root = np.arange(len(fps))
    for a, b in near_pairs(fps, bits):
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    order = np.argsort(root, kind="stable")
    groups = root[order]
    first = np.r_[True, groups[1:] != groups[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    k = np.arange(len(order)) - begin
    return order[~first], order[(begin + (k - 1) // 2)[~first]]


QUARTERS = list(combinations(range(4), 2))
BYTES = list(combinations(range(4), 2))


def links(classes: DataFrame) -> DataFrame:
    """(src, dst): representatives of different fingerprints (fp, rep) whose links connect all that differ in at most two bits."""
    quarter = lambda q: F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)
    keys = F.array(*(F.lit(k << 32).bitwiseOR(F.shiftleft(quarter(i), 16)).bitwiseOR(quarter(j)) for k, (i, j) in enumerate(QUARTERS)))
    dealt = classes.select(F.explode(keys).alias("block"), "fp", "rep")
    sizes = written(dealt.groupBy("block").count().filter("count > 1").select("block", "count"), "blocks")
    large = sizes.filter(F.col("count") > SPLIT_ABOVE).select("block")
    rest = lambda k: [q for q in range(4) if q not in QUARTERS[k]]
    half = F.element_at(F.array(*(F.shiftleft(quarter(rest(k)[0]), 16).bitwiseOR(quarter(rest(k)[1])) for k in range(6))), (F.shiftrightunsigned("block", 32) + 1).cast("int"))
    byte = lambda q: F.shiftrightunsigned(F.col("half"), 8 * q).bitwiseAND(0xFF)
    fine = F.array(*(F.lit((k + 1) << 16).bitwiseOR(F.shiftleft(byte(i), 8)).bitwiseOR(byte(j)) for k, (i, j) in enumerate(BYTES)))
    if large.limit(1).count():
        dealt = dealt.join(large.withColumn("large", F.lit(True)), "block", "left").withColumn("half", half)
        dealt = dealt.select("block", F.explode(F.when(F.col("large"), fine).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"), "fp", "rep")
    else:
        dealt = dealt.withColumn("sub", F.lit(0).cast("long"))
    dealt = dealt.select("block", "sub", "fp", "rep").repartition(F.col("block"), F.col("sub")).sortWithinPartitions("block", "sub")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def join(batches):
        held = [np.empty((0, 4), np.int64)]

        def joined(block: np.ndarray):
            at = np.flatnonzero(np.r_[True, (block[1:, :2] != block[:-1, :2]).any(1)]) if len(block) else np.empty(0, np.int64)
            ends = np.r_[at[1:], len(block)]
            many = ends - at > 1
            src, dst = [], []
            for s, e in zip(at[many].tolist(), ends[many].tolist()):
                fps, reps = block[s:e, 2].view(np.uint64) if e - s > 1 else None, block[s:e, 3]
                if e - s == 2:
                    if int(fps[0] ^ fps[1]).bit_count() <= BITS:
                        src.append(reps[:1])
                        dst.append(reps[1:])
                    continue
                order = np.argsort(gray_rank(np.ascontiguousarray(fps)), kind="stable")
                a, b = spanning_links(np.ascontiguousarray(fps[order]))
                src.append(reps[order][a])
                dst.append(reps[order][b])
            if src:
                yield batch_of(schema, np.concatenate(src), np.concatenate(dst))

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            if (rows[-1, :2] != held[1][0, :2]).any():  # all but the last block are whole
                whole = np.concatenate(held)
                last = np.flatnonzero((whole[:, :2] != whole[-1, :2]).any(1))[-1] + 1
                yield from joined(whole[:last])
                held = [np.empty((0, 4), np.int64), whole[last:]]
        yield from joined(np.concatenate(held))

    return dealt.mapInArrow(join, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id. The fingerprint itself is the node, so rows without an id link like others."""
    marked = written(fingerprints(docs), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = written(connected_components(links(classes.select("fp", F.col("fp").alias("rep")))), "components")
    linked = classes.join(found, classes.fp == found.node)
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = split_join(linked.select("fp", "component"), ids, "component", "fp").select("fp", "component_id")
    whole = classes.select("fp", "least").join(linked.withColumn("linked", F.lit(True)), "fp", "left")
    whole = written(whole.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "whole")
    return split_join(marked, whole, "fp", "doc_id").select("doc_id", "fp", "component_id")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

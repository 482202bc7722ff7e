"""Near-duplicates by the Jaccard similarity of word shingles: every pair of at least 0.8 is linked, none is missed.

No Hamming radius on fingerprints keeps all such pairs, so candidates come from a prefix filter: in one order of all
shingles, two sets of similarity 0.8 share one of the first ``n - ceil(0.8 n) + 1`` of each. The order (common shingles
last, counted on a sample) decides only how many candidates there are. Rows of equal sets are one class; the classes
that share a prefix shingle are a group. A group is parted where neighbours in size differ by more than a fifth, then
where parity bitmaps (two sets differ in at least as many shingles as their bitmaps in bits; a bitmap has at least two
bits a shingle) show that no pair can be similar; what chains of parts connect is searched exactly, by breadth, against
the members not reached yet, so each set is moved once.

No task holds more than a bounded number of members: a group of over ``HELD`` classes goes on unparted, row by row. A
chain whose sets have over ``CHAIN_BYTES`` is cut into blocks. Its members are held against one of them, the pivot, each
by itself; those that link to it need no search among each other, and what is left is searched in pairs of blocks, each
pair by a task, so that every pair of members but those of the pivot meets.

Defined cases: words are those of ``simhash``; fewer words than a shingle give one shingle of the whole sequence; a null
or word-free text has the shingle of the empty sequence; rows with a null doc_id (or one that is no number) link like
others, and a component's id is its smallest doc_id that is not null (null if there is none); repeated rows stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, hashed_share, release, small_batches, written
from .components import connected_components, split_join

SHINGLE_WORDS = 5
SEED = 42
#: Similarity of a link at least, as a fraction.
OVER, UNDER = 4, 5
#: Rows on which common shingles are counted, and common shingles that are put last; both change the work, not the result.
SAMPLE_ROWS, COMMON = 10_000, 100_000
#: Bits of a parity bitmap at least.
BITMAP = 2048
#: Members that one task holds of a group, and bytes of sets that it holds of a chain.
HELD = 200_000
CHAIN_BYTES = 32 << 20


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of hashes of the text's word shingles, in rising order."""
    words = (text or "").encode().lower().split()
    found = [b" ".join(words)] if len(words) <= n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64))


def key_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not in ``common`` (rising) by hash, then the others by rank."""
    n = len(hashes)
    size = n - (OVER * n + UNDER - 1) // UNDER + 1
    place = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        place = np.where(common[at] == hashes, rank[at] + 1, 0)
    return hashes[np.argsort(place, kind="stable")[:size]]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each bit; the number of bits is a power of two that grows with the set."""
    bits = max(BITMAP, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of words) of half as many bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def possible(size: np.ndarray, maps: list[bytes]) -> list[np.ndarray]:
    """Places of more than one set that chains of possible links connect; ``size`` rises, and so the bitmaps grow."""
    width = np.array([len(m) for m in maps])
    begin = np.flatnonzero(np.r_[True, width[1:] != width[:-1]])
    levels = [(s, e, np.frombuffer(b"".join(maps[s:e]), np.uint64).reshape(e - s, -1)) for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(maps)])]
    left, out = np.arange(len(size)), []
    while len(left):
        queue, chain, left = [left[0]], [left[:1]], left[1:]
        while queue and len(left):
            j = queue.pop()
            s, _, own = next(x for x in levels if x[0] <= j < x[1])
            mine = own[j - s : j - s + 1]
            a, b = np.searchsorted(size[left], [-(-OVER * size[j] // UNDER), UNDER * size[j] // OVER + 1])
            near = np.zeros(len(left), bool)
            for s, e, theirs in levels:
                lo, hi = max(a, np.searchsorted(left, s)), min(b, np.searchsorted(left, e))
                if lo >= hi:
                    continue
                x, y = theirs[left[lo:hi] - s], mine
                while x.shape[1] > y.shape[1]:
                    x = folded(x)
                while y.shape[1] > x.shape[1]:
                    y = folded(y)
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                near[lo:hi] = apart * (OVER + UNDER) <= (UNDER - OVER) * (size[left[lo:hi]] + size[j])
            queue += left[near].tolist()
            chain.append(left[near])
            left = left[~near]
        chain = np.concatenate(chain)
        if len(chain) > 1:
            out.append(chain)
    return out


def components(sets: list[np.ndarray]) -> list[int]:
    """For each set the smallest place of a set that a chain of links reaches. The list is emptied, so that its sets are held once."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    whole = np.concatenate([sets[i] for i in order])
    sets.clear()
    place = np.argsort(whole, kind="stable")  # numbers for hashes, as np.unique has them, in less memory
    whole = whole[place]
    number = np.cumsum(np.r_[False, whole[1:] != whole[:-1]], dtype=np.int32)
    del whole
    flat = np.empty(len(number), np.int32)
    flat[place] = number
    mark, begin = np.zeros(int(number[-1]) + 1, bool), np.r_[0, np.cumsum(size)]
    del place, number
    own = [flat[begin[k] : begin[k + 1]] for k in range(len(order))]
    out = [-1] * len(order)
    left = np.arange(len(order))  # places in ``order`` not reached yet, by size, with their sets in a row
    rest, starts, reached = flat, begin[:-1], np.zeros(len(order), bool)
    for k in range(len(order)):
        if reached[k]:
            continue
        reached[k] = True
        queue, chain = [k], [k]
        while queue:
            j = queue.pop()
            open_ = left[~reached[left]]
            if not len(open_):
                break
            if 2 * len(open_) <= len(left):
                left, rest = open_, np.concatenate([own[i] for i in open_])
                starts = np.r_[0, np.cumsum(size[left])[:-1]]
            a, b = np.searchsorted(size[left], [-(-OVER * size[j] // UNDER), UNDER * size[j] // OVER + 1])
            if a == b:
                continue
            s, e = starts[a], starts[b] if b < len(left) else len(rest)
            mark[own[j]] = True
            both = np.add.reduceat(mark[rest[s:e]], starts[a:b] - s, dtype=np.int64)
            mark[own[j]] = False
            linked = left[a:b][(both * (OVER + UNDER) >= OVER * (size[left[a:b]] + size[j])) & ~reached[left[a:b]]]
            reached[linked] = True
            queue += linked.tolist()
            chain += linked.tolist()
        least = min(order[i] for i in chain)
        for i in chain:
            out[order[i]] = least
    return out


def blocks(batches, most: int):
    """(rows, whole) over sorted rows of longs: whole runs of rows with the same first column, as many as a batch ends, or a piece of one with over ``most`` rows."""
    wide = None  # first column of a run that is given in pieces
    held: list = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if wide is not None:
            n = int(np.searchsorted(rows[:, 0] != wide, True))
            if n:
                yield rows[:n], False
            rows = rows[n:]
        if not len(rows):
            continue
        wide = None
        held.append(rows)
        if rows[-1, 0] != held[0][0, 0]:  # all but the last run are whole
            whole = np.concatenate(held)
            last = np.flatnonzero(whole[:, 0] != whole[-1, 0])[-1] + 1
            yield whole[:last], True
            held = [whole[last:]]
        if sum(map(len, held)) > most:
            wide = held[0][0, 0]
            yield np.concatenate(held), False
            held = []
    if held:
        yield np.concatenate(held), True


MEMBER = pa.schema([("gid", pa.int64()), ("key", pa.int64())])


def members_of(found: list[np.ndarray]):
    """Rows (gid, key) of lists of keys; the same list has the same gid."""
    named = {key_of(keys): keys for keys in map(np.sort, found)}
    if named:
        yield batch_of(MEMBER, np.repeat(np.array(list(named), np.int64), [len(m) for m in named.values()]), np.concatenate(list(named.values())))


def groups(tokens: DataFrame, most: int = HELD) -> DataFrame:
    """(gid, key): the classes of like size that share a prefix shingle, from (token, size, key); equal groups once."""

    def gather(batches):
        release()
        for rows, whole in blocks(batches, most):
            if not whole:
                yield batch_of(MEMBER, np.full(len(rows), key_of(rows[:1, 0])), rows[:, 2])
                continue
            rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]
            cut = (rows[1:, 0] != rows[:-1, 0]) | (UNDER * rows[:-1, 1] < OVER * rows[1:, 1])
            at = np.flatnonzero(np.r_[True, cut])
            end = np.r_[at[1:], len(rows)]
            many = end - at > 1
            yield from members_of([rows[s:e, 2] for s, e in zip(at[many].tolist(), end[many].tolist())])

    return tokens.repartition(F.col("token")).sortWithinPartitions("token", "size", "key").mapInArrow(gather, "gid long, key long").distinct()


def parted(members: DataFrame, most: int = HELD) -> DataFrame:
    """(gid, key): the parts of groups (gid, size, key, map) in which bitmaps leave a link possible; equal parts once. A group of over ``most`` members, or of bitmaps of as many bytes as ``CHAIN_BYTES``, goes on in pieces under its own id."""

    def part(batches):
        release()
        gid, held, bulk, wide = None, [], 0, False

        def parts():
            keys, size = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            return [keys[p] for p in possible(size, [h[2] for h in held])]

        for batch in batches:
            found = []
            for g, size, key, row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != gid:
                    found += parts() if held and not wide else []
                    if held and wide:
                        yield batch_of(MEMBER, [gid] * len(held), [h[0] for h in held])
                    gid, held, bulk, wide = g, [], 0, False
                held.append((key, size, row))
                bulk += len(row)
                if len(held) > most or bulk > CHAIN_BYTES:
                    yield batch_of(MEMBER, [g] * len(held), [h[0] for h in held])
                    held, bulk, wide = [], 0, True
            yield from members_of(found)
        if held and wide:
            yield batch_of(MEMBER, [gid] * len(held), [h[0] for h in held])
        yield from members_of(parts() if held and not wide else [])

    return members.repartition(F.col("gid")).sortWithinPartitions("gid", "size").mapInArrow(part, "gid long, key long").distinct()


def links(members: DataFrame) -> DataFrame:
    """(src, dst): links that connect what pairs of at least 0.8 connect, from the groups' sets (gid, key, hashes)."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def search(batches):
        release()

        def searched(held):
            keys, sets = list(held), [np.frombuffer(h, np.uint64) for h in held.values()]
            held.clear()
            root = components(sets)
            return [(keys[r], keys[i]) for i, r in enumerate(root) if r != i]

        gid, held, found = None, {}, []
        for batch in batches:
            for g, key, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if g != gid:
                    found += searched(held) if len(held) > 1 else []
                    gid, held = g, {}
                held[key] = hashes
            if found:
                yield batch_of(schema, *zip(*found))
                found = []
        found += searched(held) if len(held) > 1 else []
        if found:
            yield batch_of(schema, *zip(*found))

    parts = max(64, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return members.repartition(parts, "gid").sortWithinPartitions("gid").mapInArrow(search, "src long, dst long").distinct()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return np.isin(a, b, assume_unique=True).sum() * (OVER + UNDER) >= OVER * (len(a) + len(b))


def pivoted(members: DataFrame) -> DataFrame:
    """(gid, key, size, pivot, linked): each member of large chains (gid, key, size, hashes), the pivot of its chain, and whether it links to it."""
    first = members.groupBy("gid").agg(F.min("key").alias("pivot"))
    pivot = written(members.join(first, [members.gid == first.gid, members.key == first.pivot], "left_semi").select("gid", F.col("key").alias("pivot"), F.col("hashes").alias("its")), "pivots")

    def hold(batches):
        release()
        schema = pa.schema([("gid", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("pivot", pa.int64()), ("linked", pa.bool_())])
        for b in batches:
            pairs = zip(b.column("hashes").to_pylist(), b.column("its").to_pylist())
            yield batch_of(schema, *(b.column(c) for c in ("gid", "key", "size", "pivot")), [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs])

    return split_join(members, pivot, "gid", "key").mapInArrow(hold, "gid long, key long, size long, pivot long, linked boolean")


def chain_links(found: DataFrame, sets: DataFrame, chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """(src, dst): what :func:`links` gives for chains (gid, key, size) and sets (key, hashes), where no task holds more sets than twice ``chain_bytes`` of a chain."""
    total = found.groupBy("gid").agg(F.sum("size").alias("all")).filter(F.col("all") * 8 > chain_bytes)
    large = written(total, "large-chains")
    if not large.limit(1).count():
        return links(found.join(sets, "key").select("gid", "key", "hashes"))
    plain = found.join(large, "gid", "left_anti").select("gid", "key")
    wide = written(found.join(large.select("gid"), "gid", "left_semi").join(sets, "key").select("gid", "key", "size", "hashes"), "large-sets")
    marked = written(pivoted(wide), "pivoted")
    star = marked.filter("linked and key <> pivot").select(F.col("pivot").alias("src"), F.col("key").alias("dst"))
    blocks_of = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) * 8 / chain_bytes)).cast("int")
    counts = marked.groupBy("gid").agg(blocks_of(F.sum(F.when(F.col("linked"), F.col("size")))).alias("near"), blocks_of(F.sum(F.when(~F.col("linked"), F.col("size")))).alias("far"), F.bool_or(~F.col("linked")).alias("open")).filter("open")
    dealt = marked.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "gid").withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("linked"), F.col("near")).otherwise(F.col("far"))).cast("int"))
    # a linked member meets all blocks of open ones; an open one meets all blocks of either kind
    met = F.when(F.col("linked"), F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda o: F.struct(o.alias("a"), F.col("block").alias("b"), F.lit(True).alias("star")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("near") - 1), lambda o: F.struct(F.col("block").alias("a"), o.alias("b"), F.lit(True).alias("star"))),
            F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"), F.lit(False).alias("star"))),
        )
    )
    pairs = dealt.select("gid", "key", F.explode(met).alias("m")).select(F.xxhash64("gid", "m.a", "m.b", "m.star").alias("gid"), "key")
    return links(plain.union(pairs).join(sets, "key").select("gid", "key", "hashes")).union(star)


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several rows of a sample (rising), and their ranks by count."""

    def mark(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, n).view(np.int64))], ["token"])

    sample = hashed_share(docs.select("text"), "text", SAMPLE_ROWS)
    counted = sample.select("text").mapInArrow(mark, "token long").groupBy("token").count().filter("count > 2")
    rows = counted.orderBy(F.desc("count"), "token").limit(COMMON).collect()
    token = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(rows) - np.arange(len(rows)))[order]


def group_links(marked: DataFrame, also: DataFrame) -> DataFrame:
    """(src, dst): links from the smallest key of each group of ``also`` (row, group) to the others, by the keys of ``marked`` (row, key)."""
    pairs = written(marked.select("row", "key").distinct().join(also.select("row", "group").distinct(), "row").select("group", "key").distinct(), "grouped")
    least = pairs.groupBy("group").agg(F.min("key").alias("src"), F.count("*").alias("n")).filter("n > 1").select("group", "src")
    return split_join(pairs, least, "group", "key").select("src", F.col("key").alias("dst"))


def components_of(docs: DataFrame, n: int = SHINGLE_WORDS, held: int = HELD, chain_bytes: int = CHAIN_BYTES, also: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (hash of the text), key (of its set of shingles), component (of keys). Rows of one group of ``also`` (row, group) are linked too."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    common, rank = common_shingles(docs, n)
    first = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int64())), ("map", pa.binary())])
    whole = pa.schema([("key", pa.int64()), ("hashes", pa.binary())])

    def mark(batches):
        release()
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            sets = [shingles(t, n) for t in b.column(2).to_pylist()]
            yield batch_of(first, list(range(at, at + len(sets))), b.column(0), b.column(1), [key_of(s) for s in sets], [len(s) for s in sets], [prefix(s, common, rank).view(np.int64) for s in sets], [bitmap(s) for s in sets])
            at += len(sets)

    def sets_of(batches):
        release()
        for b in batches:
            sets = [shingles(t, n) for t in b.column(0).to_pylist()]
            yield batch_of(whole, [key_of(s) for s in sets], [s.tobytes() for s in sets])

    marked = written(docs.mapInArrow(mark, "uid long, doc_id long, row long, key long, size long, tokens array<long>, map binary"), "shingles")
    classes = written(marked.groupBy("key").agg(F.min(F.struct("uid", "doc_id", "row")).alias("rep")).select("key", "rep.*"), "classes")
    own = marked.select("uid", "key", "size", "tokens", "map").join(classes.select("uid"), "uid", "left_semi")
    near = written(groups(own.select(F.explode("tokens").alias("token"), "size", "key"), held), "groups")
    close = written(near.select("key").distinct(), "close")
    maps = own.join(close, "key", "left_semi").select("key", "size", "map")
    parts = written(parted(near.join(maps, "key").select("gid", "size", "key", "map"), held), "parts")
    star = parts.join(parts.groupBy("gid").agg(F.min("key").alias("src")), "gid").select("src", F.col("key").alias("dst"))
    chained = connected_components(star).select(F.col("component").alias("gid"), F.col("node").alias("key"))
    found = written(chained.join(own.select("key", "size"), "key"), "found")
    reps = written(classes.join(found.select("key").distinct(), "key", "left_semi").select("row", F.col("doc_id").alias("__id")).distinct(), "reps")
    texts = docs.join(reps, (docs["row"] == reps["row"]) & docs["doc_id"].eqNullSafe(reps["__id"]), "left_semi").select("text")
    sets = texts.mapInArrow(sets_of, "key long, hashes binary").groupBy("key").agg(F.min("hashes").alias("hashes"))  # repeated rows of one id
    linked = chain_links(found, written(sets, "sets"), chain_bytes)
    linked = connected_components(linked if also is None else linked.union(group_links(marked, also)))
    joined = written(classes.join(linked, classes.key == linked.node, "left").select("key", F.coalesce("component", "key").alias("component")), "components")
    return split_join(marked.select("doc_id", "row", "key"), joined, "key", "row").select("doc_id", "row", "key", "component")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, held: int = HELD, chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of its set of shingles), component_id."""
    found = written(components_of(docs, n, held, chain_bytes), "linked")
    ids = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return split_join(found, ids, "component", "row").select("doc_id", "key", "component_id")


def first_of_each(docs: DataFrame, n: int = SHINGLE_WORDS, also: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of the smallest doc_id (of none, where no row has one), once; of rows alike in doc_id and text the one that is smallest written as JSON."""
    found = components_of(docs, n, also=also).groupBy("component", "doc_id", "row").agg(F.count("*").alias("n"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("f"))
    id, row, times = (fresh(f"__{n}", docs.columns) for n in ("id", "row", "n"))
    kept = written(first.select(F.col("f.doc_id").alias(id), F.col("f.row").alias(row), F.col("f.n").alias(times)), "kept")
    on = F.xxhash64(docs["text"]).eqNullSafe(kept[row]) & docs["doc_id"].cast("long").eqNullSafe(kept[id])
    once = docs.join(kept.filter(F.col(times) == 1), on, "left_semi")
    if not kept.filter(F.col(times) > 1).limit(1).count():
        return once
    named = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.to_json(F.struct(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(named))), {"ignoreNullFields": "false"})
    many = docs.join(kept.filter(F.col(times) > 1), on).select(F.col(id), F.col(row), F.struct(whole.alias("order"), *(c.alias(f"c{i}") for i, c in enumerate(named))).alias(times))
    many = many.groupBy(id, row).agg(F.min_by(times, f"{times}.order").alias(times)).select(*(F.col(f"{times}.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return once.unionByName(many)

"""Approximate nearest neighbours by an inverted multi-index.

Vectors are rotated to the axes of their covariance, dealt in turn to two halves of like spread (which keeps inner
products), and each half has its own codebook; a cell is a pair of centroids. A query walks the cells with a heap in
order of the summed inner products of its halves with the two centroids, until the cells passed hold a given share of
all vectors; the vectors of those cells are reranked by the exact inner product in double precision, on the vectors as
given. Rotation, codebooks, and the share that reaches ``TARGET`` recall are fitted on a bounded sample; every vector
is indexed. Cells grow with the table, up to what the sample can fit.

Cells are dealt to shards of bounded size (a cell too large for one is cut into several), so neither a dense cell nor
one very common vector makes a large task. A query goes once to each shard that holds a cell of its walk, in blocks of
bounded size; a shard returns its ``k`` best for each query, and the best of those are the result. How much that saves
is up to the vectors: the share is small where they have clusters, and near one where they have none.

Defined cases: vectors that are null, zero or hold null or non-finite components, or have another length than the
first, take no part as query or candidate, nor do rows whose id is null or no number; repeated ids stay separate rows,
each query row with its own result (a query does not find rows of its own id); ties go to the smaller id; fewer
candidates than k give all of them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, hashed_share, written

#: Parameters: rows of the fitting sample (about; never over twice as many); recall asked of the walk on the sample;
#: vectors and queries of a shard's block; vectors of a cell; centroids of a half, for which the sample has 20 rows each.
SAMPLE_ROWS = 20_000
TARGET = 0.96
SHARD_ROWS = 4096
QUERY_ROWS = 8192
CELL_ROWS = 64
MAX_CENTROIDS = 1024
K = 20


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Plain k-means; centroids without members keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = assign(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, need: int) -> list[int]:
    """Cells (i * len(second) + j) in falling order of first[i] + second[j], until they hold ``need`` vectors: the multi-sequence walk with a heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, fb, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    m, held, out = len(b), 0, []
    heap, pushed = [(-(fa[0] + fb[0]), 0, 0)], {(0, 0)}
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * m + b[j]
        n = int(sizes[cell])
        if n:
            out.append(cell)
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < m and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (-(fa[x] + fb[y]), x, y))
    return out


def rotation(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix to the axes of the sample's second moments, the widest first, dealt in turn to the halves (first, second, second, first)."""
    _, axes = np.linalg.eigh(x.T @ x)
    place = np.arange(x.shape[1])
    return axes[:, ::-1][:, np.argsort((place + 1) // 2 % 2, kind="stable")]


class Index:
    def __init__(self, sample: np.ndarray, rows: int, k: int = K, target: float = TARGET):
        self.turn = rotation(sample)
        self.half = -(-sample.shape[1] // 2)
        most = max(4, min(MAX_CENTROIDS, len(sample) // 20))
        centroids = int(min(most, max(4, 2 ** round(np.log2(max(1.0, rows / CELL_ROWS)) / 2))))
        self.books = [codebook(h, centroids) for h in self.halves(sample)]
        self.share = self.calibrate(sample, k, target)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.turn
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (assign(h, c) if h.shape[1] else np.zeros(len(h), np.int64) for h, c in zip(self.halves(x), self.books))
        return one * len(self.books[1]) + two

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of each row's halves with the centroids."""
        return tuple(h @ c.T for h, c in zip(self.halves(x), self.books))

    def calibrate(self, sample: np.ndarray, k: int, target: float) -> float:
        """The share of all vectors that the walk must pass for ``target`` recall on the sample, for up to 200 of its rows as queries."""
        cells = self.cells(sample)
        sizes = np.bincount(cells, minlength=len(self.books[0]) * len(self.books[1]))
        needed = []
        for q in sample[:: max(1, len(sample) // 200)]:
            score = sample @ q
            best = np.argsort(-score, kind="stable")[1 : k + 1]
            one, two = self.scores(q[None])
            order = walk(one[0], two[0], sizes, len(sample))
            passed = dict(zip(order, np.cumsum(sizes[order]).tolist()))
            needed.extend(passed[c] for c in cells[best].tolist())
        return float(np.quantile(needed, target)) / len(sample) if needed else 1.0


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (key, vector) its ``k`` nearest found among ``df``."""
    spark = df.sparkSession
    base = written(usable(df, key, vector), "vectors")
    rows = base.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return spark.createDataFrame([], empty)
    width = len(base.select("v").first()[0])
    base = base.filter(F.size("v") == width)
    some = hashed_share(base, "id", SAMPLE_ROWS).select("v").limit(2 * SAMPLE_ROWS).collect() or base.select("v").limit(1).collect()
    sample = np.array(sorted(r[0] for r in some), float)
    index = Index(sample, rows, k, target)
    held = spark.sparkContext.broadcast(index)

    def place(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.cells(x).astype(np.int64))], names=["id", "v", "cell"])

    entries = written(base.mapInArrow(place, "id long, v array<double>, cell long"), "entries")
    n_cells = len(index.books[0]) * len(index.books[1])
    sizes = np.zeros(n_cells, np.int64)
    for cell, n in entries.groupBy("cell").count().collect():  # no more than cells, MAX_CENTROIDS squared at most
        sizes[cell] = n
    # Shards are runs of cells; a cell of over SHARD_ROWS vectors takes several shards, dealt by id.
    first, parts, at, fill = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), 0, 0
    for c in range(n_cells):
        n = int(sizes[c])
        if n > SHARD_ROWS:
            at += fill > 0
            first[c], parts[c] = at, -(-n // SHARD_ROWS)
            at, fill = at + parts[c], 0
        else:
            if fill + n > SHARD_ROWS:
                at, fill = at + 1, 0
            first[c], fill = at, fill + n
    most = k + 1  # one of them may be the query's own row
    need = max(most, int(np.ceil(index.share * rows)))
    shards = spark.sparkContext.broadcast((sizes, first, parts))

    def route(batches):
        sizes, first, parts = shards.value
        index = held.value
        schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, width)
            s1, s2 = index.scores(x)
            for uid, key, v, block, u, w in zip(*(c.to_pylist() for c in b.columns), s1, s2):
                by: dict[int, list[int]] = {}
                for c in walk(u, w, sizes, need):
                    for s in range(int(first[c]), int(first[c] + parts[c])):
                        by.setdefault(s, []).append(c)
                yield batch_of(schema, list(by), [block] * len(by), [uid] * len(by), [key] * len(by), [v] * len(by), list(by.values()))

    def deal(batches):
        _, first, parts = shards.value
        at = 0
        for b in batches:
            cell = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + (np.arange(len(cell)) + at) % parts[cell]), *b.columns], names=["shard", "id", "v", "cell"])
            at += len(cell)

    wanted = written(usable(queries, key, vector).filter(F.size("v") == width).withColumn("uid", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-wanted.count() // QUERY_ROWS))

    asked = wanted.select("uid", "id", "v", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).mapInArrow(route, "shard long, block long, uid long, id long, v array<double>, cells array<long>")
    # A shard meets its queries in blocks of about QUERY_ROWS.
    asked = written(asked, "asked")
    pairs = asked.select("shard", "block").distinct()
    dealt = entries.select("id", "v", "cell").mapInArrow(deal, "shard long, id long, v array<double>, cell long")
    dealt = dealt.join(pairs, "shard").select(F.col("shard").alias("its_shard"), F.col("block").alias("its_block"), "cell", F.col("id").alias("its_id"), F.col("v").alias("its_v"))
    top = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("own", pa.bool_())])

    def rank(_, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return top.empty_table()
        order = np.lexsort((mine["its_id"].to_numpy(), mine["cell"].to_numpy()))
        ids, cell = mine["its_id"].to_numpy()[order], mine["cell"].to_numpy()[order]
        x = mine["its_v"].combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        uid, qid, q = theirs["uid"].to_numpy(), theirs["id"].to_numpy(), theirs["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        there, at = np.unique(cell, return_inverse=True)
        out = []
        for s in range(0, len(qid), 256):
            scores = q[s : s + 256] @ x.T
            walked = np.zeros((len(scores), len(there)), bool)
            for r, cells in enumerate(theirs["cells"][s : s + 256].to_pylist()):
                i = np.searchsorted(there, cells)
                i[i == len(there)] = 0
                walked[r, i[there[i] == cells]] = True
            scores[~walked[:, at]] = -np.inf
            for r in range(len(scores)):
                row = scores[r]
                least = np.partition(row, -most)[-most] if len(row) > most else -np.inf
                near = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else row > least))
                exact = (x[near] * q[s + r]).sum(1)  # each row by itself: equal vectors have equal scores
                own = (ids[near] == qid[s + r]) & (x[near] == q[s + r]).all(1)
                best = np.lexsort((~own, ids[near], -exact))[:most]
                out.append((np.full(len(best), uid[s + r]), np.full(len(best), qid[s + r]), ids[near][best], exact[best], own[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=top)

    found = dealt.groupBy("its_shard", "its_block").cogroup(asked.groupBy("shard", "block")).applyInArrow(rank, "uid long, query_id long, vec_id long, score double, own boolean")
    best_first = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    met = F.count_if("own").over(best_first.rowsBetween(Window.unboundedPreceding, 0))  # rows equal to the query so far: the first of them is the query
    placed = found.withColumn("place", F.row_number().over(best_first)).withColumn("met", met).filter(~(F.col("own") & (F.col("met") == 1)))
    return placed.select("query_id", (F.col("place") - F.least(F.col("met"), F.lit(1))).cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

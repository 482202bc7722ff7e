"""Importance resampling towards a target: hashed n-gram features, weights, and a Gumbel top-k draw.

Each task runs DuckDB over its own Arrow batches: SQL takes the words, unnests them, builds n-grams with a window, and
hashes each distinct feature once with zlib's CRC-32, registered as a function. A task keeps only its counts per bucket
(at most as many as there are buckets) and DuckDB may spill to its temporary folder. Spark writes the counts of all
tasks as Parquet in the shared folder, merges them, and turns them into gains, a table as long as there are buckets.
A second pass, DuckDB again, sums the gains of each document; the rank of the drawn ones comes from a sort by ranges, so
no task sees more than its range.

Defined cases: a null or word-free text has no features and weight 0; a null doc_id hashes as the empty string and comes
after all others among equal scores; repeated rows are drawn each for itself, one after another; of rows with one doc_id
and the same score the one of more features, then of the smaller text hash, comes first; an empty target or an empty
corpus has counts of zero; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

#: The letters that are lower-cased, and a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What DuckDB may hold in one task.
MEMORY = "384MB"


@dataclass(frozen=True)
class Draw:
    """Length of n-grams, number of buckets, documents drawn of a hundred, words that a drawn document has at least, seed."""

    ngram: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024


def crc32(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x.as_buffer()) for x in column.cast(pa.binary()).combine_chunks()] if len(column) else [], pa.int64())


def session():
    """A DuckDB of this task alone, with the CRC registered."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
    con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def features(ngram: int) -> str:
    """SQL: (row, feature) of every run of 1 to ``ngram`` words of ``batch`` (row, text)."""
    words = f"SELECT row, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM batch WHERE text IS NOT NULL)"
    if ngram == 1:
        return f"SELECT row, w AS feature FROM ({words})"
    runs = [f"SELECT row, string_agg(w, ' ') OVER n{n} AS feature, count(*) OVER n{n} AS size, {n} AS wanted FROM words WINDOW n{n} AS (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in range(1, ngram + 1)]
    return f"WITH words AS ({words}) SELECT row, feature FROM ({' UNION ALL '.join(runs)}) WHERE size = wanted"


def numbered(column: pa.Array) -> pa.Table:
    return pa.table({"row": pa.array(range(len(column)), pa.int32()), "text": column})


def bucket_counts(texts: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out."""
    small_batches(texts.sparkSession)
    ngram, buckets = draw.ngram, draw.buckets

    def count(batches):
        con = session()
        con.execute("CREATE TABLE counts (bucket BIGINT, n BIGINT)")
        for b in batches:
            batch = numbered(b.column(0))  # noqa: F841  (read by the SQL)
            con.register("batch", batch)
            con.execute(f"INSERT INTO counts SELECT crc32(feature) % {buckets} AS bucket, sum(n) FROM (SELECT feature, count(*) AS n FROM ({features(ngram)}) GROUP BY feature) GROUP BY bucket")
            con.unregister("batch")
        found = con.sql("SELECT bucket, sum(n)::BIGINT AS n FROM counts GROUP BY bucket").to_arrow_table()
        con.close()
        yield from found.to_batches()

    spilled = written(texts.select("text").mapInArrow(count, "bucket long, n long"), "bucket-counts")
    return spilled.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket, from (bucket, n) of both sides; a list as long as ``buckets``."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, a, b = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gain = F.floor(F.lit(1000.0) * F.log(((t + 1) * (a + buckets)) / ((s + 1) * (b + buckets))))
    return [r.gain for r in both.crossJoin(F.broadcast(total)).select("bucket", gain.cast("long").alias("gain")).orderBy("bucket").collect()]


def weighed(docs: DataFrame, gain: list[int], draw: Draw = Draw()) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    ngram, buckets = draw.ngram, draw.buckets
    sums = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("total", pa.int64())])

    def weigh(batches):
        con = session()
        con.register("gain_table", pa.table({"bucket": pa.array(range(buckets), pa.int64()), "gain": pa.array(held.value, pa.int64())}))
        con.execute("CREATE TABLE gains AS SELECT * FROM gain_table")
        for b in batches:
            batch = numbered(b.column(2))  # noqa: F841  (read by the SQL)
            con.register("batch", batch)
            con.execute(f"CREATE OR REPLACE TEMP TABLE found AS SELECT row, feature, count(*) AS n FROM ({features(ngram)}) GROUP BY row, feature")
            con.execute(f"CREATE OR REPLACE TEMP TABLE known AS SELECT feature, gain FROM (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM found)) JOIN gains USING (bucket)")
            table = con.sql("""
                SELECT coalesce(sum(n) FILTER (NOT contains(feature, ' ')), 0)::BIGINT AS n_words, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * gain), 0)::BIGINT AS total
                FROM batch LEFT JOIN (found JOIN known USING (feature)) USING (row) GROUP BY row ORDER BY row""").to_arrow_table()
            con.unregister("batch")
            table = table.cast(sums).combine_chunks()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(c.chunk(0) if c.num_chunks else pa.array([], pa.int64()) for c in table.columns)], names=["doc_id", "text_hash", *sums.names])
        con.close()

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = kept.mapInArrow(weigh, "doc_id long, text_hash long, n_words long, n_features long, total long")
    return found.select("doc_id", "text_hash", "n_words", "n_features", F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel number) from the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... for the drawn rows, null for the others."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc_nulls_last("text_hash")]
    fit = F.col("n_words") >= min_words
    spread = scored.filter(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    spread = written(spread.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ranked")
    sizes = spread.groupBy("part").agg(F.count("*").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    drawn = F.floor(F.lit(percent) * F.lit(spread.count()) / 100)
    rank = F.col("before") + F.col("at") + 1
    top = spread.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank).cast("long")).drop("part", "at", "before")
    return top.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs, how), bucket_counts(target, how), how.buckets)
    scored = written(weighed(docs, gain, how).withColumn("score", F.col("weight") + noise(F.col("doc_id"), how.seed)), "scored")
    return ranked(scored, how.percent, how.min_words).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(how: Draw = Draw()) -> str:
    """What :func:`draw` gives for single words, as DuckDB SQL; the CRC is computed from its polynomial, byte by byte."""
    words = lambda table, key: f"SELECT {key} AS k, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM {table}"
    return f"""
    WITH bits AS (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits),
    d AS ({words('documents', 'doc_id')}), b AS ({words('benchmark', 'item_id')}),
    vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b))),
    hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % {how.buckets} AS bucket FROM vocabulary, crc_table),
    s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {how.buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {how.buckets}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
    f AS (SELECT k, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS w FROM d JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY k),
    weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
                       coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{how.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
                FROM documents LEFT JOIN f ON doc_id = k),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM weighed WHERE n_features >= {how.min_words})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= {how.percent} * total // 100 THEN place::BIGINT END AS rank FROM weighed LEFT JOIN placed USING (doc_id)"""

"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

The corpus is a tree (domain, language, source). Weights go down the tree: the children of a node share its budget in
proportion to their weights, and a child that can't use its share (its texts, repeated ``max_epochs`` times, are too
few) leaves the rest to its siblings. As a node's capacity is the sum of its children's, only what all siblings
together can't use goes back to the level above. A leaf takes whole epochs and then a token-prefix of one more epoch,
each in an order seeded by epoch: the documents, by hash, whose running token sum stays within what is left.

The prefix is found without sorting a leaf: token sums by hash bucket (about the square root of the leaf's rows) give
the bucket where the budget ends, only that bucket's documents are put in order, and what remains is one threshold
hash for each leaf. Documents then need no shuffle but the join with the small table of leaves, which Spark broadcasts
only below its own size limit.

Defined cases: a null level value is ``unknown``; a null text has one token, as an empty one; a null id is the empty
id; repeated rows are taken together or not at all; leaves of weight 0 or less get nothing; an empty table gives an
empty result; the documents' own columns stay as they are, whatever their names (internal ones begin with ``__mix``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MAX_EPOCHS = 4
SEED = 20240229
LEVELS = ("__mix0", "__mix1", "__mix2")
#: Parts of one in which remainders are compared: fractions of sums of weights up to a million differ by more.
RATIO = 1_000_000_000_000

#: Parameters of the registered query: the corpus tree and its integer weights, as SQL over the levels' names.
DOMAIN = "CASE WHEN source IS NULL THEN NULL WHEN crc32(source) % 3 = 0 THEN 'web' WHEN crc32(source) % 3 = 1 THEN 'books' ELSE 'reference' END"
WEIGHTS = {
    "domain": "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END",
    "lang": "CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 ELSE 10 END",
    "source": "CASE source WHEN 'src0' THEN 2 ELSE 1 END",
}


def token_estimate(text: str = "text") -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1. Any other token count can be given instead."""
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4)).cast("long")


def levels_of(domain: str = DOMAIN, lang: str = "lang", source: str = "source") -> list[Column]:
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return [known(F.expr(domain)), known(F.col(lang)), known(F.col(source))]


def weight_of(name: str, level: str, weights: dict[str, str]) -> Column:
    return F.expr(f"transform(array({level}), {name} -> {weights[name]})[0]").cast("long")


def ratio(a: str, b: str) -> tuple[str, str]:
    """SQL of two longs that order fractions a / b of longs exactly, while b (a sum of weights among siblings) is at most a million."""
    return f"{a} div {b}", f"(({a} % {b}) * {RATIO}) div {b}"


def leaf_budgets(slim: DataFrame, budget: int | None, max_epochs: int = MAX_EPOCHS, weights: dict[str, str] | None = None) -> DataFrame:
    """For each leaf: the levels, supply (tokens), docs, budget (tokens)."""
    weights = weights or WEIGHTS
    names = list(weights)
    leaves = slim.groupBy(*LEVELS).agg(F.sum("__mix_tokens").alias("supply"), F.count("*").alias("docs"))
    for name, level in zip(names, LEVELS):
        leaves = leaves.withColumn(f"w_{level}", weight_of(name, level, weights))
    use = F.greatest(*(F.lit(0), F.least(*(F.signum(f"w_{x}") for x in LEVELS)))).cast("long")
    leaves = written(leaves.withColumn("cap", F.col("supply") * max_epochs * use), "leaves")
    total = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("supply"), F.lit(0)).alias("supply")).first()
    given: DataFrame | None = None
    root = min(total.cap, total.supply if budget is None else budget)
    for depth in range(1, len(LEVELS) + 1):
        own, above = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.filter("cap > 0").groupBy(*own, F.col(f"w_{own[-1]}").alias("w")).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("given", F.lit(root).cast("long")) if given is None else nodes.join(given, above)
        rising = Window.partitionBy(*above).orderBy(*(F.expr(x) for x in ratio("cap", "w")), own[-1])
        before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("num", F.col("given") - before).withColumn("den", rest)
        rate = F.when(F.col("num") >= 0, F.struct(*(F.expr(x) for x in ratio("num", "den")), "num", "den"))
        nodes = nodes.withColumn("rate", F.max(rate).over(Window.partitionBy(*above)))
        nodes = nodes.withColumn("share", F.least("cap", F.expr("(rate.num div rate.den) * w + ((rate.num % rate.den) * w) div rate.den")))
        given = nodes.select(*own, F.col("share").alias("given"))
    return leaves.select(*LEVELS, "supply", "docs").join(given, list(LEVELS), "left").withColumn("budget", F.coalesce("given", F.lit(0))).drop("given")


def epoch_hash(seed: int, epoch: Column | str, id: str = "__mix_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(epoch) if isinstance(epoch, str) else epoch).cast("string"), F.col(id)))


def leaf_plan(slim: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict[str, str] | None = None) -> DataFrame:
    """For each leaf: the levels, supply, budget, epochs (whole ones) and last (documents whose hash of the next epoch is at most this are taken once more; null: none)."""
    keys = list(LEVELS)
    leaves = leaf_budgets(slim, budget, max_epochs, weights).withColumn("epochs", F.expr("budget div supply")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    leaves = written(leaves, "budgets")
    most = leaves.agg(F.coalesce(F.max("docs"), F.lit(1))).first()[0]
    digits = max(1, math.ceil(math.log(max(1, most), 16) / 2))
    hashed = slim.join(leaves.filter("rest > 0").select(*keys, "epochs", "rest"), keys).withColumn("h", epoch_hash(seed, "epochs")).select(*keys, "rest", "h", "__mix_tokens", F.substring("h", 1, digits).alias("bucket"))
    buckets = hashed.groupBy(*keys, "rest", "bucket").agg(F.sum("__mix_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cuts = buckets.withColumn("upto", running).filter("upto > rest").groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cuts = cuts.select(*keys, F.col("cut.bucket").alias("bucket"), F.col("cut.before").alias("before"))
    inside = hashed.join(cuts, [*keys, "bucket"]).groupBy(*keys, "before", "rest", "h").agg(F.sum("__mix_tokens").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    exact = inside.withColumn("upto", upto).filter("upto <= rest").groupBy(*keys).agg(F.max("h").alias("h"))
    last = cuts.join(exact, keys, "left").select(*keys, F.coalesce("h", "bucket").alias("last"))
    return written(leaves.join(last, keys, "left").select(*keys, "supply", "budget", "epochs", "last"), "plan")


def slim_table(docs: DataFrame, levels: list[Column] | None = None, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """What budgeting needs of each document; texts are read once, for their length."""
    levels = levels or levels_of()
    return written(docs.select(*(c.alias(n) for c, n in zip(levels, LEVELS)), (token_estimate() if tokens is None else tokens).alias("__mix_tokens"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__mix_id"), F.col(key).alias("__mix_key")), "slim")


def copies(df: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``df`` (with the levels and __mix_id) joined with its leaf's plan, and __mix_copies."""
    out = df.join(plan, list(LEVELS))
    return out.withColumn("__mix_copies", F.col("epochs") + F.coalesce((epoch_hash(seed, "epochs") <= F.col("last")).cast("long"), F.lit(0)))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, levels: list[Column] | None = None, weights: dict[str, str] | None = None) -> DataFrame:
    """The documents' rows, each as many times as the mixture takes it. ``budget``: tokens; None: as many as there are."""
    levels, names = levels or levels_of(), docs.columns
    plan = leaf_plan(slim_table(docs, levels), budget, max_epochs, seed, weights).select(*LEVELS, "epochs", "last")
    plan = plan.select(*LEVELS, F.col("epochs").alias("__mix_epochs"), F.col("last").alias("__mix_last"))
    keyed = docs.withColumns({n: c for c, n in zip(levels, LEVELS)}).withColumn("__mix_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    taken = F.col("__mix_epochs") + F.coalesce((epoch_hash(seed, "__mix_epochs") <= F.col("__mix_last")).cast("long"), F.lit(0))
    out = keyed.join(plan, list(LEVELS)).withColumn("__mix_copies", taken).filter("__mix_copies > 0")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*(F.col(f"`{c}`") for c in names))


def allocation(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, levels: list[Column] | None = None, weights: dict[str, str] | None = None) -> DataFrame:
    """One row per document: its leaf, its tokens, the leaf's supply, budget and whole epochs, and how often the mixture takes the document."""
    slim = slim_table(docs, levels)
    out = copies(slim, leaf_plan(slim, budget, max_epochs, seed, weights), seed)
    return out.select(F.col("__mix_key").alias("doc_id"), *(F.col(x).alias(n) for x, n in zip(LEVELS, ("domain", "lang", "source"))), F.col("__mix_tokens").alias("n_tokens"), F.col("supply").alias("leaf_supply"), F.col("budget").alias("leaf_budget"), "epochs", F.col("__mix_copies").alias("copies"))


def oracle(table: str = "documents", domain: str | None = None, weights: dict[str, str] | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`allocation` with the budget left open."""
    weights = weights or WEIGHTS
    # DuckDB has no crc32; the domain of the driver's sources comes from the same rule, evaluated here.
    import zlib

    rule = " ".join(f"WHEN 'src{i}' THEN '{('web', 'books', 'reference')[zlib.crc32(f'src{i}'.encode()) % 3]}'" for i in range(20))
    domain = domain or f"CASE source {rule} END"
    fill = []
    for depth, name in enumerate(weights, 1):
        own = list(weights)[:depth]
        above = ", ".join(own[:-1])
        part = f"PARTITION BY {above}" if above else ""
        given = f"g{depth - 1}.share" if above else "(SELECT least(sum(cap), sum(supply)) FROM leaves)"
        join = f"JOIN g{depth - 1} USING ({above})" if above else ""
        cols = ", ".join(own)
        fill.append(f"""n{depth} AS (SELECT {cols}, w, n.cap, {given} AS given FROM (SELECT {cols}, w_{name} AS w, sum(cap)::BIGINT AS cap FROM leaves WHERE cap > 0 GROUP BY {cols}, w_{name}) n {join}),
o{depth} AS (SELECT *, given - coalesce(sum(cap) OVER ({part} ORDER BY cap // w, ((cap % w) * {RATIO}) // w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS num, (sum(w) OVER ({part} ORDER BY cap // w, ((cap % w) * {RATIO}) // w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS den FROM n{depth}),
r{depth} AS (SELECT *, max(CASE WHEN num >= 0 THEN [num // den, ((num % den) * {RATIO}) // den, num, den] END) OVER ({part}) AS rate FROM o{depth}),
g{depth} AS (SELECT {cols}, least(cap, (rate[3] // rate[4]) * w + ((rate[3] % rate[4]) * w) // rate[4])::BIGINT AS share FROM r{depth})""")
    keys = ", ".join(weights)
    return f"""WITH d AS (SELECT doc_id, coalesce({domain}, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
 greatest(1, (coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS n_tokens FROM {table}),
l AS (SELECT {keys}, sum(n_tokens)::BIGINT AS supply FROM d GROUP BY {keys}),
leaves AS (SELECT *, {", ".join(f"({w})::BIGINT AS w_{n}" for n, w in weights.items())}, supply * {max_epochs} AS cap FROM l),
{", ".join(fill)},
b AS (SELECT leaves.*, coalesce(share, 0) AS budget, (coalesce(share, 0) // supply)::BIGINT AS epochs FROM leaves LEFT JOIN g3 USING ({keys})),
h AS (SELECT d.*, supply, budget, epochs, md5(concat_ws(':', '{seed}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS h FROM d JOIN b USING ({keys})),
t AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY h) AS upto FROM h)
SELECT doc_id, {keys}, n_tokens, supply AS leaf_supply, budget AS leaf_budget, epochs, epochs + (upto <= budget - epochs * supply)::BIGINT AS copies FROM t"""

"""Manifest validation: structural checks first, references only for sound manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..schema import BROKERS, LAYERS, METHODS

#: Fixed value: what a service id looks like.
SERVICE_ID = "^[a-z0-9][a-z0-9._-]*$"
ARRAYS = ("endpoints", "consumers", "calls", "publishes", "handlers")


def problem(when: Column, path: Column | str, message: Column | str) -> Column:
    """struct<path, message> where the condition holds (an unknown condition counts as broken)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.coalesce(when, F.lit(True)), F.struct(lit(path).alias("path"), lit(message).alias("message")))


def gathered(df: DataFrame, keys: list[str], *problems: Column) -> DataFrame:
    found = df.select(*keys, F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("p"))
    return found.select(*keys, "p.path", "p.message")


def structural(m: DataFrame) -> DataFrame:
    """(m_ord, path, message) of manifests whose shape is wrong."""
    s = lambda n: F.col(f"service.{n}")
    missing = F.col("service").isNull()
    return gathered(
        m,
        ["m_ord"],
        problem(~F.col("schemaVersion").eqNullSafe(F.lit("1")), "schemaVersion", 'expected "1"'),
        problem(missing, "service", "required object"),
        problem(~missing & F.coalesce(~s("id").rlike(SERVICE_ID), F.lit(True)), "service.id", "must match " + SERVICE_ID),
        problem(~missing & s("name").isNull(), "service.name", "required string"),
        problem(~missing & F.coalesce(~s("layer").isin(LAYERS), F.lit(True)), "service.layer", "must be one of " + ", ".join(LAYERS)),
        *(problem(F.col(a).isNull(), a, "required array") for a in ARRAYS),
    )


def place_of(array: str, field: str = "") -> Column:
    return F.concat(F.lit(f"{array}["), F.col("i_ord").cast("string"), F.lit("]" + (f".{field}" if field else "")))


def located(array: str) -> list[Column]:
    loc = F.col("loc")
    return [problem(loc.isNull(), place_of(array, "location"), "location must be an object"), problem(loc.isNotNull() & F.col("loc.file").isNull(), place_of(array, "location.file"), "must be a string"), problem(loc.isNotNull() & F.col("loc.line").isNull(), place_of(array, "location.line"), "must be a number")]


def unknown_handlers(rows: DataFrame, handlers: DataFrame, column: str, array: str) -> DataFrame:
    """Rows whose handler the manifest doesn't have (null never is one)."""
    lost = rows.join(handlers.select("m_ord", F.col("id").alias(column)).distinct(), ["m_ord", column], "left_anti")
    return lost.select("m_ord", place_of(array, column).alias("path"), F.concat(F.lit("unknown handler "), F.coalesce(column, F.lit("undefined"))).alias("message"))


def later(rows: DataFrame) -> DataFrame:
    """Rows that repeat an id of their manifest."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("m_ord", "id").orderBy("i_ord"))).filter("__n > 1").drop("__n")


def handler_ids(handlers: DataFrame) -> DataFrame:
    missing = gathered(handlers, ["m_ord"], problem(F.col("id").isNull(), place_of("handlers", "id"), "required string"), problem(F.col("calls").isNull(), place_of("handlers", "calls"), "required array"))
    twice = later(handlers.filter("id is not null")).select("m_ord", place_of("handlers", "id").alias("path"), F.concat(F.lit("duplicate handler id "), "id").alias("message"))
    return missing.union(twice)


def unknown_callees(handlers: DataFrame) -> DataFrame:
    calls = handlers.select("m_ord", "i_ord", F.posexplode("calls").alias("j", "callee"))
    lost = calls.join(handlers.select("m_ord", F.col("id").alias("callee")).distinct(), ["m_ord", "callee"], "left_anti")
    return lost.select("m_ord", F.concat(F.lit("handlers["), F.col("i_ord").cast("string"), F.lit("].calls["), F.col("j").cast("string"), F.lit("]")).alias("path"), F.concat(F.lit("unknown handler "), "callee").alias("message"))


def endpoint_shape(endpoints: DataFrame) -> DataFrame:
    bad = gathered(endpoints, ["m_ord"], problem(~F.col("method").isin(METHODS), place_of("endpoints", "method"), "invalid http method"), problem(~F.startswith("path", F.lit("/")), place_of("endpoints", "path"), "must start with /"))
    return bad.union(later(endpoints).select("m_ord", place_of("endpoints", "id").alias("path"), F.lit("duplicate endpoint id").alias("message")))


def message_shape(rows: DataFrame, array: str) -> DataFrame:
    return gathered(rows, ["m_ord"], problem(~F.col("broker").isin(BROKERS), place_of(array, "broker"), "invalid broker"), problem(fn.truthy("topic").isNull(), place_of(array, "topic"), "required string"))


def call_shape(calls: DataFrame) -> DataFrame:
    return gathered(calls, ["m_ord"], problem(F.col("url").isNull(), place_of("calls", "url"), "required string"), problem(F.col("method").isNotNull() & ~F.col("method").isin(METHODS), place_of("calls", "method"), "invalid http method"))


def referential(e) -> DataFrame:
    """(m_ord, path, message) over the tables of structurally sound manifests."""
    parts = [handler_ids(e.handlers), unknown_callees(e.handlers), endpoint_shape(e.endpoints), message_shape(e.consumers, "consumers"), call_shape(e.calls), message_shape(e.publishes, "publishes")]
    parts += [unknown_handlers(e.endpoints, e.handlers, "handler", "endpoints"), unknown_handlers(e.consumers, e.handlers, "handler", "consumers"), unknown_handlers(e.calls, e.handlers, "fromHandler", "calls"), unknown_handlers(e.publishes, e.handlers, "fromHandler", "publishes")]
    parts += [gathered(getattr(e, a), ["m_ord"], *located(a)) for a in ARRAYS]
    return reduce(DataFrame.unionByName, parts)


def validate(manifests: DataFrame) -> DataFrame:
    """All errors of manifests (as read by sources.read_manifests), by manifest."""
    from ..sources.manifests import estate

    broken = structural(manifests)
    sound = manifests.join(broken.select("m_ord").distinct(), "m_ord", "left_anti")
    return broken.unionByName(referential(estate(sound)))

"""Documents of any size: a folder of parts in order, whose concatenation by path is one JSON document.

Every item of an array is one line, so that parts are written and read by as many tasks as there are; an item (a flow
with its steps, at most) is all that one task holds at once. A folder is complete when Spark's commit has left its mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import numbered

LAST = (1 << 63) - 1


def document_lines(arrays: dict[str, tuple[DataFrame, list[str | Column]]], head: str) -> DataFrame:
    """(section, place, line) of a document that begins with ``head`` ('{...,') and holds arrays by name, each the rows of a table in an order; an empty table is an empty array."""
    marks, items = [], []
    for i, (name, (rows, order)) in enumerate(arrays.items()):
        section = f"{i:03d}-{name}"
        marks.append((section, 0, f'{"]," if i else head}"{name}":['))
        keys = [F.col(o) if isinstance(o, str) else o for o in order]
        hidden = [f"__o{k}" for k in range(len(keys))]
        doc = rows.select(*(k.alias(h) for k, h in zip(keys, hidden)), F.to_json(F.struct(*(c for c in rows.columns if c not in ("ord", "m_ord", "i_ord")))).alias("doc"))
        doc = numbered(doc, "place", *hidden, "doc", kind="long")
        items.append(doc.select(F.lit(section).alias("section"), "place", F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "doc").alias("line")))
    marks.append((section, LAST, "]}"))
    spark = items[0].sparkSession
    return reduce(DataFrame.unionByName, items, spark.createDataFrame(marks, "section string, place long, line string"))


def write_document(lines: DataFrame, folder: str) -> None:
    """The lines as text files in the document's order, one folder for each section."""
    order = ("section", "place")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("section", "line").write.partitionBy("section").text(folder)


def read_items(spark: SparkSession, folder: str, name: str, shape: str) -> DataFrame:
    """The items of one array of a written document, parsed by ``shape``; other sections aren't read."""
    rows = spark.read.text(folder).filter(F.substring("section", 5, 1 << 30) == name)
    items = rows.filter(F.substring("value", 1, 1).isin("{", ",") & F.col("value").endswith("}"))
    return items.select(F.from_json(F.ltrim("value", F.lit(",")), shape).alias("x")).select("x.*")

"""Documents in parts: their concatenation is the document, and their items read back."""

import glob
import json

from pyspark.sql import functions as F

from waymesh.sources import documents


def whole(folder):
    return json.loads("".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/*/part-*"))))


def test_parts_in_order(spark, tmp_path):
    # a text with line ends, commas and brackets stays one line; ranges of one section fall into several parts
    n = 5000
    numbers = spark.range(n).select((n - F.col("id")).alias("id"), F.concat(F.lit('],"x":[\n,{'), F.repeat(F.lit("é\r"), 20)).alias("text")).repartition(7)
    none = spark.createDataFrame([], "id string")
    folder = str(tmp_path / "doc")
    lines = documents.document_lines({"none": (none, ["id"]), "numbers": (numbers, ["id"]), "last": (none, ["id"])}, '{"v":1,')
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_document(lines, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{folder}/section=001-numbers/part-*")) > 1
    assert glob.glob(f"{folder}/_SUCCESS")
    got = whole(folder)
    assert list(got) == ["v", "none", "numbers", "last"] and got["none"] == got["last"] == []
    assert got["numbers"] == [{"id": i, "text": '],"x":[\n,{' + "é\r" * 20} for i in range(1, n + 1)]
    back = documents.read_items(spark, folder, "numbers", "id long, text string")
    assert not back.exceptAll(numbers).count() and back.count() == n
    assert not documents.read_items(spark, folder, "last", "id string").count()

"""Fact tables of a repository's sources, parsed file by file on the executors."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.session import cut
from .structure import Parser

VALUE = "struct<kind:string,text:string,refs:array<string>,raw:string>"
ATTR = f"struct<name:string,args:array<{VALUE}>,named:map<string,array<{VALUE}>>>"
CALL = f"struct<receiver:string,method:string,targs:string,args:array<{VALUE}>,named:map<string,{VALUE}>,line:int,`new`:boolean,raw:string>"
FACTS = (
    f"service string, file string, language string, issue string, types array<struct<name:string,kind:string,bases:array<string>,line:int,attrs:array<{ATTR}>>>, "
    f"units array<struct<id:string,name:string,kind:string,line:int,`type`:string,params array<struct<name:string,of:string>>,attrs:array<{ATTR}>,calls:array<{CALL}>,children:array<string>,body:string,abstract:boolean>>, "
    f"fields array<struct<`type`:string,name:string,of:string,value:string,attrs:array<{ATTR}>>>, imports array<struct<local:string,imported:string,source:string>>, constants array<struct<`type`:string,name:string,value:string>>"
).replace("params array", "params:array")


def arrow_value():
    return pa.struct([("kind", pa.string()), ("text", pa.string()), ("refs", pa.list_(pa.string())), ("raw", pa.string())])


def arrow_schema() -> pa.Schema:
    s, v = pa.string(), arrow_value()
    attr = pa.struct([("name", s), ("args", pa.list_(v)), ("named", pa.map_(s, pa.list_(v)))])
    call = pa.struct([("receiver", s), ("method", s), ("targs", s), ("args", pa.list_(v)), ("named", pa.map_(s, v)), ("line", pa.int32()), ("new", pa.bool_()), ("raw", s)])
    unit = pa.struct([("id", s), ("name", s), ("kind", s), ("line", pa.int32()), ("type", s), ("params", pa.list_(pa.struct([("name", s), ("of", s)]))), ("attrs", pa.list_(attr)), ("calls", pa.list_(call)), ("children", pa.list_(s)), ("body", s), ("abstract", pa.bool_())])
    types = pa.struct([("name", s), ("kind", s), ("bases", pa.list_(s)), ("line", pa.int32()), ("attrs", pa.list_(attr))])
    fields = pa.struct([("type", s), ("name", s), ("of", s), ("value", s), ("attrs", pa.list_(attr))])
    return pa.schema([("service", s), ("file", s), ("language", s), ("issue", s), ("types", pa.list_(types)), ("units", pa.list_(unit)), ("fields", pa.list_(fields)), ("imports", pa.list_(pa.struct([("local", s), ("imported", s), ("source", s)]))), ("constants", pa.list_(pa.struct([("type", s), ("name", s), ("value", s)])))])


def parse_file(service: str, file: str, text: str | None, issue: str | None, schema: pa.Schema) -> dict:
    out = {"service": service, "file": file, "language": "", "issue": None, "types": [], "units": [], "fields": [], "imports": [], "constants": []}
    if text is None:
        return out | {"issue": issue or "file-skipped"}
    try:
        p = Parser(file, text).parse()
    except (IndexError, KeyError, ValueError, RecursionError) as e:
        return out | {"issue": f"parse-failed: {type(e).__name__}"}
    def attr(a):
        return {"name": a["name"], "args": a["args"], "named": list(a["named"].items())}

    units = [{**u.__dict__, "params": [{"name": n, "of": t} for n, t in u.params], "attrs": [attr(a) for a in u.attrs], "calls": [{**c, "named": list(c["named"].items())} for c in u.calls]} for u in p.units]
    types = [{**t, "attrs": [attr(a) for a in t["attrs"]]} for t in p.types]
    fields = [{**f, "attrs": [attr(a) for a in f.get("attrs", [])]} for f in p.fields]
    return out | {"language": p.language, "types": types, "units": units, "fields": fields, "imports": p.imports, "constants": p.constants}


@dataclass(frozen=True)
class Facts:
    files: DataFrame
    types: DataFrame
    units: DataFrame
    calls: DataFrame
    fields: DataFrame
    imports: DataFrame
    constants: DataFrame


def parse_sources(sources: DataFrame) -> Facts:
    """Fact tables from (service, file, text, and perhaps issue: why there is no text). A file that can't be parsed, or has no text, is an issue in ``files``.

    Repeated unit ids of a service get their file in front from the second on; of types and constants of one name the
    first is known.
    """
    schema = arrow_schema()

    def parse(batches):
        for b in batches:
            rows = [parse_file(*r, schema) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    issue = "issue" if "issue" in sources.columns else F.lit(None).cast("string").alias("issue")
    parsed = cut(sources.select("service", "file", "text", issue).mapInArrow(parse, FACTS))
    of = lambda name: parsed.select("service", "file", "language", F.posexplode(name).alias("ord", "x")).select("service", "file", "language", "ord", "x.*")
    from pyspark.sql.window import Window

    units = of("units").withColumn("n", F.row_number().over(Window.partitionBy("service", "id").orderBy("file", "ord")))
    units = units.withColumn("first_id", F.col("id")).withColumn("id", F.when(F.col("n") > 1, F.concat_ws(":", "file", "id")).otherwise(F.col("id"))).drop("n")
    calls = units.select("service", "file", "language", F.col("id").alias("unit"), "type", F.posexplode("calls").alias("c_ord", "c")).select("service", "file", "language", "unit", "type", "c_ord", "c.*")
    return Facts(parsed.select("service", "file", "language", "issue"), of("types"), units.drop("calls"), calls, of("fields"), of("imports"), of("constants"))

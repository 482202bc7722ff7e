"""The tables of an estate of services, and those of the graph built from them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut
from ..schema import TABLES


@dataclass(frozen=True)
class Config:
    """Aggregation settings. Key order of ``targets`` matters: the first that fits wins."""

    targets: dict[str, str] = field(default_factory=dict)
    externals: dict[str, dict] = field(default_factory=dict)
    trace_names: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    max_depth: int = 8
    include_non_roots: bool = False


@dataclass(frozen=True)
class Estate:
    services: DataFrame
    handlers: DataFrame
    endpoints: DataFrame
    consumers: DataFrame
    calls: DataFrame
    publishes: DataFrame
    declared: DataFrame
    issues: DataFrame

    def without(self, ignored: tuple[str, ...]) -> Estate:
        """The estate without the manifests of the ignored services."""
        if not ignored:
            return self
        keep = lambda df, c: df.filter(~F.col(c).isin(*ignored))
        return Estate(**{f.name: keep(getattr(self, f.name), "id" if f.name == "services" else "service") for f in fields(self)})

    def written(self) -> Estate:
        """The estate as tables of its own: manifests are taken apart once, whatever is asked of them."""
        return Estate(**{f.name: cut(getattr(self, f.name)) for f in fields(self)})

    def replace(self, **changes: DataFrame) -> Estate:
        return replace(self, **changes)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], "m_ord int, i_ord int, " + TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with all columns of the named table, missing ones null."""
    wanted = {f.name: f.dataType for f in empty_table(df.sparkSession, name).schema.fields}
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()))


def estate_of(spark: SparkSession, **tables: DataFrame) -> Estate:
    return Estate(**{n: conform(tables[n], n) if n in tables else empty_table(spark, n) for n in TABLES})

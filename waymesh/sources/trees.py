"""Repositories as trees of files: listed level by level by the executors, on any store that Arrow reads, and pruned before anything is read."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut
from .manifests import MAX_SOURCE_CHARS, SKIPPED_FOLDERS, SOURCE_SUFFIXES

#: Levels below a root at most.
DEPTH = 64
#: Names of a repository's own settings, in the order in which they are looked for.
SETTINGS = ("waymesh.yaml", "waymesh.yml", "waymesh.json")

ENTRY = "root string, folder string, name string, is_dir boolean, size long, issue string"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; one without a scheme is in Spark's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


def opened(uri: str):
    """(Arrow file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def entries(folders: DataFrame) -> DataFrame:
    """What folders (root, folder) hold: root, folder, name, is_dir, size. A folder that can't be listed is one row with an issue."""
    names = ["root", "folder", "name", "is_dir", "size", "issue"]
    schema = pa.schema([(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()))])

    def look(batches):
        from pyarrow import fs

        for b in batches:
            rows = []
            for root, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    store, path = opened(folder)
                    found = store.get_file_info(fs.FileSelector(path))
                    rows += [(root, folder, i.base_name, i.type == fs.FileType.Directory, i.size, None) for i in found]
                except (OSError, ValueError) as e:
                    rows.append((root, folder, None, None, None, f"read-failed: {type(e).__name__}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, schema.types)], schema=schema)

    return folders.select("root", "folder").repartition("folder").mapInArrow(look, ENTRY)


def starts(spark: SparkSession, roots: list[str]) -> DataFrame:
    uris = [qualified(spark, r) for r in dict.fromkeys(roots)]
    return spark.createDataFrame([(r, r) for r in uris], "root string, folder string")


def below(found: DataFrame, skipped: list[str]) -> DataFrame:
    """The folders among entries that are looked into next."""
    return found.filter(F.col("is_dir") & ~F.col("name").isin(*skipped)).select("root", F.concat_ws("/", "folder", "name").alias("folder"))


def walk(spark: SparkSession, roots: list[str], skipped: list[str] = SKIPPED_FOLDERS, depth: int = DEPTH) -> DataFrame:
    """(root, file, size, issue): all files under the roots, by their paths from there. Skipped folders aren't looked into; a folder that can't be listed is a row with an issue."""
    levels, frontier = [], starts(spark, roots)
    for _ in range(depth + 1):
        found = cut(entries(frontier))
        levels.append(found.filter("issue is not null or not is_dir"))
        frontier = cut(below(found, skipped))
        if not frontier.limit(1).count():
            break
    every = reduce(DataFrame.union, levels)
    file = F.expr("substring(concat_ws('/', folder, name), length(root) + 2)")
    return every.select("root", file.alias("file"), "size", "issue")


def texts(files: DataFrame, max_chars: int = MAX_SOURCE_CHARS) -> DataFrame:
    """``files`` (root, file, size, issue) with text. A file of too many characters has none and is skipped, unread if its size alone says so; one that can't be read has an issue."""
    schema = pa.schema([(n, pa.string()) for n in ("root", "file", "text", "issue")])

    def take(batches):
        for b in batches:
            for root, file, size, issue in zip(*(c.to_pylist() for c in b.columns)):
                text = None
                if not issue and size is not None and size > 4 * max_chars:
                    issue = "file-skipped: too large"
                elif not issue:
                    try:
                        store, path = opened(root)
                        with store.open_input_file(f"{path}/{file}") as src:
                            text = src.read().decode("utf-8", "replace")
                        if len(text) > max_chars:
                            text, issue = None, "file-skipped: too large"
                    except (OSError, ValueError) as e:
                        issue = f"read-failed: {type(e).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (root, file, text, issue)], schema=schema)

    return files.select("root", "file", "size", "issue").repartition("root", "file").mapInArrow(take, "root string, file string, text string, issue string")


def read_sources(spark: SparkSession, roots: list[str] | str, suffixes: list[str] = SOURCE_SUFFIXES, skipped: list[str] = SKIPPED_FOLDERS, max_chars: int = MAX_SOURCE_CHARS) -> DataFrame:
    """(root, service, file, text, issue) of the sources of repositories; the service is the name of the repository's folder. Nothing in a skipped folder is listed, and nothing but sources is read."""
    files = walk(spark, [roots] if isinstance(roots, str) else roots, skipped)
    wanted = reduce(lambda a, b: a | b, (F.lower("file").endswith(s) for s in suffixes))
    out = texts(files.filter(wanted | F.col("issue").isNotNull()), max_chars)
    return out.select("root", F.element_at(F.split("root", "/"), -1).alias("service"), "file", "text", "issue")


def find_repositories(spark: SparkSession, roots: list[str], depth: int = 2, configured_only: bool = False, names: tuple[str, ...] = SETTINGS, skipped: list[str] = SKIPPED_FOLDERS) -> DataFrame:
    """(folder): folders that are repositories (they hold settings, or .git), down to ``depth`` levels below the roots; none is looked into further, and hidden folders aren't."""
    marks, found, frontier = [*names, *([] if configured_only else [".git"])], [], starts(spark, roots)
    for level in range(depth + 1):
        held = cut(entries(frontier))
        repos = held.filter(F.col("name").isin(*marks)).select("folder").distinct()
        found.append(repos)
        if level == depth:
            break
        frontier = cut(below(held.join(repos, "folder", "left_anti").filter(~F.col("name").startswith(".")), skipped))
        if not frontier.limit(1).count():
            break
    return reduce(DataFrame.union, found).distinct()


SETTING = (
    "service string, id string, name string, layer string, owner string, repo string, language string, description string, frameworks array<string>, tags array<string>, "
    "targets map<string,string>, declared array<struct<service:string,reason:string>>, enable array<string>, disable array<string>"
)


def setting_of(service: str, got: dict) -> dict:
    """One row of settings from a settings document; what has another shape than expected is left out."""
    own, plugins = (x if isinstance(x, dict) else {} for x in (got.get("service"), got.get("plugins")))
    text = lambda x: None if x is None or isinstance(x, dict | list) else str(x)
    many = lambda x: [str(y) for y in x] if isinstance(x, list) else None
    targets = got.get("targets") if isinstance(got.get("targets"), dict) else {}
    declared = got.get("declaredDependencies") if isinstance(got.get("declaredDependencies"), list) else []
    return {
        "service": service, **{k: text(own.get(k)) for k in ("id", "name", "layer", "owner", "repo", "language", "description")}, "frameworks": many(own.get("frameworks")), "tags": many(own.get("tags")),
        "targets": [(str(k), str(v)) for k, v in targets.items()], "declared": [{"service": text(d.get("service")), "reason": text(d.get("reason"))} for d in declared if isinstance(d, dict)],
        "enable": many(plugins.get("enable")), "disable": many(plugins.get("disable")),
    }


def read_settings(files: DataFrame, names: tuple[str, ...] = SETTINGS) -> DataFrame:
    """Settings of each service from files (service, file, text), in YAML or JSON: the first of ``names`` that can be read counts; without any a service has no row."""
    s = pa.string()
    schema = pa.schema([*((n, s) for n in ("service", "id", "name", "layer", "owner", "repo", "language", "description")), ("frameworks", pa.list_(s)), ("tags", pa.list_(s)), ("targets", pa.map_(s, s)), ("declared", pa.list_(pa.struct([("service", s), ("reason", s)]))), ("enable", pa.list_(s)), ("disable", pa.list_(s))])
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("file")).cast("int")
    mine = files.filter(F.col("file").isin(*names) & F.col("text").isNotNull()).select("service", rank.alias("rank"), "text").groupBy("service").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("all"))

    def read(batches):
        import yaml

        for b in batches:
            rows = []
            for service, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for one in found:
                    try:
                        got = json.loads(one["text"]) if names[one["rank"] - 1].endswith(".json") else yaml.safe_load(one["text"])
                    except (ValueError, yaml.YAMLError):
                        continue
                    rows.append(setting_of(service, got if isinstance(got, dict) else {}))
                    break
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut(mine.mapInArrow(read, SETTING))

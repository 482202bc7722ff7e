"""Which service an outbound call reaches: rules in order of precedence, each applied to what the earlier ones left over.

All rules work on distinct probes (hint, host, or method and path), not on calls, so a million calls to one route cost
one lookup. One table holds, for each distinct method and path, the best endpoint of every service that has one; the
rules look their targets up in it. Theta conditions (suffix paths with wildcards, tokens inside a host) are equi-joins
on exploded keys. What the rules find is joined back to the calls once, and one expression says which rule wins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.session import cut
from .estate import Config, Estate

EP = "struct<id:string,i_ord:int,score:int>"


def parsed_calls(calls: DataFrame) -> DataFrame:
    """Calls with host, path, hint and target ('' as null)."""
    u = fn.call_url("url")
    return calls.withColumns({"host": u["host"], "path": u["path"], "hint": fn.truthy("targetHint"), "explicit": fn.truthy("targetService")})


def methods_agree(a: Column, b: Column) -> Column:
    a, b = F.coalesce(fn.truthy(a), F.lit("ANY")), F.coalesce(fn.truthy(b), F.lit("ANY"))
    return (a == "ANY") | (b == "ANY") | (a == b)


def _null_safe(a: DataFrame, b: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join on columns that may be null on both sides."""
    b = b.select(*(F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in b.columns))
    on = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names))
    return a.join(b, on, how) if how == "left_semi" else a.join(b, on, how).drop(*(f"__{n}" for n in names))


def raised(confidence: Column) -> Column:
    return F.when(F.col("ep").isNotNull(), F.least(F.lit(1.0), confidence + 0.05)).otherwise(confidence)


def known_nodes(e: Estate) -> DataFrame:
    topic = F.when((F.col("broker") == "rabbitmq") & fn.truthy("exchange").isNotNull(), F.col("exchange")).otherwise(F.col("topic"))
    parts = [e.services.select(F.col("id").alias("node")), e.endpoints.select(fn.endpoint_node("service", "id")), e.handlers.select(fn.endpoint_node("service", "id")), e.publishes.select(fn.topic_node("broker", "topic")), e.consumers.select(fn.topic_node("broker", topic))]
    return reduce(DataFrame.union, parts).distinct()


def required_literal(pattern: str) -> str:
    """The longest text that every match of a regular expression holds, in lower case; '' if none is sure (alternatives, for one)."""
    runs, run, depth, at = [], "", 0, 0
    while at < len(pattern):
        c, step = pattern[at], 1
        one = ""
        if c == "\\" and at + 1 < len(pattern):
            step = 2
            one = pattern[at + 1] if not pattern[at + 1].isalnum() else ""
        elif c == "[":
            end = pattern.find("]", at + 2)
            if end < 0:
                return ""
            step = end + 1 - at
        elif c == "|" and depth == 0:
            return ""
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{":
            step = max(1, pattern.find("}", at) + 1 - at)
        elif c not in "|^$.*+?":
            one = c
        if depth or not one:
            runs.append(run)
            run = ""
        elif pattern[at + step : at + step + 1] in ("?", "*", "{"):  # may be missing
            runs.append(run)
            run = ""
        else:
            run += one
            if pattern[at + step : at + step + 1] == "+":
                runs.append(run)
                run = ""
        at += step
    return max([*runs, run], key=len).lower()


#: Characters of a piece that tells where a pattern may begin, and of the longest piece that is looked up there.
GRAM, PIECE = 3, 16
#: A table of settings is sent to all executors up to so many characters; a larger one is joined by a shuffle.
SENT_CHARS = 8_000_000


def _sent(rows: list[tuple], spark: SparkSession, schema: str) -> DataFrame:
    """A table of settings, which the driver holds anyway."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if sum(len(str(x)) for row in rows for x in row) <= SENT_CHARS else table


def tried_targets(texts: DataFrame, plain: list[tuple[int, str]], sought: list[tuple[int, str, str]]) -> DataFrame:
    """(text, t_ord, regex): each text with the plain keys (t_ord, lower case) that it is, where regex is null, and the patterns (t_ord, regex, required literal) whose literal it holds.

    Only places where a literal's first characters stand are kept; what stands there is looked up by equality, in each
    length that a literal has. So it doesn't count how many patterns begin alike. Texts are read once for all of this.
    """
    begins = sorted({literal[:GRAM] for *_, literal in sought})
    lengths = sorted({len(literal[:PIECE]) for *_, literal in sought})
    table = [(at, None, key, True) for at, key in plain] + [(at, regex, literal[:PIECE], False) for at, regex, literal in sought]
    held = texts.select("text", F.lower("text").alias("low")).withColumn("whole", F.lit(True)).withColumn("piece", F.col("low"))
    if sought:
        last = F.greatest(F.length("low") - (GRAM - 1), F.lit(1))
        places = F.filter(F.sequence(F.lit(1), last), lambda i: F.substring("low", i, F.lit(GRAM)).isin(*begins))
        at = held.select("text", "low", F.explode(F.concat(F.array(F.lit(0)), places)).alias("at"))
        there = F.array_distinct(F.array(*(F.substring("low", F.col("at"), F.lit(n)) for n in lengths)))
        held = at.select("text", (F.col("at") == 0).alias("whole"), F.explode(F.when(F.col("at") == 0, F.array("low")).otherwise(there)).alias("piece"))
    return held.join(_sent(table, texts.sparkSession, "t_ord int, regex string, piece string, whole boolean"), ["piece", "whole"]).select("text", "t_ord", "regex")


def matched_targets(texts: DataFrame, config: Config) -> DataFrame:
    """(text, t_ord): for distinct ``text``, the place of the first target, in key order, that fits it; texts that none fits are left out.

    Keys are a table, not a chain of conditions. A plain key is joined by equality. A pattern is tried only on texts that
    hold the longest text that the pattern requires (its first ``PIECE`` characters), which is an equality join too; only
    patterns that require none are tried on every text.
    """
    plain, sought, loose = [], [], []
    for at, key in enumerate(config.targets):
        if len(key) > 2 and key[0] == key[-1] == "/":
            # beyond ASCII, lower case may depend on what stands beside a letter
            literal = max(re.findall(r"[\x00-\x7f]+", required_literal(key[1:-1])), key=len, default="")
            (sought if len(literal) >= GRAM else loose).append((at, "(?i)" + key[1:-1], literal))
        else:
            plain.append((at, key.lower()))
    found = [tried_targets(texts, plain, sought).filter(F.col("regex").isNull() | F.expr("text rlike regex")).select("text", "t_ord")]
    if loose:
        held = F.array(*(F.struct(F.lit(at).alias("t_ord"), F.lit(regex).alias("regex")) for at, regex, _ in loose))
        hit = F.get(F.filter(held, lambda x: F.regexp_like("text", x["regex"])), F.lit(0))["t_ord"]
        found.append(texts.select("text", hit.alias("t_ord")).filter("t_ord is not null"))
    return reduce(DataFrame.union, found).groupBy("text").agg(F.min("t_ord").alias("t_ord"))


def with_config_value(calls: DataFrame, config: Config) -> DataFrame:
    """``calls`` (hint, host, url) with value: that of the first target that fits any of the three, in key order.

    ``calls`` are read once for each of the three and once more, so they should be a table. Each of the three has a table
    of its own: hints and hosts are few as a rule, and a small table joins without a shuffle.
    """
    if not config.targets:
        return calls.withColumn("value", F.lit(None).cast("string"))
    probes, first = ("hint", "host", "url"), calls
    for c in probes:
        found = cut(matched_targets(calls.select(F.col(c).alias("text")).filter("text <> ''").distinct(), config))
        first = first.join(found.select(F.col("text").alias(c), F.col("t_ord").alias(f"__{c}")), c, "left")
    values = _sent(list(enumerate(config.targets.values())), calls.sparkSession, "t_ord int, value string")
    first = first.withColumn("t_ord", F.least(*(F.col(f"__{c}") for c in probes)))
    return first.join(values, "t_ord", "left").drop("t_ord", *(f"__{c}" for c in probes))


def hint_candidates(probes: DataFrame, services: DataFrame) -> DataFrame:
    """For distinct (service, hint): the services that share most tokens with the hint: tops array<string> in manifest order."""
    hints = probes.select(F.col("service").alias("caller"), "hint").distinct().withColumn("t", F.explode(F.array_distinct(fn.tokens("hint"))))
    words = services.select("id", "m_ord", F.explode(F.array_distinct(F.concat(fn.tokens("id"), fn.tokens("name")))).alias("t"))
    scored = hints.join(words, "t").filter(F.col("id") != F.col("caller")).groupBy("caller", "hint", "id", "m_ord").agg(F.count("*").alias("score"))
    top = scored.withColumn("most", F.max("score").over(Window.partitionBy("caller", "hint"))).filter("score = most")
    tops = top.groupBy("caller", "hint").agg(F.sort_array(F.collect_list(F.struct("m_ord", "id"))).alias("tops"))
    return tops.select(F.col("caller").alias("service"), "hint", F.col("tops.id").alias("tops"))


def host_owners(probes: DataFrame, services: DataFrame) -> DataFrame:
    """For distinct (service, host): the first service, other than the caller, all of whose tokens are parts of the host."""
    words = services.select("id", "m_ord", F.array_distinct(fn.tokens("id")).alias("ts")).filter("size(ts) > 0")
    hosts = probes.select(F.col("service").alias("caller"), "host").distinct()
    parts = hosts.select("host").distinct().withColumn("part", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(host)), i -> transform(sequence(1, length(host) - i + 1), n -> substring(host, i, n)))))")))
    held = words.withColumn("part", F.explode("ts")).join(parts, "part").groupBy("host", "id", "m_ord", F.size("ts").alias("n")).agg(F.count("*").alias("met")).filter("met = n")
    return hosts.join(held, "host").filter("id <> caller").groupBy(F.col("caller").alias("service"), "host").agg(F.min_by("id", "m_ord").alias("owner"))


def path_candidates(probes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """For distinct (method, path): each service (target) with its best matching endpoint, the first on ties: ep struct<id, i_ord, score>.

    Any place that is fixed in the call must be equal or a wildcard in the endpoint, so the call's last fixed segment
    and its place from the end are the join key. A call of wildcards alone meets any endpoint that is long enough, all
    with score 0: only its length and method matter, so it meets the first endpoint of each service, method and length.
    """
    p = probes.filter("path <> ''").select("method", "path").distinct()
    back = F.reverse(F.transform(fn.segments("path"), F.lower))
    key = lambda place, seg: F.concat(place.cast("string"), F.lit("/"), seg)
    p = p.withColumn("back", back).withColumn("at", F.array_position(F.transform("back", lambda x: x != "{p}"), True).cast("int"))
    e = endpoints.select(F.col("service").alias("target"), F.col("id").alias("e_id"), F.col("method").alias("e_method"), F.col("path").alias("e_path"), F.col("i_ord").cast("int").alias("e_ord")).withColumn("back", F.reverse(F.transform(fn.segments("e_path"), F.lower)))
    fixed = p.filter("at > 0").withColumn("k", F.explode(F.array(key(F.col("at"), F.element_at("back", F.greatest(F.lit(1), F.col("at")))), key(F.col("at"), F.lit("{p}"))))).select("method", "path", "k")
    keyed = e.select("target", "e_id", "e_method", "e_path", "e_ord", F.explode(F.array_distinct(F.transform("back", lambda x, i: key(i + 1, x)))).alias("k"))
    met = fixed.join(keyed, "k").filter(methods_agree(F.col("method"), F.col("e_method")) & fn.path_matches("path", "e_path")).withColumn("score", fn.match_score("path", "e_path").cast("int"))
    first = e.groupBy("target", "e_method", F.size("back").alias("n")).agg(F.min(F.struct("e_ord", "e_id")).alias("e"))
    wild = p.filter("at = 0").withColumn("need", F.size("back")).filter("need > 0")
    loose = wild.join(first, (F.col("n") >= F.col("need")) & methods_agree(F.col("method"), F.col("e_method"))).select("method", "path", "target", "e.e_id", "e.e_ord", F.lit(0).alias("score"))
    rows = met.select("method", "path", "target", "e_id", "e_ord", "score").union(loose)
    best = F.max_by(F.struct(F.col("e_id").alias("id"), F.col("e_ord").alias("i_ord"), "score"), F.struct("score", -F.col("e_ord")))
    return rows.groupBy("method", "path", "target").agg(best.alias("ep"))


COLUMNS = ["m_ord", "i_ord", "service", "id", "method", "url", "fromHandler", "loc", "target", "resolution", "confidence", "ep", "outer"]


def tied_hints(probes: DataFrame, candidates: DataFrame) -> DataFrame:
    """For distinct (service, hint, method, path) whose hint fits several services (tops): won, the only one of them that has the path."""
    several = probes.select("service", "hint", "method", "path", F.explode("tops").alias("target"))
    met = _null_safe(several, candidates.select("method", "path", "target"), ["method", "path", "target"], "left_semi")
    return met.groupBy("service", "hint", "method", "path").agg(F.min("target").alias("won"), F.count("*").alias("n")).filter("n = 1").drop("n")


def shared_paths(candidates: DataFrame, services: DataFrame) -> DataFrame:
    """For distinct (method, path): n, how many services have it, and best array<struct<by, t_ord, target, ep>>, the first three of them.

    Three are enough to know the two best without the caller's own service, whichever that is; no list is made for each
    caller. Each task keeps three of a path before the shuffle.
    """
    order = services.select(F.col("id").alias("target"), F.col("m_ord").alias("t_ord"))
    rows = candidates.join(order, "target").withColumn("by", -F.col("ep.score"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("method", "path").orderBy("by", "t_ord", "target"))).filter("r <= 3")
    best = top.groupBy("method", "path").agg(F.sort_array(F.collect_list(F.struct("by", "t_ord", "target", "ep"))).alias("best"))
    return _null_safe(best, rows.groupBy("method", "path").agg(F.count("*").alias("n")), ["method", "path"], "inner")


def ranked_paths(probes: DataFrame, candidates: DataFrame, services: DataFrame) -> DataFrame:
    """For distinct (service, method, path): n_found, how many other services have the path, and found, the two best of them."""
    met = _null_safe(probes, shared_paths(candidates, services), ["method", "path"], "inner")
    own = _null_safe(met, candidates.select("method", "path", F.col("target").alias("service"), F.lit(1).alias("own")), ["method", "path", "service"], "left")
    others = own.withColumn("n_found", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int")).filter("n_found > 0")
    return others.select("service", "method", "path", "n_found", F.slice(F.filter("best", lambda x: x["target"] != F.col("service")), 1, 2).alias("found"))


def named_paths(probes: DataFrame, candidates: DataFrame, services: DataFrame) -> DataFrame:
    """(method, path, names): for the paths of messages, all services that have it, best first: one list for all callers."""
    order = services.select(F.col("id").alias("target"), F.col("m_ord").alias("t_ord"))
    rows = _null_safe(candidates, probes.select("method", "path").distinct(), ["method", "path"], "left_semi").join(order, "target")
    return rows.groupBy("method", "path").agg(F.sort_array(F.collect_list(F.struct((-F.col("ep.score")).alias("by"), "t_ord", "target"))).alias("s")).select("method", "path", F.col("s.target").alias("names"))


def ruled_calls(e: Estate, config: Config) -> tuple[DataFrame, DataFrame]:
    """(calls, candidates): each call with what every rule says of it, the rule that wins (null: none), its target and that target's endpoint; and the endpoints that paths fit."""
    calls = cut(with_config_value(cut(parsed_calls(e.calls)), config).withColumn("named", F.coalesce("explicit", "value")))
    candidates = cut(path_candidates(calls, e.endpoints))
    rows = _null_safe(calls, known_nodes(e).select(F.col("node").alias("named"), F.lit(True).alias("known")), ["named"], "left")
    open_ = calls.filter("named is null")
    tops = cut(hint_candidates(open_.filter("hint is not null"), e.services))
    hinted = open_.join(tops, ["service", "hint"])
    won = tied_hints(hinted.filter("size(tops) > 1").select("service", "hint", "method", "path", "tops").distinct(), candidates)
    owners = host_owners(open_.filter("host is not null"), e.services)
    asked = open_.filter("host is null and path <> ''").select("service", "method", "path").distinct()
    paths = ranked_paths(asked, candidates, e.services)
    rows = rows.join(tops, ["service", "hint"], "left")
    rows = _null_safe(rows, won, ["service", "hint", "method", "path"], "left")
    rows = rows.join(owners, ["service", "host"], "left")
    rows = _null_safe(rows, paths, ["service", "method", "path"], "left")
    clear = (F.col("n_found") == 1) | (F.get("found", F.lit(0))["by"] < F.get("found", F.lit(1))["by"])
    hint = F.when(F.size("tops") == 1, "hint").when(F.col("won").isNotNull(), "hint+path")
    host = F.when(F.col("host").isNotNull(), F.when(F.col("owner").isNotNull(), "host-match").otherwise("literal-host"))
    path = F.when(F.coalesce(clear, F.lit(False)), "path-match")
    rule = F.when(F.col("named").isNotNull(), "named").otherwise(F.coalesce(hint, host, path))
    external, known = F.col("named").startswith("external:"), F.col("known").isNotNull()
    outer = F.when(F.col("rule") == "named", F.when(external, F.substring("named", 10, 1 << 30)).when(~known, F.col("named"))).when(F.col("rule") == "literal-host", F.col("host"))
    first = F.get("found", F.lit(0))
    target = F.when(F.col("outer").isNotNull(), fn.external_node("outer")).when(F.col("rule") == "named", F.col("named")).when(F.col("rule") == "hint", F.get("tops", F.lit(0))).when(F.col("rule") == "hint+path", F.col("won")).when(F.col("rule") == "host-match", F.col("owner")).when(F.col("rule") == "path-match", first["target"])
    rows = rows.withColumn("rule", rule).withColumn("outer", outer).withColumn("target", target)
    ruled = cut(_null_safe(rows, candidates, ["method", "path", "target"], "left").withColumn("ep", F.when(F.col("rule") == "path-match", first["ep"]).when(F.col("rule") != "literal-host", F.col("ep"))))
    return ruled, candidates


def resolve(e: Estate, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(resolved, issues): each resolved call once, with target, endpoint, resolution and confidence; and what was ambiguous or unresolved."""
    rows, candidates = ruled_calls(e, config)
    external, known = F.col("named").startswith("external:"), F.col("known").isNotNull()
    declared = F.col("explicit").isNotNull()
    name = F.when(declared, "declared").otherwise("config")
    resolution = F.when(F.col("rule") == "named", F.when(external | known, name).otherwise(F.concat(name, F.lit("-external")))).otherwise(F.col("rule"))
    given = F.when(declared, 1.0).otherwise(0.95)
    confidence = (
        F.when(F.col("rule") == "named", F.when(external, given).when(~known, F.least(given, F.lit(0.9))).otherwise(raised(given)))
        .when(F.col("rule").isin("hint", "hint+path"), raised(F.lit(0.8))).when(F.col("rule") == "host-match", raised(F.lit(0.7)))
        .when(F.col("rule") == "literal-host", 0.9).when(F.col("n_found") == 1, 0.7).otherwise(0.6)
    )
    resolved = rows.filter("rule is not null").withColumn("resolution", resolution).withColumn("confidence", confidence).select(*COLUMNS)

    def issue(df: DataFrame, code: str, message: Column) -> DataFrame:
        return df.select(F.lit("warn").alias("level"), F.lit(code).alias("code"), "service", message.alias("message"), "loc", "m_ord", "i_ord")

    tied = F.concat(F.lit('Hint "'), F.col("targetHint"), F.lit('" matches several services: '), F.concat_ws(", ", "tops"))
    vague = F.concat(F.lit("Path "), F.col("path"), F.lit(" matches endpoints in several services: "), F.concat_ws(", ", F.array_remove("names", F.col("service"))), F.lit("; add a targets entry"))
    hint = F.when(F.col("hint").isNotNull(), F.concat(F.lit(" (hint: "), F.col("targetHint"), F.lit(")"))).otherwise("")
    lost = F.concat(F.lit("Could not resolve target of "), F.coalesce("method", F.lit("HTTP")), F.lit(" "), F.col("url"), hint, F.lit(" from "), F.col("fromHandler"))
    several = rows.filter("rule is null and n_found > 1")
    told = _null_safe(several, named_paths(several, candidates, e.services), ["method", "path"], "inner")
    issues = [
        issue(rows.filter("named is null and size(tops) > 1 and won is null"), "call:ambiguous-hint", tied),
        issue(told, "call:ambiguous-path", vague),
        issue(rows.filter("rule is null"), "call:unresolved", lost),
    ]
    return resolved, reduce(DataFrame.unionByName, issues)

"""Consequential operations: calls joined with the rule catalogue.

A pattern matches a dotted name or any of its dotted endings. All endings are exploded, so that the match is an
equi-join with the small rule table; of several rules the one with the least (priority, position) wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.plans import catalogue
from reachlight.plans.catalogue import Rule

SQL_METHODS = ("exec", "execute", "executemany", "executescript")
GO_SQL_METHODS = ("Exec", "ExecContext", "Query", "QueryContext", "QueryRow", "QueryRowContext")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row for each rule: place (its position), id, category, severity, priority, description and tags."""
    rows = [(i, r.id, r.category, r.severity, r.priority, r.description, *r.tags) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "place int, rule_id string, category string, severity string, priority int, description string, cwe string, owasp string")


def pattern_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.language, r.priority, r.kind, p, list(r.modules), [x.lower() for x in r.excluded], [x.lower() for x in r.constructors], [x.lower() for x in r.hops]) for i, r in enumerate(rules) if r.kind in ("name", "attr", "qualified") for p in r.patterns]
    return spark.createDataFrame(rows, "place int, language string, priority int, how string, pattern string, modules array<string>, excluded array<string>, constructors array<string>, hops array<string>")


def endings(name: Column) -> Column:
    """A dotted name and what follows each of its dots."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def ends_with(name: Column, end: Column | str) -> Column:
    end = F.lit(end) if isinstance(end, str) else end
    return (name == end) | name.endswith(F.concat(F.lit("."), end))


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def calls_of(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "path", "language", F.explode("calls").alias("c")).select("repo", "path", "language", "c.*")


KEY = ("repo", "path", "ord")


def by_pattern(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo, path, ord, place, priority) of each matching pair of call and rule, before the winner is chosen."""
    qualified = F.when(F.col("kind") != "other", F.array_distinct(F.concat(F.flatten(F.transform("names", endings)), "exact"))).otherwise(F.array().cast("array<string>"))
    one = lambda how, on: F.when(on, F.array(F.struct(F.lit(how).alias("how"), F.col("last").alias("pattern"))))
    none = F.array().cast("array<struct<how:string,pattern:string>>")
    keys = F.concat(F.coalesce(one("name", F.col("kind") == "name"), none), F.coalesce(one("attr", F.col("kind") == "attr"), none), F.transform(qualified, lambda p: F.struct(F.lit("qualified").alias("how"), p.alias("pattern"))))
    # Go calls that are marked aren't the caller's doing
    calls = calls.where((F.col("language") != "go") | (F.array_join("classes", "") == ""))
    pairs = calls.select(*KEY, "language", "kind", "mods", "strong", F.lower("origin").alias("origin"), F.lower(F.concat_ws(" ", "chain")).alias("way"), F.explode(keys).alias("k")).select("*", "k.how", "k.pattern").join(F.broadcast(patterns), ["how", "pattern", "language"])
    final = last_part(F.col("origin"))
    modules = (F.col("how") != "attr") | (F.size("modules") == 0) | F.arrays_overlap("mods", "modules")
    not_excluded = ~(F.col("strong") & F.exists("excluded", lambda x: ends_with(F.col("origin"), x) | (x == final)))
    gated = (F.size("constructors") > 0) | (F.size("hops") > 0)
    made = F.col("strong") & F.exists("constructors", lambda x: (x == F.col("origin")) | ends_with(F.col("origin"), last_part(x)))
    led = F.exists("hops", lambda x: F.col("way").contains(x))
    passes = ~gated | ((F.col("kind") == "attr") & (F.col("origin") != "") & (made | led))
    return pairs.where(modules & ((F.col("how") != "qualified") | (not_excluded & passes))).select(*KEY, "place", "priority")


def is_deploy() -> Column:
    words = "|".join(catalogue.DEPLOY_WORDS)
    methods = F.col("last").isin("Popen", "call", "check_call", "check_output", "run", "system") & F.col("module_name").isin("os", "subprocess") & (F.size(F.split("callee", r"\.")) == 2)
    return (F.col("kind") == "attr") & methods & F.exists("args", lambda a: a["pos"].isNotNull() & F.exists(a["literals"], lambda x: F.lower(x).rlike(words)))


def first_text() -> Column:
    """The text of the first positional argument; '' if it isn't a literal."""
    return F.coalesce(F.get(F.filter("args", lambda a: a["pos"] == 0), F.lit(0))["text"], F.lit(""))


def is_rest() -> Column:
    url = F.lower(first_text())
    path = "|".join(catalogue.REST_PATHS)
    return (F.col("kind") == "attr") & F.lower("last").isin("delete", "patch", "post", "put") & (url.contains("api.github.com") | url.contains("github.com/api")) & url.rlike(path)


def is_open_for_writing() -> Column:
    mode = F.coalesce(F.get(F.filter("args", lambda a: (a["pos"] == 1) | (a["kw"] == "mode")), F.lit(0))["text"], F.lit(""))
    return (F.col("kind") == "name") & (F.col("callee") == "open") & mode.rlike("[wax+]")


def is_database() -> Column:
    origin = F.lower("origin")
    driver = F.col("strong") & F.lit(False)
    for d in catalogue.DB_DRIVERS:
        driver = driver | (F.col("strong") & ((origin == d.lower()) | origin.startswith(d.lower() + ".")))
    maker = F.col("strong") & last_part(origin).isin(*[m.lower() for m in catalogue.DB_MAKERS])
    return driver | maker | F.lower("receiver").rlike("|".join(catalogue.DB_NAMES))


def by_sql(calls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Statements executed on a database: a literal must match a rule's pattern, anything else always counts."""
    text = first_text()

    def hits(language: str) -> Column:
        return F.array_compact(F.array(*[F.when((text == "") | text.rlike("(?is)" + "|".join(r.patterns)), F.struct(F.lit(r.priority).alias("priority"), F.lit(i).alias("place"))) for i, r in enumerate(rules) if r.kind == "sql" and r.language == language]))

    names = sorted({m for r in rules if r.kind == "sql" and r.language == "go" for m in r.modules})
    python = (F.col("language") == "python") & F.col("last").isin(*SQL_METHODS) & is_database()
    go = (F.col("language") == "go") & F.col("last").isin(*GO_SQL_METHODS) & F.col("receiver").isin(*names)
    on = (F.col("kind") == "attr") & F.exists("args", lambda a: a["pos"].isNotNull()) & (python | go)
    return calls.where(on).select(*KEY, F.array_min(F.when(F.col("language") == "go", hits("go")).otherwise(hits("python"))).alias("w")).where("w IS NOT NULL").select(*KEY, "w.place")


def sinks(facts: DataFrame, rules: Sequence[Rule] = catalogue.RULES) -> DataFrame:
    """(repo, path, line, col, fn, place, severity, text): at most one row for each call and pass, as passes aren't merged.

    The passes: patterns, deployment commands and REST calls together; SQL; files opened for writing; texts assigned
    to variables named like statements.
    """
    spark = facts.sparkSession
    calls = calls_of(facts)
    flagged = [(i, r.priority, (F.col("language") == "python") & {"deploy": is_deploy, "rest": is_rest}[r.kind]()) for i, r in enumerate(rules) if r.kind in ("deploy", "rest")]
    special = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(i).alias("place"), F.lit(p).alias("priority"))) for i, p, on in flagged])) if flagged else None
    found = by_pattern(calls, pattern_table(spark, rules))
    if special is not None:
        found = found.unionByName(calls.select(*KEY, F.explode(special).alias("s")).select(*KEY, "s.place", "s.priority"))
    won = found.groupBy(*KEY).agg(F.min(F.struct("priority", "place")).alias("w")).select(*KEY, "w.place")
    passes = won.unionByName(by_sql(calls, rules))
    for i, r in enumerate(rules):
        if r.kind == "open":
            passes = passes.unionByName(calls.where((F.col("language") == "python") & is_open_for_writing()).select(*KEY, F.lit(i).alias("place")))
    severity = F.element_at(F.array(*[F.lit(r.severity) for r in rules]), F.col("place") + 1)
    escalated = F.lit(False)
    for i, r in enumerate(rules):
        if r.escalates:
            escalated = escalated | ((F.col("place") == i) & F.exists("args", lambda a: ((a["pos"] == 0) | a["kw"].isin(*r.escalates)) & F.arrays_overlap(a["roots"], F.col("near_params"))))
    rows = passes.join(calls.select(*KEY, "line", "col", "fn", "text", "args", "near_params"), list(KEY)).select("repo", "path", "line", "col", "fn", "place", F.when(escalated, "high").otherwise(severity).alias("severity"), "text")
    texts = facts.select("repo", "path", F.explode("texts").alias("t")).select("repo", "path", "t.*").where(F.lower("target").isin("command", "query", "sql", "statement", "stmt"))
    for i, r in enumerate(rules):
        if r.kind == "text":
            rows = rows.unionByName(texts.where(F.col("value").rlike("(?is)" + "|".join(r.patterns))).select("repo", "path", "line", "col", "fn", F.lit(i).alias("place"), F.lit(r.severity).alias("severity"), F.concat(F.lit("'"), F.substring("value", 1, 80), F.lit("'")).alias("text")))
    return rows

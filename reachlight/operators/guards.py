"""Whether an authority check stands before an operation: one that dominates it, is bound to its data, and is heeded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlight.operators.reachability import functions_of, strings
from reachlight.operators.sinks import calls_of, last_part
from reachlight.plans import catalogue

USED = ("Assert", "Assign", "BoolOp", "If", "Raise", "Return", "UnaryOp", "While")


def is_guard_name(name: Column, guards: Sequence[str]) -> Column:
    """A guard's name, or one that ends with it after a dot, in any case; or a name like validate_x or _check."""
    low = F.lower(name)
    known = F.arrays_overlap(F.transform(F.sequence(F.lit(1), F.size(F.split(low, r"\."))), lambda i: F.array_join(F.slice(F.split(low, r"\."), i, 99), ".")), strings(sorted({g.lower() for g in guards})))
    return (name != "") & known


def is_check_name(name: Column) -> Column:
    return F.regexp_replace(last_part(F.lower(name)), "^_+", "").rlike(f"^(?:{'|'.join(catalogue.CHECK_WORDS)})(?:_|$)")


CAMEL = "allow assert authenticate authorize can check deny enforce ensure gate guard may must permit require validate verify".split()
#: Names that TypeScript adds to the vocabulary.
SCRIPT_GUARDS = "abac canExecute checkAuth ensureAuthorized intercept pdp pep permission policy preAuthorize protect rbac secured".split()


def squeezed(words: Sequence[str]) -> list[str]:
    return sorted({w.lower().split(".")[-1].replace("_", "") for w in words})


def is_other_guard(name: Column, guards: Sequence[str]) -> Column:
    """Guards of the other languages, in camel case or snake case: a known name, or one that begins like a check."""
    last = last_part(name)
    flat = F.lower(F.regexp_replace(last, "_", ""))
    script = flat.isin(*squeezed([*guards, *SCRIPT_GUARDS])) | flat.rlike("^(?:" + "|".join(CAMEL) + ")")
    go = flat.isin(*squeezed(guards)) | last.rlike("^_*(?i:" + "|".join(catalogue.CHECK_WORDS) + ")(?:_|[A-Z]|$)")
    return (name != "") & F.when(F.col("language") == "go", go).otherwise(script)


def names(args: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(args, lambda a: a["name"])))


def holds(ranges: Column, line: Column) -> Column:
    return F.exists(ranges, lambda r: line.between(r["lo"], r["hi"]))


def dominates() -> Column:
    """No step between the guard and its function lets control pass the guard by on the way to the sink."""
    at = F.transform("steps", lambda s: s["ord"])
    own = F.slice(F.col("steps"), 1, F.greatest(F.array_position(at, F.col("fn")).cast("int") - 1, F.lit(0)))
    line = F.col("line")
    bad = F.exists(
        own,
        lambda s: (
            (s["kind"] == "function")
            | ((s["kind"] == "If") & (s["never"] | (s["body"] & ~holds(s["body_ranges"], line)) | (s["orelse"] & ~holds(s["orelse_ranges"], line))))
            | ((s["kind"] == "ExceptHandler") & ~line.between(s["lo"], s["hi"]))
            | ((s["kind"] == "Try") & s["body"] & ~holds(s["body_ranges"], line) & s["swallows"])
        ),
    )
    return ~bad


def checked(found: DataFrame, facts: DataFrame, guards: Sequence[str] = catalogue.GUARDS) -> DataFrame:
    """The reachable sinks with guard_status (guarded, weak, unbound or '') and guard_message."""
    at = ["repo", "path", "line"]
    calls = calls_of(facts)
    first = calls.groupBy("repo", "path", "line").agg(F.min_by(names(F.col("args")), "ord").alias("sink_names"))
    sinks = found.join(first, at, "left").withColumn("sid", F.xxhash64("repo", "path", "line", "fn"))
    maybe = calls.where(F.when(F.col("language") == "python", (F.col("callee") != "") & (is_guard_name(F.col("callee"), guards) | is_check_name(F.col("callee")))).otherwise(is_other_guard(F.col("callee"), guards))).select(
        "language", "repo", "path", F.col("ord").alias("g_ord"), F.col("line").alias("g_line"), "callee", F.col("parent"), names(F.col("args")).alias("g_names"), "fids", "constant_in", "steps"
    )
    spots = sinks.where("fn >= 0").select("repo", "path", "line", "fn", "sink_names", "aliases").dropDuplicates(["repo", "path", "line", "fn"])
    before = spots.join(maybe, ["repo", "path"]).where((F.col("g_line") < F.col("line")) & F.array_contains("fids", F.col("fn")) & dominates())
    best = before.groupBy("repo", "path", "line", "fn").agg(F.min_by(F.struct("language", "callee", "parent", "g_names", "constant_in", "sink_names", "aliases"), "g_ord").alias("g")).select("repo", "path", "line", "fn", "g.*")
    local = functions_of(facts).groupBy("repo", "path", "name").agg(F.min_by("raises", "fn").alias("raises"))
    best = best.withColumn("name", last_part(F.col("callee"))).join(local, ["repo", "path", "name"], "left")
    low = F.lower("name")
    flat = F.regexp_replace(low, "_", "")
    other = flat.isin(*squeezed(catalogue.RAISING)) | F.col("name").rlike("^(?i:assert|enforce|ensure|must|require)(?:_|[A-Z]|$)")
    by_name = F.when(F.col("language") != "python", other).otherwise(low.rlike("^(?:" + "|".join(catalogue.RAISING_STARTS) + ")") | low.rlike("|".join(catalogue.RAISING)))
    expanded = F.array_union("g_names", F.flatten(F.transform(F.filter("aliases", lambda a: F.array_contains(F.col("g_names"), a["name"])), lambda a: a["sources"])))
    bound = F.col("sink_names").isNull() | (F.size("g_names") == 0) | (F.size("sink_names") == 0) | F.arrays_overlap(expanded, F.col("sink_names"))
    fake = F.col("sink_names").isNotNull() & (F.size("sink_names") > 0) & F.array_contains("constant_in", F.col("fn"))
    best = best.select(*at, "fn", F.coalesce("raises", by_name).alias("raising"), bound.alias("bound"), fake.alias("fake"), F.col("parent").isin(*USED).alias("used"), (F.col("parent") == "Discard").alias("dropped"))
    status = (
        F.when(F.col("raising") & ~F.col("bound") & F.col("fake"), "unbound").when(F.col("raising") & F.col("dropped"), "weak").when(F.col("raising"), "guarded")
        .when(F.col("bound") & F.col("used"), "guarded").when(F.col("bound"), "weak").otherwise("unbound")
    )
    message = (
        F.when(F.col("raising") & ~F.col("bound") & F.col("fake"), "a raising check dominates, but it only sees constants")
        .when(F.col("raising") & F.col("dropped"), "a raising check dominates, but its result is thrown away").when(F.col("raising"), "a raising check dominates").when(F.col("bound") & F.col("used"), "a check dominates, is bound to the data, and its result is used")
        .when(F.col("bound"), "a check dominates, but its result is discarded").otherwise("a check dominates, but it shares no data with the operation")
    )
    best = best.select(*at, "fn", status.alias("s"), message.alias("m"))
    decorated = F.exists("decorators", lambda d: is_guard_name(d["name"], guards))
    approved = F.exists("decorators", lambda d: d["called"] & (d["name"] == "tool") & F.arrays_overlap(d["flags"], strings(("external_execution", "human_input"))))
    joined = sinks.join(best, [*at, "fn"], "left")
    return joined.withColumns(
        {
            "guard_status": F.when(decorated | approved, "guarded").otherwise(F.coalesce("s", F.lit(""))),
            "guard_message": F.when(decorated, "a guard decorates the function").when(approved, "the framework asks for approval").otherwise(F.coalesce("m", F.lit(""))),
        }
    ).drop("s", "m", "sid", "sink_names")


def guarded_classes(facts: DataFrame) -> DataFrame:
    """(repo, path, classes): classes of each file that carry a declared guard, or inherit one in the file, however far."""
    spark = facts.sparkSession
    classes = facts.select("repo", "path", F.explode("classes").alias("c")).select("repo", "path", "c.*")
    own = classes.where(F.arrays_overlap("truthy", strings(catalogue.GUARD_ATTRIBUTES)) | F.arrays_overlap("decorators", strings(catalogue.GUARD_DECORATORS))).select("repo", "path", "name")
    made = facts.select("repo", "path", F.explode("made_with").alias("m")).where(F.col("m.kw").isin(*catalogue.GUARD_ARGUMENTS)).select("repo", "path", F.col("m.name").alias("name"))
    direct = own.union(made).groupBy("repo", "path").agg(F.collect_set("name").alias("seed"))
    edges = facts.select("repo", "path", F.transform("classes", lambda c: F.struct(c["name"].alias("name"), c["bases"].alias("bases"))).alias("edges"))
    # each pass over the file's classes takes one more step down; there are no more steps than classes
    grow = lambda seen, edges: F.array_union(seen, F.transform(F.filter(edges, lambda e: F.arrays_overlap(e["bases"], seen)), lambda e: e["name"]))
    steps = F.aggregate(F.sequence(F.lit(0), F.size("edges")), F.col("seed"), lambda seen, _: grow(seen, F.col("edges")))
    return direct.join(edges, ["repo", "path"]).select("repo", "path", steps.alias("guarded_classes"))

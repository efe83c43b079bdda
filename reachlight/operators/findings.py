"""Capabilities and findings: severity, suppression, baseline, hashes and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlight.operators.guards import guarded_classes, holds
from reachlight.operators.sinks import calls_of, rule_table
from reachlight.plans import catalogue

RANK = {"low": 0, "medium": 1, "high": 2}


def looked_up(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def snippet_hash(source: Column, line: Column) -> Column:
    """16 hex digits over a line and the one before it, white space (ASCII) made single."""
    lines = F.split(source, "\n")
    start = F.greatest(line - 1, F.lit(1))
    text = F.array_join(F.slice(lines, start, F.when(line > 1, 2).otherwise(1)), "\n")
    return text_hash(text)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""), r"[ \t\n\r\f]+", " "), 256), 1, 16)


def downgraded(severity: Column) -> Column:
    return F.when(severity == "high", "medium").otherwise("low")


def effective_severity(severity: Column, confidence: Column) -> Column:
    return F.when(confidence == "medium", downgraded(severity)).otherwise(severity)


def label(category: Column) -> Column:
    return F.coalesce(looked_up(category, {k: v[0] for k, v in catalogue.LABELS.items()}), F.upper(F.regexp_replace(category, "_", " ")))


def remediation(category: Column) -> Column:
    return F.coalesce(looked_up(category, {k: v[1] for k, v in catalogue.LABELS.items()}), F.lit("Check the caller's authority over this very object before the call."))


def without_cleanup(found: DataFrame, facts: DataFrame, files: DataFrame, rules) -> DataFrame:
    """Without deletions and writes in a finally block of a module that makes temporary files."""
    at = [i for i, r in enumerate(rules) if r.category in ("data_destruction", "file_mutation")]
    temporary = None
    for word in catalogue.TEMPORARY:
        temporary = F.col("source").contains(word) if temporary is None else temporary | F.col("source").contains(word)
    spots = facts.where(F.size("finally_ranges") > 0).select("repo", "path", "finally_ranges").join(files.where(temporary).select("repo", "path"), ["repo", "path"])
    return found.join(spots, ["repo", "path"], "left").where(~(F.col("place").isin(*at) & F.col("finally_ranges").isNotNull() & holds(F.col("finally_ranges"), F.col("line")))).drop("finally_ranges")


def capabilities(found: DataFrame, files: DataFrame, rules) -> DataFrame:
    """Every reachable operation, guarded ones too, with its state."""
    names = rule_table(found.sparkSession, rules)
    state = F.when(F.col("guard_status") == "guarded", "guard_found").when(F.col("guard_status") == "", "review_required").otherwise("guard_incomplete")
    return (
        found.join(F.broadcast(names.drop("severity")), "place")
        .join(files.select("repo", "path", "source", "tier", "language"), ["repo", "path"])
        .select("repo", "path", "line", "col", "fn", "rule_id", "category", "severity", "description", "cwe", "owasp", F.col("text").alias("call_text"), state.alias("state"), "guard_status", "guard_message", "confidence", "reason", "tier", "language", snippet_hash(F.col("source"), F.col("line")).alias("snippet_hash"))
    )


def declared(caps: DataFrame, facts: DataFrame) -> DataFrame:
    """caps with declared: why a class or a decorator around the operation's first call says that it is guarded; ''."""
    first = calls_of(facts).groupBy("repo", "path", "line").agg(F.min_by(F.struct("classes", "class_bases", "fn_decorators"), "ord").alias("around"))
    with_classes = caps.join(first, ["repo", "path", "line"], "left").join(guarded_classes(facts), ["repo", "path"], "left")
    by_decorator = F.get(F.filter("around.fn_decorators", lambda d: d.isin(*catalogue.GUARD_DECORATORS)), F.lit(0))
    by_class = F.arrays_overlap("around.classes", F.col("guarded_classes")) | F.exists("around.class_bases", lambda b: F.arrays_overlap(b, F.col("guarded_classes")))
    decorated = F.exists("around.fn_decorators", lambda d: d.isin(*catalogue.GUARD_DECORATORS))
    why = F.when(decorated, F.concat(F.lit("decorator:"), by_decorator)).when(by_class, "class").otherwise("")
    return with_classes.withColumn("declared", F.coalesce(why, F.lit(""))).drop("around", "guarded_classes")


def findings(caps: DataFrame, facts: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """Capabilities that no dominating guard covers, one row each, with suppressed and why.

    suppressions: (repo, path, rule_id), matched on the rule's own id.
    """
    open_ = declared(caps.where("guard_status != 'guarded'"), facts)
    severity = F.when(F.col("guard_status") == "weak", "low").when(F.col("guard_status") == "unbound", "medium").when(F.col("confidence") == "medium", downgraded(F.col("severity"))).otherwise(F.col("severity"))
    ending = looked_up(F.col("guard_status"), {"weak": "-WEAK", "unbound": "-UNBOUND", "": ""})
    out = open_.withColumn("by_comment", F.lit(False))
    if suppressions is not None:
        out = out.drop("by_comment").join(suppressions.select("repo", "path", "rule_id", F.lit(True).alias("by_comment")).distinct(), ["repo", "path", "rule_id"], "left")
    why = F.when(F.coalesce("by_comment", F.lit(False)), "inline").when(F.col("declared") != "", F.concat(F.lit("declared:"), "declared")).otherwise("")
    shown = out.withColumns({"base_rule_id": F.col("rule_id"), "rule_id": F.concat("rule_id", ending), "severity": severity, "suppression_reason": why, "suppressed": why != "", "remediation": remediation(F.col("category"))})
    return shown.withColumn("effective_severity", effective_severity(F.col("severity"), F.col("confidence"))).drop("by_comment", "declared", "fn")


def with_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings, those suppressed that a baseline (path, snippet_hash) holds."""
    known = baseline.where("path != '' AND snippet_hash != ''").select("path", "snippet_hash", F.lit(True).alias("in_baseline")).distinct()
    hit = F.col("in_baseline").isNotNull()
    out = found.join(known, ["path", "snippet_hash"], "left")
    return out.withColumns({"suppression_reason": F.when(hit, "baseline").otherwise(F.col("suppression_reason")), "suppressed": hit | F.col("suppressed")}).select(*found.columns)


def gate(found: DataFrame, threshold: str) -> DataFrame:
    """One row, (failed boolean): whether any finding that isn't suppressed is at least so severe."""
    rank = looked_up(F.col("effective_severity"), RANK)
    return found.agg(F.coalesce(F.max((rank >= RANK[threshold]) & ~F.col("suppressed")), F.lit(False)).alias("failed"))


def summary(caps: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return caps.agg(F.count("*").alias("capabilities"), n("guard_found"), n("guard_incomplete"), n("review_required"))


def exposure_key() -> Column:
    """Lower is more exposed: takes inputs, severity, confidence, destroys, then place."""
    takes = F.when(F.col("call_text").rlike(r"\([^)]*[A-Za-z_]"), 0).otherwise(1)
    destroys = F.when(F.col("category").isin("data_destruction", "payments", "shell_execution", "code_execution"), 0).otherwise(1)
    return F.struct(takes, -looked_up(F.col("effective_severity"), RANK), F.when(F.col("confidence") == "high", 0).otherwise(1), destroys, "path", "line", "rule_id")


def most_exposed(found: DataFrame) -> DataFrame:
    """The one finding, in each repository, that is looked at first."""
    order = Window.partitionBy("repo").orderBy(exposure_key())
    return found.where("NOT suppressed").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def by_consequence(found: DataFrame, most: int = 6) -> DataFrame:
    """(repo, label, findings, rule_ids, methods): the first distinct methods in order of exposure."""
    # the last call outside all parentheses: its name stands before parentheses that end the text
    inner = r"[^()]*"
    for _ in range(6):
        inner = rf"(?:[^()]|\({inner}\))*"
    last = F.regexp_extract("call_text", rf"([^\s().]+)\s*\({inner}\)\s*$", 1)
    method = F.when(last != "", last).otherwise(F.element_at(F.split(F.regexp_extract("call_text", r"^([^(]*)", 1), r"\."), -1))
    # what is alike but for its place is one row before any text is looked at
    alike = ["repo", "category", "call_text", "rule_id", "effective_severity", "confidence"]
    kinds = found.where("NOT suppressed").groupBy(*alike).agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("at")).select(*alike, "n", "at.*")
    each = kinds.select("repo", label(F.col("category")).alias("label"), "rule_id", exposure_key().alias("k"), method.alias("m"), "n")
    # one row for each distinct method before any list is made
    methods = each.groupBy("repo", "label", "m").agg(F.sum("n").alias("n"), F.collect_set("rule_id").alias("ids"), F.min("k").alias("k"))
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]), 1, most)
    return methods.groupBy("repo", "label").agg(F.sum("n").alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("rule_ids"), first.alias("methods"))


def new_since(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return found.join(baseline.select("path", "snippet_hash").distinct(), ["path", "snippet_hash"], "left_anti")


def guard_suggestions(facts: DataFrame) -> DataFrame:
    """Functions of the tree that are named like guards but aren't in the vocabulary."""
    names = facts.select("repo", "path", F.explode("functions.name").alias("name"))
    shaped = F.lower("name").rlike("auth|permi|allow|approv|guard|access|policy|confirm|^(?:check|verify|validate|require|ensure|assert)_")
    return names.where(shaped & ~F.lower("name").isin(*[g.lower() for g in catalogue.GUARDS])).distinct()



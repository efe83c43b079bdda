"""Whether an agent can reach an operation: signals of the outermost enclosing function, the first of which decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlight.plans import catalogue

SIGNALS = ("tool_decorator", "resource_boundary", "tool_wrapper", "tool_base_class_method", "tool_list_param", "tool_schema_dispatch", "action_dispatch")


def among(x: Column, words) -> Column:
    return x.isin(*words)


def functions_of(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "path", "language", "tool_names", F.explode("functions").alias("f")).select("repo", "path", F.col("language").alias("fn_language"), "tool_names", F.col("f.ord").alias("fn"), *[F.col(f"f.{k}").alias(k) for k in ("name", "decorators", "raises", "bases", "passed_to", "listed_in", "branches", "action_lines", "aliases")])


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def signals() -> dict[str, Column]:
    """A boolean for each signal, over rows of a sink joined with its function."""
    wrapped = F.exists("passed_to", lambda c: F.exists(strings(catalogue.WRAPPERS), lambda w: c.contains(w) | w.contains(c)))
    inside = F.exists("branches", lambda b: F.arrays_overlap(b["consts"], F.col("tool_names")) & F.exists(b["ranges"], lambda r: F.col("line").between(r["lo"], r["hi"])))
    return {
        "tool_decorator": F.exists("decorators", lambda d: among(d["name"], catalogue.TOOL_DECORATORS)),
        "resource_boundary": F.exists("decorators", lambda d: among(d["name"], catalogue.ENTRY_DECORATORS) | among(d["last"], catalogue.ENTRY_DECORATORS)),
        "tool_wrapper": wrapped,
        "tool_base_class_method": among(F.col("name"), catalogue.TOOL_METHODS) & F.arrays_overlap("bases", strings(catalogue.TOOL_BASES)),
        "tool_list_param": F.arrays_overlap("listed_in", strings(catalogue.TOOL_LISTS)),
        "tool_schema_dispatch": inside,
        "action_dispatch": F.array_contains("action_lines", F.col("line")),
    }


def reached(sinks: DataFrame, facts: DataFrame, module_level: bool = False) -> DataFrame:
    """Sinks that an agent can reach, with confidence and reason, and their function's decorators and aliases.

    Sinks outside any function count only with module_level, if the module imports an agent framework; those in a
    __main__ block or in the body of a class never do.
    """
    joined = sinks.join(functions_of(facts), ["repo", "path", "fn"])
    case = None
    for name, on in signals().items():
        case = F.when(on, name) if case is None else case.when(on, name)
    # the extractor of the other languages says itself how a function is registered
    case = F.when(F.col("fn_language") == "python", case).otherwise(F.get("listed_in", F.lit(0)))
    found = joined.withColumn("reason", case).where("reason IS NOT NULL").withColumn("confidence", F.lit("high"))
    found = found.select(*sinks.columns, "reason", "confidence", "decorators", "aliases")
    if not module_level:
        return found
    within = lambda c: F.exists(c, lambda r: F.col("line").between(r["lo"], r["hi"]))
    imports = F.exists("modules", lambda m: F.exists(strings(catalogue.FRAMEWORKS), lambda f: m.contains(f)))
    top = sinks.where("fn IS NULL").join(facts.select("repo", "path", "modules", "main_ranges", "class_ranges"), ["repo", "path"]).where(imports & ~within("main_ranges") & ~within("class_ranges"))
    return found.unionByName(top.select(*sinks.columns, F.lit("module_level_agent_import").alias("reason"), F.lit("medium").alias("confidence")), allowMissingColumns=True)

"""A scan: files, facts, capabilities, findings and errors as DataFrames, for one tree or many at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from reachlight.functions.braces import extract_braces
from reachlight.functions.extract import EMPTY, FACTS, extract
from reachlight.operators import findings as f
from reachlight.operators.guards import checked
from reachlight.operators.reachability import reached
from reachlight.operators.sinks import sinks
from reachlight.plans import catalogue
from reachlight.plans.catalogue import Rule
from reachlight.sources import tree


class Scan(NamedTuple):
    """files: all that was listed; facts: of the analysed ones; errors: (repo, path, error); unsupported: (repo, path, language)."""

    files: DataFrame
    facts: DataFrame
    capabilities: DataFrame
    findings: DataFrame
    errors: DataFrame
    unsupported: DataFrame


def _ddl() -> str:
    """The facts' schema; nested fields keep their colons, top ones have none."""
    out, depth = [], 0
    for c in FACTS:
        depth += (c == "<") - (c == ">")
        out.append(" " if c == ":" and not depth else c)
    return "repo string, path string, language string, sha256 string, error string, " + "".join(out)


def facts(files: DataFrame) -> DataFrame:
    """One row for each file in a language of tree.ANALYSED. A file that can't be read, decoded or parsed has its error and no facts."""
    schema = _ddl()
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("repo", "path", "language", "sha256")} | (EMPTY | {"error": r["error"]} if r["error"] else extract(r["source"]) if r["language"] == "python" else extract_braces(r["source"], r["language"])) for r in rows], schema=arrow)

    return files.where(F.col("language").isin(*tree.ANALYSED)).select("repo", "path", "language", "source", "sha256", "error").mapInArrow(run, schema)


def contents(files: DataFrame) -> DataFrame:
    """One row in the shape of files() for each content that can be analysed: repo is its language, path its hash.

    Facts and all that follows from them depend on nothing else of a file, so that a content is analysed once however many
    files hold it; of_files() gives each of them its rows.
    """
    held = files.where(F.col("language").isin(*tree.ANALYSED) & (F.col("error") == "")).select("language", "sha256", "source").distinct()
    return held.select(F.col("language").alias("repo"), F.col("sha256").alias("path"), "language", "source", "sha256", F.lit("").alias("tier"), F.lit("").alias("error"))


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of contents as rows of every file that holds the content, in the same columns; tier is the file's."""
    held = files.where(F.col("language").isin(*tree.ANALYSED) & (F.col("error") == "")).select("repo", "path", "tier", F.col("language").alias("its_language"), F.col("sha256").alias("its_hash"))
    keys = {"repo": "its_language", "path": "its_hash"}
    return rows.drop("tier").withColumnsRenamed(keys).join(held, list(keys.values())).select(*rows.columns)


def _one_each(facts: DataFrame, unique: DataFrame) -> DataFrame:
    """Of facts of files those of one file for each content in unique, as facts of contents."""
    first = facts.groupBy("language", "sha256").agg(F.min(F.struct("repo", "path")).alias("f")).select("language", "sha256", "f.*").join(unique.select("language", "sha256"), ["language", "sha256"], "left_semi").select("repo", "path", "language", "sha256")
    return facts.dropDuplicates(["repo", "path", "language", "sha256"]).join(first, ["repo", "path", "language", "sha256"], "left_semi").withColumns({"repo": F.col("language"), "path": F.col("sha256")})


def scan(files: DataFrame, rules: Sequence[Rule] = catalogue.RULES, guards: Sequence[str] = catalogue.GUARDS, baseline: DataFrame | None = None, module_level: bool = False, known: DataFrame | None = None, store: str | None = None) -> Scan:
    """Scans files (see sources.tree). known: facts of an earlier scan; files whose content they hold aren't parsed again.

    store: a folder that the facts are written to as Parquet, of which later steps read only the fields they need and
    later scans can take known; without it they are kept in memory and on disk while the scan is used.

    A scan without findings means that no supported unguarded path was identified, never that the code is safe.
    """
    unique = contents(files)
    if store is None:
        unique = unique.persist()
    if known is None:
        got = facts(unique)
    else:
        had = _one_each(known, unique)
        got = had.unionByName(facts(unique.join(had.select("repo", "path"), ["repo", "path"], "left_anti")))
    if store is None:
        got = got.persist()
    unread = files.where(F.col("language").isin(*tree.ANALYSED) & (F.col("error") != ""))
    nothing = [F.array().cast(t).alias(c) for c, t in got.dtypes if t.startswith("array")]
    all_facts = of_files(got, files).unionByName(unread.select("repo", "path", "language", "sha256", "error", *nothing))
    if store is not None:
        all_facts.write.mode("overwrite").parquet(store)
        all_facts = files.sparkSession.read.schema(all_facts.schema).parquet(store)
        got = _one_each(all_facts, unique)
    found = reached(sinks(got, rules), got, module_level)
    found = f.without_cleanup(found, got, unique, rules)
    caps = f.capabilities(checked(found, got, guards), unique, rules)
    shown = of_files(f.findings(caps, got, tree.suppressions(unique)), files)
    if baseline is not None:
        shown = f.with_baseline(shown, baseline)
    errors = of_files(got.where("error != ''").select("repo", "path", "error"), files).unionByName(files.where("error != ''").select("repo", "path", "error"))
    return Scan(files, all_facts, of_files(caps.drop("fn"), files), shown, errors, tree.unsupported(files))


def repositories(s: Scan) -> DataFrame:
    """Per repository: files scanned, errors, findings, and maps of findings by rule and by severity."""
    kinds = s.findings.where("NOT suppressed").groupBy("repo", "rule_id", "effective_severity").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("repo").agg(F.sum("n").alias("findings"), F.collect_list(F.struct("rule_id", "effective_severity", "n")).alias("kinds"))
    total = lambda c, key: F.aggregate(F.filter("kinds", lambda k: k[c] == key), F.lit(0).cast("bigint"), lambda a, k: a + k["n"])
    counts = lambda c: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("kinds", lambda k: k[c]))), lambda key: F.struct(key.alias(c), total(c, key).alias("n")))).alias(f"by_{c}")
    base = s.files.groupBy("repo").agg(F.count_if(F.col("language").isin(*tree.ANALYSED)).alias("files_scanned"))
    out = base.join(s.errors.groupBy("repo").agg(F.count("*").alias("errors")), "repo", "left")
    return out.join(kinds.select("repo", "findings", counts("rule_id"), counts("effective_severity")), "repo", "left").fillna(0, ["errors", "findings"])

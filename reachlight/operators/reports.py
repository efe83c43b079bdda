"""Reports: documents made of a scan's DataFrames. Rows are put in order before they are gathered; one repository at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlight.plans.scan import Scan
from reachlight.sources.tree import ANALYSED

NO_FINDINGS = "No supported unguarded path was identified. This does not say that the code is safe."
LEVELS = {"high": "error", "medium": "warning", "low": "note"}
ORDER = ["path", "line", "col", "rule_id"]


def json_rows(df: DataFrame) -> DataFrame:
    """(repo, json): one JSON object a row, for df.write.text or further joins."""
    return df.select("repo", F.to_json(F.struct(*[c for c in df.columns if c != "repo"])).alias("json"))


def counts(scan: Scan) -> DataFrame:
    """One row for each repository: capabilities by state, findings by severity, errors, unsupported files by language."""
    caps = scan.capabilities.groupBy("repo").agg(F.count("*").alias("capabilities"), *[F.count_if(F.col("state") == s).alias(s) for s in ("guard_found", "guard_incomplete", "review_required")])
    found = scan.findings.where("NOT suppressed").groupBy("repo").agg(F.count("*").alias("findings"), *[F.count_if(F.col("effective_severity") == s).alias(s) for s in LEVELS], F.count_if(F.col("tier") == "example").alias("in_examples"))
    errors = scan.errors.groupBy("repo").agg(F.count("*").alias("errored"))
    other = scan.unsupported.groupBy("repo", "language").agg(F.count("*").alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("unsupported"))
    base = scan.files.groupBy("repo").agg(F.count_if(F.col("language").isin(*ANALYSED)).alias("scanned"))
    for x in (caps, found, errors, other):
        base = base.join(x, "repo", "left")
    return base.fillna(0)


def _rows(df: DataFrame, repo: str, columns: Iterable[str]) -> list[dict]:
    return [r.asDict() for r in df.where(F.col("repo") == repo).select(*columns).orderBy(*[c for c in ORDER if c in df.columns]).toLocalIterator()]


FINDING = ["path", "line", "col", "rule_id", "category", "severity", "effective_severity", "confidence", "description", "call_text", "remediation", "snippet_hash", "suppressed", "suppression_reason", "tier"]
CAPABILITY = ["path", "line", "col", "rule_id", "category", "severity", "call_text", "state", "guard_status", "guard_message", "confidence", "reason", "tier", "language"]


def document(scan: Scan, repo: str) -> dict:
    """The JSON document of one repository."""
    row = counts(scan).where(F.col("repo") == repo).first()
    totals = {k: v for k, v in row.asDict().items() if k not in ("repo", "unsupported")} if row else {}
    return {
        "repository": repo, **totals, "findings_list": _rows(scan.findings.where("NOT suppressed"), repo, FINDING), "capabilities_list": _rows(scan.capabilities, repo, CAPABILITY),
        "unsupported": {"by_language": dict(row["unsupported"] or {}) if row else {}, "files": [r["path"] for r in _rows(scan.unsupported, repo, ["path"])]}, "errors": _rows(scan.errors, repo, ["path", "error"]),
        "statement": "" if totals.get("findings") else NO_FINDINGS,
    }


def sarif(scan: Scan, repo: str) -> dict:
    """SARIF 2.1.0 of one repository. Each rule is listed once, in order of its first finding."""
    rows = [r.asDict() for r in scan.findings.where((F.col("repo") == repo) & ~F.col("suppressed")).orderBy(*ORDER).toLocalIterator()]
    rules: dict[str, dict] = {}
    for r in rows:
        rules.setdefault(r["rule_id"], {"id": r["rule_id"], "shortDescription": {"text": r["description"]}, "properties": {"tags": [r["cwe"], r["owasp"], r["category"]]}})
    results = [
        {
            "ruleId": r["rule_id"], "level": LEVELS[r["effective_severity"]], "message": {"text": f"{r['description']}: {r['call_text']}. {r['remediation']}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": r["line"], "startColumn": r["col"] + 1}}}], "partialFingerprints": {"snippet": r["snippet_hash"]},
        }
        for r in rows
    ]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "reachlight", "rules": list(rules.values())}}, "results": results}]}


def text(scan: Scan, repo: str) -> str:
    """A list by file, for people."""
    doc = document(scan, repo)
    lines = [f"{repo}: {doc.get('scanned', 0)} files, {doc.get('findings', 0)} findings, {doc.get('errored', 0)} not analysed"]
    at = None
    for f in doc["findings_list"]:
        if f["path"] != at:
            at = f["path"]
            lines.append(at)
        lines.append(f"  {f['line']}: {f['effective_severity']} {f['rule_id']}  {f['call_text']}")
    return "\n".join([*lines, *([doc["statement"]] if doc["statement"] else [])])


def markdown(scan: Scan, repo: str) -> str:
    doc = document(scan, repo)
    rows = [f"| {f['effective_severity']} | {f['rule_id']} | `{f['path']}:{f['line']}` | `{f['call_text'].replace('|', chr(92) + '|')}` |" for f in doc["findings_list"]]
    return "\n".join([f"# {repo}", "", doc["statement"], "", *(["| severity | rule | place | call |", "|-|-|-|-|", *rows] if rows else [])])


def write_baseline(scan: Scan, path: str) -> None:
    """Findings as a baseline: JSON rows (path, line, rule_id, snippet_hash, category, severity)."""
    scan.findings.select("path", "line", "rule_id", "snippet_hash", "category", "severity").write.mode("overwrite").json(path)


def explain(scan: Scan, repo: str, path: str, line: int) -> list[dict]:
    """What is known of the operations at one line: the finding, its check, and the values that the caller controls."""
    at = (F.col("repo") == repo) & (F.col("path") == path)
    caps = scan.capabilities.where(at & (F.col("line") == line))
    calls = scan.facts.where(at).select("repo", "path", F.explode("calls").alias("c")).where(F.col("c.line") == line)
    controlled = F.array_distinct(F.flatten(F.transform("c.args", lambda a: F.array_intersect(a["roots"], F.col("c.near_params")))))
    inputs = calls.groupBy("repo", "path").agg(F.array_distinct(F.flatten(F.collect_list(controlled))).alias("controlled"), F.first("c.origin").alias("receiver"), F.first("c.chain").alias("chain"))
    rows = caps.join(inputs, ["repo", "path"], "left").orderBy("rule_id").collect()
    return [r.asDict() for r in rows]


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True, default=str)

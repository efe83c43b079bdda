"""The whole scanner on modules made from the events table.

Each event gives one module: its type chooses the operation, event_id % 6 how it is guarded. The SQL holds what the
guard decision must be for each kind, derived by hand from the decision table; it is no second scanner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.operators import findings as f
from reachlight.plans.scan import Scan, repositories, scan
from reachlight.sources import tree

#: Event type: (operation, rule, severity).
OPERATIONS = {
    "click": ("page.click(x)", "BROWSER-ACTION", "high", "BROWSER"),
    "error": ("subprocess.run(x)", "EXEC-SHELL", "high", "SHELL"),
    "purchase": ("stripe.Refund.create(x)", "PAY-STRIPE-REFUND", "high", "MONEY"),
    "signup": ("session.add(x)", "DATABASE-ORM-MUTATE", "medium", "DATABASE CHANGES"),
    "view": ("requests.post(x)", "NET-EGRESS", "high", "NETWORK"),
}
#: event_id % 6: lines before the operation. 5 is not decorated, so no agent reaches it.
VARIANTS = ("", "    authorize(x)\n", "    check_permission(x)\n", "    if not has_permission(who):\n        raise PermissionError\n", "    if False:\n        authorize(x)\n", "")


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + " END"


def modules(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    kind, variant = F.col("event_type"), (F.col("event_id") % 6).cast("int")
    operation = F.create_map(*[F.lit(x) for k, v in OPERATIONS.items() for x in (k, v[0])])[kind]
    before = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), variant + 1)
    head = F.when(variant == 5, "# module\n\n").otherwise("# module\n@tool\n")
    source = F.concat(head, F.lit("def f(x, who):\n"), before, F.lit("    "), operation, F.lit("\n"))
    return tree.from_table(events.select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), source.alias("source")), "repo", "path", "source")


def scanned(spark: SparkSession, folder: str) -> Scan:
    return scan(modules(spark, folder))


def scan_findings(spark, folder):
    return scanned(spark, folder).findings.select("repo", "path", "line", "rule_id", "category", "effective_severity", "suppressed")


def scan_capabilities(spark, folder):
    return scanned(spark, folder).capabilities.select("repo", "path", "line", "rule_id", "state", "guard_status", "confidence", "reason", "tier")


def scan_consequences(spark, folder):
    found = f.by_consequence(scanned(spark, folder).findings)
    return found.select("repo", "label", "findings", F.array_join("rule_ids", ",").alias("rule_ids"))


def scan_repositories(spark, folder):
    return repositories(scanned(spark, folder)).select("repo", "files_scanned", "errors", "findings")


def scan_new(spark, folder):
    """Findings that a baseline of the even modules doesn't hold; hashes take in the line before, so some are shared."""
    found = scanned(spark, folder).findings
    base = found.where("CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) % 4 = 0").select("path", "snippet_hash")
    return f.new_since(found, base).select("path", "rule_id")


QUERIES = {q.__name__: q for q in (scan_findings, scan_capabilities, scan_consequences, scan_repositories, scan_new)}

_BASE = f"""SELECT 'r' || (user_id % 10) AS repo, 'e' || event_id || '.py' AS path, event_id, event_id % 6 AS v,
CAST([4, 5, 5, 6, 6, 4][event_id % 6 + 1] AS INTEGER) AS line, {_case('event_type', {k: v[1] for k, v in OPERATIONS.items()})} AS rule,
{_case('event_type', {k: v[2] for k, v in OPERATIONS.items()})} AS severity, {_case('event_type', {k: v[3] for k, v in OPERATIONS.items()})} AS label,
{_case('event_type', {'click': 'browser_action', 'error': 'shell_execution', 'purchase': 'payments', 'signup': 'database_mutation', 'view': 'network_egress'})} AS category FROM events"""
_RULE = "rule || CASE v WHEN 2 THEN '-WEAK' WHEN 3 THEN '-UNBOUND' ELSE '' END"
ORACLE_SQL = {
    "scan_findings": f"SELECT repo, path, line, {_RULE} AS rule_id, category, CASE v WHEN 2 THEN 'low' WHEN 3 THEN 'medium' ELSE severity END AS effective_severity, false AS suppressed FROM ({_BASE}) WHERE v IN (0, 2, 3, 4)",
    "scan_capabilities": f"SELECT repo, path, line, rule AS rule_id, ['review_required', 'guard_found', 'guard_incomplete', 'guard_incomplete', 'review_required'][v + 1] AS state, ['', 'guarded', 'weak', 'unbound', ''][v + 1] AS guard_status, 'high' AS confidence, 'tool_decorator' AS reason, 'production' AS tier FROM ({_BASE}) WHERE v < 5",
    "scan_consequences": f"SELECT repo, label, count(*) AS findings, string_agg(DISTINCT {_RULE}, ',' ORDER BY {_RULE}) AS rule_ids FROM ({_BASE}) WHERE v IN (0, 2, 3, 4) GROUP BY repo, label",
    "scan_repositories": f"SELECT repo, count(*) AS files_scanned, CAST(0 AS BIGINT) AS errors, count(*) FILTER (WHERE v IN (0, 2, 3, 4)) AS findings FROM ({_BASE}) GROUP BY repo",
    "scan_new": f"SELECT path, {_RULE} AS rule_id FROM ({_BASE}) WHERE v IN (0, 2, 3, 4) AND event_id % 4 <> 0",
}

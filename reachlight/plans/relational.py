"""The scanner's relational operators on the driver's tables, each with equivalent SQL.

They show the plan of each operator on data of another kind: suffix matches as equi-joins, the first of several rows
as a minimum of structs, interval and before joins on an equality with a residual, decisions as ordered cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlight.functions import text as t
from reachlight.operators.findings import text_hash
from reachlight.operators.sinks import endings

Queries = dict


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def redact_documents(spark, folder):
    """Credential redaction of every text."""
    new = t.redacted(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.sha2(new, 256).alias("redacted_hash"), (new != F.col("text")).alias("changed"))


def _sql_redact(column: str) -> str:
    for pattern, new in t.CREDENTIALS:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'gi')"
    return column


def _sql_hit(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p, _ in t.CREDENTIALS) + ")"


def credential_hits(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count_if(t.has_credential(F.col("text"))).alias("hits"), F.count("*").alias("docs"))


def snippet_hash_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text_hash(F.col("text")).alias("snippet_hash"))


HASH_SQL = r"substr(sha256(regexp_replace(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')), 1, 16)"


def baseline_new(spark, folder):
    """Rows whose (source, hash) a baseline doesn't hold: an anti-join."""
    docs = table(spark, folder, "documents").select("doc_id", "source", text_hash(F.col("text")).alias("h"))
    base = docs.where("doc_id % 2 = 0").select("source", "h").distinct()
    return docs.join(base, ["source", "h"], "left_anti").select("doc_id", "source")


def suppress_flag(spark, folder):
    """Flagged by a suppression relation: a left join that never multiplies rows."""
    events = table(spark, folder, "events")
    known = events.where("event_id % 7 = 0").select("user_id", "event_type", F.lit(True).alias("s")).distinct()
    return events.join(known, ["user_id", "event_type"], "left").select("event_id", F.coalesce("s", F.lit(False)).alias("suppressed"))


RULES = (("R-COM", 20, "com"), ("R-EX-COM", 10, "example.com"), ("R-NET", 20, "net"), ("R-EX-NET", 30, "example.net"), ("R-ORG", 5, "org"), ("R-EX-ORG", 5, "example.org"))


def first_rule_match(spark, folder):
    """The winning rule of each host: endings are exploded for an equi-join; the least (priority, position) wins."""
    rules = spark.createDataFrame([(i, p, r, e) for i, (r, p, e) in enumerate(RULES)], "place int, priority int, rule_id string, ending string")
    hosts = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))
    pairs = hosts.select("page_id", F.explode(endings(F.col("host"))).alias("ending")).join(F.broadcast(rules), "ending")
    return pairs.groupBy("page_id").agg(F.min(F.struct("priority", "place", "rule_id")).alias("w")).select("page_id", "w.rule_id")


FIRST_RULE_SQL = f"""
WITH rules(place, priority, rule_id, ending) AS (VALUES {', '.join(f"({i}, {p}, '{r}', '{e}')" for i, (r, p, e) in enumerate(RULES))}),
hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, arg_min(rule_id, priority * 100 + place) AS rule_id
FROM hosts JOIN rules ON host = ending OR ends_with(host, '.' || ending) GROUP BY page_id"""


def _spans(spark, folder):
    e = table(spark, folder, "events")
    starts = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("lo"))
    return e, starts.withColumn("hi", F.col("lo") + F.expr("INTERVAL 6 HOURS"))


def enclosing_interval(spark, folder):
    """The outermost and innermost span around each error: an equi-join on the user with a range residual."""
    e, spans = _spans(spark, folder)
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    both = errors.join(spans, "user_id").where("ts >= lo AND ts <= hi")
    return both.groupBy("event_id").agg(F.min_by("span_id", F.struct("lo", "span_id")).alias("outermost"), F.max_by("span_id", F.struct("lo", "span_id")).alias("innermost"))


def before_join_first_guard(spark, folder):
    """The first signup before each purchase of a user."""
    e = table(spark, folder, "events")
    guard = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("guard_id"), F.col("ts").alias("guard_ts"))
    sink = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return sink.join(guard, "user_id").where("guard_ts < ts").groupBy("event_id").agg(F.min_by("guard_id", F.struct("guard_ts", "guard_id")).alias("guard_id"))


SIGNALS = (("urgent", "o_orderpriority = '1-URGENT'"), ("large", "o_totalprice > 300000"), ("open", "o_orderstatus = 'O'"), ("high", "o_orderpriority = '2-HIGH'"), ("small", "o_totalprice < 20000"), ("pending", "o_orderstatus = 'P'"), ("even", "o_orderkey % 2 = 0"))


def ordered_case_signals(spark, folder):
    """The first of seven signals that holds; rows without one go."""
    case = None
    for name, on in SIGNALS:
        case = F.when(F.expr(on), name) if case is None else case.when(F.expr(on), name)
    return table(spark, folder, "orders").select("o_orderkey", case.alias("reason")).where("reason IS NOT NULL")


RANKED = "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END"


def severity_gate(spark, folder):
    """Whether the greatest rank of each group reaches a threshold."""
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg((F.max(F.expr(RANKED)) >= 2).alias("failed"))


LABELS = {"ECONOMY": "CHEAP", "STANDARD": "PLAIN", "PROMO": "OFFER"}


def consequence_group(spark, folder):
    """Counts, distinct ids and the first six distinct names of each label, in order of exposure."""
    part = table(spark, folder, "part")
    kind = F.split("p_type", " ")[0]
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[kind], F.upper(kind))
    each = part.select(label.alias("label"), "p_brand", F.struct((-F.col("p_size")).alias("k"), F.col("p_partkey"), F.col("p_name")).alias("x"))
    return each.groupBy("label").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("rule_ids"), F.array_join(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p_name"])), 1, 6), ",").alias("methods"))


CONSEQUENCE_SQL = f"""
WITH p AS (SELECT *, split_part(p_type, ' ', 1) AS kind FROM part),
l AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE upper(kind) END AS label FROM p),
n AS (SELECT label, p_name, row_number() OVER (PARTITION BY label ORDER BY f) AS r FROM (
  SELECT label, p_name, min(o) AS f FROM (SELECT label, p_name, row_number() OVER (PARTITION BY label ORDER BY -p_size, p_partkey) AS o FROM l) GROUP BY 1, 2))
SELECT label, findings, rule_ids, methods FROM
 (SELECT label, count(*) AS findings, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS rule_ids FROM l GROUP BY label)
 JOIN (SELECT label, string_agg(p_name, ',' ORDER BY r) AS methods FROM n WHERE r <= 6 GROUP BY label) USING (label)"""


def most_exposed_top1(spark, folder):
    """The most exposed line of each order by a composite key."""
    key = F.struct((-F.expr(RANKED)).alias("a"), (-F.col("l_quantity")).alias("b"), "l_shipdate", "l_linenumber")
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", key).alias("l_linenumber"))


def capability_summary(spark, folder):
    n = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return table(spark, folder, "orders").agg(F.count("*").alias("capabilities"), n("F", "guard_found"), n("O", "review_required"), n("P", "guard_incomplete"))


def triage_diff(spark, folder):
    """Full outer join of two sets of labels: in both, or in one alone."""
    labels = table(spark, folder, "labels")
    a = labels.where("doc_id % 3 != 0").select("doc_id", F.lit(1).alias("a"))
    b = labels.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("b"))
    side = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").otherwise("both")
    return a.join(b, "doc_id", "full_outer").select("doc_id", side.alias("side"))


def precision(spark, folder):
    """True positives as a percentage of all that were judged, for each source."""
    both = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return both.groupBy("source").agg(F.round(100.0 * F.sum("quality") / F.count("*"), 1).alias("precision"), F.count("*").alias("judged"))


def repo_rule_matrix(spark, folder):
    """Counts by source and language, with totals (the rollup is an addition)."""
    return table(spark, folder, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


def recursive_closure(spark, folder):
    """All that inherits from a seed, however far: parts whose parent is a third of their key.

    Spark's recursion stops with an error beyond a million rows, and each of its steps joins all that came before. A
    part's forebears follow from its key, so each part's whole chain is looked up in one join: it is in the closure if
    every link is there, as often as the links' numbers of rows multiply to.
    """
    step = lambda chain: F.concat(chain, F.array(F.floor(F.element_at(chain, -1) / 3).cast("bigint")))
    # a key of 64 bits has less than 41 forebears, as each is a third of the one before
    above = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.array(F.col("p_partkey").cast("bigint")), lambda chain, _: F.when(F.element_at(chain, -1) > 2, step(chain)).otherwise(chain))
    rows = table(spark, folder, "part").where("p_partkey > 0").groupBy("p_partkey").agg(F.count("*").alias("n"))
    links = rows.select("p_partkey", F.posexplode(above).alias("depth", "link"))
    there = rows.select(F.col("p_partkey").cast("bigint").alias("link"), "n")
    whole = links.join(there, "link").groupBy("p_partkey").agg(F.max("depth").alias("depth"), F.count("*").alias("found"), F.min("link").alias("seed"), F.collect_list("n").alias("ns"))
    times = F.aggregate("ns", F.lit(1).cast("bigint"), lambda a, n: a * n)
    return whole.where("found = depth + 1 AND seed IN (1, 2)").select("p_partkey", "depth", F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("copy")).drop("copy")


CLOSURE_SQL = """
WITH RECURSIVE guarded(p_partkey, depth) AS (
  SELECT p_partkey, 0 FROM {table} WHERE p_partkey IN (1, 2)
  UNION ALL
  SELECT c.p_partkey, g.depth + 1 FROM guarded g JOIN {table} c ON CAST(floor(c.p_partkey / 3) AS BIGINT) = g.p_partkey WHERE c.p_partkey > 2)
SELECT p_partkey, depth FROM guarded"""


def conversation_look_back(spark, folder):
    """Turns that have a long one among themselves and the three before."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    return table(spark, folder, "conversations").select("conv_id", "turn", (F.max(F.when(F.length("text") > 400, 1).otherwise(0)).over(window) == 1).alias("near_long"))


def ext_inventory(spark, folder):
    """Pages by the ending of their address."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, folder, "pages").select(t.extension(path).alias("ext")).groupBy("ext").agg(F.count("*").alias("n"))


def top_categories(spark, folder):
    """The twelve commonest, ties by name."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


def changed_files(spark, folder):
    """Set differences and what is common, of two versions of a relation."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old, new = docs.where("doc_id % 5 != 0"), docs.where("doc_id % 7 != 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, F.lit("edited")).otherwise(F.col("h")))
    both = old.withColumnRenamed("h", "h_old").join(new.withColumnRenamed("h", "h_new"), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("h_old").isNull(), "new").when(F.col("h_new").isNull(), "deleted").when(F.col("h_old") != F.col("h_new"), "changed").otherwise("same").alias("state"))


QUERIES = {f.__name__: f for f in (redact_documents, credential_hits, snippet_hash_documents, baseline_new, suppress_flag, first_rule_match, enclosing_interval, before_join_first_guard, ordered_case_signals, severity_gate, consequence_group, most_exposed_top1, capability_summary, triage_diff, precision, repo_rule_matrix, recursive_closure, conversation_look_back, ext_inventory, top_categories, changed_files)}

ORACLE_SQL = {
    "redact_documents": f"SELECT doc_id, sha256({_sql_redact('text')}) AS redacted_hash, {_sql_redact('text')} <> text AS changed FROM documents",
    "credential_hits": f"SELECT source, count(*) FILTER (WHERE {_sql_hit('text')}) AS hits, count(*) AS docs FROM documents GROUP BY source",
    "snippet_hash_documents": f"SELECT doc_id, {HASH_SQL} AS snippet_hash FROM documents",
    "baseline_new": f"WITH d AS (SELECT doc_id, source, {HASH_SQL} AS h FROM documents) SELECT doc_id, source FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id % 2 = 0 AND b.source = d.source AND b.h = d.h)",
    "suppress_flag": "SELECT event_id, EXISTS (SELECT 1 FROM events s WHERE s.event_id % 7 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type) AS suppressed FROM events e",
    "first_rule_match": FIRST_RULE_SQL,
    "enclosing_interval": """WITH s AS (SELECT user_id, event_id AS span_id, ts AS lo, ts + INTERVAL 6 HOUR AS hi FROM events WHERE event_type = 'signup')
SELECT e.event_id, arg_min(span_id, (lo, span_id)) AS outermost, arg_max(span_id, (lo, span_id)) AS innermost
FROM events e JOIN s ON s.user_id = e.user_id AND e.ts BETWEEN lo AND hi WHERE e.event_type = 'error' GROUP BY e.event_id""",
    "before_join_first_guard": """SELECT s.event_id, arg_min(g.event_id, (g.ts, g.event_id)) AS guard_id FROM events s JOIN events g
ON g.user_id = s.user_id AND g.ts < s.ts AND g.event_type = 'signup' WHERE s.event_type = 'purchase' GROUP BY s.event_id""",
    "ordered_case_signals": f"SELECT * FROM (SELECT o_orderkey, CASE {' '.join(f'WHEN {on} THEN {chr(39)}{name}{chr(39)}' for name, on in SIGNALS)} END AS reason FROM orders) WHERE reason IS NOT NULL",
    "severity_gate": f"SELECT l_suppkey, max({RANKED}) >= 2 AS failed FROM lineitem GROUP BY l_suppkey",
    "consequence_group": CONSEQUENCE_SQL,
    "most_exposed_top1": f"SELECT l_orderkey, arg_min(l_linenumber, (-({RANKED}), -l_quantity, l_shipdate, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey",
    "capability_summary": "SELECT count(*) AS capabilities, count(*) FILTER (WHERE o_orderstatus = 'F') AS guard_found, count(*) FILTER (WHERE o_orderstatus = 'O') AS review_required, count(*) FILTER (WHERE o_orderstatus = 'P') AS guard_incomplete FROM orders",
    "triage_diff": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'both' WHEN doc_id % 3 <> 0 THEN 'only_left' ELSE 'only_right' END AS side FROM labels WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "precision": "SELECT source, round(100.0 * sum(quality) / count(*), 1) AS precision, count(*) AS judged FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "repo_rule_matrix": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)",
    "recursive_closure": CLOSURE_SQL.format(table="part"),
    "conversation_look_back": "SELECT conv_id, turn, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS near_long FROM conversations",
    "ext_inventory": r"SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "top_categories": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12",
    "changed_files": """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'edited' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS state FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""",
}

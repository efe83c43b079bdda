"""Scanning a stream of changed files (an addition): each micro-batch goes through the same plan as a whole tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reachlight.plans.scan import Scan, scan
from reachlight.sources import tree


def scan_changes(changes: DataFrame, sink: Callable[[Scan, int], None], checkpoint: str) -> StreamingQuery:
    """changes: a stream of (repo, path, source, ts). Of several versions of a file in one batch the latest counts.

    sink gets each batch's scan and number; it must write by that number, as a batch is repeated after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("repo", "path").agg(F.max_by("source", "ts").alias("source"))
        sink(scan(tree.from_table(latest, "repo", "path", "source")), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_by_window(findings: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of findings (repo, rule_id, ts) by tumbling windows; rows later than ``late`` are dropped."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", width), "repo", "rule_id").agg(F.count("*").alias("n"))

"""Source trees as a table: one row for each file, whether or not it can be read, decoded or analysed.

Spark's own file sources skip names that begin with _ or ., __init__.py among them, so files are listed here.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "repo string, path string, ext string, language string, source string, sha256 string, tier string, error string"

PRUNED = {".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", "site-packages", "dist", "build", ".eggs", ".mypy_cache", ".pytest_cache", ".ruff_cache", "vendor", "third_party", ".idea"}
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".cjs": "typescript", ".go": "go",
    ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".rs": "rust", ".php": "php", ".cs": "csharp", ".swift": "swift", ".scala": "scala", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".lua": "lua", ".dart": "dart", ".ex": "elixir", ".pl": "perl", ".r": "r", ".jl": "julia", ".sh": "shell", ".ps1": "powershell",
}
ANALYSED = ("go", "python", "typescript")
TESTS = ("**/*_test.go", "**/*.spec.*", "**/*.test.*", "**/__tests__/**", "**/test_*.py", "**/*_test.py", "**/tests/**", "**/test/**", "**/conftest.py")
EXAMPLES = "benchmark benchmarks cookbook demo demos doc docs documentation docs_src doc_src example examples recipes sample samples tutorial tutorials".split()


def glob_regex(glob: str) -> str:
    """A regular expression for a whole relative path. * crosses slashes; the shape of the glob decides what else it means."""
    body = glob.strip("/")
    if body.startswith("**/") and body.endswith("/**"):
        return rf"^(?:.*/)?{_plain(body[3:-3])}/.*$"
    if body.endswith("/**"):
        return rf"^(?:.*/)?{_plain(body[:-3])}(?:/.*)?$"
    if body.startswith("**/"):
        return rf"^(?:.*/)?{_plain(body[3:])}$"
    return rf"^(?:.*/)?{_plain(body)}$" if "/" not in body else rf"^{_plain(body)}$"


def _plain(glob: str) -> str:
    return re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(glob))


def excluded(path: Column, globs: Iterable[str]) -> Column:
    found = [path.rlike(glob_regex(g)) for g in globs]
    return F.coalesce(*[F.when(f, F.lit(True)) for f in found], F.lit(False)) if found else F.lit(False)


def tier(path: Column) -> Column:
    """example for demonstrations and documentation, else production."""
    return F.when(F.concat(F.lit("/"), F.ltrim(F.lit("/"), F.regexp_replace(path, r"\\", "/"))).rlike(rf"/(?:{'|'.join(EXAMPLES)})/"), "example").otherwise("production")


def listed(root: str) -> Iterator[str]:
    """Relative paths of the files under root with a known suffix, in order; directories that hold no sources of the tree's own are skipped."""
    if os.path.isfile(root):
        yield os.path.basename(root)
        return
    for at, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in PRUNED and not os.path.exists(os.path.join(at, d, "pyvenv.cfg")))
        for name in sorted(names):
            if os.path.splitext(name)[1].lower() in LANGUAGES:
                yield os.path.relpath(os.path.join(at, name), root).replace(os.sep, "/")


def files(spark: SparkSession, roots: dict[str, str], include: Iterable[str] = (), exclude: Iterable[str] = (), only: Iterable[str] | None = None) -> DataFrame:
    """All source files of the trees, by repository name. only: relative paths to which the listing is restricted.

    The driver lists names; tasks read and decode the files, so their folder must be one that all of them can see.
    Test files are left out unless an include glob names tests; excludes win over includes.
    """
    names = [(repo, root, p) for repo, root in sorted(roots.items()) for p in (listed(root) if only is None else sorted(only))]
    table = spark.createDataFrame(names, "repo string, root string, path string")
    include, exclude = list(include), list(exclude)
    if not any("test" in g for g in include):
        exclude += TESTS
    kept = table.where(~excluded(F.col("path"), exclude))
    if include:
        kept = kept.where(excluded(F.col("path"), include))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, root, path in part.itertuples(index=False):
                ext = os.path.splitext(path)[1].lower()
                source, digest, error = "", "", ""
                try:
                    with open(root if os.path.isfile(root) else os.path.join(root, path), "rb") as f:
                        raw = f.read()
                    digest = hashlib.sha256(raw).hexdigest()
                    source = raw.decode("utf-8-sig")
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((repo, path, ext, LANGUAGES.get(ext, ""), source, digest, "", error))
            yield pd.DataFrame(rows, columns=["repo", "path", "ext", "language", "source", "sha256", "tier", "error"])

    return kept.repartition("repo", "path").mapInPandas(read, SCHEMA).withColumn("tier", tier(F.col("path")))


def from_table(df: DataFrame, repo: str | Column, path: str | Column, source: str | Column) -> DataFrame:
    """A table of sources in the shape of files()."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    bare = df.select(c(repo).alias("repo"), c(path).alias("path"), F.coalesce(c(source), F.lit("")).alias("source"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return bare.select("repo", "path", ext.alias("ext"), F.coalesce(known[ext], F.lit("")).alias("language"), "source", F.sha2("source", 256).alias("sha256"), tier(F.col("path")).alias("tier"), F.lit("").alias("error"))


def unsupported(files: DataFrame) -> DataFrame:
    """Files in languages that are recognised but not analysed."""
    return files.where(~F.col("language").isin(*ANALYSED)).select("repo", "path", "language")


def suppressions(files: DataFrame) -> DataFrame:
    """(repo, path, rule_id) of comments # reachlight: ignore[RULE] or # reachlight: ignore RULE. They hold for the whole file."""
    lines = files.where(F.col("source").contains("reachlight: ignore")).select("repo", "path", F.explode(F.split("source", "\n")).alias("line"))
    rules = F.regexp_extract("line", r"(?:#|//)\s*reachlight:\s*ignore[\[ ]\s*([A-Za-z0-9_, -]+)", 1)
    return lines.select("repo", "path", F.explode(F.split(rules, r"\s*,\s*")).alias("rule_id")).select("repo", "path", F.trim("rule_id").alias("rule_id")).where("rule_id != ''").distinct()

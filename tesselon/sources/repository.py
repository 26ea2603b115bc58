"""Repository sources: file scan with ignore rules, git history, package description."""

from __future__ import annotations

import json
import os
import re
import subprocess
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IGNORED, Config
from ..functions import text as T

FILES = "path string, abs_path string, size long, mtime_ms long, content string"


def pattern_of(rule: str) -> tuple[str, bool] | None:
    """An ignore rule as (regular expression over relative paths, negated); null for blanks and comments."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder = rule.endswith("/")
    start = rule.startswith("/")
    rule = rule.strip("/")
    anchored = "/" in rule or start
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i:]:
            end = rule.index("]", i)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '(?:/|$)'}", negated


def ignored(path, rules: list[str]):
    """Whether the last rule that fits a path ignores it."""
    out = F.lit(False)
    for rule in rules:
        made = pattern_of(rule)
        if made:
            pattern, negated = made
            out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def scan(spark: SparkSession, config: Config) -> DataFrame:
    """Source files under the root: ignore rules and the size limit are applied before any content is decoded."""
    root = Path(config.root).resolve()
    gitignore = root / ".gitignore"
    rules = [*IGNORED, *(gitignore.read_text().splitlines() if gitignore.is_file() else []), *config.exclude]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.as_uri())
    absolute = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    d = raw.select(absolute.alias("abs_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    d = d.withColumn("path", F.substring("abs_path", len(root.as_posix()) + 2, 1_000_000))
    d = d.where(T.extension(F.col("path")).isin(*[e.lower() for e in config.extensions]) & (F.col("size") <= config.max_file_size_bytes) & ~ignored(F.col("path"), rules))
    linked = linked_paths(root)
    if linked:
        d = d.where(~reduce(or_, [(F.col("path") == x) | F.col("path").startswith(x + "/") for x in linked]))
    return d.select("path", "abs_path", "size", "mtime_ms", F.col("content").cast("string").alias("content"))


def linked_paths(root: Path) -> list[str]:
    """Symbolic links under the root, outermost ones; what they lead to is not part of the repository."""
    out = []
    for folder, names, files in os.walk(root):
        here = [n for n in [*names, *files] if os.path.islink(os.path.join(folder, n))]
        out += [Path(folder, n).relative_to(root).as_posix() for n in here]
        names[:] = [n for n in names if n not in here and n not in ("node_modules", ".git")]
    return sorted(out)


# --- git ---------------------------------------------------------------------------------------------------
HISTORY = "path string, commit_count long, last_commit_at long, authors map<string,long>"
_HEADER = "\x01"
#: Numbers of lines in one range of a log.
RANGE = 1 << 16


def git_log(root: str, window_days: int = 180, max_commits: int = 2000) -> list[str] | None:
    """Lines of the log, or null where there is no git or no repository."""
    command = ["git", "-C", root, "log", f"--since={window_days} days ago", f"--max-count={max_commits}", "--name-only", "--relative", "--no-renames", f"--pretty=format:{_HEADER}%ct%x09%an"]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.splitlines()


def unquoted(line: str) -> str:
    if len(line) > 1 and line[0] == line[-1] == '"':
        return line[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "ignore").decode("utf-8", "replace")
    return line


def history_of_lines(lines: DataFrame) -> DataFrame:
    """lines (n, line) of a log -> HISTORY: a header carries its author and time to the paths below it.

    Headers are carried within ranges of RANGE numbers, each a window of its own; what a range begins with is the last
    header of the ranges before it, found over one row for each.
    """
    head = F.when(F.col("line").startswith(_HEADER), F.substring("line", 2, 1_000_000))
    d = lines.select("n", "line", F.floor(F.col("n") / RANGE).alias("range"), head.alias("own"))
    ends = d.groupBy("range").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("end"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("range", F.last("end", ignorenulls=True).over(before).alias("begin"))
    w = Window.partitionBy("range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("within", F.last("own", ignorenulls=True).over(w)).join(begins, "range").withColumn("head", F.coalesce("within", "begin"))
    d = d.where((F.col("line") != "") & ~F.col("line").startswith(_HEADER) & F.col("head").isNotNull())
    d = d.select(F.col("line").alias("path"), (F.split("head", "\t")[0].cast("long") * 1000).alias("at"), F.split("head", "\t")[1].alias("author"))
    by = d.groupBy("path", "author").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return by.groupBy("path").agg(F.sum("n").alias("commit_count"), F.max("at").alias("last_commit_at"), F.map_from_entries(F.collect_list(F.struct("author", "n"))).alias("authors"))


def history(spark: SparkSession, config: Config) -> DataFrame | None:
    lines = git_log(config.root, config.git.window_days, config.git.max_commits) if config.git.enabled else None
    if lines is None:
        return None
    rows = [(i, unquoted(x)) for i, x in enumerate(lines)]
    return history_of_lines(spark.createDataFrame(rows, "n long, line string"))


# --- package description -----------------------------------------------------------------------------------
def package_json(root: str) -> dict:
    try:
        value = json.loads((Path(root) / "package.json").read_text())
    except (OSError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


def entrypoints(package: dict) -> list[tuple[str, str]]:
    """(kind, path) named by a package: main, module, types, bin, and all strings in exports down to depth four."""
    found: dict[tuple[str, str], None] = {}

    def add(kind, value):
        if isinstance(value, str) and value:
            found[kind, value.removeprefix("./")] = None

    def walk(value, depth):
        if isinstance(value, str):
            add("exports", value)
        elif depth <= 4 and isinstance(value, (dict, list)):
            for x in value.values() if isinstance(value, dict) else value:
                walk(x, depth + 1)

    for kind in ("main", "module", "types"):
        add(kind, package.get(kind))
    own = package.get("bin")
    for value in own.values() if isinstance(own, dict) else [own]:
        add("bin", value)
    walk(package.get("exports"), 0)
    return list(found)

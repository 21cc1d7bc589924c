"""Readers of what a repository holds beside its code: history, changes, ignore rules, build and infrastructure files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_secret_name, is_secret_value

#: Directories that are never walked.
SKIPPED = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", ".idea", ".vscode", "coverage", ".next", ".cache")


# Files and ignore rules
def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A rule of an ignore file as a regular expression over relative paths, and whether it takes files back in; None for comments."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    back, rule = rule.startswith("!"), rule.lstrip("!")
    only_dir, rule = rule.endswith("/"), rule.rstrip("/")
    rooted, rule = "/" in rule, rule.lstrip("/")
    out, k = "", 0
    while k < len(rule):
        c = rule[k]
        if rule.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rule.startswith("/**", k) and k + 3 == len(rule):
            out, k = out + "/.*", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in rule[k:]:
            end = rule.index("]", k)
            out, k = out + rule[k : end + 1].replace("[!", "[^"), end + 1
        elif c == "\\" and k + 1 < len(rule):
            out, k = out + re.escape(rule[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$"), back


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a list of rules leaves a path out; the last rule that fits decides."""
    out = F.lit(False)
    for rule in rules:
        if (made := ignore_regex(rule)) is not None:
            out = F.when(path.rlike(made[0]), F.lit(not made[1])).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, rules: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """path, size of the files below root that are neither skipped nor ignored, and the top directories that were excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/", "")
    files = files.select(base.alias("path"), "size")
    skip = F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/")
    out = skip | ignored(F.col("path"), list(rules))
    return files.filter(~out), files.filter(out).select(F.regexp_extract("path", "^([^/]+)", 1).alias("subtree")).distinct()


# Git
def commits(log: DataFrame) -> DataFrame:
    """hash, ts, file of git log --name-only --format=COMMIT:%H:%ct lines (at, value): each file line belongs to the last header before it.

    Lines of one log are in one order, so a log is read by one task; logs of several repositories (repo) are read side by side.
    """
    repo = F.col("repo") if "repo" in log.columns else F.lit("")
    head = F.regexp_extract("value", "^COMMIT:([0-9a-f]+):(\\d+)$", 1)
    df = log.select(repo.alias("repo"), "at", "value", F.when(head != "", F.struct(head.alias("hash"), F.regexp_extract("value", "^COMMIT:([0-9a-f]+):(\\d+)$", 2).cast("long").alias("ts"))).alias("h"))
    last = F.last("h", ignorenulls=True).over(Window.partitionBy("repo").orderBy("at"))
    return df.withColumn("c", last).filter(F.col("h").isNull() & (F.trim("value") != "") & F.col("c").isNotNull()).select("c.hash", "c.ts", F.col("value").alias("file"))


def name_status(lines: DataFrame) -> DataFrame:
    """status, path, old_path of git diff --name-status lines (value)."""
    p = F.split("value", "\t")
    moved = F.get(p, F.lit(0)).rlike("^[RC]")
    return lines.filter(F.size(p) >= 2).select(F.substring("value", 1, 1).alias("status"), F.when(moved, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("path"), F.when(moved, F.get(p, F.lit(1))).alias("old_path"))


def hunks(lines: DataFrame) -> DataFrame:
    """path, start, end on the new side of git diff --unified=0 lines (at, value); a hunk of no lines is one line."""
    name = F.when(F.col("value").startswith("+++ "), F.regexp_replace(F.substring("value", 5, 10_000), "^b/", ""))
    df = lines.withColumn("path", F.last(name, ignorenulls=True).over(Window.partitionBy(F.col("repo") if "repo" in lines.columns else F.lit("")).orderBy("at")))
    head = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    df = df.filter(F.col("value").rlike(head) & (F.col("path") != "/dev/null"))
    start, n = F.regexp_extract("value", head, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("value", head, 2), F.lit("")).cast("int"), F.lit(1))
    return df.select("path", F.greatest(start, F.lit(1)).alias("start"), F.greatest(F.greatest(start, F.lit(1)) + F.greatest(n, F.lit(1)) - 1, F.lit(1)).alias("end"))


# Build and infrastructure
def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """directory, file, includes, defines of a compile_commands.json."""
    df = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    args = F.coalesce("arguments", F.split("command", "\\s+"))
    after = lambda flag: F.transform(F.filter(args, lambda a: a.startswith(flag) & (F.length(a) > len(flag))), lambda a: F.substring(a, len(flag) + 1, 10_000))
    return df.select("directory", "file", after("-I").alias("includes"), after("-D").alias("defines"))


def dockerfile(lines: DataFrame) -> DataFrame:
    """path, instruction, key, value of Dockerfile lines (path, value): images, ports, environment, arguments, entry points; secrets are dropped."""
    head = r"^\s*(FROM|EXPOSE|ENV|ARG|ENTRYPOINT|CMD|WORKDIR|USER)\s+(.*)$"
    df = lines.filter(F.col("value").rlike(head)).select("path", F.regexp_extract("value", head, 1).alias("instruction"), F.regexp_extract("value", head, 2).alias("rest"))
    pair = F.col("instruction").isin("ENV", "ARG")
    key = F.when(pair, F.regexp_extract("rest", r"^([A-Za-z_][A-Za-z0-9_]*)", 1)).otherwise("")
    value = F.when(pair, F.regexp_replace("rest", r"^[A-Za-z_][A-Za-z0-9_]*[= ]?", "")).otherwise(F.col("rest"))
    return df.select("path", "instruction", key.alias("key"), F.trim(F.trim(value), F.lit("\"'")).alias("value")).filter(~is_secret_name(F.col("key")) & ~is_secret_value(F.col("value")))


def dotenv(lines: DataFrame) -> DataFrame:
    """path, key, value of KEY=value and export KEY=value lines (path, value); secrets are dropped."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    df = lines.filter(F.col("value").rlike(pattern)).select("path", F.regexp_extract("value", pattern, 1).alias("key"), F.trim(F.regexp_extract("value", pattern, 2), F.lit("\"'")).alias("value"))
    return df.filter(~is_secret_name(F.col("key")) & ~is_secret_value(F.col("value")))


def env_urls(lines: DataFrame) -> DataFrame:
    """Settings whose value is a URL."""
    return dotenv(lines).filter(F.col("value").rlike(r"^[a-z][a-z0-9+.-]*://"))


def terraform(lines: DataFrame) -> DataFrame:
    """path, block, type, name of resource, data, module, variable, output and provider lines (path, value)."""
    head = r'^\s*(resource|data|module|variable|output|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?'
    df = lines.filter(F.col("value").rlike(head))
    x = [F.regexp_extract("value", head, k) for k in (1, 2, 3)]
    return df.select("path", x[0].alias("block"), F.when(x[2] != "", x[1]).otherwise("").alias("type"), F.when(x[2] != "", x[2]).otherwise(x[1]).alias("name"))


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, name, images of Kubernetes documents in files (path, text): top-level kind, the name under metadata, and every image."""
    docs = files.select("path", F.explode(F.split("text", r"(?m)^---\s*$")).alias("doc"))
    one = lambda pattern: F.trim(F.regexp_extract("doc", pattern, 1), F.lit("\"' "))
    df = docs.select("path", one(r"(?m)^kind:\s*(\S+)").alias("kind"), one(r"(?ms)^metadata:\s*$.*?^\s+name:\s*(\S+)").alias("name"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("doc", F.lit(r"(?m)^\s*-?\s*image:\s*(\S+)"), F.lit(1)), lambda i: F.trim(i, F.lit("\"'"))))).alias("images"))
    return df.filter("kind <> ''")


def roles(evidence: DataFrame) -> DataFrame:
    """repo, role, rule of repositories (repo, declared, vendored, gitignored, do_not_edit, has_remote): the first rule that applies, by name."""
    rule = F.when(F.col("declared").isNotNull(), "declared").when(F.col("vendored"), "vendored registry").when(F.col("gitignored"), "ignored by parent").when(F.col("do_not_edit"), "do-not-edit header").when(F.col("has_remote"), "remote").otherwise("default")
    role = F.when(rule == "declared", F.col("declared")).when(rule == "remote", "member").otherwise("reference")
    return evidence.select("repo", role.alias("role"), rule.alias("rule"))

"""What git knows of a working tree, as rows. Without git, or outside a repository, all is empty."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def head(root: str) -> tuple[str | None, str | None]:
    """The commit and the branch; no branch if the head is detached."""
    commit, branch = _git(root, "rev-parse", "HEAD"), _git(root, "symbolic-ref", "--short", "-q", "HEAD")
    return (commit or "").strip() or None, (branch or "").strip() or None


def status(spark: SparkSession, root: str) -> DataFrame:
    """path and status (changed, deleted or untracked) of the working tree; a rename deletes one and changes one."""
    rows, parts = [], iter((_git(root, "status", "--porcelain", "-z", "--untracked-files=all") or "").split("\0"))
    for p in parts:
        if len(p) < 4:
            continue
        kind, path = p[:2], p[3:]
        if "R" in kind or "C" in kind:
            old = next(parts, "")
            rows.append((path, "changed"))
            if "R" in kind:
                rows.append((old, "deleted"))
        else:
            rows.append((path, "untracked" if kind == "??" else "deleted" if "D" in kind else "changed"))
    return spark.createDataFrame(rows, "path string, status string")


def since(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """path of the files that differ between a commit and the working tree."""
    out = _git(root, "diff", "--name-only", "-z", commit, "--") if commit and not commit.startswith("-") else None
    return spark.createDataFrame([(p,) for p in (out or "").split("\0") if p], "path string")


def recent(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """place (0 is the latest), commit, author, date, subject and files of the last n commits."""
    out = _git(root, "log", f"-n{int(n)}", "--name-only", "-z", "--format=%x01%H%x02%an%x02%aI%x02%s%x03") or ""
    rows = []
    for i, block in enumerate(out.split("\x01")[1:]):
        told, _, files = block.partition("\x03")
        rows.append((i, *told.split("\x02"), [f for f in files.replace("\n", "\0").split("\0") if f]))
    return spark.createDataFrame(rows, "place int, commit string, author string, date string, subject string, files array<string>")


def deleted_known(known: DataFrame, now: DataFrame) -> DataFrame:
    """path of the indexed files that git says are deleted."""
    return known.select("path").intersect(now.filter("status = 'deleted'").select("path"))

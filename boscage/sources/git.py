"""History of files in git, read by the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMIT = "hash string, author_name string, author_email string, author_date string, message string"
_FIELD, _RECORD = "\x1f", "\x1e"


def _git(repo: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    return done.stdout if done.returncode == 0 else None


def log(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """Commits that touched a file, renames followed; no rows outside a repository."""
    said = _git(repo, "log", "--follow", f"--format=%H{_FIELD}%an{_FIELD}%ae{_FIELD}%aI{_FIELD}%s{_RECORD}", "--", path) or ""
    rows = [tuple(r.strip("\n").split(_FIELD)) for r in said.split(_RECORD) if r.strip()]
    return spark.createDataFrame([r for r in rows if len(r) == 5], COMMIT)


def file_commits(spark: SparkSession, repo: str, paths: list[str]) -> DataFrame:
    """(file_path, commit...) for all given files, by one reading of the log with the files that each commit touched; renames are followed."""
    said = _git(repo, "log", "-M", "--name-status", f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%ae{_FIELD}%aI{_FIELD}%s") or ""
    top = (_git(repo, "rev-parse", "--show-toplevel") or repo).strip()
    names = {os.path.relpath(os.path.realpath(os.path.join(repo, p) if not os.path.isabs(p) else p), os.path.realpath(top)): p for p in paths}
    rows = []
    for record in said.split(_RECORD)[1:]:  # newest first
        head, *touched = record.strip("\n").split("\n")
        commit = tuple(head.split(_FIELD))
        for line in filter(None, touched):
            status, *at = line.split("\t")
            if at and at[-1] in names and len(commit) == 5:
                rows.append((names[at[-1]], *commit))
                if status.startswith("R"):  # before, the file had the other name
                    names.setdefault(at[0], names[at[-1]])
    return spark.createDataFrame(rows, "file_path string, " + COMMIT)


def text_at(repo: str, path: str, revision: str) -> str | None:
    """A file's text at a revision, None if it wasn't there."""
    return _git(repo, "show", f"{revision}:{path}")


def blame(spark: SparkSession, repo: str, path: str) -> DataFrame:
    """(line, hash): the last commit of each line."""
    said = _git(repo, "blame", "-s", "-l", "--", path)
    rows = [(k, line.split(" ", 1)[0].lstrip("^")) for k, line in enumerate((said or "").splitlines(), 1)]
    return spark.createDataFrame(rows, "line int, hash string")

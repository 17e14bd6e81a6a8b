"""What the driver observes outside Spark: checkouts, processes, probes, spools, roots and backups; each gives rows for a table."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import porcelain_dirty

REVISION = "path string, status string, commitSha string, branch string, dirty boolean, isLinkedWorktree boolean, repositoryId string, worktreeId string, commonDir string, subdirectory string"


def _git(path: str, *words: str) -> bytes | None:
    """What a read-only git command prints; null where it fails or takes long."""
    try:
        done = subprocess.run(["git", "--no-optional-locks", "-C", path, *words], capture_output=True, timeout=20, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def _opaque(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def revision(path: str) -> dict:
    """One row of REVISION: the checkout that holds a folder. Places are told as digests only; a folder outside any checkout is not_git, one without commits unborn."""
    row = dict.fromkeys((c.split()[0] for c in REVISION.split(", ")), None) | {"path": path, "status": "not_git"}
    said = _git(path, "rev-parse", "--path-format=absolute", "--git-dir", "--git-common-dir", "--show-prefix")
    if said is None:
        return row
    own, common, prefix = (said.decode().split("\n") + ["", "", ""])[:3]
    row |= {
        "isLinkedWorktree": own != common, "commonDir": common, "subdirectory": prefix.rstrip("/"),
        "repositoryId": _opaque("repository", common, prefix), "worktreeId": _opaque("worktree", own, prefix)
    }
    head, branch, status = _git(path, "rev-parse", "--verify", "HEAD"), _git(path, "symbolic-ref", "--short", "-q", "HEAD"), _git(
        path, "status", "--porcelain", "-z", "--", "."
    )
    if head is None:
        return row | {"status": "unborn"}
    return row | {
        "status": "available" if status is not None else "unavailable", "commitSha": head.decode().strip(),
        "branch": branch and branch.decode().strip(), "dirty": None if status is None else porcelain_dirty(status)
    }


def revisions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A table of REVISION for a bounded list of folders."""
    return spark.createDataFrame([revision(p) for p in paths], REVISION)


def linked_worktrees(projects: DataFrame, candidates: DataFrame) -> DataFrame:
    """(project, worktree): candidates (path, commonDir, subdirectory, isLinkedWorktree) that are linked worktrees of a registered project's repository, at the same place in it and not the project itself."""
    of = projects.select(F.col("path").alias("project"), "commonDir", "subdirectory")
    return candidates.where("isLinkedWorktree").select(
        F.col("path").alias("worktree"), "commonDir", "subdirectory"
    ).join(of, ["commonDir", "subdirectory"]).where("project <> worktree").select("project", "worktree")


def locate(roots: dict[str, str], root_id: str, relative: str) -> str | None:
    """The real folder of a locator: inside its root, and inside no other root; null otherwise."""
    if root_id not in roots or not relative or any(p in ("", ".", "..") for p in relative.split("/")) and relative != ".":
        return None
    real = {k: os.path.realpath(v) for k, v in roots.items()}
    there = os.path.realpath(os.path.join(real[root_id], relative))
    holds = lambda folder: there == folder or there.startswith(folder.rstrip("/") + "/")
    return there if os.path.isdir(there) and [k for k, v in real.items() if holds(v)] == [root_id] else None


def listed(registry: DataFrame, available: DataFrame) -> DataFrame:
    """Registry rows (name, path, ...) whose path is null where it isn't among the available ones (path)."""
    known = available.select("path", F.lit(True).alias("there")).distinct()
    return registry.join(known, "path", "left").withColumn("path", F.when(F.col("there"), F.col("path"))).drop("there")


def process_sample(pid: int) -> dict | None:
    """Start, CPU seconds and resident bytes of a process; null if it is gone."""
    try:
        with open(f"/proc/{pid}/stat", encoding="ascii", errors="replace") as f:
            fields = f.read().rpartition(")")[2].split()
    except OSError:
        return None
    ticks = os.sysconf("SC_CLK_TCK")
    return {"started": int(fields[19]), "cpu": (int(fields[11]) + int(fields[12])) / ticks, "rss": int(fields[21]) * os.sysconf("SC_PAGE_SIZE")}


def get_json(origin: str, path: str, seconds: float = 5.0, most: int = 65_536) -> dict | None:
    """One JSON object from a service on this machine; null for another answer, a longer one, or none. Other origins are refused."""
    if urlsplit(origin).scheme != "http" or urlsplit(origin).hostname not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("only a local origin is asked")
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
    try:
        with opener.open(origin + path, timeout=seconds) as answer:
            raw = answer.read(most + 1)
        value = json.loads(raw) if len(raw) <= most else None
    except (OSError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def soak(probe: Callable[[], dict], seconds: float, every: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """A probe's samples at fixed times from now to a deadline; a late one is taken at once and moves no later one."""
    began, out = clock(), []
    while (due := began + len(out) * every) <= began + seconds:
        if due > clock():
            sleep(due - clock())
        out.append({"at": clock() - began, **probe()})
    return out


@contextlib.contextmanager
def locked(folder: str) -> Iterator[str]:
    """A private folder, made if need be, held by one process at a time."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    if os.stat(folder).st_mode & 0o077:
        raise PermissionError("folder is not private")
    with open(os.path.join(folder, ".lock"), "a", encoding="ascii") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield folder


SPOOL = "key string, body string, problem string"


def spool(spark: SparkSession, folder: str, most_bytes: int = 4096) -> DataFrame:
    """(key, body, problem) of one-record files key.json in a folder: too_large, or no_object where it isn't one JSON object."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    key, body = F.regexp_extract("path", r"([^/]*)\.json$", 1), F.col("content").cast("string")
    kind = F.schema_of_variant(F.try_parse_json(body))
    problem = F.when(F.col("length") > most_bytes, "too_large").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "no_object")
    return files.select(key.alias("key"), F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def back_up(folder: str, members: list[str], target: str) -> dict[str, str]:
    """Copy named files of a folder into a new one beside their manifest of digests; the target appears at once, complete."""
    hidden = f"{target}.part"
    os.makedirs(hidden, mode=0o700)
    manifest = {}
    for name in sorted(members):
        with open(os.path.join(folder, name), "rb") as source, open(os.path.join(hidden, name), "xb") as copy:
            copy.write(source.read())
        manifest[name] = _digest(os.path.join(hidden, name))
    with open(os.path.join(hidden, "manifest.json"), "x", encoding="utf-8") as f:
        json.dump(manifest, f, sort_keys=True)
    os.rename(hidden, target)
    return manifest


def backup_problems(target: str, allowed: list[str]) -> list[str]:
    """What is wrong with a backup: members that aren't allowed, missing or unlisted, and digests that differ."""
    try:
        with open(os.path.join(target, "manifest.json"), encoding="utf-8") as f:
            manifest = json.load(f)
    except (OSError, ValueError):
        return ["manifest_invalid"]
    there = set(os.listdir(target)) - {"manifest.json"}
    out = [f"not_allowed {n}" for n in sorted(set(manifest) - set(allowed))] + [f"missing {n}" for n in sorted(set(manifest) - there)] + [
        f"unlisted {n}" for n in sorted(there - set(manifest))
    ]
    return out + [f"digest_differs {n}" for n in sorted(there & set(manifest)) if _digest(os.path.join(target, n)) != manifest[n]]


def restore(target: str, folder: str, allowed: list[str]) -> None:
    """Put a sound backup's files back, each by a rename."""
    if problems := backup_problems(target, allowed):
        raise ValueError("; ".join(problems))
    with open(os.path.join(target, "manifest.json"), encoding="utf-8") as f:
        for name in json.load(f):
            with open(os.path.join(target, name), "rb") as source, open(os.path.join(folder, f".{name}.part"), "wb") as copy:
                copy.write(source.read())
            os.replace(os.path.join(folder, f".{name}.part"), os.path.join(folder, name))

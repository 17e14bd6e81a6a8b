"""Readers of the evidence sources, all with explicit schemas."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import texts
from ..schemas import PROJECTS

# Fixed list of the extensions that are source texts.
EXTENSIONS = "ts tsx js jsx cs csproj sln slnx py go rs java sh bash ps1 psm1 psd1 md json yaml yml txt".split()
MAX_FILE_BYTES = 128 * 1024


def source_files(spark: SparkSession, root: str, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text, byte_size, sha256) of the allowed source files below a folder; too long ones and those with NUL are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = os.path.abspath(root.removeprefix("file://")) if "://" not in root or root.startswith("file:") else "/" + root.split("://", 1)[1]
    rows = found.where(F.col("length") <= most_bytes).select(F.substring(full, len(base) + 2, 1 << 20).alias("path"), "content")
    text = F.decode("content", "UTF-8")
    rows = rows.where(texts.path_allowed(F.col("path")) & F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(EXTENSIONS))
    return rows.select(
        "path", text.alias("text"), F.octet_length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256")
    ).where(~F.col("text").contains("\0"))


def registry(spark: SparkSession, path: str, source: str = "manual") -> DataFrame:
    """Projects of a JSON array: names are trimmed, a missing root is 'default', paths have slashes and no last one, a missing source is the one given. Rows without a name or a
    relative path go, and so do paths that leave their root.
    """
    rows = spark.read.schema(PROJECTS).json(path, multiLine=True)
    relative = F.regexp_replace(F.regexp_replace(F.trim("relativePath"), r"\\", "/"), "/+$", "")
    rows = rows.withColumns(
        {
            "name": F.trim("name"), "rootId": F.coalesce("rootId", F.lit("default")), "relativePath": relative,
            "registrySource": F.coalesce("registrySource", F.lit(source))
        }
    )
    return rows.where("name <> '' and relativePath <> ''").where(~F.col("relativePath").rlike(r"^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)"))


def capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file in order; for operators.telemetry.inspect."""
    return spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("line_no"), F.col("value").alias("line"))


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's content if its digest is the pinned one, else nothing."""
    return spark.read.format("binaryFile").load(path).where(F.sha2("content", 256) == sha256).select("path", "content")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Ranges of rowid, one for each partition, read-only."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("partitions", 4))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema)
        with self._open() as db:
            yield from db.execute(f'select {columns} from "{self.table}" where rowid between ? and ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite_snapshot").schema(...).option("path", ...).option("table", ...).load() of a standalone snapshot file that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def discovered(root: str, depth: int = 3, limit: int = 100) -> tuple[list[dict], bool]:
    """Project folders below a root (driver side, bounded): rows sorted by path and whether there were more than the limit."""
    marks, rows = (".git", "package.json", "pyproject.toml", "go.mod", "Cargo.toml"), []

    def walk(folder: str, level: int) -> None:
        if level > depth or len(rows) > limit:
            return
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
        names = [e.name for e in entries]
        signals = [m for m in marks if m in names] + sorted(n for n in names if n.endswith((".sln", ".csproj")))
        if signals and level:
            rows.append({"relativePath": os.path.relpath(folder, root), "signals": signals, "type": project_type(names)})
            return
        for e in entries:
            if e.is_dir(follow_symlinks=False) and e.name not in texts.IGNORED_FOLDERS:
                walk(e.path, level + 1)

    walk(root, 0)
    return sorted(rows, key=lambda r: r["relativePath"])[:limit], len(rows) > limit


def project_type(names: list[str]) -> str:
    """Type of a folder by its files: the first rule that fits."""
    if any(n.endswith((".sln", ".slnx", ".csproj")) for n in names):
        return "dotnet"
    if "tsconfig.json" in names:
        return "typescript"
    if "package.json" in names:
        return "nodejs"
    return "python" if {"pyproject.toml", "requirements.txt", "setup.py"} & set(names) else "unknown"


def porcelain_dirty(status: bytes) -> bool | None:
    """Whether a NUL-separated status listing shows changes; untracked byte code doesn't count; None if it is malformed."""
    parts, k, dirty = status.split(b"\0"), 0, False
    if parts.pop() != b"":
        return None
    while k < len(parts):
        entry = parts[k]
        if len(entry) < 4 or entry[2:3] != b" ":
            return None
        code, name = entry[:2], entry[3:]
        k += 2 if b"R" in code or b"C" in code else 1
        if k > len(parts):
            return None
        dirty = dirty or not (code == b"??" and (name.endswith((b".pyc", b"__pycache__/")) or b"__pycache__/" in name))
    return dirty


def front_matter(text: str) -> dict[str, str | list[str]]:
    """Flat front matter of a manifest: scalars and lists of scalars; raises ValueError on repeated keys or a missing end."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}
    out: dict = {}
    key = None
    for line in lines[1:]:
        if line.strip() == "---":
            return out
        if line.startswith(("  - ", "- ")) and key:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(line.split("- ", 1)[1].strip().strip("\"'"))
        elif ":" in line:
            key, value = (p.strip() for p in line.split(":", 1))
            if key in out:
                raise ValueError(f"repeated key {key}")
            out[key] = json.loads(value) if value.startswith("[") else value.strip("\"'")
    raise ValueError("front matter does not end")


EVIDENCE = "schemaVersion int, snapshotToken string, provider struct<id: string, version: string>, nodes array<struct<id: string, label: string, kind: string, file: string, line: int>>, edges array<struct<src: string, dst: string, relation: string>>"
#: Nodes, edges and bytes of an external provider's answer. Fixed values.
ANSWER_NODES, ANSWER_EDGES, ANSWER_BYTES = 2000, 4000, 256 * 1024


def external_evidence(spark: SparkSession, path: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an external provider's answers, JSON files of EVIDENCE made ahead; those too large, too long or of another snapshot are passed over."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= ANSWER_BYTES)
    rows = files.select(F.from_json(F.col("content").cast("string"), EVIDENCE).alias("e")).select("e.*")
    sound = rows.where((F.col("schemaVersion") == 1) & (F.col("snapshotToken") == snapshot) & (F.size("nodes") <= ANSWER_NODES) & (F.size("edges") <= ANSWER_EDGES))
    return sound.select(F.inline("nodes")), sound.select(F.inline("edges"))

"""Explicit schemas of the evidence tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType().add("id", "long").add("label", "string").add("kind", "string").add("file", "string").add("feature", "string").add("layer", "string")
EDGES = T.StructType().add("src", "long").add("dst", "long").add("relation", "string")
FILES = T.StructType().add("path", "string").add("text", "string")
PROJECTS = T.StructType().add("name", "string").add("rootId", "string").add("relativePath", "string").add("projectId", "string").add("registrySource", "string").add("addedAt", "string").add("discoveredAt", "string")
# Fixed values of the capture format: the six keys of a record, and no others.
LOG_KEYS = ("runId", "profile", "sha", "nexusTools", "writePaths", "watchPaths")
_PATHS = T.ArrayType(T.StringType())
LOG = T.StructType().add("runId", "string").add("profile", "string").add("sha", "string").add("nexusTools", "boolean").add("writePaths", _PATHS).add("watchPaths", _PATHS)
COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "api_call_count")
#: Three-valued evidence: an empty result and one that was not evaluated differ.
STATUS = "status string, finding_state string, reasons array<string>"

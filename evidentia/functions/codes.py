"""Codes, quoting and naming rules as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the naming rules: layers in their order, folders that name no feature, types that are no dependency.
LAYER_ORDER = ["API", "Application", "Domain", "Infrastructure", "Tests", "Other"]
ARCHITECTURE_SEGMENTS = (
    "api application domain infrastructure core shared common services service handlers handler commands command queries query controllers controller endpoints endpoint "
    "models model entities entity dtos dto contracts contract interfaces interface persistence repositories repository database dbcontext configurations configuration config "
    "migrations mapping mappers mapper options validators validator validation extensions extension middleware middlewares exceptions exception constants constant enums enum properties bin obj"
).split()
COMMON_FOLDERS = "src app pages components hooks utils lib types features".split()
IGNORED_TYPES = "string int long decimal double float bool DateTime DateOnly Guid Task IEnumerable ICollection List Dictionary CancellationToken object void".split()
# Fixed values of the document and term rules.
DOCUMENT_KINDS = {"PROJECT.md": "project", "AGENTS.md": "agents", "CONTEXT.md": "context"}
ADR_FOLDERS = ("docs/adr", "docs/adrs", "adr", "adrs")
STOP_TERMS = "the and for with add update fix task".split()
# Fixed value of the folder rule: which part of a path names which layer, the first that fits.
FOLDER_LAYERS = (
    ("presentation", ("components",)), ("logic", ("hooks",)), ("common", ("utils", "lib")), ("services", ("services", "api")),
    ("types", ("types", "interfaces"))
)


def simple_hash(text: Column) -> Column:
    """Hexadecimal of the absolute 32-bit hash 31 * h + c over UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda i: F.conv(F.call_function("substring", units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    places = F.when(F.length(units) > 0, F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.lower(F.hex(F.abs(F.aggregate(places, F.lit(0).cast("long"), lambda h, i: wrap(h * 31 + unit(i))))))


def clean_type(text: Column) -> Column:
    """The last word of a type once brackets, commas and question marks are blanks; null without any."""
    words = F.filter(F.split(F.regexp_replace(text, r"[?<>,()\[\]]", " "), r"\s+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(-1))


def useful_type(name: Column) -> Column:
    return name.isNotNull() & (name != "") & ~name.isin(*IGNORED_TYPES)


def quoted(label: Column) -> Column:
    """A label as it is if it needs no quotes, else as a JSON string; null where it is empty, over 1024 characters or holds control or format characters."""
    plain = label.rlike(r"^[A-Za-z0-9_./$-]+$")
    as_json = F.concat(F.lit('"'), F.regexp_replace(label, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when((label != "") & (F.length(label) <= 1024) & ~label.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), F.when(plain, label).otherwise(as_json))


def escaped_controls(text: Column) -> Column:
    """Control characters as \\xNN."""
    out = F.coalesce(text, F.lit(""))
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; whole numbers without a fraction. Raises ValueError on what is no JSON number."""
    if isinstance(value, dict):
        return "{" + ",".join(
            f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        ) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null where a text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text, parse_constant=lambda c: 1 / 0))
        except (ValueError, ZeroDivisionError, RecursionError):
            return None

    return texts.map(one)


def symbol_label(label: Column) -> Column:
    """Whether a label may name a symbol: short, not blank, no controls, no path, drive or URI."""
    bad = label.rlike(r"[\x00-\x1f\x7f]") | label.rlike(r"^(?:[\\/]|\.\.[\\/]|[A-Za-z]:(?!:)|[A-Za-z][A-Za-z0-9+.-]*://)") | label.rlike(r"(?:^|[\\/])\.git(?:[\\/]|$)")
    return F.coalesce((F.length(label) <= 128) & (F.trim(label) != "") & ~bad, F.lit(False))


def position_in(text: Column, line: Column, column: Column) -> Column:
    """Whether a place, counted from 1, lies in a text; the place after a line's last character does."""
    lines = F.split(text, r"\r?\n", -1)
    there = (line >= 1) & (line <= F.size(lines)) & (column >= 1)
    return F.coalesce(there & (column <= F.length(F.get(lines, line - 1)) + 1), F.lit(False))


def terms_of(title: str, description: str = "") -> list[str]:
    """Up to 32 different terms of three letters and more of a request, in order, without the stop words."""
    found = dict.fromkeys(re.findall(r"[a-z0-9_]{3,}", f"{title} {description}".lower()))
    return [t for t in found if t not in STOP_TERMS][:32]


def lexical(text: Column, terms: list[str]) -> Column:
    """Whether any term is in a text, in lower case."""
    low, hit = F.lower(text), F.lit(False)
    for t in terms:
        hit = hit | low.contains(t)
    return F.coalesce(hit, F.lit(False))


def document_kind(path: Column) -> Column:
    """Kind of a contextual document by its name and place; null for others."""
    name, folder = F.element_at(F.split(path, "/"), -1), F.regexp_replace(path, r"/?[^/]*$", "")
    adr = F.lit(False)
    for f in ADR_FOLDERS:
        adr = adr | (folder == f) | folder.startswith(f"{f}/")
    out = F.when((name == "AGENT.md") | ((name == "PROJECT.md") & path.contains("/")), F.lit(None).cast("string"))
    for known, kind in DOCUMENT_KINDS.items():
        out = out.when(name == known, kind)
    return out.when(path == "docs/CURRENT_STATUS.md", "context").when(F.lower(name).endswith(".md") & adr, "adr")


def _capital(segment: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(segment, r"(?i)\.cs$", ""), r"(?i)\.csproj$", ""))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20))


def _business(segments: Column, layer: Column) -> Column:
    """The first segment that names neither architecture, layer nor drive; null without one."""
    names = F.transform(segments, _capital)
    keep = lambda s: (s != "") & ~F.lower(s).isin(*ARCHITECTURE_SEGMENTS) & (F.lower(s) != F.lower(F.coalesce(layer, F.lit("")))) & ~s.rlike("^[A-Za-z]:$")
    return F.get(F.filter(names, keep), F.lit(0))


def feature(project: Column, layer: Column, path: Column, namespace: Column, name: Column) -> Column:
    """Business feature of a symbol: from its folders below the project, else its namespace, else its name; null without any."""
    project = F.coalesce(project, F.lit(""))
    segments = F.filter(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), lambda s: s != "")
    root = F.array_position(segments, project)
    folders = F.when(F.size(segments) > 1, F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    folders = F.when(root > 0, F.filter(folders, lambda s, i: i >= root)).otherwise(folders)
    own = F.transform(F.split(project, "[._-]"), F.lower)
    spaces = F.filter(F.split(F.coalesce(namespace, F.lit("")), r"\."), lambda s: (s != "") & ~F.array_contains(own, F.lower(s)))
    prefix = F.regexp_extract(
        F.coalesce(name, F.lit("")),
        r"^([A-Z][a-zA-Z0-9]*?)(?:Controller|Service|Handler|Repository|Command|Query|Dto|Request|Response|Entity|Client)?$", 1
    )
    prefix = F.regexp_replace(F.regexp_replace(prefix, r"(?i)(?:Creation|Create|Update|Delete|Get|List|Sync|Processor|Manager)$", ""), r"^I(?=[A-Z])", "")
    return F.coalesce(_business(folders, layer), _business(spaces, layer), F.when(F.length(prefix) >= 3, _capital(prefix)))


def folder_layer(path: Column) -> Column:
    """Layer of a TypeScript file by its folders."""
    low, out = F.concat(F.lit("/"), F.lower(path)), F.lit("unknown")
    for layer, folders in reversed(FOLDER_LAYERS):
        hit = F.lit(False)
        for f in folders:
            hit = hit | low.contains(f"/{f}/")
        out = F.when(hit, layer).otherwise(out)
    return out


def folder_feature(path: Column) -> Column:
    """The first part of a path that has no dot and is no common folder; else shared."""
    named = F.filter(F.split(path, "/"), lambda p: ~p.contains(".") & ~F.lower(p).isin(*COMMON_FOLDERS))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("shared"))


def by_layer(layers: Column) -> Column:
    """Layers in their fixed order, unknown ones last by name."""
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LAYER_ORDER)), x), F.lit(0)), F.lit(99))
    return F.transform(F.array_sort(F.transform(layers, lambda x: F.struct(rank(x).alias("r"), x.alias("x")))), lambda s: s["x"])

"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the identifier extractor: words that are no identifiers.
IGNORED_WORDS = "public private protected internal class interface record struct enum namespace using return new await async var this base null true false string int long decimal double float bool void object Task List IEnumerable Dictionary DateTime Guid CancellationToken".split()
# Fixed values of the path policy: folders that are never scanned, and names that may hold secrets.
IGNORED_FOLDERS = ".git .vs .vscode node_modules bin obj dist build coverage .next".split()
SECRET_NAME = r"^(?:\.env(?:\..*)?|\.ssh|\.aws|\.azure|\.npmrc|\.pypirc|credentials?(?:\..*)?|secrets?(?:\..*)?|service[-_]account(?:\..*)?|id_rsa|id_ed25519)$"
# Fixed patterns of the redaction rule. Word boundaries are spelt out: the JDK's \b takes letters beyond ASCII for word characters.
SECRETS = (
    r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?(?:-----END [^-]*PRIVATE KEY-----|\z)",
    r"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,})(?![A-Za-z0-9_])",
    r"(?im)^[^\n\r]*(?<![A-Za-z0-9_])(?:api[_-]?key|secret|password|access[_-]?token|authorization)[\"']?\s*[:=][^\n\r]*$",
)


def redacted(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most `most` UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    goes_on = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")  # noqa: E731  byte n + 1 continues a character
    end = F.lit(most - 3)
    for n in (most - 2, most - 1, most):
        end = F.when(~goes_on(n), n).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.call_function("substring", raw, F.lit(1), end), "UTF-8"))


def bounded(text: Column, most: int = 512) -> Column:
    """A redacted text of at most `most` bytes."""
    return cut_bytes(redacted(F.coalesce(text, F.lit(""))), most)


def identifiers(text: Column) -> Column:
    """Different identifiers of three characters and more that are no ignored words."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)"), 1))
    return F.filter(F.array_except(found, F.array(*map(F.lit, IGNORED_WORDS))), lambda w: F.length(w) >= 3)


def path_allowed(path: Column) -> Column:
    """Whether a path is relative and canonical and no part of it is an ignored folder or may be a secret."""
    parts = F.split(path, "/")
    sound = (F.length(path) <= 1024) & (F.length(path) > 0) & ~path.rlike(r"[\x00-\x1f\x7f]") & ~path.rlike("^[A-Za-z]:") & ~path.contains("\\") & (F.trim(path) == path)
    bad = lambda p: p.isin("", ".", "..", *IGNORED_FOLDERS) | p.rlike("(?i)" + SECRET_NAME)
    return F.coalesce(sound & ~F.exists(parts, bad), F.lit(False))


def line_count(text: Column) -> Column:
    """Lines of a text; a last line break begins none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)))


def title(text: Column, path: Column) -> Column:
    """The first heading of level one, else the file's name with capitals."""
    head = F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*\r?$", 1)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    bare = F.regexp_replace(name, r"(?i)^ADR[-_ ]*\d+[-_ ]*", "")
    words = F.trim(F.regexp_replace(F.when(bare == "", name).otherwise(bare), r"[-_\s]+", " "))
    shown = F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    return F.when(head != "", head).otherwise(shown)


# Fixed values of the layer rule: parts of a project's name and the layer that they stand for, the first that fits.
LAYERS = (("API", "api|webapi|web"), ("Application", "application"), ("Domain", "domain"), ("Infrastructure", "infrastructure"), ("Tests", "test|tests"))
# Fixed values of the category rule: how a name ends, what a namespace or project holds, or the kind, in the order in which they are tried.
CATEGORIES = (
    ("controller", {"name": ("Controller",), "namespace": (".Controllers",)}),
    ("interface", {"kind": ("interface",)}),
    ("enum", {"kind": ("enum",)}),
    ("service", {"name": ("Service", "Handler", "Validator"), "namespace": (".Services", ".Handlers", ".Validators")}),
    ("repository", {"name": ("Repository",), "namespace": (".Repositories",)}),
    ("database", {"name": ("DbContext",), "namespace": (".Persistence", ".Database")}),
    ("contract", {"name": ("Dto", "Request", "Response"), "namespace": (".Contracts", ".Dtos")}),
    ("domain", {"namespace": (".Entities", ".Domain"), "project": ("Domain",)}),
    ("infrastructure", {"namespace": (".Infrastructure",), "project": ("Infrastructure",)}),
    ("middleware", {"name": ("Middleware",), "namespace": (".Middleware",)}),
    ("extension", {"name": ("Extensions",), "namespace": (".Extensions",)}),
    ("application", {"project": ("Application",)}),
    ("api", {"project": ("API", "Api")}),
)


def layer(project: Column) -> Column:
    """Layer of a project's name."""
    out = F.lit("Other")
    for value, names in reversed(LAYERS):
        out = F.when(F.lower(project).rlike(f"(^|[._-])({names})([._-]|$)"), value).otherwise(out)
    return out


def category(name: Column, namespace: Column, kind: Column, project: Column) -> Column:
    """Category of a symbol: the first rule that fits."""
    test = {"name": lambda x: name.endswith(x), "namespace": lambda x: namespace.contains(x), "kind": lambda x: kind == x, "project": lambda x: project.contains(x)}
    out = F.lit("unknown")
    for value, rule in reversed(CATEGORIES):
        out = F.when(reduce(or_, [test[where](x) for where, xs in rule.items() for x in xs]), value).otherwise(out)
    return out


def language(path: Column) -> Column:
    """Language of a path by its extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in (
        ("typescript", ("ts", "tsx")), ("javascript", ("js", "jsx")), ("csharp", ("cs",)), ("python", ("py",)), ("go", ("go",)), ("rust", ("rs",)),
        ("java", ("java",)), ("markdown", ("md",))
    ):
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def code_units(text: Column) -> Column:
    """A sort key that orders strings by UTF-16 code units, which differs from code points beyond U+FFFF."""
    return F.encode(text, "UTF-16BE")

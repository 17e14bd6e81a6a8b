"""Code seen by its tokens: strings, comments and templates masked, brackets counted, offsets turned into lines and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ESCAPED = r"\\[\s\S]"
_SINGLE, _DOUBLE = (rf"{q}(?:{_ESCAPED}|[^{q}\\\n])*+{q}?" for q in "'\"")
_STRING = f"(?:{_SINGLE}|{_DOUBLE})"
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
#: A pattern between slashes, where a value may begin and so no division is meant.
_REGEX = r"(?<=[=(,:\[!&|?{};\n][ \t]{0,8})/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*+"
#: A string that names a module stays.
_SPECIFIER = rf"(?<=(?:from|import)[ \t\r\n]{{0,40}}){_STRING}"
#: Templates within templates that are told apart.
NESTED = 3


def _template(levels: int) -> str:
    """A template with its ${...} parts; every loop is possessive, so long ones take no stack."""
    hole = ""
    if levels:
        inside = rf"{_STRING}|{_template(levels - 1)}|\{{(?:{_STRING}|[^{{}}`'\"])*+\}}|[^{{}}`'\"]"
        hole = rf"\$\{{(?:{inside})*+\}}|"
    return rf"`(?:{_ESCAPED}|{hole}[^`\\])*+`?"


#: Each match is one stretch of text and the matches are all of it. Group 1: what is masked. What looks behind is tried only where a string or a slash begins.
_TOKEN = rf"[^/'\"`]++|({_COMMENT}|{_template(NESTED)}|(?=['\"])(?!{_SPECIFIER}){_STRING}|(?=/){_REGEX})|{_STRING}|/"
_LINE = r"[^\n\r\u2028\u2029]*+(?:\r\n|[\n\r\u2028\u2029])|[^\n\r\u2028\u2029]++"
_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_HEAD = r"(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|type|enum|function|const|let|var)(?:\s*\*\s*|\s+)"
#: Declarations with the name at the end of the match; further names of a variable statement; statement ends and brackets.
_EVENT = rf"(?<![\p{{L}}\p{{N}}_$.]){_HEAD}({_NAME})|,\s*({_NAME})(?=\s*(?:[=:,;!]|\z))|([;(){{}}\[\]])"
_VARIABLES = ("const", "let", "var")


def masked(text: Column) -> Column:
    """text with comments, templates, patterns and strings blanked, but for those that name modules; every other character and every line stays where it is."""
    every, hidden = (F.regexp_extract_all(text, F.lit(_TOKEN), k) for k in (0, 1))
    return F.array_join(F.zip_with(every, hidden, lambda t, h: F.when(h != "", F.regexp_replace(t, "[^\n\r\u2028\u2029]", " ")).otherwise(t)), "")


def units(text: Column) -> Column:
    """Length in UTF-16 code units, as editors and compilers count columns."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def found(files: DataFrame, pattern: str, groups: dict[str, int], column: str = "text") -> DataFrame:
    """(path, ord, at, stop, groups...): the matches of a pattern with their offsets (characters, from 0), by running sums of what lies between and in them."""
    whole = F.regexp_extract_all(column, F.lit(f"({pattern})"), 1)
    between = F.split(column, f"(?:{pattern})", -1)
    named = [F.regexp_extract_all(column, F.lit(pattern), k).alias(n) for n, k in groups.items()]
    rows = files.select("path", F.posexplode(F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("_b"), whole.alias("_w"), *named)).alias("ord", "m"))
    width, gap = F.length("m._w"), F.length("m._b")
    upto = F.sum(width + gap).over(Window.partitionBy("path").orderBy("ord"))
    return rows.select("path", "ord", (upto - width).cast("long").alias("at"), upto.cast("long").alias("stop"), *[F.col(f"m.{n}").alias(n) for n in groups])


def line_index(files: DataFrame) -> DataFrame:
    """(path, line, begin, content): lines from 1 with the offset of their first character; prefix sums of the lines' lengths."""
    rows = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_LINE})"), 1)).alias("n", "content"))
    before = F.sum(F.length("content")).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("path", (F.col("n") + 1).cast("long").alias("line"), F.coalesce(before, F.lit(0)).cast("long").alias("begin"), "content")


def located(rows: DataFrame, files: DataFrame, at: str = "at") -> DataFrame:
    """rows (path, an offset, ...) with line and column from 1, the column in UTF-16 code units. An offset at the end of a text that ends in a line break is on the line after it.

    Lines and offsets of a path are merged by offset, each offset takes the last line that begins at or before it: no pair of a line and an offset is made that is not a result.
    """
    lines = line_index(files.join(rows.select("path").distinct(), "path", "left_semi")).select("path", F.col("begin").alias("_at"), F.struct("line", "begin", "content").alias("_line"))
    hits = rows.select("path", F.col(at).alias("_at"), F.struct(*rows.columns).alias("_row"))
    last = F.last("_line", ignorenulls=True).over(Window.partitionBy("path").orderBy("_at", F.col("_line").isNull()))
    both = lines.unionByName(hits, allowMissingColumns=True).withColumn("_seen", last).where("_row is not null")
    inside = F.col("_at") - F.col("_seen.begin")
    ended = F.col("_seen").isNotNull() & (inside >= F.length("_seen.content")) & F.col("_seen.content").rlike("[\n\r\u2028\u2029]\\z")
    line = F.when(F.col("_seen").isNull(), 1).when(ended, F.col("_seen.line") + 1).otherwise(F.col("_seen.line"))
    column = F.when(F.col("_seen").isNull() | ended, 1).otherwise(units(F.substring(F.col("_seen.content"), F.lit(1), inside.cast("int"))) + 1)
    return both.select("_row.*", line.cast("long").alias("line"), column.cast("long").alias("column"))


def declarations(files: DataFrame) -> DataFrame:
    """(path, name, word, exported, is_default, at): declarations of source files (path, text) that stand in no bracket, with the offset of the name.

    What comments, strings, templates and patterns hold declares nothing, nor does what is declared in functions, classes, namespaces and blocks. A variable statement declares each of its
    names. Declarations, commas, statement ends and brackets of a file are rows in order of offset; the depth is a running sum over them, all of one shuffle by path.
    """
    code = files.select("path", masked(F.col("text")).alias("text"))
    rows = found(code, _EVENT, {"exported": 1, "default": 2, "word": 3, "name": 4, "further": 5, "mark": 6})
    in_order = Window.partitionBy("path").orderBy("ord")
    step = F.when(F.col("mark").isin("(", "{", "["), 1).when(F.col("mark").isin(")", "}", "]"), -1).otherwise(0)
    top = rows.withColumn("depth", F.sum(step).over(in_order)).where((F.col("depth") == 0) & (F.col("mark").isin("", ";")))
    # a further name belongs to the statement that began last and has not ended
    statement = F.when(F.col("further") == "", F.struct("word", (F.col("exported") != "").alias("exported")))
    top = top.withColumn("of", F.last(statement, ignorenulls=True).over(in_order))
    name = F.when(F.col("further") != "", F.col("further")).otherwise(F.col("name"))
    kept = top.where((F.col("name") != "") | ((F.col("further") != "") & F.col("of.word").isin(*_VARIABLES)))
    return kept.select(
        "path", name.alias("name"), F.col("of.word").alias("word"), F.col("of.exported").alias("exported"), (F.col("default") != "").alias("is_default"),
        (F.col("stop") - F.length(name)).alias("at")
    )


def positions(files: DataFrame) -> DataFrame:
    """declarations() with the line and column of each name."""
    return located(declarations(files), files)

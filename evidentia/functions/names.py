"""Caseless keys of file names, and whether two names collide on some file system. All of it runs in the JVM: Spark brings ICU, whose static methods the SQL function reflect() calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the key rules.
#: Characters that are ignored by default, as ranges of the Unicode property.
IGNORABLE = (
    r"[\x{ad}\x{34f}\x{61c}\x{115f}-\x{1160}\x{17b4}-\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}"
    r"\x{ffa0}\x{fff0}-\x{fff8}\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}]"
)
#: Foldings that Unicode 17 adds to those of ICU's version: (first, last, distance to the folded character, step).
ADDED = ((0xA7CE, 0xA7CE, 1, 1), (0xA7D2, 0xA7D4, 1, 2), (0x16EA0, 0x16EB8, 0x1B, 1))
#: The file-system model folds and ignores what Unicode 12 had; later characters stay.
MODEL_AGE = 12
MODEL_IGNORABLE = IGNORABLE.replace(r"\x{180f}", r"\x{180e}")

_ICU = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def decomposed(text: Column) -> Column:
    """Canonical decomposition (NFD) of a text, null for null."""
    return F.when(text.isNotNull(), F.reflect(F.lit(_ICU[0]), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(False)))


def composed(text: Column) -> Column:
    """Canonical composition (NFC) of a text, null for null."""
    return F.when(text.isNotNull(), F.reflect(F.lit(_ICU[0]), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def _folded(text: Column) -> Column:
    """Full case folding, character by character, without a locale."""
    added = [(chr(c), chr(c + by)) for first, last, by, step in ADDED for c in range(first, last + 1, step)]
    known = F.reflect(F.lit(_ICU[1]), F.lit("foldCase"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.translate(known, "".join(a for a, _ in added), "".join(b for _, b in added))


def _finished(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\u0131"), F.lit("i")), F.lit("\u0307"), F.lit(""))
    return decomposed(F.rtrim(F.regexp_replace(plain, IGNORABLE, ""), F.lit(" .")))


def name_key(name: Column) -> Column:
    """Canonical caseless key: full case folding of the decomposed name, then dots above, ignorables and trailing dots and spaces go. Null for null."""
    return F.when(name.isNotNull(), _finished(decomposed(_folded(decomposed(name)))))


def model_characters(name: Column) -> Column:
    """What a file system with fixed tables compares: each character decomposed and folded by itself, ignorable ones dropped, then marks put in order.

    Unlike name_key() it does not order marks before it folds, so a mark that folds to a letter stays where it is written.
    """
    age = lambda c: F.substring_index(F.reflect(F.lit(_ICU[1]), F.lit("getAge"), F.ascii(c)), ".", 1).cast("int")  # noqa: E731  # ascii() is a code point; 0 is of no version
    apart = lambda c: F.concat(F.lit("\0"), c, F.lit("\0"))  # noqa: E731  # no file name holds a zero
    one = lambda c: F.when(c.rlike("^[ -@\\[-~]$"), c).when(~age(c).between(1, MODEL_AGE), apart(c)).otherwise(decomposed(_folded(decomposed(c))))
    in_order = lambda piece, n: F.when(n % 2 == 1, piece).otherwise(decomposed(piece))
    # ignorable and later characters part the marks beside them, so each stretch between two of them is put in order by itself
    stretch = lambda s: F.array_join(F.transform(F.split(F.array_join(F.transform(F.split(s, ""), one), ""), "\\x00"), in_order), "")
    return F.array_join(F.transform(F.split(name, MODEL_IGNORABLE), stretch), "")


def model_key(name: Column) -> Column:
    """model_characters() without dots above and trailing dots and spaces. Null for null."""
    return F.when(name.isNotNull(), _finished(model_characters(name)))


def collide(a: Column, b: Column) -> Column:
    """Either key equal. The relation is not transitive, so names are never put into one group by both keys. Null names collide with nothing."""
    return F.coalesce((name_key(a) == name_key(b)) | (model_key(a) == model_key(b)), F.lit(False))


def collisions(names: DataFrame) -> DataFrame:
    """(kind, key, names): groups of different names with an equal key of one kind. Names are made distinct first, and each group is a count, combined before the shuffle."""
    once = names.where("name is not null").select("name").distinct()
    keyed = once.select("name", name_key(F.col("name")).alias("full"), model_key(F.col("name")).alias("simple"))
    tall = keyed.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key")) for kind in ("full", "simple")])))
    return tall.groupBy("kind", "key").agg(F.count("*").alias("names")).where("names > 1")


def protected_in(excluded: list[str]):
    """Maker of a column: whether a path is one of the excluded ones or below one, whatever the case and composition of its letters. False for null."""

    def judged(path: Column) -> Column:
        key = F.lower(composed(path))
        bases = [F.lower(composed(F.lit(e))) for e in excluded]
        hit = F.exists(F.array(*bases), lambda b: (key == b) | F.startswith(key, F.concat(b, F.lit("/")))) if bases else F.lit(False)
        return F.coalesce(hit, F.lit(False))

    return judged


def crossing(boundaries: list[str]):
    """Maker of a column: whether a path is at or below a boundary, where each of the boundary's parts collides with the path's part at its place. False for null."""

    def judged(path: Column) -> Column:
        keys = lambda of: F.transform(F.split(of, "/"), lambda part: F.struct(name_key(part).alias("full"), model_key(part).alias("simple")))
        same = lambda pair: (pair["p"]["full"] == pair["b"]["full"]) | (pair["p"]["simple"] == pair["b"]["simple"])
        hit = F.lit(False)
        for boundary in boundaries:
            depth = boundary.count("/") + 1
            pairs = F.arrays_zip(F.slice(keys(path), 1, depth).alias("p"), keys(F.lit(boundary)).alias("b"))
            hit = hit | F.coalesce(F.forall(pairs, lambda pair: F.coalesce(same(pair), F.lit(False))), F.lit(False))
        return hit

    return judged


def characters(spark: SparkSession) -> DataFrame:
    """(code_point, char): every character there is, surrogates left out."""
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.col("id").cast("int").alias("code_point"))
    return points.withColumn("char", F.decode(F.unhex(F.lpad(F.hex("code_point"), 8, "0")), "UTF-32"))


def folding_table(spark: SparkSession) -> DataFrame:
    """(code_point, folded, simple) of all characters of which a key differs from themselves."""
    keyed = characters(spark).select("code_point", "char", name_key(F.col("char")).alias("folded"), model_key(F.col("char")).alias("simple"))
    return keyed.where("folded <> char or simple <> char").drop("char")

"""Words and word shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE

BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text; an empty array for a text without any."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def shingles(word: Column, size: int) -> Column:
    """Space-joined shingles of an array of words; of fewer words the whole sequence; none of no words."""
    many = F.transform(F.sequence(F.lit(1), F.size(word) - (size - 1)), lambda i: F.array_join(F.slice(word, i, size), " "))
    return F.when(F.size(word) >= size, many).when(F.size(word) > 0, F.array(F.array_join(word, " "))).otherwise(F.array().cast("array<string>"))


def hashed(word_hash: Column, size: int) -> Column:
    """64-bit hashes of shingles, from the hashes of the words; of fewer words the hash of the whole sequence."""
    many = F.transform(F.sequence(F.lit(0), F.size(word_hash) - size), lambda i: F.xxhash64(*[F.get(word_hash, i + k) for k in range(size)]))
    whole = F.array(F.xxhash64(*[F.get(word_hash, F.lit(k)) for k in range(size - 1)]))
    return F.when(F.size(word_hash) >= size, many).when(F.size(word_hash) > 0, whole).otherwise(F.array().cast("array<bigint>"))

"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, word_tokenizer
from .common import given_back, in_batches, slices, text_or_empty

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Per document the UTF-8 bytes, the tokens and whether they exceed `limit`.

    docs: doc_id long, text string; further columns are neither read nor returned. A null text counts as empty (0, 0, false);
    a null doc_id stays null; repeated rows give repeated results. One narrow pass without a shuffle: a Python worker
    holds one Arrow batch, the words of a megabyte of it and a bounded word cache. Special strings inside a text are one token each, as the library has it.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").to_pylist()
            n = pa.array([len(ids) // 4 for ids in words.encode(texts)], pa.int64())
            sizes = pa.compute.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        words.forget()

    import pyarrow.compute  # noqa: F401  pa.compute is bound by this import

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return in_batches(rows).mapInArrow(given_back(count), COUNTS)

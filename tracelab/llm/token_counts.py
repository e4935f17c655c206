"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, small

#: Words whose piece counts a worker keeps.
KEPT_WORDS = 400_000


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> WordTable:
    """The table of piece counts of a tokenizer file, one for each worker."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def compute(words: list[str]) -> np.ndarray:
        counts = np.zeros(len(words), np.int64)
        for i in range(0, len(words), 2000):
            part = own.encode(words[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            at = [x for x in part.word_ids if x is not None]
            counts[i : i + 2000] = np.bincount(at, minlength=len(words[i : i + 2000]))
        return counts

    return WordTable(compute, 1, KEPT_WORDS)


def words_of(text: str) -> list[str]:
    """Pre-tokens at the white space that every tokenizer of this kind drops: space and line feed."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    For tokenizers that drop white space and never join pieces over it (BPE with word ends). Then the number of pieces of
    a text is the sum, over its distinct pre-tokens, of frequency times pieces of the pre-token. Each block of documents
    (an Arrow batch) takes the distinct pre-tokens of its documents, counts the pieces of those that its worker hasn't met
    yet, once each and with the tokenizer's own library, joins the counts to the documents' frequencies by a hash lookup and
    sums. No ids of a document are made, and nothing is shuffled: a shuffle of (document, pre-token) pairs would move more
    bytes than the texts have.

    A null text counts as empty: 0 bytes and tokens. Null and repeated ids pass through, a row in gives a row out. Special
    strings inside a text count as the library's default does. Other columns are not carried.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(tokenizer)
        for batch in small(batches, 1000):
            texts = batch.column(1).to_pylist()
            tokens = pieces.sums([Counter(words_of(t)) for t in texts])[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )

"""Token counts with a whole-token shortcut.

Once for each worker, every string of the vocabulary is encoded alone; those that come back as one token are proven. A
text is cut at spaces, which no piece of the vocabulary spans; a cut that is a proven string counts one, and only the
others go through the merges, each distinct one once.

Rows: a null text is empty (no tokens). Repeated rows each get their count; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from turnframe.llm.chunks import piece_counts

VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
TEXTS = 500


def token_count(text: Column, path: str) -> Column:
    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for i in range(0, len(s), TEXTS):
                out += piece_counts([t or "" for t in s.iloc[i : i + TEXTS]], path)
            yield pd.Series(out, dtype="int64")

    return count(text)


def with_token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    import public_tokenizers

    text = F.coalesce("text", F.lit(""))
    counted = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path or public_tokenizers.path(VOCABULARY)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(documents: DataFrame) -> DataFrame:
    return with_token_counts(documents)

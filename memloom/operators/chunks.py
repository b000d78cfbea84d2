"""Texts cut into chunks of bounded cost at the best boundary: paragraphs, then sentences, then size."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

_PARTS = re.compile(r"[^\n]*\n+|[^\n]+$")
_SENTENCES = re.compile(r".+?(?:[.!?]\s+|[。！？]|$)", re.S)


def pieces(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(start, piece) of consecutive pieces with at most `most` characters that together are the text."""
    at = 0
    while at < len(text):
        end = at
        for pattern in (_PARTS, _SENTENCES):
            while end < len(text):
                m = pattern.match(text, end, min(len(text), at + most + 1))
                if not m or m.end() - at > most or m.end() == end:
                    break
                end = m.end()
            if end > at:
                break
        end = end if end > at else min(len(text), at + most)
        yield at, text[at:end]
        at = end


def chunks(df: DataFrame, key: str, text: str, tokens: int) -> DataFrame:
    """Rows (key, chunk_no, start, chunk): a text's chunks in order; put together they are the text. A token counts as four characters.

    Null and empty texts have no chunks; a text of any length is cut whole.
    """
    most = 4 * tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, at, piece) for k, t in zip(batch[key], batch[text], strict=True) for i, (at, piece) in enumerate(pieces(t, most))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "start", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, chunk_no int, start int, chunk string")

"""Encoding and decoding a table of texts.

One pass of mapInPandas: batches are read in portions bounded by rows, each row is a text of its own, and a
worker keeps one encoder with a bounded cache. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.bpe import Decoder, Encoder, decode_text
from colscope.llm.common import documents, filled, whole_text

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Ids that the decoder takes at a time.
PORTION = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def portions(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in lists of about so many characters, so that the words of a whole batch are never held at once."""
    some: list[str | None] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_texts(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = WORD_BPE) -> DataFrame:
    """df with a column of token ids (array of int); null and empty texts have an empty array."""
    kept = [c for c in df.columns]
    if ids_col.lower() in {c.lower() for c in kept}:
        raise ValueError(f"the table has a column {ids_col}")

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        tool = encoder(path)
        return pd.Series([np.frombuffer(tool.encode(t), np.uint32).astype(np.int32) for t in texts], dtype=object)

    return df.withColumn(ids_col, ids_of(whole_text(text_col)))


def decode_ids(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str = WORD_BPE, form: str = "text") -> DataFrame:
    """df with the text of a column of ids; null and empty arrays give the empty text."""
    if text_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {text_col}")

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        tool = Decoder(encoder(path).v, form)
        return pd.Series(["" if r is None else "".join(decode_text(tool, (r[i: i + PORTION].tolist() for i in range(0, len(r), PORTION))))
                          for r in rows], dtype=object)

    return df.withColumn(text_col, text_of(F.col(ids_col)))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; other columns are not read."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path)
        back = Decoder(tool.v, "tokens")
        for batch in filled(batches):
            counts, of_ids, of_text = [], [], []
            for text in batch["text"]:
                packed = np.frombuffer(tool.encode(text), np.uint32)
                counts.append(len(packed))
                of_ids.append(hashlib.sha256(packed.astype("<u4")).hexdigest())
                digest = hashlib.sha256()
                back.restart()
                for at in range(0, len(packed), PORTION):
                    digest.update(back.feed(packed[at: at + PORTION].tolist()))
                of_text.append(digest.hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text})

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return slim.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, folder: str) -> DataFrame:
    return round_trip(documents(spark, folder))

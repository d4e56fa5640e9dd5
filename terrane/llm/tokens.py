"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.bpe import SPLIT, encoder
from terrane.session import spread

#: Where the vocabularies of public tokenizers lie, if not told otherwise.
VOCABULARIES = os.environ.get("TERRANE_TOKENIZERS", "/opt/tokenizers")
#: Code points of text that a worker encodes before it hands the ids on.
CHUNK = 2_000_000


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK code points, a single longer text being a run of its own."""
    start = size = 0
    for i, n in enumerate(texts.to_pylist() if pa.types.is_integer(texts.type) else []):
        if size and size + (n or 0) > CHUNK:
            yield start, i
            start, size = i, 0
        size += n or 0
    yield start, len(texts)


def encoded(docs: DataFrame, key: str, text: str, path: str | None = None, split: str = SPLIT, ids: bool = True) -> DataFrame:
    """(key, ids array<bigint>) of each row, or with ids=False (key, n_tokens bigint), the texts being read whole.

    Ids are exactly those of the vocabulary's own merges, without special tokens: a text that spells a special token is
    ordinary text. Null and empty texts have no ids (an empty list, 0 tokens). One row comes out for each row that goes
    in, so repeated rows are repeated and an empty table gives none. No row is shuffled, but
    for a table of fewer splits than the cluster can work on. The vocabulary (packed, about
    0.6 MB whatever the corpus) is read by the driver and broadcast, so executors need no file of it.
    """
    spark = docs.sparkSession
    with open(path or vocabulary(), "rb") as f:
        sent = spark.sparkContext.broadcast(zlib.compress(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        own = encoder(sent.value, split)
        for batch in batches:
            texts, names = batch.column(1), batch.column(0)
            for start, end in _chunks(pc.utf8_length(texts)):
                lists = [own.encode(x) for x in texts[start:end].to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                if ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    flat = np.fromiter((i for x in lists for i in x), np.int64, int(ends[-1]))
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                else:
                    out = pa.array(sizes)
                yield pa.RecordBatch.from_arrays([names[start:end], out], names=[key, "ids" if ids else "n_tokens"])

    kind = T.StructField("ids", T.ArrayType(T.LongType())) if ids else T.StructField("n_tokens", T.LongType())
    chosen = docs.select(F.col(key), F.col(text).alias("__text"))
    chosen = spread(chosen, key, "__text")
    return chosen.mapInArrow(run, T.StructType([T.StructField(key, chosen.schema[0].dataType), kind]))

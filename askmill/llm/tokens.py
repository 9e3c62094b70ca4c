"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; a parameter of every operator that measures texts.
TOKENIZER = os.environ.get("ASKMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a file: tiktoken ranks, a tokenizers JSON or a sentencepiece model; once per worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]


def count_tokens(df: DataFrame, tokenizer: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """(id, tokens) of (id, text), with the columns to ``keep``; NULL and empty texts have 0."""
    keep, types = keep or [], dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace").decode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(count(texts), pa.int32())], ["id", *keep, "tokens"])

    return df.select(F.col("id").cast("bigint"), "text", *keep).mapInArrow(run, ", ".join(["id bigint", *(f"{c} {types[c]}" for c in keep), "tokens int"]))

"""Existing tokenizers from their files, for the workers: loaded once a process, called on whole Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import as_col


@lru_cache(8)
def _load(path: str):
    """(ids of texts, pieces of texts, text of ids) of a tokenizers (.json) or sentencepiece (.model) file."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        encode = lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]
        pieces = lambda xs: [e.tokens for e in t.encode_batch(xs, add_special_tokens=False)]
        return encode, pieces, lambda ids: t.decode_batch(ids, skip_special_tokens=False)
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda xs: m.encode(xs, num_threads=1), lambda xs: m.encode(xs, out_type=str, num_threads=1), lambda ids: m.decode(ids, num_threads=1)
    raise ValueError(f"no tokenizer for {path}")


class FileTokenizer:
    """Ids of a text; only the path travels to the workers, which read the file themselves."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> list[int]:
        return _load(self.path)[0]([text])[0]


def token_ids(c: str | Column, path: str) -> Column:
    """array<int>, null texts as no tokens."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_load(path)[0]([t or "" for t in s]), dtype=object)

    return run(as_col(c))


def encoded(c: str | Column, path: str) -> Column:
    """struct<pieces array<string>, decoded string>, as tokenizer metrics want it."""

    @F.pandas_udf("pieces array<string>, decoded string")
    def run(s: pd.Series) -> pd.DataFrame:
        ids, pieces, text = _load(path)
        texts = [t or "" for t in s]
        return pd.DataFrame({"pieces": pd.Series(pieces(texts), dtype=object), "decoded": text(ids(texts))})

    return run(as_col(c))

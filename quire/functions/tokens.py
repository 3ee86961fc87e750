"""Token counts by files of public tokenizers; the path is a parameter and the file is read by the executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(path: str) -> Callable[[list[str]], list[int]]:
    """A counter of tokens without special ones. Kinds by suffix: .json (tokenizers), .model (sentencepiece)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer for {path}")


def model_tokens(path: str) -> Callable[[Column], Column]:
    """A column function for textstats.token_stats; null counts as 0, and so does a text that can't be encoded."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        global _COUNTERS
        try:
            counters = _COUNTERS
        except NameError:
            counters = _COUNTERS = {}
        if path not in counters:
            counters[path] = load(path)
        values = [t if isinstance(t, str) else "" for t in texts]
        try:
            return pd.Series(counters[path](values), dtype="int64")
        except Exception:
            out = []
            for v in values:
                try:
                    out.append(counters[path]([v])[0])
                except Exception:
                    out.append(0)
            return pd.Series(out, dtype="int64")

    return count

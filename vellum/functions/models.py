"""Pluggable model seams with deterministic offline forms: an embedder and a passage scorer."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(1 << 18)
def _place(word: str, dim: int) -> tuple[int, float]:
    """Dimension and sign of a word, from its MD5: the same in every engine."""
    digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:6], 16) % dim, 1.0 if digest[6] in "01234567" else -1.0


def embedder(dim: int = 64):
    """A pandas UDF text -> unit vector: hashed bag of words. Texts without words give the zero vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in (text or "").lower().split():
                at, sign = _place(word, dim)
                v[at] += sign
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)

    return embed


@F.pandas_udf(T.DoubleType())
def overlap_score(questions: pd.Series, passages: pd.Series) -> pd.Series:
    """A score in [0, 1): share of the question's words that the passage holds."""
    out = []
    for q, p in zip(questions, passages):
        a, b = set((q or "").lower().split()), set((p or "").lower().split())
        out.append(len(a & b) / (len(a) + 1.0) if a else 0.0)
    return pd.Series(out)

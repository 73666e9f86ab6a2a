"""Scoring texts by a model that takes batches of token windows; the model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

from . import series as S

#: Makes, once in each Python worker, a function from a batch of windows (lists of tokens) to rows of scores.
Scorer = Callable[[], Callable[[list[list]], np.ndarray]]


def gated(texts: DataFrame, text: str = "text", letters: str = X.HEBREW, least: float = 0.5) -> DataFrame:
    """texts with `share`, the share of their letters that are of the class `letters`, and whether they are `scored`.

    Texts with a share under `least` are left out; null texts and texts without letters have a share of 0.
    """
    shared = texts.withColumn("share", F.coalesce(X.letter_share(F.col(text), letters), F.lit(0.0)))
    return shared.withColumn("scored", F.col("share") >= least)


def language_gate(texts: DataFrame, text: str = "text", letters: str = X.HEBREW, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(texts to be scored, texts left out) of `gated`, both with `share`."""
    shared = gated(texts, text, letters, least)
    return shared.where("scored").drop("scored"), shared.where("NOT scored").drop("scored")


def score_windows(
    texts: DataFrame, scorer: Scorer, names: Sequence[str], key: str = "uri", tokens: str = "tokens", size: int = 510, stride: int = 255, batch: int = 32,
) -> DataFrame:
    """(key, window, n_tokens, names): scores of each text's windows, `batch` windows to a call of the model."""
    wins = texts.select(key, F.posexplode(X.windows(F.col(tokens), size, stride)).alias("window", "ids"))
    schema = texts.select(key).schema.add("window", "integer").add("n_tokens", "integer")
    for name in names:
        schema = schema.add(name, "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in frames:
            ids = [list(x) for x in pdf["ids"]]
            scores = [np.asarray(model(ids[i : i + batch]), float).reshape(-1, len(names)) for i in range(0, len(ids), batch)]
            out = pd.DataFrame(np.concatenate(scores) if scores else np.zeros((0, len(names))), columns=list(names))
            out.insert(0, "n_tokens", [len(x) for x in ids])
            out.insert(0, "window", pdf["window"].to_numpy())
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return wins.mapInPandas(run, schema)


def score_texts(texts: DataFrame, scorer: Scorer, names: Sequence[str], key: str = "uri", **windows) -> DataFrame:
    """(key, n_windows, names): each text's scores, the means of its windows' weighted by their lengths."""
    return S.window_scores(score_windows(texts, scorer, names, key, **windows), names, key)

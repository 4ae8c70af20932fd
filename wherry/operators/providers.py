"""Models from outside as batch functions: text encoders, translators, recognisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What a task asks of a model: one value per text, or an exception."""

    def __call__(self, texts: list[str]) -> list: ...


def provided(rows: DataFrame, make: Callable[[], Provider], kind: str, text_col: str = "text", out: str = "value", batch: int = 64) -> DataFrame:
    """``rows`` with ``out`` (of Spark type ``kind``) and ``error``; ``make`` loads the model once a task.

    Null texts have a null value. A batch that fails is tried text by text, so one bad text is
    one row with an error and a null value.
    """

    def each(model: Provider, texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in model(texts)]
        except Exception as e:  # noqa: BLE001  a text that a model refuses must not end the job
            if len(texts) > 1:
                return [x for t in texts for x in each(model, [t])]
            return [(None, f"{type(e).__name__}: {e}")]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for s in parts:
            known = s[s.notna()]
            done = [x for at in range(0, len(known), batch) for x in each(model, known.iloc[at : at + batch].tolist())]
            found = pd.DataFrame(done, columns=["value", "error"], index=known.index, dtype=object)
            yield found.reindex(s.index).astype(object).where(lambda x: x.notna(), None)

    made = F.pandas_udf(run, f"value {kind}, error string")(F.col(text_col))
    return rows.withColumn("__made", made).withColumns({out: F.col("__made.value"), "error": F.col("__made.error")}).drop("__made")


class ShapeEncoder:
    """A deterministic stand-in for a text encoder: counts of characters, blanks and three letters."""

    LETTERS = ("a", "e", "t")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), *(float(t.count(x)) for x in self.LETTERS)] for t in texts]


class LetterEncoder:
    """A deterministic stand-in that texts of one language are near by: how often each of a to z stands in the text."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]

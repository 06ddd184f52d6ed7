"""Calls to what lies outside Spark, such as a translator or a model, over partitions of rows.

A plug-in is made once in each task and gets lists of texts.  Rows pass through with the answer and,
where there is none, the reason, so one bad row or a service that is down loses no data and stops no
job; a later run can take the rows whose answer is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T

#: Makes a function from texts to answers, one each; it may raise.
Plugin = Callable[[], Callable[[list[str]], list[str | None]]]


def call(df: DataFrame, make: Plugin, text: str, answer: str = "answer", failure: str = "failure", batch: int = 64) -> DataFrame:
    """``df`` with the columns ``answer`` and ``failure`` of the texts in the column ``text``.

    Null texts are not sent.  A batch that fails is sent again text by text, so only those that fail
    by themselves have a failure: what was raised, or that the number of answers is wrong.
    """
    none = F.lit(None).cast("string")
    form = df.select("*", none.alias(answer), none.alias(failure)).schema

    def ask(ready, texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = list(ready(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [(x, None if x is not None else "no answer") for x in got]
        except Exception as e:  # whatever a plug-in raises is an answer that is missing
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [ask(ready, [t])[0] for t in texts]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, broken = None, None
        for frame in frames:
            texts = frame[text].tolist()
            sent = [k for k, t in enumerate(texts) if t is not None]
            made: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
            if sent and ready is None and broken is None:
                try:
                    ready = make()
                except Exception as e:
                    broken = f"{type(e).__name__}: {e}"
            for k in range(0, len(sent), batch):
                part = sent[k : k + batch]
                answers = [(None, broken)] * len(part) if broken else ask(ready, [texts[i] for i in part])
                for i, a in zip(part, answers, strict=True):
                    made[i] = a
            columns = {answer: [a for a, _ in made], failure: [f for _, f in made]}
            yield frame.assign(**{k: pd.Series(v, index=frame.index, dtype=object) for k, v in columns.items()})

    return df.mapInPandas(task, form)


def translate(docs: DataFrame, make: Plugin, key: str = "tender_id", text: str = "text", most: int = 4000, batch: int = 64) -> DataFrame:
    """Texts that are not English, in English: key, english, failure.

    Pieces of at most ``most`` characters are rows of their own, so a long text is spread over tasks; a
    text with a piece that failed has no translation, and the first failure.
    """
    foreign = docs.filter(T.language(T.devanagari_ratio(F.coalesce(text, F.lit("")))) != "en")
    pieces = foreign.select(key, F.posexplode(T.chunks(F.col(text), most)).alias("pos", "piece"))
    asked = call(pieces.repartition(key, "pos"), make, "piece", batch=batch)
    rows = F.sort_array(F.collect_list(F.struct("pos", "answer")))  # the pieces of one text
    done = asked.groupBy(key).agg(
        F.count_if(F.col("answer").isNull()).alias("lost"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("pos"))).alias("failure"),
        F.array_join(F.transform(rows, lambda r: r["answer"]), "\n").alias("english"))
    return done.select(key, F.when(F.col("lost") == 0, F.col("english")).alias("english"), "failure")

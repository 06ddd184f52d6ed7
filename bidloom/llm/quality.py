"""Quality rules as weak supervision.

Every rule votes good, bad or abstains.  Expectation-maximisation over the histogram of vote
patterns (at most 3**rules rows, whatever the corpus size) estimates how accurate each rule is,
and the posterior probability of good quality decides, instead of "all rules must pass".

All work on texts is JVM expressions; the histogram is one partial aggregation, and the scores
come back by a broadcast of the pattern table, whose size the number of rules bounds.

Defined edge cases: a null or empty text has no words and fails the base rules; repeated rows and
ids are judged row by row; a posterior equal to the threshold keeps, and patterns with equal votes
share one; very long texts are read whole, in time linear in their words, and no rule counts
length against them; columns other than the two named are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import materialise, whole_row

#: name, SQL for "bad", SQL for "good"; neither: abstain.  Over the columns of ``features``.
RULES = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("shouting", "2 * n_shouted > n_words", "10 * n_shouted < n_words"),
    ("dup_lines", "n_dup_lines > 5 and 2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
    ("repeats", "100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words <= 25 * n_words"),
    # The share of distinct words falls with length, about as its root (Heaps), so long texts are held against that.
    ("vocabulary", "5 * n_distinct < n_words and n_distinct * n_distinct < 36 * n_words",
     "4 * n_distinct > n_words or n_distinct * n_distinct > 64 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words",
     "word_chars between 3 * n_words and 11 * n_words"),
]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts that the rules read, one row per input row; ``kept_row`` carries columns along."""
    carried = [whole_row(keep, "kept_row")] if keep else []
    names = ["kept_row"] if keep else []
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *carried)
    out = out.select(
        "doc_id", *names, "t",
        F.btrim("t", F.lit(" \t\n\x0b\x0c\r")).alias("b"),
        F.expr(r"split(t, '\n')").alias("l"),
    )
    out = out.select(
        "doc_id", *names, "t",
        F.expr(r"if(b = '', cast(array() as array<string>), split(b, '[\\x20\\x09-\\x0D]+'))").alias("w"),
        F.expr(r"filter(l, x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    out = out.withColumn(
        "h",
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), "
               "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"),
    )
    out = out.withColumn(
        "o", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<bigint>), sort_array(h))")
    )
    out = out.withColumn("d", F.expr("array_distinct(filter(o, (x, j) -> j > 0 and get(o, j - 1) = x))"))
    # Places of repeated windows: few distinct ones are looked up; many would make that quadratic,
    # so there pairs of hash and place are sorted, which is n log n for any text.
    out = out.withColumn(
        "s",
        F.expr("if(size(d) <= 24, cast(array() as array<struct<h: bigint, i: int>>), "
               "sort_array(transform(h, (x, i) -> struct(x as h, i as i))))"),
    )
    out = out.withColumn(
        "p",
        F.expr("case when size(d) = 0 then cast(array() as array<int>) when size(d) <= 24 "
               "then filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i])) "
               "else sort_array(transform(filter(s, (x, j) -> get(s, j - 1).h <=> x.h or get(s, j + 1).h <=> x.h), "
               "x -> x.i)) end"),
    )
    return out.select(
        "doc_id", *names,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(p, struct(0L as n, -3 as last), (a, x) -> struct("
               "a.n + least(3, x - a.last) as n, x as last)).n").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.expr(r"cast(regexp_count(t, '\\p{Lu}\\p{Lu}+') as bigint)").alias("n_shouted"),
    )


def _votes(rules):
    return [
        F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}")
        for name, bad, good in rules
    ]


def fit(histogram: list[tuple[tuple[int, ...], int]], rounds: int = 200,
        max_false_alarm: float = 0.002) -> dict:
    """EM over (pattern, count): how often a rule that votes says "bad", by class.

    Votes are independent given the class; abstaining says nothing.  Rules are written to be
    precise, so on good documents a rule may say "bad" at most ``max_false_alarm`` of the time;
    without this bound the two classes can settle on long and short texts.  How often it says
    "bad" on bad documents is free: families of junk trip one rule each, so agreement of the
    others is weak evidence, and the estimates find that.
    """
    if not histogram:
        return {"posterior": np.zeros(0)}
    votes = np.array([v for v, _ in histogram], dtype=int)
    n = np.array([c for _, c in histogram], dtype=float)
    bad, good = (votes == -1).astype(float), (votes == 1).astype(float)
    hit = np.full(votes.shape[1], 0.3)
    false = np.full(votes.shape[1], max_false_alarm)
    prior, post = 0.8, np.zeros(len(n))
    for _ in range(rounds):
        odds = bad @ np.log(false / hit) + good @ np.log((1 - false) / (1 - hit))
        new = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -700, 700)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        w0, w1 = n * (1 - post), n * post
        hit = np.clip((w0 @ bad + 1) / (w0 @ (bad + good) + 2), 0.05, 0.95)
        false = np.clip((w1 @ bad + 1e-3) / (w1 @ (bad + good) + 1), 1e-5, max_false_alarm)
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.01, 0.99))
    return {"prior": prior, "hit": hit, "false_alarm": false, "posterior": post}


def _pattern(rules):
    code = reduce(lambda a, r: a * 3 + F.col(f"v_{r[0]}") + 1, rules, F.lit(0))
    return code.cast("int").alias("pattern")


def _judge(found: DataFrame, model: DataFrame, threshold: float) -> DataFrame:
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return found.join(F.broadcast(model), "pattern", "left").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )


def _model(found: DataFrame, rules) -> DataFrame:
    """Posterior of each vote pattern; the histogram has at most 3 ** len(rules) rows."""
    rows = found.groupBy("pattern").count().collect()
    patterns = [r["pattern"] for r in rows]
    votes = [tuple(p // 3**k % 3 - 1 for k in reversed(range(len(rules)))) for p in patterns]
    fitted = fit(list(zip(votes, [r["count"] for r in rows], strict=True)))
    return found.sparkSession.createDataFrame(
        [(p, float(q)) for p, q in zip(patterns, fitted["posterior"], strict=True)], "pattern int, quality double"
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Features, base verdict, posterior ``quality`` and ``kept``, one row per input row."""
    # Written before they are joined: conditions on votes would otherwise be worked out from texts.
    found = features(docs, id_col, text_col).select("*", *_votes(rules))
    found = materialise(found, "quality").withColumn("pattern", _pattern(rules))
    return _judge(found, _model(found, rules), threshold)


def select_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules=RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept.

    Rows are written with their votes, so texts are read once and none is shuffled.
    """
    found = features(docs, id_col, text_col, tuple(docs.columns)).select("*", *_votes(rules))
    found = materialise(found, "votes").withColumn("pattern", _pattern(rules))
    return _judge(found, _model(found, rules), threshold).filter("kept").select("kept_row.*")

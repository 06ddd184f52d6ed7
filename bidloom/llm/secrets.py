"""Secret scan: base patterns, and a randomness test battery over the other long tokens.

Candidates are all runs of 20 or more characters of the base64 and identifier alphabets.  Each gets
the narrowest encoding that fits (hex, letters, base32, base36, base62 and base64, by case).  Three statistics of its symbols are compared with what uniform draws from that alphabet
give: chi-squared over the alphabet, runs above and below the middle of the alphabet, and
serial correlation of neighbours.  Their p-values are combined by Bonferroni, and the combined ones
go through false-discovery control over the whole corpus: of the candidates that are dismissed as
not random, at most the share ``lost`` is.  A fixed level would lose more the rarer prose is.

The rest are secrets unless prose could have given them: written words and identifiers have letters
of known frequency and change between cases, digits and signs at known rates.  A string's chance
under that model over its chance under uniform draws is at most t with probability t or less if it
is prose (Markov's inequality), so the ratio is a p-value, and for random strings it falls
exponentially with length.  The same control holds the false ones of those reported to ``fdr``.

Both controls are Benjamini-Hochberg over p-values weighted by length (longer strings carry more
power, so they get a larger part of the error budget).  The ranks come from a histogram of weighted
p-values with a fixed number of bins, so no candidate list is sorted in one place; one threshold
comes back.  Ties: p-values of one bin stand or fall together, at the bin's largest.

Everything is DataFrame functions.  No text is shuffled; the histogram is a partial aggregation.

Defined edge cases: a null or empty text has no spans; very long texts are scanned whole, in n log n
of their matches; repeated rows and ids are scanned row by
row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm import spans as S
from bidloom.llm.common import materialise

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = [
    ("assign", ASSIGN, 2, "char_length(x.part) >= 12", "true"),
    ("access", "AKIA[A-Z0-9]+", 0, "char_length(x.body) >= 18", "contains(t, 'AKIA')"),
    # Runs are maximal, so asking for 16 characters finds the runs that pass, and no short ones.
    ("hex", "[0-9a-f]{16,}", 0, "true", "true"),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_LOW, _UP, _TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from narrow to wide.
ALPHABETS = [
    ("hex", _TEN + _LOW[:6]),
    ("upper_hex", _TEN + _UP[:6]),
    ("lower", _LOW),
    ("upper", _UP),
    ("base32", _UP + "234567"),
    ("base36", _TEN + _LOW),
    ("upper_base36", _TEN + _UP),
    ("letters", _UP + _LOW),
    ("base62", _UP + _LOW + _TEN),
    ("base64", _UP + _LOW + _TEN + "+/"),
]
#: Per cent of the letters a to z in prose, the largest over English, German, French and Spanish.
LETTERS = [11.5, 2.2, 4, 5.1, 16.4, 2.2, 3, 6.1, 7.5, 0.6, 1.4, 5.5, 3.2, 9.8, 8.7, 2.5, 1.4, 7, 8, 9.1, 6.3, 1.8, 2.4, 0.4,
           2, 1.1]
#: Chances of the next class (lower case, upper case, digit, sign) in words and identifiers, by class.
CHANGES = [[0.83, 0.07, 0.04, 0.06], [0.8, 0.12, 0.04, 0.04], [0.06, 0.06, 0.78, 0.1], [0.45, 0.15, 0.3, 0.1]]
BINS_PER_DECADE, DECADES = 8, 40


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text ``t`` and the array ``base`` of base spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = [
        S.all_matches("t", pattern, kind, rank, ok, group, gate)
        for rank, (kind, pattern, group, ok, gate) in enumerate(BASE)
    ]
    return rows.withColumn("base", F.concat(*found))


def statistics(body: Column) -> Column:
    """Encoding and test statistics of one string, as a struct."""
    bare = F.translate(F.rtrim(body, F.lit("=")), "-_", "+/")
    picks = [F.when(bare.rlike(f"^[{a.replace('/', '/')}]+$"), F.lit(k)) for k, (_, a) in enumerate(ALPHABETS)]
    which = F.coalesce(*picks, F.lit(len(ALPHABETS) - 1))
    alphabet = F.element_at(F.array(*[F.lit(a) for _, a in ALPHABETS]), which + 1)
    return F.struct(bare.alias("s"), which.alias("which"), alphabet.alias("alphabet"))


def prose_log(body: str) -> Column:
    """Natural logarithm of the chance of a string under prose; without lower case, case says nothing."""
    symbols = _LOW + _UP + _TEN + "+/="
    letters = [math.log(x / sum(LETTERS)) for x in LETTERS]
    own = [*letters, *letters, *[math.log(0.1)] * 10, *[math.log(0.5)] * 3]
    array = lambda values: f"array({', '.join(f'{x:.6f}D' for x in values)})"
    folded = f"if({body} rlike '[a-z]', {body}, lower({body}))"
    return F.expr(
        f"aggregate(transform(split({folded}, ''), c -> locate(c, '{symbols}')), "
        f"named_struct('last', 0, 'sum', {math.log(0.25):.6f}D), (a, x) -> if(x = 0, a, named_struct("
        "'last', case when x <= 26 then 1 when x <= 52 then 2 when x <= 62 then 3 else 4 end, "
        f"'sum', a.sum + element_at({array(own)}, x) + if(a.last = 0, 0D, element_at("
        f"{array([math.log(x) for row in CHANGES for x in row])}, 4 * a.last - 4 + "
        "case when x <= 26 then 1 when x <= 52 then 2 when x <= 62 then 3 else 4 end)))), a -> a.sum)"
    )


def battery(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds encoding, the three z statistics, ``p_random`` and ``p_prose`` for strings in ``body``."""
    # Exploded, so that the optimizer does not put the choice of encoding in the place of each use.
    df = df.withColumn("e", F.explode(F.array(statistics(F.col(body)))))
    df = df.withColumn("n", F.char_length("e.s").cast("double")).withColumn(
        "k", F.char_length("e.alphabet").cast("double")
    )
    # Each symbol's count from the length that its removal takes away: linear in text and alphabet.
    df = df.withColumn(
        "squares",
        F.expr("aggregate(split(e.alphabet, ''), 0D, (a, c) -> a + if(c = '', 0D, "
               "power(n - char_length(replace(e.s, c, '')), 2)))"),
    )
    df = df.withColumn("codes", F.expr("transform(split(e.s, ''), c -> cast(locate(c, e.alphabet) as double))"))
    df = df.withColumn("codes", F.expr("filter(codes, c -> c > 0)"))
    high = "x > k / 2 + 0.25"
    sums = (
        "aggregate(codes, named_struct('up', 0D, 'runs', 0D, 'lag', 0D, 'last', 0D), (a, x) -> named_struct("
        f"'up', a.up + if({high}, 1D, 0D), "
        f"'runs', a.runs + if(a.last = 0 or ({high}) <> (a.last > k / 2 + 0.25), 1D, 0D), "
        "'lag', a.lag + if(a.last = 0, 0D, (x - (k + 1) / 2) * (a.last - (k + 1) / 2)), 'last', x))"
    )
    df = df.withColumn("m", F.expr(sums))
    chi = F.col("k") / F.col("n") * F.col("squares") - F.col("n")
    sd = F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    up, down = F.col("m.up"), F.col("n") - F.col("m.up")
    expect = 1 + 2 * up * down / F.col("n")
    var = F.greatest(F.lit(0.25), (expect - 1) * (expect - 2) / F.greatest(F.lit(1.0), F.col("n") - 1))
    spread = (F.col("k") * F.col("k") - 1) / 12 * F.sqrt(F.col("n"))
    df = df.withColumn("z_chi", (chi - (F.col("k") - 1)) / sd)
    df = df.withColumn("z_runs", F.when((up == 0) | (down == 0), F.sqrt("n")).otherwise((F.col("m.runs") - expect) / F.sqrt(var)))
    df = df.withColumn("z_serial", F.col("m.lag") / spread)
    worst = F.least(*[S.normal_tail(F.col(z)) for z in ("z_chi", "z_runs", "z_serial")])
    return (
        df.withColumn("p_random", F.least(F.lit(1.0), 3 * worst))
        .withColumn("p_prose", F.exp(F.least(F.lit(0.0), prose_log("e.s") + F.col("n") * F.log("k"))))
        .withColumn("encoding", F.element_at(F.array(*[F.lit(a) for a, _ in ALPHABETS]), F.col("e.which") + 1))
        .drop("e", "squares", "codes", "m", "k")
    )


def discoveries(tested: DataFrame, p: str, rate: float) -> DataFrame:
    """Adds ``found``: p-values in column ``p`` that pass at false-discovery rate ``rate``, by length ``n``."""
    total = tested.agg(F.count("*").alias("c"), F.avg("n").alias("n")).first()
    count, mean = total["c"] or 0, total["n"] or 1.0
    weighted = F.greatest(F.col(p) * mean / F.col("n"), F.lit(10.0**-DECADES))
    binned = tested.withColumn(
        "bin", F.greatest(F.lit(0), F.floor(-F.log10(weighted) * BINS_PER_DECADE)).cast("int")
    )
    bins = binned.groupBy("bin").agg(F.count("*").alias("c"))  # at most BINS_PER_DECADE * DECADES + 1 rows
    # A bin passes when its largest p, times all candidates, is within the rate times those at or below it.
    below = F.sum("c").over(W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0))
    level = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    passed = bins.select("bin", (level * count <= rate * below).alias("ok")).filter("ok").agg(F.min("bin")).first()[0]
    return binned.withColumn("found", F.col("bin") >= (passed if passed is not None else 10**9)).drop("bin")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01,
         lost: float = 0.001) -> DataFrame:
    """One row per input row: ``base`` and ``all`` spans (arrays of SPAN)."""
    rows = base_spans(docs, id_col, text_col)
    rows = rows.withColumn("runs", S.all_matches("t", CANDIDATE, "random", len(BASE)))
    rows = rows.withColumn("more", S.meeting("runs", "base", meets=False)).drop("runs")
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()).drop("t"), "secrets")
    tested = battery(rows.select("rid", F.explode("more").alias("x")).select("rid", "x", F.col("x.body").alias("body")))
    tested = materialise(tested.select("rid", "x", "n", "p_random", "p_prose"), "tested")
    random = discoveries(tested, "p_random", lost).filter("not found").drop("found")
    kept = discoveries(random, "p_prose", fdr).filter("found")
    added = kept.groupBy("rid").agg(F.collect_list("x").alias("added"))
    return rows.join(added, "rid", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(f"array<{S.SPAN}>"))).alias("all")
    )

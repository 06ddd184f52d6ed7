"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base matches are the seeds.  A lexical pattern is the word before or the word after a mention.
Mentions are all tokens with a digit or an @ and runs of such tokens, so patterns are judged by
everything they extract, not by seeds alone.  A mention without @ and with fewer than six digits
says little by itself: it is one instance per pair of words around it, the others are one instance
wherever they stand.  Spark scores the bipartite graph of patterns and distinct instances in rounds:
a pattern scores the mean confidence of its instances (with a prior against rare ones), an instance
the noisy-or of its patterns.  The share of confident instances of the same shape (runs of digits
and letters reduced to one sign) joins that noisy-or as a weak vote: it lifts instances that a
pattern extracts and keeps none from being found.  Instances that no base pattern matches and that
end above the threshold are reported with the kind whose patterns found them.

Everything is DataFrame functions.  Texts are not shuffled; mentions are.  A frequent word is a
frequent pattern: it is counted by partial aggregation, and edges meet scores in a join that
adaptive execution can split.  Rounds are written to the shared folder.

Defined edge cases: a null or empty text has no spans; very long texts are scanned whole, in n log n
of their matches; repeated rows and ids are scanned row by
row, and an instance counts once per pattern however often it is repeated; kinds that score a pattern
alike go in the order of ``KINDS``, and of kinds that extract an instance with one confidence the
last by name is reported; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm import spans as S
from bidloom.llm.common import materialise, whole_row

KINDS = ["email", "ip", "card", "phone"]
#: A start is allowed after the previous match or where no character of the run stands before it:
#: the same matches as without it, but long runs are not tried from each of their characters.
BASE = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "true",
     "contains(t, '@')"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
     "forall(split(x.body, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
     "t rlike '[0-9][.][0-9]'"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "{luhn}", "t rlike '[0-9][ -]?[0-9]'"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
     "char_length(regexp_replace(x.body, '[^0-9]', '')) between 10 and 15", "contains(t, '+')"),
]
_DIGITS = "reverse(regexp_replace(x.body, '[^0-9]', ''))"
_LUHN = (
    f"if(char_length({_DIGITS}) between 14 and 19, aggregate(transform(split({_DIGITS}, '(?<=.)(?=.)'), "
    "(c, i) -> if(i % 2 = 0, cast(c as int), cast(substr('0246813579', cast(c as int) + 1, 1) as int))), "
    "0, (a, v) -> a + v) % 10 = 0, false)"
)
#: A token with a digit or an @, tried from its first character only.
MENTION = r"(?<![^\s,;:!?()])[^\s,;:!?()]*?[0-9@][^\s,;:!?()]*+"
#: Such a token, or digits in brackets, with the tokens of digits that go on from it.
WIDE = (
    r"(?<![^\s,;:!?()])(?:\([0-9]++\)(?=\x20?[0-9])|[^\s,;:!?()]*?[0-9@][^\s,;:!?()]*+)"
    r"(?:\x20?\([0-9]++\)|(?:\x20|(?<=\)))[0-9][^\s,;:!?()]*+|:{1,2}[0-9A-Za-z]++|,[0-9]++)*+"
)
#: Weight of the vote of an instance's shape.
SHAPE_WEIGHT = 0.5


def base_columns(text: str = "t") -> Column:
    return F.concat(*[
        S.all_matches(text, pattern, kind, rank, ok.replace("{luhn}", _LUHN), 0, gate)
        for rank, (kind, pattern, ok, gate) in enumerate(BASE)
    ])


def shape(body: Column) -> Column:
    """Runs of digits as 9, of letters as a."""
    return F.regexp_replace(F.regexp_replace(body, r"[0-9]+", "9"), r"\p{L}+", "a")


def instance(x: str) -> Column:
    """What makes mentions the same instance: the text, with the words around it if it is short of digits."""
    own = f"{x}.body like '%@%' or char_length(regexp_replace({x}.body, '[^0-9]', '')) >= 6 or array_contains(array({', '.join(repr(k) for k in KINDS)}), {x}.kind)"
    return F.expr(f"if({own}, {x}.body, concat_ws('\x1f', {x}.body, {x}.before, {x}.after))")


def _edges(mentions: DataFrame) -> DataFrame:
    """Distinct (pattern, instance), with the seed kind of the instance or null, and its shape."""
    sides = [
        F.when(F.col(f"x.{side}") != "", F.concat_ws("\x1f", F.lit(side), F.col(f"x.{side}"))) for side in ("before", "after")
    ]
    return (
        mentions.select(F.explode(F.array_compact(F.array(*sides))).alias("pattern"), instance("x").alias("body"),
                        F.col("x.kind").alias("kind"), shape(F.col("x.body")).alias("shape"))
        .groupBy("pattern", "body")
        .agg(F.max(F.when(F.col("kind").isin(KINDS), F.col("kind"))).alias("kind"), F.min("shape").alias("shape"))
    )


def confident(mentions: DataFrame, rounds: int = 3, support: int = 5, pattern_level: float = 0.6,
              level: float = 0.9) -> DataFrame:
    """Unseen instances that high-confidence patterns extract: (body, found kind, confidence)."""
    edges = materialise(_edges(mentions), "edges")
    fields = ["pattern", "body", "shape"]
    known = edges.select(*fields, F.col("kind").alias("of"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("conf"))
    best = F.greatest(*KINDS)
    name = F.coalesce(*[F.when(F.col(kind) == best, F.lit(kind)) for kind in KINDS])
    of_kind = [F.sum(F.when(F.col("of") == kind, F.col("conf")).otherwise(0.0)).alias(kind) for kind in KINDS]
    for k in range(rounds):
        scores = known.groupBy("pattern").agg(F.count("*").alias("n"), *of_kind)
        scores = scores.select("pattern", name.alias("s_kind"), best.alias("s"), (best / (F.col("n") + 1)).alias("score"))
        scores = scores.filter((F.col("s") >= support) & (F.col("score") >= pattern_level)).drop("s")
        shapes = known.groupBy("shape").agg(F.count("*").alias("n"), *of_kind)
        shapes = shapes.select("shape", name.alias("s_kind"), (best / (F.col("n") + 1)).alias("share")).filter("share > 0")
        voted = (
            edges.filter("kind is null").join(scores, "pattern").groupBy("body", "shape", "s_kind")
            .agg(F.sum(F.log(F.greatest(F.lit(0.01), 1 - F.col("score")))).alias("against"))
            .join(shapes, ["shape", "s_kind"], "left")
            .withColumn("conf", 1 - F.exp("against") * (1 - SHAPE_WEIGHT * F.coalesce("share", F.lit(0.0))))
            .groupBy("body").agg(F.max(F.struct("conf", "s_kind")).alias("top"))
            .select("body", F.col("top.s_kind").alias("of"), F.col("top.conf").alias("conf"))
        )
        voted = materialise(voted, f"votes-{k}")
        seeds = edges.filter("kind is not null").select(*fields, F.col("kind").alias("of"), F.lit(1.0).alias("conf"))
        rest = edges.filter("kind is null").select(*fields).join(voted, "body", "left")
        known = seeds.unionByName(rest.select(*fields, "of", F.coalesce("conf", F.lit(0.0)).alias("conf")))
    return voted.filter(F.col("conf") >= level)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
         rounds: int = 3, support: int = 5, pattern_level: float = 0.6, level: float = 0.9) -> DataFrame:
    """One row per input row: ``base`` and ``all`` spans (arrays of SPAN).

    The columns that ``keep`` names come along in the struct ``kept``.
    """
    kept = [whole_row(keep, "kept")] if keep else []
    name = ["kept"] if keep else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *kept
    )
    rows = rows.select(
        "doc_id", "t", *name, F.monotonically_increasing_id().alias("rid"), base_columns().alias("base"),
        S.all_matches("t", WIDE, "mention", len(BASE)).alias("wide"),
    )
    # Of runs that hold a base match, the other tokens remain.
    rows = rows.withColumn("cut", S.meeting("wide", "base"))
    rows = rows.withColumn("apart", S.meeting("wide", "base", meets=False))
    rows = rows.withColumn("single", S.all_matches("t", MENTION, "mention", len(BASE) + 1, gate="size(cut) > 0"))
    rows = rows.withColumn("single", S.meeting("single", "cut"))
    rows = rows.withColumn("more", F.concat("apart", S.meeting("single", "base", meets=False)))
    rows = rows.drop("t", "wide", "cut", "apart", "single")
    rows = materialise(rows, "mentions")
    mentions = rows.select("rid", F.explode(F.concat("base", "more")).alias("x"))
    found = confident(mentions, rounds, support, pattern_level, level).select("body", F.col("of"))
    added = (
        rows.select("rid", F.explode("more").alias("x")).withColumn("body", instance("x")).join(found, "body")
        .groupBy("rid").agg(F.collect_list(F.col("x").withField("kind", F.concat(F.lit("like_"), "of"))).alias("added"))
    )
    both = F.concat("base", F.coalesce("added", F.array().cast(f"array<{S.SPAN}>")))
    return rows.join(added, "rid", "left").select(
        "doc_id", *name, "base", both.alias("all")
    )


def masked(text: str, spans: str, block: int = 4096) -> Column:
    """Column ``text`` with each of ``spans`` replaced by its kind in brackets; overlapping spans are one.

    The text is cut into blocks once and each gap is taken from its blocks, so that places far
    into a long text are not looked for from its start.
    """
    ends = S.running("transform(x, y -> y.end)", "greatest(p, q)", "0")
    at, to = "if(i = 0, 0, e[i - 1])", "x[i].start"
    gap = (
        "if({to} <= {at}, '', array_join(transform(sequence(int({at} / {n}), int(({to} - 1) / {n})), k -> substr(b[k], "
        "greatest({at} - k * {n}, 0) + 1, least({to} - k * {n}, {n}) - greatest({at} - k * {n}, 0))), ''))"
    ).format
    pieces = f"transform(sequence(0, size(x) - 1), i -> if({to} < {at}, '', concat({gap(at=at, to=to, n=block)}, '[', x[i].kind, ']')))"
    tail = gap(at="e[size(e) - 1]", to=f"char_length({text})", n=block)
    body = f"concat(array_join({pieces}, ''), {tail})"
    bound = (
        f"transform(array(sort_array({spans})), x -> transform(array({ends}), e -> transform(array("
        f"regexp_extract_all({text}, '(?s).{{1,{block}}}', 0)), b -> {body})[0])[0])[0]"
    )
    return F.expr(f"if(size({spans}) = 0, {text}, {bound})")

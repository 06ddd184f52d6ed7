"""Facts in bidder documents: one pass over the texts, whatever the number of criteria.

``facts`` has one row per fact with its field, and the order columns ``pass`` and ``match_pos``.
Amounts are one family that all money fields share; the family is expanded by the join to
criteria, not by copying rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import patterns as P
from bidloom.functions import text as T


def amount_inr(number: Column, unit: Column, cr_is_unit: bool = True) -> Column:
    """Rupees of a number with separators and a unit; null if it is no number."""
    unit = F.lower(F.coalesce(unit, F.lit("")))
    crore = unit.contains("crore") | ((F.trim(unit) == "cr") if cr_is_unit else F.lit(False))
    scale = (
        F.when(crore, 1e7).when(unit.contains("lakh") | unit.contains("lac"), 1e5).when(unit.contains("million"), 1e6)
    )
    return number_of(number) * scale.otherwise(1.0)


def number_of(digits: Column) -> Column:
    """A number in digits of any script, with or without commas; null if it is none."""
    return F.regexp_replace(T.plain_digits(digits), ",", "").try_cast("double")


def _matches(text: Column, pattern: str, groups: tuple[str, ...]) -> Column:
    """All matches of a pattern with the named groups and ``raw``.  The text is searched once, groups are read from its matches."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(
        *[F.regexp_extract(m, pattern, k + 1).alias(g) for k, g in enumerate(groups)], m.alias("raw")))


def money_matches(text: Column) -> Column:
    """All rupee amounts of a text, in order: value, raw."""
    return F.transform(_matches(text, P.MONEY_ALL, ("number", "unit")), lambda m: F.struct(
        amount_inr(m["number"], m["unit"], cr_is_unit=False).alias("value"), m["raw"].alias("raw")))


def turnover_matches(text: Column) -> Column:
    """Numbers after the word turnover: value, raw; small ones are taken as crores."""
    found = F.transform(_matches(text, P.MONEY_TURNOVER, ("number",)), lambda m: F.struct(number_of(m["number"]).alias("v"), m["raw"].alias("raw")))
    return F.transform(found, lambda x: F.struct(F.when(x["v"] < 1e6, x["v"] * 1e7).otherwise(x["v"]).alias("value"), x["raw"].alias("raw")))


def _money(docs: DataFrame, matches: Column, number: int, conf: float) -> DataFrame:
    out = docs.select(*docs.columns, F.posexplode_outer(matches).alias("match_pos", "m")).filter("m.value is not null")
    return out.select(*docs.columns, F.lit(number).alias("pass"), "match_pos", "m.value", F.lit(conf).alias("ext_conf"), "m.raw")


def money_pass1(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rupee amounts, in order: match_pos, value, ext_conf, raw."""
    return _money(docs, money_matches(F.col(text)), 1, 0.9)


def money_pass2(docs: DataFrame, text: str = "text") -> DataFrame:
    """Numbers after the word turnover."""
    return _money(docs, turnover_matches(F.col(text)), 2, 0.75)


def bool_signals(text: Column) -> dict[str, Column]:
    """field: struct(value, conf) by the presence rules over a lower-cased text; the first rule that holds counts."""
    t = text

    def holds(every, some, pattern, least) -> Column:
        tests = [t.contains(w) for w in every]
        tests += [reduce(lambda a, b: a | b, (t.contains(w) for w in some))] if some else []
        tests += [t.rlike(pattern)] if pattern else []
        tests += [F.char_length(t) >= least] if least else []
        return reduce(lambda a, b: a & b, tests)

    def pick(rules, miss) -> Column:
        out = F
        for *test, value, conf in rules:
            out = out.when(holds(*test), F.struct(F.lit(float(value)).alias("value"), F.lit(conf).alias("conf")))
        return out.otherwise(F.struct(F.lit(0.0).alias("value"), F.lit(miss).alias("conf")))

    return {field: pick(*signal) for field, signal in P.SIGNALS.items()}


def bool_facts(docs: DataFrame, fields: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per document and field with value and conf, hits and misses alike."""
    rows, signals = _with_signals(docs, fields or P.BOOL_FIELDS, text)
    listed = F.array(*[F.struct(F.lit(k).alias("field"), s["value"].alias("value"), s["conf"].alias("ext_conf")) for k, s in signals.items()])
    return rows.select(*docs.columns, F.inline(listed))


def _with_signals(docs: DataFrame, fields: list[str], text: str | Column) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with a column for each field's signal, so that each is worked out once, and those columns."""
    every = bool_signals(F.col("_low"))
    rows = docs.withColumn("_low", F.lower(text)).withColumns({f"_signal_{f}": every[f] for f in fields})
    return rows, {f: F.col(f"_signal_{f}") for f in fields}


def counted(text: Column) -> Column:
    """What the count rules can match in a text, in order and apart: each number with a rule's words after it.

    A rule gives the same matches in this as in the text, as no digit follows the number that it takes, and letters
    go on to the end of the word, should one rule's word begin another's.
    """
    pieces = F.regexp_extract_all(text, F.lit(P.COUNTED), F.lit(0))
    return F.array_join(pieces, "|")


def count_facts(docs: DataFrame, fields: list[str] | None = None, text: str = "text") -> DataFrame:
    """Largest count per document and field; texts without one give no row.

    A text is searched once, for all rules; those whose words were found look through what was found.
    """
    fields = fields or P.COUNT_FIELDS
    column = {P.COUNT_RULES[k][0]: f"_count_{k}" for k in fields}
    rows = docs.select(*docs.columns, F.explode_outer(F.array(counted(F.col(text)))).alias("_counted")).filter("_counted <> ''").withColumn("_low", F.lower("_counted"))
    # Other letters than ASCII ones can stand for those of the words.
    plain = F.octet_length("_counted") == F.char_length("_counted")

    def largest(pattern: str, words: tuple[str, ...]) -> Column:
        numbers = F.transform(F.regexp_extract_all("_counted", F.lit(pattern), F.lit(1)), number_of)
        return F.when(~plain | reduce(lambda a, b: a | b, (F.col("_low").contains(w) for w in words)), F.array_max(numbers))

    rows = rows.withColumns({column[P.COUNT_RULES[k][0]]: largest(P.COUNT_RULES[k][0], P.COUNT_WORDS[k]) for k in fields})
    parts = []
    for k in fields:
        pattern, conf = P.COUNT_RULES[k]
        parts.append(F.struct(F.lit(k).alias("field"), F.col(column[pattern]).alias("value"), F.lit(conf).alias("ext_conf")))
    return rows.select(*docs.columns, F.inline_outer(F.array(*parts))).filter(F.col("value") > 0)


def ocr_confidence(quality: Column, mean: Column | None = None) -> Column:
    """Zero counts as missing, as it does for the rules."""
    mean = F.lit(None).cast("double") if mean is None else mean
    return F.coalesce(F.nullif(quality, F.lit(0.0)), F.nullif(mean, F.lit(0.0)), F.lit(0.75))


def full_text(text: Column, pages: Column) -> Column:
    """The text without white space around it, else the texts of the pages that have one, by line."""
    own = F.filter(F.transform(pages, lambda p: p["text"]), lambda x: x != "")
    return F.coalesce(F.nullif(T.strip(text), F.lit("")), T.strip(F.array_join(own, "\n")), F.lit(""))


def stored_text(payload: Column) -> Column:
    """Text of a stored reading, in any of its four forms.

    An object with ``text``, an object with ``pages``, plain text that is no JSON, and any other
    JSON, which has none.  A value that is false, zero or empty counts as missing.
    """
    v = F.try_parse_json(payload)
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    read = lambda x, path: F.nullif(F.nullif(F.try_variant_get(x, path, "string"), F.lit("false")), F.lit("0"))
    pages = F.transform(F.try_variant_get(v, "$.pages", "array<variant>"), lambda p: F.struct(F.when(is_object(p), read(p, "$.text")).alias("text")))
    return F.when(v.isNull(), F.coalesce(T.strip(payload), F.lit(""))).when(is_object(v), full_text(read(v, "$.text"), pages)).otherwise("")


FACT = "struct<family: string, pass: int, match_pos: int, value: double, ext_conf: double, raw: string>"
DOC = ["tender_id", "bidder_id", "doc_id", "doc_pos", "doc_type", "quality_score"]


def family_lists(docs: DataFrame, fields: list[str] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with what its texts are searched for, and of each family the array of its facts (null values are none).

    ``family`` is ``money`` or the field itself; ``fields`` names the fields that are asked for, so that rules
    of others are not run.  ``raw`` is the match of an amount; for other facts, which rest on the text as a
    whole, it is null.  A null text is searched as an empty one.
    """
    asked = lambda known: [f for f in known if fields is None or f in fields]
    form = f"array<{FACT}>"

    def fact(family, number, place, value, conf, raw=None):
        names = zip(("family", "pass", "match_pos", "value", "ext_conf", "raw"), (family, number, place, value, conf, raw), strict=True)
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in names])

    one = lambda f, value, conf: F.when(value > 0, F.array(fact(f, 1, 0, value, conf)).cast(form)).otherwise(F.array().cast(form))
    text, lists = F.coalesce("text", F.lit("")), {}
    if asked(P.MONEY_FIELDS):
        passes = []
        for number, conf, matches in ((1, 0.9, money_matches(text)), (2, 0.75, turnover_matches(text))):
            # The lambda is read here and now, so it has this turn's values.
            passes.append(F.transform(matches, lambda m, i: fact("money", number, i, m["value"], conf, m["raw"])))
        lists["money"] = F.filter(F.concat(*[x.cast(form) for x in passes]), lambda x: x["value"].isNotNull())
    docs, signals = _with_signals(docs, asked(P.BOOL_FIELDS), text)
    for f in asked(P.BOOL_FIELDS):
        value, conf = signals[f]["value"], signals[f]["conf"]
        lists[f] = F.array(fact(f, 1, 0, value, conf)).cast(form) if f == "generic_compliance" else one(f, value, conf)
    counts = {f: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(P.COUNT_RULES[f][0]), F.lit(1)), number_of)) for f in asked(P.COUNT_FIELDS)}
    docs = docs.withColumns({f"_count_{f}": c for f, c in counts.items()}) if counts else docs
    return docs, lists | {f: one(f, F.col(f"_count_{f}"), P.COUNT_RULES[f][1]) for f in counts}


def fact_lists(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``docs`` with ocr_conf and ``facts``, the array of all facts of its text, by family: each text gives one array."""
    rows, lists = family_lists(docs, fields)
    every = F.concat(F.array().cast(f"array<{FACT}>"), *lists.values())
    return rows.select(*docs.columns, ocr_confidence(F.col("quality_score")).alias("ocr_conf"), every.alias("facts"))


SAID = "struct<n: int, top: double, low: double, surest: struct<e: double, p: int, m: int, v: double, raw: string>>"


def families(fields: list[str]) -> list[str]:
    """The families of some fields, each once, in order."""
    return sorted({"money" if f in P.MONEY_FIELDS else f for f in fields})


def said(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``docs`` with ``said``: of each of ``families(fields)`` what its text says, null where that is nothing.

    That is the count and extremes of its facts, and the one found most surely, first in pass and match order.
    """
    rows, lists = family_lists(docs, fields)
    names, column = families(fields), lambda f: f"_facts_{f}"
    rows = rows.withColumns({column(f): lists[f] for f in names}) if names else rows

    def summary(f: str) -> Column:
        x = F.col(column(f))
        surest = lambda y: F.struct(y["ext_conf"].alias("e"), (-y["pass"]).alias("p"), (-y["match_pos"]).alias("m"), y["value"].alias("v"), y["raw"].alias("raw"))
        best = surest(F.get(x, F.lit(0))) if f != "money" else F.array_max(F.transform(x, surest))
        values = x["value"]
        return F.when(F.size(x) > 0, F.struct(F.size(x).alias("n"), F.array_max(values).alias("top"), F.array_min(values).alias("low"), best.alias("surest")))

    return rows.select(*docs.columns, F.array(*map(summary, names)).cast(f"array<{SAID}>").alias("said"))


def facts(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """All facts of documents (tender_id, bidder_id, doc_id, doc_pos, doc_type, quality_score, text), one a row.

    ``document`` and ``start`` are what is shown of the document: its filename where there is one, and its first characters.
    """
    return each(fact_lists(docs.select(*DOC, "text", *shown(docs)), fields).select(*DOC, F.inline_outer("facts"), "ocr_conf", "document", "start"), "family")


def each(rows: DataFrame, always: str) -> DataFrame:
    """Rows of an outer generator without those of empty arrays, by a column that elements always have.

    A plain generator makes a filter on the size of its array, which works out the array once more.
    """
    return rows.filter(F.col(always).isNotNull())


def shown(docs: DataFrame) -> list[Column]:
    name = F.coalesce("filename", "doc_id") if "filename" in docs.columns else F.col("doc_id")
    return [name.alias("document"), F.left("text", F.lit(200)).alias("start")]


def asked_fields(criteria: DataFrame) -> list[str]:
    """The known fields that criteria name, at most as many as there are rules."""
    known = P.MONEY_FIELDS + P.COUNT_FIELDS + P.BOOL_FIELDS
    return sorted(r[0] for r in criteria.filter(F.col("field").isin(known)).select("field").distinct().collect())


def family_of(field: Column) -> Column:
    return F.when(field.isin(P.MONEY_FIELDS), "money").otherwise(field)


def rules_of(criteria: DataFrame) -> DataFrame:
    """The criteria of each tender as one array, in order of their ids: tender_id, rules.

    ``types`` are the expected document types in order of preference.
    """
    names = {"id": "criterion_id", "value": "target"}
    own = [F.col(c).alias(names.get(c, c)) for c in ("id", "field", "operator", "value", "priority", "semantic_ambiguity_score")]
    types = F.split(F.when(F.coalesce("priority", F.lit("")) == "", F.lit("supporting")).otherwise(F.col("priority")), ",")
    rule = F.struct(*own, family_of(F.col("field")).alias("family"), types.alias("types"))
    return criteria.groupBy("tender_id").agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def gather(criteria: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """Facts by criterion of the same tender and family: the evidence of each pair."""
    both = fact_rows.join(rules_of(criteria), "tender_id")
    wanted = F.filter("rules", lambda r: r["family"] == F.col("family"))
    rows = each(both.select(*fact_rows.columns, F.explode_outer(wanted).alias("rule")), "rule")
    return rows.select(*fact_rows.columns, *[F.col(f"rule.{c}").alias(c) for c in ("criterion_id", "field", "priority")])

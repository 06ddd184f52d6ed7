"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import (
    collocations, decontam, licenses, mixing, ngram_join, packing, pii, quality, repeats, secrets, spans, tokens, variants,
    warc,
)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each row of ``documents``."""
    found = secrets.find(_table(spark, sf_dir, "documents"))
    counts = [spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("all")).alias("spans"),
    )


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` left without repeated 200-byte strings."""
    return repeats.remove(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly supervised quality verdict for each row of ``documents``."""
    return quality.score(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back."""
    return warc.archive(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of near-duplicate rows of ``documents``."""
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each row of ``documents``."""
    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in each row of ``documents``."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each row of ``documents``."""
    return tokens.count(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` packed into sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each row of ``documents``."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("all")).alias("spans"),
    )


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a curriculum over the sources of ``documents`` takes of each row."""
    return mixing.taken(*mixing.mix(_table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First collocations of each language of ``documents``."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with the form that each rare spelling stands for."""
    return variants.group(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_warc_archive": op1_warc_archive,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontamination": op3_decontamination,
        "op4_license_scan": op4_license_scan,
        "op5_token_counts": op5_token_counts,
        "op6_secret_scan": op6_secret_scan,
        "op7_repeat_removal": op7_repeat_removal,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_personal_data": op10_personal_data,
        "op11_source_mix": op11_source_mix,
        "op12_collocations": op12_collocations,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
top as (select h, max(page_id) as keeper from p where n >= 1000 group by h)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
  case when top.keeper is null or top.keeper = p.page_id then 'response' else 'revisit' end as record_type,
  case when top.keeper <> p.page_id then top.keeper end as refers_to
from p left join top on top.h = p.h"""

OP3_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where text is not null),
iw as (select distinct item, k, array_to_string(w[s : s + k - 1], ' ') as win from
  (select item, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') as win from
  (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from iw) where len(w) >= k)),
hit as (select doc_id, s, iw.k, item from dw join iw on iw.win = dw.win and iw.k = dw.k),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join cover on cover.doc_id = d.doc_id left join found on found.doc_id = d.doc_id"""


OP11_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('0' || chr(31) || coalesce(cast(doc_id as varchar), '') || chr(31) || coalesce(text, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
-- Sources that reach their limit first come first; the first open one whose share is under its limit sets the shares.
c as (select *, 3 * source_size as cap, row_number() over (order by source_size::double / w, source nulls last) as k from s),
p as (select *, coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as shut,
    sum(w) over (order by k rows between current row and unbounded following) as heavy, sum(source_size) over () as total from c),
f as (select k, total - shut as remains, heavy from p where (total - shut) * w <= cap * heavy order by k limit 1),
t as (select c.source, c.source_size, case when c.k < f.k then c.cap::double else c.w * f.remains::double / f.heavy end as target from c, f),
a as (select d.*, t.source_size, t.target, round(t.target)::bigint as goal,
    sum(size) over (partition by d.source order by h rows between unbounded preceding and current row) - size as began from d join t on t.source is not distinct from d.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, goal - began)) + greatest(0, least(size, goal - began - source_size)) + greatest(0, least(size, goal - began - 2 * source_size)))::bigint as taken
from a"""

OP12_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(LOWER, '[.,;:!?\x0A-\x0D]')) as piece from documents),
ws as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from ws group by lang),
ph as (select lang, phrase, any_value(k) as k, count(*) as f from
  (select lang, k, array_to_string(w[s : s + k - 1], ' ') as phrase from
    (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from ws, (select unnest(range(1, 6)) as k) where len(w) >= k)) group by lang, phrase having count(*) >= 100),
cut as (select lang, phrase, f as a, c, array_to_string(p[: c], ' ') as lp, array_to_string(p[c + 1 :], ' ') as rp from
  (select *, string_split(phrase, ' ') as p, unnest(range(1, k)) as c from ph where k > 1)),
sc as (select cut.lang, cut.phrase, a, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score, c from cut
  join ph x on x.lang = cut.lang and x.phrase = lp join ph y on y.lang = cut.lang and y.phrase = rp join totals on totals.lang = cut.lang),
best as (select * from sc qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, sub, max(f) as longer from (select lang, f, array_to_string(p[s : s + m - 1], ' ') as sub from
  (select lang, f, p, m, unnest(range(1, len(p) - m + 2)) as s from
    (select *, string_split(phrase, ' ') as p, unnest(range(2, k)) as m from ph where k > 2))) group by lang, sub)
select best.lang, row_number() over (partition by best.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from best left join inside on inside.lang = best.lang and sub = phrase where longer is null or 100 * longer < 100 * a
qualify rank <= 2000""".replace("LOWER", _LOWER)


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    return {
        "op1_warc_archive": OP1_SQL, "op3_decontamination": OP3_SQL, "op11_source_mix": OP11_SQL, "op12_collocations": OP12_SQL,
    }

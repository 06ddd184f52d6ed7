"""Pipeline stages on a small corpus: what goes, what stays, and the columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    question = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    clean = [(k, prose(rng, 150)) for k in range(40)]
    rows = clean + [
        (100, clean[0][1]), (101, clean[0][1].replace(clean[0][1].split()[70], "changed", 1)),
        (102, prose(rng, 60) + " " + question), (103, prose(rng, 10)), (104, None), (105, "word " * 200),
        (106, " ".join(x + "###" for x in prose(rng, 150).split())),
        (107, prose(rng, 80) + " write to a.b@example.org now " + prose(rng, 80)),
    ]
    folder = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = [(d, t, "en", None, None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(table, schema).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, question), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, corpus)
    assert good.columns == docs.columns
    assert ids(good) == set(range(40)) | {100, 101, 102, 107}
    assert good.filter("source is not null").count() == 0
    good.write.parquet(f"{corpus}/s1")
    good = spark.read.parquet(f"{corpus}/s1")
    one = stages["near_duplicates"](spark, good, corpus)
    assert one.columns == docs.columns and ids(one) == set(range(40)) | {102, 107}
    fair = stages["decontamination"](spark, one, corpus)
    assert fair.columns == docs.columns and ids(fair) == set(range(40)) | {107}
    masked = {r.doc_id: r for r in stages["personal_data"](spark, fair, corpus).collect()}
    assert "[email]" in masked[107].text and "@" not in masked[107].text and masked[107].n_chars == len(masked[107].text)
    assert masked[5].text == docs.filter("doc_id = 5").first().text


def test_stages_carry_any_column(spark, corpus):
    """Names that the operators use themselves, null and repeated ids, null and repeated texts."""
    names = "rid row _row kept all base t w hits items n_words n_hit key labels quality pattern pos text_raw".split()
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 20 or doc_id = 107")
    docs = docs.unionByName(docs.filter("doc_id in (3, 4)")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None)))
    docs = docs.unionByName(docs.filter("doc_id = 6").withColumn("text", F.lit(None)))
    docs = docs.select("*", *[F.lit(77 + k).alias(c) for k, c in enumerate(names)]).withColumn("a b.c", F.lit("x"))
    want = {"quality_rules": docs.filter("text is not null").count(), "near_duplicates": 22, "decontamination": docs.count(),
            "personal_data": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == want[name], name
        assert all([r[c] for c in names] == list(range(77, 77 + len(names))) and r["a b.c"] == "x" for r in rows), name
        assert stage(spark, docs.limit(0), corpus).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert pieces.filter("start = 0").count() == docs.count()
    assert pieces.columns == corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), corpus).columns


def test_very_long_texts(spark, corpus):
    """A clean text of 100,000 words goes through every stage whole; the share of its distinct words is low, as in any."""
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{int(rng.paretovariate(0.5)) % 30000:x}" for _ in range(100_000)]
    text = " ".join(x + "." * (k % 17 == 0) + "\n" * (k % 51 == 0) for k, x in enumerate(words))
    assert 5 * len(set(text.split())) < 100_000
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 40")
    docs = docs.unionByName(spark.createDataFrame([(500, text, "en", "s", len(text))], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = {r.doc_id: r.text for r in stage(spark, docs, corpus).collect()}
        assert len(kept) == 41 and kept[500] == text, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).filter("doc_id = 500").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 100_000


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert ids(out) == set(range(40)) | {107}


def test_empty(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The n-gram join against all pairs."""

import random
import re

import pytest

from bidloom.llm import ngram_join

from .conftest import document_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(rows):
    """(doc_id, class by smallest id, links) for every row."""
    found = [sets_of(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(found[a] & found[b])
            if both and both >= 0.8 * len(found[a] | found[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(k)] = min(doc, ids.get(top(k), doc))
    return [(d, ids.get(top(k)), links[k]) for k, (d, _) in enumerate(rows)]


def near_rows():
    """Chains of edits, a large group, and texts near the threshold on either side."""
    rng = random.Random(11)
    rows, doc = [], 1000
    for _ in range(30):
        words = prose(rng, rng.randrange(30, 150)).split()
        for _ in range(rng.randrange(1, 8)):
            rows.append((doc, " ".join(words)))
            doc += 1
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    base = prose(rng, 200).split()
    for _ in range(90):
        own = list(base)
        own[rng.randrange(200)] = "z" + str(rng.randrange(10**6))
        rows.append((doc, " ".join(own)))
        doc += 1
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_all_links(spark, block):
    rows = [r for r in near_rows() + document_rows() if r[0] is not None]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, rid int, key string").repartition(5).cache()
    out = ngram_join.join(docs, block=block).select("doc_id", "class_id", "n_links")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(rows), key=key)


def test_edges(spark, no_docs):
    assert ngram_join.join(no_docs).count() == 0
    rows = [(None, None), (None, ""), (5, "a b"), (5, "A, b!"), (6, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [
        ("5", "5", 1), ("5", "5", 1), ("6", "6", 0), ("None", "None", 0), ("None", "None", 0),
    ]


def test_recall_estimate_shortens_prefixes(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):  # pairs just above the threshold
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((2 * k, " ".join(words)))
        words[30], words[90] = "x", "y"
        rows.append((2 * k + 1, " ".join(words)))
    report = {}
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache(), report=report)
    assert out.filter("n_links = 1").count() == 120
    assert len(report) > 1 and list(report) == sorted(report, reverse=True)


def test_copies_do_not_loosen_the_stop_rule(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(60):  # 80 of 100 shingles in common
        own = words(94)
        rows.append((2 * k, " ".join(own)))
        own[30], own[70] = "x", "y"
        rows.append((2 * k + 1, " ".join(own)))
    hot = words(40)
    rows += [(1000 + k, " ".join(hot)) for k in range(20_000)] + [(999, " ".join([*hot[:-1], "z"]))]
    report = {}
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache(), report=report)
    assert out.filter("doc_id < 120 and n_links = 1").count() == 120
    assert min(report) == 4 and report[4][0] == 61


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 2000), (2000, 3000)], "u long, v long")
    got = {r.u: r.root for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {2000: 1000, 3000: 1000}


def test_no_table_is_broadcast_by_its_estimate(spark, monkeypatch):
    """Rows of an explode and packed numbers are sized far too low, so no join with them is planned as a broadcast.

    Labels alone may be: they do not pack, so their estimate holds.
    """
    plans, write = {}, ngram_join.Workspace.write

    def noted(self, df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, tag)

    monkeypatch.setattr(ngram_join.Workspace, "write", noted)
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + [x + " more" for x in texts[:9]])), "doc_id long, text string")
    out = ngram_join.join(docs)
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    assert len({r.class_id for r in out.collect()}) == 30
    assert sum("Join" in x for x in plans.values()) > 5
    assert not [t for t, x in plans.items() if "Broadcast" in x and not t.startswith("picked")]
    reps = spark.createDataFrame([(k, bytes(2 * ngram_join.TREES * ngram_join.DEPTH)) for k in range(4)], "rid long, labels binary")
    assert "Broadcast" not in ngram_join.meetings(reps, 6, 512)._jdf.queryExecution().executedPlan().toString()

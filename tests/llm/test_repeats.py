"""Removal of repeated strings against all strings."""

import collections
import hashlib
import random

import numpy as np
import pytest

from bidloom.llm import repeats

from .conftest import as_rows, document_rows, prose


def brute(rows, width):
    seen = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shared_rows():
    rng = random.Random(4)
    passages = [prose(rng, 60) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(40) : len(p) - rng.randrange(40)], prose(rng, rng.randrange(1, 40))]
        rows.append((3000 + k, " ".join(parts)))
    rows += [(4000, "ab" * 700), (4001, "é" * 400), (4002, rows[0][1] + rows[1][1]), (4003, "q" * 199), (4004, "q" * 199)]
    rows += [(4005, "r" * 200), (4006, "s" * 201)]
    return rows


@pytest.mark.parametrize("width, anchor", [(200, 32), (40, 8)])
def test_removed_bytes(spark, no_docs, width, anchor):
    rows = shared_rows() + document_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, n int").repartition(3).cache()
    out = repeats.remove(docs, width, anchor, with_text=True).cache()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(rows, width), key=key)
    assert as_rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    kept = out.selectExpr("sum(length(kept)) + sum(n_removed)", "sum(n_bytes)").first()
    assert kept[0] == kept[1]
    assert repeats.remove(no_docs).count() == 0

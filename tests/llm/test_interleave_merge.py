"""The merge of shard Burrows-Wheeler transforms by interleave refinement, on one machine.

It is the method that op7 was dealt and does not use; ``python -m tests.llm.test_interleave_merge
FILE`` prints what a round costs and how many rounds a byte needs.  Its repeats are a second
reference for the operator.
"""

import sys
import time

import numpy as np

from bidloom.llm import repeats

from .conftest import as_rows, document_rows
from .test_repeats import shared_rows


def shard(texts, depth):
    """Transform and places of a shard's suffixes, sorted by at least ``depth`` bytes; 0 ends a text."""
    s = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int16) + 1, 0) for t in texts])
    ends = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    size = 1
    while size < depth:
        following = np.zeros(len(s), np.int64)
        following[:-size] = rank[size:]
        key = rank * (len(s) + 300) + following
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        size *= 2
    places = np.argsort(rank, kind="stable")
    return s[places - 1], places


def merge(left, right, depth):
    """Refines the interleave once a byte; yields (shard of each suffix, class of equal prefixes) a round.

    A prefix of k + 1 bytes is a byte and the class of the k bytes after it, so common prefixes
    come from the rounds and no suffix is sorted again.
    """
    z = np.repeat(np.array([0, 1], np.uint8), [len(left), len(right)])
    group = np.zeros(len(z), np.int64)
    for _ in range(depth):
        byte = np.empty(len(z), np.int16)
        byte[z == 0], byte[z == 1] = left, right
        order = np.argsort(byte, kind="stable")
        z, byte, group = z[order], byte[order], group[order]
        new = (np.diff(byte) != 0) | (np.diff(group) != 0) | (byte[1:] == 0)
        group = np.cumsum(np.concatenate(([0], new)))
        yield z, group


def removed(texts, width):
    """Bytes of each text that strings of ``width`` bytes repeat, by the merge of two shards."""
    parts = [texts[0::2], texts[1::2]]
    (left, left_at), (right, right_at) = (shard(p, width) for p in parts)
    for z, group in merge(left, right, width):
        pass
    at = np.empty(len(z), np.int64)
    at[z == 0], at[z == 1] = left_at, right_at
    often = np.bincount(group)[group] > 1
    out = [0] * len(texts)
    for k, part in enumerate(parts):
        size = sum(len(t) + 1 for t in part)
        change = np.zeros(size + 1, np.int64)
        starts = at[(z == k) & often]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + width, -1)
        gone, first = np.cumsum(change) > 0, 0
        for j, text in enumerate(part):
            out[2 * j + k] = int(gone[first : first + len(text)].sum())
            first += len(text) + 1
    return out


def test_merged_shards_find_what_the_operator_removes(spark):
    rows = [r for r in shared_rows() + document_rows() if r[0] is not None]
    want = removed([(t or "").encode() for _, t in rows], repeats.WIDTH)
    out = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(out, "doc_id", "n_removed") == sorted(zip([d for d, _ in rows], want, strict=True))


if __name__ == "__main__":
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table(sys.argv[1], columns=["text"])["text"].to_pylist()]
    (left, _), (right, _) = shard(texts[0::2], repeats.WIDTH), shard(texts[1::2], repeats.WIDTH)
    n, spent, several, mixed = len(left) + len(right), 0.0, 0, 0
    began = time.process_time()
    for z, group in merge(left, right, repeats.WIDTH):
        spent += time.process_time() - began
        size, of_right = np.bincount(group), np.bincount(group, weights=z)
        several += int(size[size > 1].sum())
        mixed += int(size[(of_right > 0) & (of_right < size)].sum())
        began = time.process_time()
    print(f"{n} bytes: {spent / repeats.WIDTH / n * 1e9:.0f} ns a byte and round; rounds a byte needs without settled "
          f"classes: {several / n:.1f} for the repeats, {mixed / n:.1f} for the interleave alone")  # fmt: skip

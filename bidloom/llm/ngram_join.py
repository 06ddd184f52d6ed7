"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its five-word shingles.  Texts with equal sets are copies: one represents
them.  Each representative has a label per tree, a string of MinHash values; documents that share
a prefix of a label meet in a node of that tree's prefix trie (equal prefixes are adjacent in the
sorted order, here equal keys of a shuffle).  Every pair that meets is checked on whole sets.

Depth is adaptive: matching starts on long prefixes.  Each verified link of similarity s would
have been found with a known chance p(s) at that depth, so the links found tell how many were
missed (the sum of 1/p(s) - 1).  Prefixes are shortened until that estimate is within the target.
Both sides count pairs of representatives, so copies do not loosen it.  A pair is verified at the
first depth at which it meets; shorter prefixes add only the pairs that are new.  At the default
threshold three values always suffice (0.8 is missed there with chance 4e-8); if one value is not
enough for other parameters, that is an error.

No pairs are shuffled.  A node of n documents is cut into blocks of ``block`` documents, and a
task compares two blocks, so no task holds a large group and none is sampled or capped.  A pair
that meets in several trees belongs to the first of them, so it is counted once.  A first round
of tasks compares labels only (288 bytes a document) and tells which documents have a partner
whose estimated similarity is not far below the threshold (the chance that this leaves out a pair
is part of p); only their shingle sets are made and sent.  Tasks return one row per document: its
links and the root of its local class.  Exact numbers of links need every pair of a family of
near copies; blocks where many pairs meet are counted by one product of incidence matrices.

The rows are written once with their keys, and all later steps read those; ``row_col`` names a key
that a written table already has.

Where rows come of an explode, or numbers of a written file that packs them well, the planner takes
them for far smaller than they are (documents by trees: 4.6 million rows of 537 MB for under 10).
Such joins merge at every size, so that the driver never gathers a table to broadcast it.

Defined edge cases: a text without words (null, empty) has no shingles, no links, and is a class
of its own; one of one to four words is one shingle of all its words; very long texts are signed
and compared whole; repeated rows are copies, and of equal ids the row of smallest key stands
first; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import byte_words, with_row_id
from bidloom.sources.shared import Workspace

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 6


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def labels(sets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value of a set; ``factors`` are odd 64-bit multipliers."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for at in range(0, len(sets), 1024):  # bounds the table of products
        np.minimum(least, (factors[:, None] * sets[None, at : at + 1024]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype("<u2")


def _factors() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sign(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, key, labels): key is a digest of the shingle set, null for an empty one."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = _factors()
        for batch in batches:
            keys, found = [], []
            for text in batch["t"]:
                own = shingles(text)
                keys.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                found.append(labels(own, factors).tobytes() if len(own) else None)
            yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"], "key": keys, "labels": found})

    return rows.mapInPandas(task, "rid long, doc_id string, key binary, labels binary")


def agreement(lowest: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities, and the chance that at least the share ``lowest`` of a pair's values agrees."""
    n, grid = TREES * DEPTH, np.linspace(0, 1, 1001)
    need = math.ceil(lowest * n)
    tail = sum(math.comb(n, k) * grid**k * (1 - grid) ** (n - k) for k in range(need, n + 1))
    return grid, np.minimum(1.0, tail)


def chance(s: np.ndarray | float, depth: int, agrees: tuple | None = None) -> np.ndarray | float:
    """Chance that a pair of similarity ``s`` shares a prefix of this depth in some tree, and agrees enough."""
    meets = 1 - (1 - s**depth) ** TREES
    return meets if agrees is None else meets * np.interp(s, *agrees)


def meetings(reps: DataFrame, depth: int, block: int) -> DataFrame:
    """(node, tree, i, j, mine, rid): documents by pairs of blocks of the trie nodes that hold several."""
    tree = reps.select("rid", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    node = F.xxhash64("tree", F.substring("labels", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth)))
    members = tree.select(node.alias("node"), "tree", "rid")
    sizes = members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.join(sizes.hint("merge"), "node").select(
        "node", "tree", "rid", blocks.alias("nb"), F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("mine")
    )
    other = placed.select("node", "tree", "rid", "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    return other.select(
        "node", "tree", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rid"
    )


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups of rows that are sorted by ``names``, with the groups' borders."""
    held: list[pd.DataFrame] = []

    def cuts(frame: pd.DataFrame) -> np.ndarray:
        keys = frame[names].to_numpy()
        return np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(frame)]))

    for batch in batches:
        if batch.empty:
            continue
        at = cuts(batch)
        if held and tuple(held[-1][names].iloc[-1]) == tuple(batch[names].iloc[0]):
            if len(at) == 2:
                held.append(batch)
                continue
            held.append(batch.iloc[: at[1]])
            batch = batch.iloc[at[1] :]
            at = at[1:] - at[1]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield whole, cuts(whole)
        last = at[-2]
        if last:
            yield batch.iloc[:last].reset_index(drop=True), at[:-1]
        held = [batch.iloc[last:]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, cuts(whole)


def _prefixes(rows: np.ndarray, depth: int) -> np.ndarray:
    """(documents, trees, 1 or 2) numbers that are equal where prefixes of ``depth`` values are."""
    values = rows.reshape(len(rows), TREES, DEPTH).astype(np.uint64)
    parts = []
    for at in range(0, depth, 4):
        part = np.zeros((len(rows), TREES), np.uint64)
        for k in range(at, min(at + 4, depth)):
            part = part << np.uint64(16) | values[:, :, k]
        parts.append(part)
    return np.stack(parts, axis=2)


def _within(borders: np.ndarray, mine: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs a < b of each group, across its two blocks where it has two; at most about ``most`` at once."""
    lists, size = [], 0
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a == 2:
            left, right = np.array([a]), np.array([a + 1])
        else:
            own = mine[a:b]
            if own.min() != own.max():
                left, right = a + np.flatnonzero(own == own.min()), a + np.flatnonzero(own != own.min())
                left, right = np.repeat(left, len(right)), np.tile(right, len(left))
            else:
                left, right = np.triu_indices(b - a, 1)
                left, right = left + a, right + a
        for at in range(0, len(left), most):
            lists.append((left[at : at + most], right[at : at + most]))
            size += len(lists[-1][0])
            if size >= most:
                yield np.concatenate([x for x, _ in lists]), np.concatenate([y for _, y in lists])
                lists, size = [], 0
    if lists:
        yield np.concatenate([x for x, _ in lists]), np.concatenate([y for _, y in lists])


def _pairs_to_check(group: pd.DataFrame, borders: np.ndarray, depth: int, known: int | None, lowest: float):
    """Index pairs that their node owns and that may be similar enough.

    A pair belongs to the first tree in which its prefixes are equal, and to the first round in
    which it meets: one that shares a prefix of ``known`` values was verified before.
    """
    rows = np.frombuffer(b"".join(group["labels"]), "<u2").reshape(len(group), -1)
    tree, mine = group["tree"].to_numpy(), group["mine"].to_numpy()
    now, before = _prefixes(rows, depth), None if known is None else _prefixes(rows, known)
    for a, b in _within(borders, mine, 20_000):  # bounds the tables of comparisons
        same = (now[a] == now[b]).all(axis=2)
        good = same[np.arange(len(a)), tree[a]] & (same.argmax(axis=1) == tree[a])
        if before is not None:
            good &= ~(before[a] == before[b]).all(axis=2).any(axis=1)
        a, b = a[good], b[good]
        if len(a):
            good = (rows[a] == rows[b]).mean(axis=1) >= lowest
            yield a[good], b[good]


def candidates(met: DataFrame, reps: DataFrame, depth: int, known: int | None, lowest: float) -> DataFrame:
    """Those rows of ``met`` whose document owns a pair there that must be verified."""
    rows = met.join(reps.select("rid", "labels"), "rid").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    names = ["node", "i", "j"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, borders in _groups(batches, names):
            hit = np.zeros(len(group), bool)
            for a, b in _pairs_to_check(group, borders, depth, known, lowest):
                hit[a] = hit[b] = True
            if hit.any():
                yield group.loc[hit, [*names, "tree", "mine", "rid"]]

    return rows.select(*names, "tree", "mine", "rid", "labels").mapInPandas(
        task, "node long, i int, j int, tree int, mine int, rid long"
    )


def _common_by_product(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs, by products of incidence matrices over shared shingles."""
    left, right = np.unique(a), np.unique(b)
    used = np.union1d(left, right)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    l_at, r_at = np.searchsorted(used, left), np.searchsorted(used, right)
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(shared.sum()), 2048):  # bounds the matrices
        x, y = np.searchsorted(column, [at, at + 2048])
        table = np.zeros((len(used), 2048), np.float32)
        table[row[x:y], column[x:y] - at] = 1
        common += np.rint(table[l_at] @ table[r_at].T).astype(np.int64)
    return common[np.searchsorted(left, a), np.searchsorted(right, b)]


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        # Both are sorted and distinct: equal neighbours of the merged list are common.
        both = np.concatenate((sets[x], sets[y]))
        both.sort()
        out[k] = np.count_nonzero(both[1:] == both[:-1])
    return out


def verify(picked: DataFrame, sets: DataFrame, depth: int, known: int | None, threshold: float, lowest: float) -> DataFrame:
    """Exact similarity of the pairs: per document its links, its root, its pairs, and how many such
    pairs each depth up to this one would have missed."""
    names = ["node", "i", "j"]
    rows = picked.hint("merge").join(sets, "rid").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agrees = agreement(lowest)
        for group, borders in _groups(batches, names):
            found = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            size = np.array([len(x) for x in found])
            copies, rid = group["copies"].to_numpy(), group["rid"].to_numpy()
            links, pairs = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            missed, linked = np.zeros((len(group), depth)), []
            for a, b in _pairs_to_check(group, borders, depth, known, lowest):
                fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
                a, b = a[fits], b[fits]
                if not len(a):
                    continue
                # Pairs come group by group; where they are many for their documents, a product is cheaper.
                own = np.searchsorted(borders, a, side="right")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(a)])).tolist()
                common = np.zeros(len(a), np.int64)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    dense = y - x > 4 and y - x > 2 * len(np.union1d(a[x:y], b[x:y]))
                    common[x:y] = (_common_by_product if dense else _common)(found, a[x:y], b[x:y])
                s = common / (size[a] + size[b] - common)
                good = s >= threshold
                a, b, s = a[good], b[good], s[good]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                np.add.at(pairs, a, 1)
                for k in range(depth):
                    np.add.at(missed[:, k], a, 1 / chance(s, k + 1, agrees) - 1)
                linked.append((a, b))
            if not linked:
                continue
            a, b = (np.concatenate(x) for x in zip(*linked, strict=True))
            root, before = rid.copy(), None
            while before is None or (root != before).any():
                before, low = root.copy(), np.minimum(root[a], root[b])
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
            some = links > 0
            yield pd.DataFrame({"rid": rid, "links": links, "root": root, "pairs": pairs, "missed": list(missed)})[some]

    return rows.select(*names, "tree", "mine", "rid", "labels", "copies", "shingles").mapInPandas(
        task, "rid long, links long, root long, pairs long, missed array<double>"
    )


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, root): the smallest node of each node's component, by alternating star contraction.

    Every round is written to the shared folder; the number of rounds grows with the logarithm of
    the longest path.  Nodes of high degree are only counted and joined, never collected.
    """
    work = Workspace(edges.sparkSession)
    now = work.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "small")
    mark = None
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.write(large, f"large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = work.write(small.filter("u <> v").distinct(), f"small-{k}")
        work.drop(f"small-{k - 1}" if k else "small", f"large-{k}")
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if was == mark:
            return now.select("u", F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = 0.99999, start_depth: int = DEPTH,
         block: int = 512, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
         report: dict | None = None) -> DataFrame:
    """One row per input row: rid, doc_id, class_id (smallest doc_id), class_rid (its row), n_links.

    ``n_links`` counts the other rows of similarity at or above the threshold, copies included.
    ``row_col`` names a unique key of a written table, which then stands for ``rid``.
    """
    work = Workspace(docs.sparkSession)
    named = [F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("t")]
    if row_col is None:
        rows = work.write(with_row_id(docs.select(*named)), "rows")
    else:
        rows = docs.select(*named, F.col(row_col).alias("rid"))
    signed = work.write(sign(rows), "signed")
    full = signed.filter(F.col("key").isNotNull())
    reps = work.write(
        full.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("labels").alias("labels")),
        "reps",
    )
    # Agreement of TREES * DEPTH values lies this far below the similarity once in a million times.
    lowest = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))

    def set_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shingles=[shingles(x).tobytes() for x in batch["t"]])[["rid", "copies", "labels", "shingles"]]

    found, n, missed = [], 0, [0.0] * start_depth
    for depth in range(start_depth, 0, -1):
        known = depth + 1 if found else None
        picked = work.write(candidates(meetings(reps, depth, block), reps, depth, known, lowest), f"picked-{depth}")
        needed = reps.join(picked.select("rid").distinct().hint("merge"), "rid", "left_semi").select("rid", "copies", "labels")
        # Texts meet their keys by a shuffle at every size: how many are needed has no bound.
        sets = rows.select("rid", "t").join(needed.hint("merge"), "rid").mapInPandas(
            set_task, "rid long, copies long, labels binary, shingles binary"
        )
        links = work.write(verify(picked, sets, depth, known, threshold, lowest), f"links-{depth}")
        work.drop(f"picked-{depth}")
        found.append(links)
        # Links of every round count: each tells how many alike this depth still misses.
        own, *rest = links.agg(F.sum("pairs"), *(F.sum(F.col("missed")[k]) for k in range(depth))).first()
        n, missed = n + (own or 0), [x + (y or 0.0) for x, y in zip(missed, rest, strict=False)]
        if report is not None:
            report[depth] = (n, missed[depth - 1])
        if missed[depth - 1] <= (1 - target) * max(n, 1):
            break
    else:
        raise RuntimeError(f"about {missed[0]:.3g} of {n} links are missed even by prefixes of one value")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    linked = links.groupBy("rid").agg(F.sum("links").alias("links"))
    by_key = reps.join(linked.hint("merge"), "rid", "left").join(roots.withColumnRenamed("u", "rid").hint("merge"), "rid", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "rid").alias("root"),
    )
    out = signed.select("rid", "doc_id", "key").join(by_key.hint("merge"), "key", "left").select(
        "rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "rid").alias("root"),
    )
    out = work.write(out, "classes")
    work.drop("rows", "signed", "reps", *(f"links-{d}" for d in range(1, start_depth + 1)))
    heads = out.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "rid")).alias("first"))
    return out.join(heads.hint("merge"), "root").select("rid", "doc_id", "class_id", F.col("first.rid").alias("class_rid"), "n_links")

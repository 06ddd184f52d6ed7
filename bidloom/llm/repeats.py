"""Removal of bytes that 200-byte strings repeat elsewhere.

Prefix classes of suffixes are refined from coarse to fine, as an interleave of shards would be,
and only classes that still hold more than one suffix go on:

1. Sampled 32-byte prefixes.  Of the 169 32-byte strings within each 200-byte string the one of
   least hash is its anchor, so equal 200-byte strings have equal anchors.  Anchors that occur
   once in the corpus end here, with all strings they stand for.
2. Runs.  Consecutive strings with one anchor are a run; a run whose whole bytes occur again is
   repeated as a whole, and one run of each such class stands for the others.
3. Blocks of up to 16 neighbouring strings, for the runs that are left and the ones they may meet.
   The bytes that all strings of a block share are its core: a block whose core is met nowhere
   else ends here, one whose bytes are met again is repeated as a whole.
4. Full 200-byte classes, for the strings of the blocks that are left.

Classes are named by two 64-bit hashes of different functions, that of the anchor and that of the
bytes, so 1e11 different strings meet by chance once in some 1e16 such corpora.  They are counted by
partial aggregation: a passage that a third of all rows share is a few keys whose counts are added
before the shuffle.  Nothing gathers a class in one task.  Texts equal to another text are settled
by their digest and one of them stands for all.  The rows are written once with their keys, and all
later steps read those; tables are deleted when no later step reads them.

Defined edge cases: a null or empty text has no bytes; texts under ``width`` bytes lose nothing;
repeated rows of ``width`` bytes or more lose everything; a very long text is cut into its runs as a
whole, within one task; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import with_row_id
from bidloom.sources.shared import Workspace

WIDTH, ANCHOR, BLOCK = 200, 32, 16
_BYTE = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left ^ (right * _A)) * _B
    out ^= out >> np.uint64(29)
    return out


def rolling(data: bytes, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, by doubling."""
    h, size = _BYTE[np.frombuffer(data, np.uint8)], 1
    if len(h) < width:
        return h[:0]
    while 2 * size <= width:
        h = _pair(h[:-size], h[size:])
        size *= 2
    if size < width:  # two overlapping strings cover the width
        h = _pair(h[: len(h) - (width - size)], h[width - size :])
    return h


def anchors(data: bytes, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``width`` bytes the place of its anchor; and the anchors' hashes."""
    h = rolling(data, anchor)
    span = width - anchor + 1
    if len(h) < span:
        return np.zeros(0, np.int64), h
    low = np.uint64((1 << 30) - 1)
    least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    return (least & low).astype(np.int64), h


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sample(width: int, anchor: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, doc, text in zip(batch["rid"], batch["doc_id"], batch["t"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                at, h = anchors(data, width, anchor)
                own = np.unique(h[np.unique(at)], return_counts=True) if len(at) else (h[:0], np.zeros(0, int))
                out.append((rid, doc, len(data), hashlib.sha256(data).hexdigest(), _as_long(own[0]), own[1].astype(np.int64)))
            yield pd.DataFrame(out, columns=["rid", "doc_id", "n_bytes", "sha", "h", "n"])

    return task, "rid long, doc_id string, n_bytes long, sha string, h array<long>, n array<long>"


def runs_of(data: bytes, chosen: np.ndarray, width: int, anchor: int) -> list[tuple[int, int, int, int, int]]:
    """(first, last, place of the anchor, its hash, class) of each run of strings whose anchor is in sorted ``chosen``."""
    at, h = anchors(data, width, anchor)
    if not len(at) or not len(chosen):
        return []
    cuts = np.flatnonzero(np.diff(at)) + 1
    firsts, lasts = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)])) - 1
    keys = _as_long(h[at[firsts]])
    good = chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys
    out = []
    for a, b, key in zip(firsts[good].tolist(), lasts[good].tolist(), keys[good].tolist(), strict=True):
        p = int(at[a])
        out.append((a, b, p, key, _digest(data[a : b + width], p - a)))
    return out


def _digest(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def blocks_of(data: bytes, a: int, b: int, p: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(block, first, last, core, class) of the blocks of a run; ``data`` starts at the run's first byte.

    Blocks are aligned to the distance of a string's start from its anchor, so that they line up
    in all runs of an anchor, whatever their lengths.
    """
    out = []
    for k in range((p - b) // BLOCK, (p - a) // BLOCK + 1):
        near, far = k * BLOCK, k * BLOCK + BLOCK - 1
        first, last = max(a, p - far), min(b, p - near)
        core = data[p - near - a : p - far + width - a]
        out.append((k, first, last, _digest(core), _digest(data[first - a : last + width - a], p - last)))
    return out


def remove(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_col: str = "doc_id",
           text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes)."""
    work = Workspace(docs.sparkSession)
    rows = with_row_id(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("t")))
    rows = work.write(rows, "rows")
    sampled = work.write(rows.mapInPandas(*_sample(width, anchor)), "anchors")
    same = sampled.filter(F.col("n_bytes") >= width).groupBy("sha").agg(F.min("rid").alias("rid"), F.count("*").alias("c"))
    same = work.write(same, "texts")
    alone = sampled.select("rid", "h", "n").join(same.select("rid"), "rid", "left_semi")
    seen = alone.select("rid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("rid", "x.h", "x.n")
    often = seen.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    chosen = seen.select("rid", "h").join(often, "h").groupBy("rid").agg(F.sort_array(F.collect_set("h")).alias("chosen"))
    texts = work.write(rows.select("rid", "t").join(chosen, "rid"), "shared")
    if not with_text:
        work.drop("rows")

    def find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text, own in zip(batch["rid"], batch["t"], batch["chosen"], strict=True):
                out += [(rid, *r) for r in runs_of(text.encode("utf-8", "surrogatepass"), np.asarray(own), width, anchor)]
            yield pd.DataFrame(out, columns=["rid", "a", "b", "p", "h", "whole"])

    runs = work.write(texts.mapInPandas(find_runs, "rid long, a int, b int, p int, h long, whole long"), "runs")
    classes = work.write(
        runs.groupBy("h", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "a")).alias("head")), "classes"
    )
    # An anchor's strings need comparing where one of its runs is not repeated as a whole and it has several.
    open_ = classes.groupBy("h").agg(F.min("c").alias("least"), F.count("*").alias("k")).filter("least = 1 and k > 1").select("h")
    settled = classes.filter("c > 1").select("h", "whole")
    whole = runs.join(settled, ["h", "whole"], "left_semi").select("rid", "a", "b", F.lit(True).alias("whole"))
    heads = classes.join(open_, "h", "left_semi").select("head.rid", "head.a")
    plan = runs.select("rid", "a", "b", "p", "h").join(heads, ["rid", "a"]).groupBy("rid").agg(
        F.collect_list(F.struct("a", "b", "p", "h")).alias("runs")
    )

    def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text, own in zip(batch["rid"], batch["t"], batch["runs"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(rid, r["a"], r["b"], r["p"], r["h"], data[r["a"] : r["b"] + width]) for r in own]
            yield pd.DataFrame(out, columns=["rid", "a", "b", "p", "h", "bytes"])

    pieces = work.write(
        texts.select("rid", "t").join(plan, "rid").mapInPandas(cut_runs, "rid long, a int, b int, p int, h long, bytes binary"),
        "pieces",
    )

    def find_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                out += [(r.rid, r.a, r.h, *x) for x in blocks_of(r.bytes, r.a, r.b, r.p, width)]
            yield pd.DataFrame(out, columns=["rid", "a", "h", "k", "first", "last", "core", "whole"])

    form = "rid long, a int, h long, k int, first int, last int, core long, whole long"
    blocks = work.write(pieces.mapInPandas(find_blocks, form), "blocks")
    kinds = work.write(
        blocks.groupBy("h", "k", "core", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "a")).alias("head")), "kinds"
    )
    several = kinds.groupBy("h", "k", "core").agg(F.min("c").alias("least"), F.count("*").alias("n"))
    several = several.filter("least = 1 and n > 1").select("h", "k", "core")
    again = kinds.filter("c > 1").select("h", "k", "core", "whole")
    again = blocks.join(again, ["h", "k", "core", "whole"], "left_semi").select("rid", F.col("first").alias("a"), F.col("last").alias("b"))
    left = kinds.join(several, ["h", "k", "core"], "left_semi").select("head.rid", "head.a", "k")
    left = left.groupBy("rid", "a").agg(F.collect_list("k").alias("ks"))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for k in r.ks:
                    first, last = max(r.a, r.p - k * BLOCK - BLOCK + 1), min(r.b, r.p - k * BLOCK)
                    out += [(r.rid, s, r.h, _digest(r.bytes[s - r.a : s - r.a + width])) for s in range(first, last + 1)]
            yield pd.DataFrame(out, columns=["rid", "a", "h", "w"])

    fine = work.write(pieces.join(left, ["rid", "a"]).mapInPandas(strings, "rid long, a int, h long, w long"), "strings")
    twice = fine.groupBy("h", "w").agg(F.count("*").alias("c")).filter("c > 1").select("h", "w")
    single = fine.join(twice, ["h", "w"], "left_semi").select("rid", "a", F.col("a").alias("b")).unionByName(again)
    marks = whole.select("rid", "a", "b").unionByName(single).groupBy("rid").agg(
        F.collect_list(F.struct("a", "b")).alias("marks")
    )
    marks = work.write(marks, "marks")
    work.drop("runs", "classes", "pieces", "blocks", "kinds", "strings")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, text, own in zip(batch["rid"], batch["t"], batch["marks"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, spans, at, end = [], 0, 0, -1
                for a, b in sorted((r["a"], r["b"] + width) for r in own):
                    if a > end:
                        spans += 1
                        kept.append(data[at:a])
                        end = b
                    else:
                        end = max(end, b)
                    at = end
                kept = b"".join([*kept, data[at:]])
                out.append((rid, len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(out, columns=["rid", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.select("rid", "t").join(marks, "rid").mapInPandas(
        cut, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    copies = same.filter("c > 1").select("sha", F.lit(True).alias("copied"))
    out = sampled.drop("h", "n").join(done, "rid", "left").join(copies, "sha", "left")
    gone = F.coalesce("copied", F.lit(False))
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    kept = F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", F.encode(F.coalesce("t", F.lit("")), "utf-8")))
    return out.join(rows.select("rid", "t"), "rid").select(*columns, kept.alias("kept"))

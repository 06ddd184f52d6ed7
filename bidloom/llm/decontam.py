"""Benchmark decontamination with one Aho-Corasick automaton.

Documents and benchmark items are normalised to lower-case words.  Every 13 consecutive words of
an item (all words of a shorter one) are one pattern; one automaton over all patterns reads each
document once, and its matches are mapped to word numbers and to character offsets of the original.

A benchmark whose windows and item ids stay under ``block_bytes`` is the only thing that reaches
every task, as one broadcast; documents do not move, whatever keys or sources are frequent.

A larger one stays in tables.  Documents are read once against a Bloom filter of its windows (64 MB
at most, no misses); only the passages that the filter lets through move, each to the block of the
benchmark that its windows fall into by their hash.  A task meets the patterns of a block, builds
their automaton, and runs the passages of that block through it; a block that many passages fall
into is dealt out over several tasks.  Ids of items are joined to distinct sets of windows
afterwards, so a window that very many items share is no list in a task or on the driver.  Neither
way rewrites the documents for a block, and both give equal rows.

Defined edge cases: a null or empty text has no words, is hit nowhere and is clean; very long texts
are read whole; an item without words never matches; an item whose id is null hits words but adds
nothing to the list of items; repeated rows and ids are judged row by row, repeated item ids count
once; overlapping and equal matches hit a word once; an empty table gives an empty table; an empty
benchmark leaves all documents clean; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm import bloom
from bidloom.llm.common import byte_words, whole_row, with_row_id
from bidloom.sources.shared import Workspace

WINDOW = 13
_U = np.uint64
#: A random odd number that joins hashes of words to that of a window.
_CHAIN = _U(0x8CB92BA72F3D8DD7)
#: Bytes of passages that one task takes of a block.
_SHARE = 32_000_000


def joined(words: list[bytes]) -> str:
    """Words between single spaces, a space at either end, one character a byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(text: str | None, width: int = WINDOW) -> list[str]:
    """The patterns of an item."""
    words = byte_words(text)
    width = min(width, len(words))
    return list(dict.fromkeys(joined(words[i : i + width]) for i in range(len(words) - width + 1) if words))


def window_keys(words: list[bytes], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sizes``, which ascend: a 64-bit key of every window of so many words."""
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    word = np.array([known[w] for w in words], _U)
    key, length = bloom.mix(word), 1
    for size in sizes:
        while length < min(size, len(words)):
            key, length = bloom.mix(key[:-1] * _CHAIN + word[length:]), length + 1
        if length == size and len(words) >= size:
            yield size, key


def window_rows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item`` (null where an item has no id) and ``pattern``, a row for each window of each item."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):  # bounds what is held besides the batch
                part = batch.iloc[at : at + 500]
                own = [windows(text, width) for text in part["t"]]
                pairs = [(i, p) for i, w in zip(part["i"], own, strict=True) for p in w]
                yield pd.DataFrame(pairs, columns=["item", "pattern"], dtype=object)

    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    return items.mapInPandas(task, "item string, pattern string")


def automaton(patterns: Iterable[tuple[str, object]]):
    """An automaton over patterns, each with what it stands for; None without patterns."""
    tree = ahocorasick.Automaton()
    for pattern, own in patterns:
        tree.add_word(pattern, (pattern.count(" ") - 1, own))
    if len(tree):
        tree.make_automaton()
    return tree if len(tree) else None


def matches(tree, line: str) -> Iterator[tuple[int, int, object]]:
    """(first word, number of words, what it stands for) of every pattern in words that are ``joined``."""
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    for end, (size, own) in tree.iter(line):
        yield int(np.searchsorted(gaps, end)) - size, size, own


def char_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each word in characters of the original text."""
    return [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def _judged(text: str | None, n_words: int, runs: Iterable[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """How many words the runs (first word, number of words) hit, and the hit spans of the text in characters."""
    mask = np.zeros(n_words + 2, np.int8)
    for first, size in runs:
        mask[first + 1 : first + size + 1] = 1
    n_hit = int(mask.sum())
    if not n_hit:
        return 0, []
    edge, at = np.diff(mask), char_offsets(text)
    starts, ends = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
    return n_hit, [(at[a][0], at[b - 1][1]) for a, b in zip(starts, ends, strict=True)]


_SPANS = "array<struct<start: long, end: long>>"
_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _texts(batch: pa.RecordBatch, inner: str | None) -> list[str | None]:
    """The texts of a batch: the column ``text``, or the field ``inner`` of ``kept``."""
    return (batch.column("text") if inner is None else batch.column("kept").field(inner)).to_pylist()


def _made(batch: pa.RecordBatch, names: list[str], rows: list[tuple], items: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch, then n_words, n_hit, spans and items."""
    sizes, hits, found = zip(*rows, strict=True) if rows else ((), (), ())
    spans = pa.array([[{"start": a, "end": b} for a, b in own] for own in found], _PAIRS)
    made = [pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), spans, items]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in names), *made], [*names, "n_words", "n_hit", "spans", "items"]
    )


def _by_broadcast(docs: DataFrame, benchmark: DataFrame, width: int, inner: str | None, names: list[str], form) -> DataFrame:
    rows = window_rows(benchmark, width).groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    patterns = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton(patterns.value)
        for batch in batches:
            out, found = [], []
            for text in _texts(batch, inner):
                words = byte_words(text)
                seen = list(matches(tree, joined(words))) if tree is not None and words else []
                out.append((len(words), *_judged(text, len(words), ((f, n) for f, n, _ in seen))))
                found.append(sorted({i for _, _, own in seen for i in own}))
            yield _made(batch, names, out, pa.array(found, pa.list_(pa.string())))

    return docs.mapInArrow(task, form)


def _passages(rows: DataFrame, sizes: list[int], table, blocks: int, inner: str | None) -> DataFrame:
    """Runs of words that the filter lets through: rid, first (word), block, line."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            out = []
            for rid, text in zip(batch.column("rid").to_pylist(), _texts(batch, inner), strict=True):
                words, places = byte_words(text), []
                for size, key in window_keys(words, sizes):
                    at = np.flatnonzero(bloom.held(bits, key))
                    block = (key[at] % _U(blocks)).tolist()
                    places += [(b, a, a + size) for b, a in zip(block, at.tolist(), strict=True)]
                block = first = last = -1
                for b, a, z in [*sorted(places), (-1, 0, 0)]:
                    if b != block or a > last:
                        if block >= 0:
                            out.append((rid, first, block, joined(words[first:last])))
                        block, first, last = b, a, z
                    last = max(last, z)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["rid", "first", "block", "line"]), form)

    form = pa.schema([("rid", pa.int64()), ("first", pa.int64()), ("block", pa.int64()), ("line", pa.string())])
    return rows.mapInArrow(task, "rid long, first long, block long, line string")


def _matched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of a block, then its passages, block after block: rid, first, n, wid of each match."""
    own, tree, patterns = None, None, []
    for batch in rows:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("block", "share", "wid", "rid", "first", "line")]
        for block, share, wid, rid, first, line in zip(*columns, strict=True):
            if (block, share) != own:
                own, tree, patterns = (block, share), None, []
            if rid is None:
                patterns.append((line, wid))
                continue
            if tree is None:
                tree, patterns = automaton(patterns), []
            if tree is not None:
                out += [(rid, first + f, n, w) for f, n, w in matches(tree, line)]
        form = pa.schema([(c, pa.int64()) for c in ("rid", "first", "n", "wid")])
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=form.names, dtype="int64"), form)


def _by_blocks(docs: DataFrame, benchmark: DataFrame, width: int, inner: str | None, names: list[str], form, blocks: int) -> DataFrame:
    spark = docs.sparkSession
    work = Workspace(spark)
    members = work.write(window_rows(benchmark, width).distinct(), "members")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["pattern"].str.count(" ").to_numpy(np.int64) - 1
            key = np.zeros(len(batch), _U)
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                lines = "".join(batch["pattern"].iloc[own]).encode("latin-1").split()
                key[own] = next(window_keys(lines, (int(n),)))[1][:: int(n)]
            yield batch.assign(n=size, key=key.view(np.int64), block=(key % _U(blocks)).view(np.int64))

    table = with_row_id(members.select("pattern").distinct(), "wid")
    table = work.write(table.mapInPandas(keyed, "pattern string, wid long, n long, key long, block long"), "windows")
    sizes = [r.n for r in table.select("n").distinct().orderBy("n").collect()]  # at most `width` rows
    places = bloom.blocks_for(table.count(), 1 << 23)
    bits = spark.sparkContext.broadcast(bloom.built(table.select("key"), places))

    rows = work.write(with_row_id(docs), "rows")
    passages = work.write(_passages(rows, sizes, bits, blocks, inner), "passages")
    shares = passages.groupBy("block").agg(F.ceil(F.sum(F.octet_length("line")) / F.lit(_SHARE)).alias("shares"))
    none = F.lit(None).cast("long")
    heads = table.join(shares, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "wid",
        none.alias("rid"), none.alias("first"), F.col("pattern").alias("line"),
    )
    lines = passages.join(shares, "block").select(
        "block", F.pmod("rid", "shares").alias("share"), none.alias("wid"), "rid", "first", "line"
    )
    met = heads.unionByName(lines).repartition("block", "share").sortWithinPartitions("block", "share", F.col("rid").asc_nulls_first())
    met = met.mapInArrow(_matched, "rid long, first long, n long, wid long")
    found = met.groupBy("rid").agg(
        F.collect_set(F.struct("first", "n")).alias("runs"), F.sort_array(F.collect_set("wid")).alias("wids")
    )
    found = work.write(found, "found")
    ids = found.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(table.select("wid", "pattern"), "wid")
    ids = ids.join(members, "pattern").groupBy("wids").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = work.write(found.join(ids, "wids").select("rid", "runs", "items"), "named")
    work.drop("members", "windows", "passages", "found")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(_texts(batch, inner), batch.column("runs").to_pylist(), strict=True):
                n = len(byte_words(text))
                out.append((n, *_judged(text, n, ((r["first"], r["n"]) for r in runs or ()))))
            yield _made(batch, names, out, batch.column("items"))

    whole = rows.join(found, "rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return whole.mapInArrow(task, form)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", keep: tuple[str, ...] = (), block_bytes: int = 8_000_000) -> DataFrame:
    """One row per input row: n_words, n_hit, the items found, the hit spans in characters of the
    text, and the verdict.

    The columns that ``keep`` names come along in the struct ``kept``.
    """
    # Each word starts a window of at most `width` words, and a word and its gap take two bytes or more.
    size = F.octet_length(F.col("text").cast("string")).cast("long")
    ids = F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 8
    bound = benchmark.agg(F.sum(size * width + ids * (size / 2 + 1))).first()[0] or 0
    blocks = max(1, -(-int(bound) // block_bytes))
    carried = [whole_row(keep, "kept")] if keep else []
    inner = text_col if text_col in keep else None  # then the text travels within the struct only
    text = [F.col(text_col).alias("text")] if inner is None else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *carried, *text)
    names = ["doc_id", *(["kept"] if keep else [])]
    void = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items")]
    form = rows.select(*names, *void).schema
    if blocks == 1:
        out = _by_broadcast(rows, benchmark, width, inner, names, form)
    else:
        out = _by_blocks(rows, benchmark, width, inner, names, form, blocks)
    return out.select(
        *names, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )

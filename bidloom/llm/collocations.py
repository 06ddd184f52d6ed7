"""Phrase collocations by prefix-free parsing.

Every piece of a text (what lies between marks of punctuation) is parsed into chunks.  A chunk ends
where a word whose hash is a trigger begins, so equal passages are cut alike wherever they stand, and
it carries as many words of the next chunk as a phrase can reach into it.  Distinct chunks form a
dictionary with their frequencies.  Phrases are counted inside distinct chunks, weighted; a phrase
belongs to the chunk in whose own words it begins, so overlaps count once.

Counting takes three passes over the dictionary.  The first two count 64-bit hashes of phrases, of
one and two words, then of longer ones made of frequent pairs; hashes that reach the least count go
into a Bloom filter.  The last counts the phrases themselves, as text, where the filter holds them.
Neither a collision of hashes nor a false positive changes a result: both only add phrases that the
last pass counts and drops.  The filter has at most ``most_blocks`` 64-bit blocks (16 MB); where the
corpus has more frequent phrases than that holds well, more phrases are counted, never fewer.

Skew: each task sums equal phrases of some millions of words before the shuffle, so a word pair that
makes up a third of the corpus is one row per such block.  Joins of phrases to the counts of their
parts are ordinary shuffle joins, whose large partitions Spark splits.

Defined edge cases: null and empty texts have no words; a null language is ``und``; very long texts,
pieces and words are parsed whole; repeated rows count each; extra columns are ignored; an empty
table gives an empty table; ties of scores go by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm import bloom
from bidloom.sources.shared import Workspace

_U = np.uint64
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAPS = _ENDS | np.isin(np.arange(256), list(b" \t"))
#: Two independent hashes of words: a base, and a number for each byte.
_BASES = (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F)
_BYTES = tuple(bloom.mix(np.arange(1, 257, dtype=_U) * _U(b)) for b in _BASES)
_CHAIN = _U(0xA24BAED4963EE407)
#: Words that are summed before they are shuffled, and distinct chunks that are.
_ROOM, _CHUNKS = 1_000_000, 100_000


class Words:
    """All words of a buffer of bytes: where they stand, their pieces and their hashes."""

    def __init__(self, data: bytes):
        self.data, self.buffer = data, np.frombuffer(data, np.uint8)
        inside = ~_GAPS[self.buffer]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.letters = self.buffer[inside]
        #: Number of the piece of each word; pieces without words leave gaps.
        self.piece = np.searchsorted(np.flatnonzero(_ENDS[self.buffer]), self.start)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0, room: int = 100_000) -> np.ndarray:
        length, out = self.end - self.start, np.zeros(len(self), _U)
        power = bloom.powers(_BASES[which], int(length.max(initial=1)))
        done = 0
        for k in range(0, len(self), room):  # what a letter takes is held for some words at a time
            own = length[k : k + room]
            first = np.cumsum(own) - own
            n = int(own.sum())
            at = np.arange(n) - np.repeat(first, own)
            out[k : k + room] = np.add.reduceat(_BYTES[which][self.letters[done : done + n]] * power[at], first)
            done += n
        return bloom.mix(out)


def parse(docs: DataFrame, overlap: int, every: int) -> DataFrame:
    """Chunks of (lang, t) with how often a task met them: lang, chunk, n_own (words it does not share), freq."""

    def chunks(found: Counter, langs: list[str], texts: list[str]) -> None:
        coded = [t.encode() for t in texts]
        words = Words(b"\n".join(coded).translate(_LOWER))
        if not len(words):
            return
        borders = np.cumsum([len(c) + 1 for c in coded])
        fresh = np.ones(len(words), bool)
        fresh[1:] = words.piece[1:] != words.piece[:-1]
        ends = np.append(np.flatnonzero(fresh), len(words))
        at = np.flatnonzero(fresh | (words.hashes() % _U(every) == 0))
        till = np.append(at[1:], len(words))
        piece_end = ends[np.searchsorted(ends, at, "right")]
        last = words.end[np.minimum(till + overlap, piece_end) - 1]
        doc = np.searchsorted(borders, words.start[at], "right")
        data = words.data
        for d, s, e, n in zip(doc.tolist(), words.start[at].tolist(), last.tolist(), (till - at).tolist(), strict=True):
            found[langs[d], data[s:e], n] += 1

    def rows(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())],
            ["lang", "chunk", "n_own", "freq"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            langs, texts, room, k = batch.column("lang").to_pylist(), batch.column("t").to_pylist(), 0, 0
            for j, t in enumerate(texts):
                room += len(t)
                if room > 1_000_000 or j + 1 == len(texts):
                    chunks(found, langs[k : j + 1], texts[k : j + 1])
                    room, k = 0, j + 1
                    if len(found) > _CHUNKS:
                        yield rows(found)
                        found = Counter()
        yield rows(found)

    made = docs.mapInArrow(task, "lang string, chunk binary, n_own int, freq long")
    return made.groupBy("lang", "chunk", "n_own").agg(F.sum("freq").alias("freq"))


class Phrases:
    """Phrases of some chunks of the dictionary, as keys of the words at which they begin."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = Words(b"\n".join(batch.column("chunk").to_pylist()))
        owns = batch.column("n_own").to_numpy(zero_copy_only=False)
        chunk = self.words.piece
        first = np.searchsorted(chunk, np.arange(len(owns)))
        self.chunk, self.own = chunk, np.arange(len(chunk)) - first[chunk] < owns[chunk]
        self.freq = batch.column("freq").to_numpy(zero_copy_only=False)[chunk]
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[chunk]
        self.tongue = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], _U)[self.lang]

    def keys(self, n: int, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For lengths 1 to n: the length, a key for each word, and whether a phrase of its chunk begins there."""
        word = self.words.hashes(which)
        key, size = word, len(word)
        for k in range(1, n + 1):
            inside = self.own.copy()
            if k > 1:
                key = np.concatenate([bloom.mix(key[: size - k + 1] * _CHAIN + word[k - 1 :]), np.zeros(min(k - 1, size), _U)])[:size]
                inside[max(0, size - k + 1) :] = False
                inside[: max(0, size - k + 1)] &= self.chunk[: max(0, size - k + 1)] == self.chunk[k - 1 :]
            yield k, bloom.mix(key ^ self.tongue), inside


def _summed(keys: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and the order that groups them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(freq[order], first) if len(first) else freq[:0], order


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of some ``_ROOM`` words."""
    held, room = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):  # one batch may hold many words
            part = batch.slice(at, 2000)
            held.append(part)
            room += pc.sum(part.column("n_own")).as_py()
            if room > _ROOM:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, room = [], 0
    if room:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def frequent_short(book: DataFrame, least: int) -> DataFrame:
    """Keys of phrases of one and two words that reach the least count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            phrases = Phrases(block)
            for _, key, inside in phrases.keys(2):
                made, n, _ = _summed(key[inside], phrases.freq[inside])
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(n)], ["key", "n"])

    return book.mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_long(book: DataFrame, short: np.ndarray, least: int, longest: int) -> DataFrame:
    """Keys of phrases of three words or more that reach it; all pairs in them must be frequent."""
    shared = book.sparkSession.sparkContext.broadcast(short)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            phrases, good = Phrases(block), None
            for k, key, inside in phrases.keys(longest):
                if k == 2:
                    pair = np.zeros(len(key), bool)
                    pair[inside] = bloom.held(shared.value, key[inside])
                    # Pairs that begin in shared words count too where a phrase runs on into them.
                    tail = np.flatnonzero(~phrases.own[:-1] & (phrases.chunk[1:] == phrases.chunk[:-1]))
                    pair[tail] = bloom.held(shared.value, key[tail])
                    good = pair
                if k > 2:
                    good = good.copy()
                    good[: len(good) - k + 2] &= pair[k - 2 :]
                    at = inside & good
                    made, n, _ = _summed(key[at], phrases.freq[at])
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(n)], ["key", "n"])

    return book.mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(book: DataFrame, frequent: np.ndarray, least: int, longest: int) -> DataFrame:
    """Phrases of up to ``longest`` words that reach the least count: lang, size, phrase, f."""
    shared = book.sparkSession.sparkContext.broadcast(frequent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            phrases = Phrases(block)
            data, start, end = phrases.words.data, phrases.words.start, phrases.words.end
            for (k, key, inside), (_, check, _) in zip(phrases.keys(longest), phrases.keys(longest, 1), strict=True):
                at = np.flatnonzero(inside)
                at = at[bloom.held(shared.value, key[at])]
                made, n, order = _summed(key[at], phrases.freq[at])
                at = at[order]
                first = np.searchsorted(key[at], made)
                same = check[at] == np.repeat(check[at[first]], np.diff(np.append(first, len(at))))
                found: Counter = Counter()
                if same.all():
                    picked = zip(at[first].tolist(), n.tolist(), strict=True)
                else:  # two phrases of one key: each occurrence by its text
                    picked = zip(at.tolist(), phrases.freq[at].tolist(), strict=True)
                for x, c in picked:
                    found[phrases.lang[x], b" ".join(data[start[x] : end[x + k - 1]].split())] += c
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([phrases.langs[i] for i, _ in keys], pa.string()), pa.array([k] * len(keys), pa.int32()),
                     pa.array([p.decode() for _, p in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "size", "phrase", "f"],
                )

    counts = book.mapInArrow(task, "lang string, size int, phrase string, f long")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def counted(docs: DataFrame, work: Workspace, least: int = 100, longest: int = 5, every: int = 24, most_blocks: int = 1 << 21,
            text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``(words, phrases)``: all words per language (lang, n), and frequent phrases of 1 to ``longest`` words."""
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("t"))
    book = work.write(parse(rows, longest - 1, every), "dictionary")
    n = book.groupBy("lang").agg(F.sum(F.col("freq") * F.col("n_own")).alias("n"))
    short = work.write(frequent_short(book, least).select("key"), "short")
    pairs = bloom.built(short, bloom.blocks_for(short.count(), most_blocks))
    long = work.write(frequent_long(book, pairs, least, longest).select("key"), "long")
    every_key = short.unionByName(long)
    both = bloom.built(every_key, bloom.blocks_for(every_key.count(), most_blocks))
    found = work.write(phrase_counts(book, both, least, longest), "phrases")
    n = work.write(n, "totals")
    work.drop("dictionary", "short", "long")
    return n, found


def scored(totals: DataFrame, phrases: DataFrame, work: Workspace, share: int = 100) -> DataFrame:
    """Candidates by their lowest-scoring cut, without those that a longer one stands for: lang, phrase, a, l, r, n, score."""
    parts = F.split("phrase", " ")
    size = F.size(parts)
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(parts, 1, k), " ").alias("left"), F.array_join(F.slice(parts, k + 1, size - k), " ").alias("right")))
    wanted = phrases.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = wanted.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    # Products may pass 64 bits: 38 digits hold frequencies up to 10^17.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumn("top", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(22,0)") * F.col("n").cast("decimal(16,0)"))
    met = met.withColumn("score", F.expr("top div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    best = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda s: F.array_join(F.slice(parts, s, m), " "))))
    within = phrases.filter("size > 2").select("lang", F.col("f"), F.explode(inner).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = best.join(within, ["lang", "phrase"], "left")
    return out.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def mine(docs: DataFrame, top: int = 2000, share: int = 100, **counts) -> DataFrame:
    """Each language's first ``top`` collocations with their rank; ``counts`` are parameters of ``counted``."""
    work = Workspace(docs.sparkSession)
    totals, phrases = counted(docs, work, **counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = scored(totals, phrases, work, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    # First within sixteenths, so that no task ranks a whole language.
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

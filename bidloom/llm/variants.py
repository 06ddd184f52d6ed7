"""Spelling variants: words one edit apart, and the form that each rare spelling stands for.

The vocabulary is counted by Spark functions.  Each word then generates its edits: every deletion,
and every replacement of a letter by a larger one.  An insertion is a deletion of the longer word,
and a smaller letter is a replacement seen from the other word, so each pair of near words comes
from one of the two, once.  Edits are probed against Bloom filters that are broadcast, one shard per
word length with blocks for its words; only those that a filter holds are shuffled, to an exact join
with the vocabulary that removes what it holds in error.

Bound: a filter has at most ``most_blocks`` 64-bit blocks (64 MB), with 32 bits or more for each
word.  A larger vocabulary is taken in parts by a hash of the word, each with filters of its own
against which all words are probed, so the share of false positives stays the same.  Edits of a word
are generated in blocks of bounded size, however long it is.

Skew: words are counted within tasks before the shuffle, so a word with a third of all occurrences
is one row per task.  A word has no more near words than it has edits, in letters that occur.

Forms are followed by doubling: what a form stands for is joined to it until nothing changes.  Each
step at least multiplies the occurrences by ``ratio``, so few rounds do.

Defined edge cases: null and empty texts have no words; a null id counts as empty text in the
checksum; very long texts and runs are taken whole; repeated rows count each; extra columns are
ignored; an empty table, or one without words, gives an empty table; ties go to the smallest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm import bloom
from bidloom.llm.common import lower_ascii
from bidloom.sources.shared import Workspace

_U = np.uint64
_BASE, _LETTER = 0x2545F4914F6CDD1D, _U(0x9FB21C651E98DF25)
#: Positions whose edits are held at a time.
_ROOM = 8192


def dropped_letter(run: Column, doc_id: Column, every: int = 31) -> Column:
    """The run without one letter where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 7, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct words with their occurrences ``n``; a dropped letter never lengthens, so shorter runs stay out."""
    runs = F.regexp_extract_all(text_col, F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % least_length), F.lit(0))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = words.select(dropped_letter(lower_ascii(F.col("run")), F.col("id")).alias("word"))
    counts = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


class Letters:
    """Words of one batch as flat arrays: code point, word and place of every letter, and their hashes."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U)
        first = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.at = np.arange(len(self.code)) - first[self.word]
        self.power = bloom.powers(_BASE, int(self.length.max()) + 1)
        here = self.value(self.code) * self.power[self.at]
        # Running sums over the whole batch; differences of them are sums within a word.
        self.upto = np.concatenate([np.zeros(1, _U), np.cumsum(here, dtype=_U)])
        moved = self.value(self.code) * self.power[np.maximum(self.at - 1, 0)]
        self.moved = np.concatenate([np.zeros(1, _U), np.cumsum(moved, dtype=_U)])
        self.first, self.end = first, first + self.length
        self.sums = self.upto[self.end] - self.upto[first]

    @staticmethod
    def value(code: np.ndarray) -> np.ndarray:
        return bloom.mix(code * _LETTER + _U(1))

    def without(self, k: np.ndarray) -> np.ndarray:
        """Hashes of the words without their k-th letters (k counts through the batch)."""
        w = self.word[k]
        return self.upto[k] - self.upto[self.first[w]] + self.moved[self.end[w]] - self.moved[k + 1]

    def replaced(self, k: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes with the k-th letters replaced by each of ``codes``, as rows of columns."""
        other = self.value(codes)[None, :] - self.value(self.code[k])[:, None]
        return self.sums[self.word[k]][:, None] + other * self.power[self.at[k]][:, None]


class Shards:
    """Bloom filters of one vocabulary by word length, in one array; ``codes`` are the letters that occur."""

    def __init__(self, sizes: dict[int, int], most_blocks: int):
        self.blocks, total = {}, 1
        self.start = {}
        for length in sorted(sizes):
            self.start[length] = total
            self.blocks[length] = bloom.blocks_for(sizes[length], most_blocks, 64)
            total += self.blocks[length]
        # Lengths without words probe one block that stays empty.
        self.table, self.codes = np.zeros(total, _U), np.zeros(0, _U)

    def lookup(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, back = np.unique(length, return_inverse=True)
        start = np.array([self.start.get(int(x), 0) for x in known], np.int64)
        size = np.array([self.blocks.get(int(x), 1) for x in known], _U)
        return start[back], size[back]

    def fill(self, words: DataFrame) -> None:
        """Set the bits of all words: an aggregation by block, of which the driver gets at most all blocks."""
        shape = self

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                own = Letters(batch["word"].tolist())
                start, size = shape.lookup(own.length)
                key = bloom.mix(own.sums)
                block = start + bloom.place(key, size).view(np.int64)
                codes = np.unique(own.code).view(np.int64)
                yield pd.DataFrame({
                    "block": np.concatenate([block, -1 - codes]),
                    "mask": np.concatenate([bloom.bits(key).view(np.int64), np.zeros(len(codes), np.int64)]),
                })

        rows = words.mapInPandas(task, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
        block, mask = rows["block"].to_numpy(), rows["mask"].to_numpy().view(_U)
        self.table[block[block >= 0]] = mask[block >= 0]
        self.codes = np.sort(-1 - block[block < 0]).astype(_U)

    def held(self, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        want = bloom.bits(key)
        return (self.table[start + bloom.place(key, size).view(np.int64)] & want) == want


def candidates(words: DataFrame, shards: Shards) -> DataFrame:
    """Edits of all words that the filters hold: word, n, other."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(shards)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = shared.value
        for batch in batches:
            if not len(batch):
                continue
            own, n = Letters(batch["word"].tolist()), batch["n"].to_numpy()
            same, shorter = filters.lookup(own.length), filters.lookup(own.length - 1)
            made: list[tuple[int, str]] = []
            for k in range(0, len(own.code), _ROOM):
                at = np.arange(k, min(k + _ROOM, len(own.code)))
                w = own.word[at]
                # Of equal letters in a row only the first is deleted: the others give the same word.
                fresh = (own.at[at] == 0) | (own.code[at] != own.code[at - 1])
                hit = fresh & filters.held(bloom.mix(own.without(at)), shorter[0][w], shorter[1][w])
                for x in at[hit]:
                    word, i = own.words[own.word[x]], own.at[x]
                    made.append((own.word[x], word[:i] + word[i + 1 :]))
                hit = filters.held(bloom.mix(own.replaced(at, filters.codes)), same[0][w][:, None], same[1][w][:, None])
                hit &= filters.codes[None, :] > own.code[at][:, None]
                for x, c in zip(*np.nonzero(hit), strict=True):
                    word, i = own.words[w[x]], own.at[at[x]]
                    made.append((w[x], word[:i] + chr(filters.codes[c]) + word[i + 1 :]))
            of = np.array([k for k, _ in made], np.int64)
            yield pd.DataFrame({"word": batch["word"].to_numpy()[of], "n": n[of], "other": [x for _, x in made]})

    return words.mapInPandas(task, "word string, n long, other string")


def near_words(words: DataFrame, work: Workspace, most_blocks: int = 1 << 23) -> DataFrame:
    """Both directions of all pairs of words (word, n) that are one edit apart: word, other, other_n."""
    parts = max(1, -(-2 * words.count() // most_blocks))
    found = None
    for part in range(parts):
        some = words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part) if parts > 1 else words
        lengths = some.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()
        shards = Shards({r.length: r.n for r in lengths}, most_blocks)
        shards.fill(some)
        met = candidates(words, shards).join(some.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        met = work.write(met, f"pairs-{part}")
        found = met if found is None else found.unionByName(met)
    back = found.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.select("word", "other", "other_n").unionByName(back)


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """What each word (word, form) stands for when its forms are followed to the last: word, root."""
    now, step = work.write(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step += 1
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = work.write(out, f"roots-{step}")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def group(docs: DataFrame, ratio: int = 10, most_blocks: int = 1 << 23, **columns) -> DataFrame:
    """One row per word: form, root, n, n_near, form_n; ``columns`` are those of ``vocabulary``."""
    work = Workspace(docs.sparkSession)
    words = work.write(vocabulary(docs, **columns), "words")
    near = near_words(words, work, most_blocks)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.n") >= ratio * F.col("n"), -F.col("best.n")))
    judged = work.write(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
        F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form")), "judged")
    last = roots(judged.filter("form is not null"), work)
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

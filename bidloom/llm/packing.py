"""Hierarchical packing into several context sizes.

Tiers are powers of two up to ``limit`` tokens.  A document gives whole windows of ``limit``
tokens while it is long enough; what is left is routed to the smallest tier that holds it.  Each
tier is packed first-fit into its own windows; a tier's windows that stay open hand their pieces
to the next longer tier, where they fill the gaps of long windows, and pieces may be cut at a gap.
Whatever is open at the end of a task is cut at powers of two, so only tails that a piece no
longer fills are padded.  Step groups take windows of a tier in turn, and each task begins with
another group, so neither a task's windows nor the few that each of many tasks has of a tier gather
in one group, and their token counts stay even.

Packing needs no order across documents, so each task packs its own rows and nothing is
shuffled; a task keeps a bounded number of open windows.  Sequence ids come from the partition
number of the input split and a counter, the same whenever a task is run again.

Each word between ASCII white space is tokenised once per Python worker and kept in a bounded table, as
the tokenizer never joins anything across white space (its pieces that close a word end in
``</w>``).

Defined edge cases: a null or empty text is its closing id alone; repeated rows and ids are
packed row by row; very long texts are cut into as many windows as they fill; windows of equal room
are filled in the order in which they were opened; extra columns are ignored; an empty table gives an
empty table; a tokenizer that joins anything across white space is an error.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of one row per document and sequence.
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group int"
)
_UNIT = re.compile(r"[^ \t\n\x0b\f\r]+")
#: White space, or what tokenizers write for it, with something at either side.
_CROSSES = re.compile("[^\\s\u0120\u010a\u2581][\\s\u0120\u010a\u2581]+[^\\s\u0120\u010a\u2581]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _worker_tables() -> dict:
    """Tables that stay with a Python worker, which serves many tasks: this package comes to each task anew."""
    home = sys.modules.setdefault("bidloom_worker_tables", types.ModuleType("bidloom_worker_tables"))
    return home.__dict__


class WordTokenizer:
    """Ids of a text as bytes of little-endian 32-bit numbers, by a table of its words.

    The table has two generations of at most ``words`` entries each: a full one becomes the old
    one, and words that are met again move to the new one.  So frequent words stay and memory is
    bounded.
    """

    def __init__(self, path: str, words: int = 600_000):
        import tokenizers

        self.tool, self.words = tokenizers.Tokenizer.from_file(path), words
        self.kept = _worker_tables().setdefault(path, {"new": {}, "old": {}})
        self.table = self.kept["new"]
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        size = self.tool.get_vocab_size()
        self.last = np.array([(self.tool.id_to_token(k) or "").endswith("</w>") for k in range(size)])

    def add(self, texts: list[list[str]]) -> None:
        """Tokenise at once all words of ``texts`` (lists of words) that the table lacks.

        Punctuation after a letter or digit is a token run of its own, so it is looked up apart
        and words that differ by it share their letters' entry.
        """
        if len(self.table) > self.words:
            self.kept["old"], self.kept["new"] = self.table, {}
            self.table = self.kept["new"]
        table, old = self.table, self.kept["old"]
        new = [w for w in set().union(*texts) if w not in table]
        table.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        split = {}
        for w in new:
            core = w.rstrip(_MARKS)
            if core and core != w and core[-1].isalnum() and not any(x in w for x in self.special):
                split[w] = (core, w[len(core) :])
        parts = {p for pair in split.values() for p in pair} | {w for w in new if w not in split}
        table.update((p, old[p]) for p in parts if p in old)
        parts = [p for p in parts if p not in table]
        letters = [p for p in parts if p.isalpha()]
        for at in range(0, len(letters), 2000):
            self._letters(letters[at : at + 2000])
        self._each([p for p in parts if p not in table])
        for w, (core, marks) in split.items():
            table[w] = table[core] + table[marks]

    def _letters(self, words: list[str]) -> None:
        """Words of letters, as one text: each ends with the only closing piece it has."""
        got = self.tool.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(got, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a letter that decomposes; such blocks go word by word
            self._each(words)
            return
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.table[word] = data[at:end]
            at = end

    def _each(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for word, got in zip(part, self.tool.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.table[word] = np.array(got.ids, dtype="<u4").tobytes()

    def ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.table.__getitem__, words))


def check_tokenizer(path: str) -> None:
    """Refuse a tokenizer whose tokens can cross white space, or that reads a word by what is around it."""
    import tokenizers

    tool = tokenizers.Tokenizer.from_file(path)
    tool.no_truncation()
    words = ["a", "B", "'s", "it's", "9", "(x)", "--", "é", "中文", "end."]
    for gap in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"):
        for left, right in zip(words, words[1:] + words[:1], strict=True):
            apart = [tool.encode(w, add_special_tokens=False).ids for w in (left, right)]
            if tool.encode(gap + left + gap + right + gap, add_special_tokens=False).ids != apart[0] + apart[1]:
                raise ValueError(f"the tokenizer does not read {left!r} and {right!r} apart across {gap!r}")
    for token in tool.get_vocab():
        if _CROSSES.search(token.removesuffix("</w>")):
            raise ValueError(f"token {token!r} crosses white space")


def split_words(text: str | None) -> list[str]:
    return _UNIT.findall(text or "")


class Packer:
    """Packs documents of one task; ``rows`` are finished pieces.

    An open window is a list of (document, start, length); ``open[t]`` holds the windows of tier
    ``t`` that still have room, by room left.
    """

    def __init__(self, base: int, limit: int, smallest: int, groups: int, most_open: int, turn: int = 0):
        self.base, self.limit, self.groups, self.most_open, self.turn = base, limit, groups, most_open, turn
        self.tiers = [1 << k for k in range(smallest.bit_length() - 1, limit.bit_length())]
        self.open: dict[int, list[list]] = {t: [] for t in self.tiers}  # [room, pieces]
        self.count = 0
        self.given = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def close(self, pieces: list, tier: int) -> None:
        at, seq = 0, self.base + self.count
        group = (self.turn + self.given.get(tier, 0)) % self.groups
        self.given[tier] = self.given.get(tier, 0) + 1
        self.count += 1
        for doc, start, length in pieces:
            ids = doc[1][4 * start : 4 * (start + length)]
            self.rows.append((doc[0], start, length, zlib.crc32(ids), len(doc[1]) // 4, seq, at, tier, group))
            at += length

    def add(self, doc: tuple) -> None:
        total, start = len(doc[1]) // 4, 0
        while total - start >= self.limit:
            self.close([(doc, start, self.limit)], self.limit)
            start += self.limit
        if start < total:
            self.place((doc, start, total - start), next(t for t in self.tiers if t >= total - start))

    def place(self, piece: tuple, tier: int) -> None:
        """First fit among the open windows of a tier; else a new one."""
        windows = self.open[tier]
        for k, window in enumerate(windows):
            if window[0] >= piece[2]:
                window[1].append(piece)
                window[0] -= piece[2]
                if not window[0]:
                    self.close(window[1], tier)
                    windows.pop(k)
                return
        if piece[2] == tier:
            self.close([piece], tier)
            return
        windows.append([tier - piece[2], [piece]])
        if len(windows) > self.most_open:
            self.promote(tier)

    def promote(self, tier: int) -> None:
        """Hand the pieces of the fullest half of a tier's open windows to the next tier.

        In the longest tier they fill the gaps of the other windows, cut where a gap ends.
        """
        windows = sorted(self.open[tier], key=lambda w: w[0])
        half = (len(windows) + 1) // 2
        self.open[tier] = windows[half:] if tier != self.limit else []
        if tier != self.limit:
            for _, pieces in windows[:half]:
                for piece in pieces:
                    self.place(piece, 2 * tier)
            return
        keep, spill = windows[:half], [p for _, pieces in windows[half:] for p in pieces]
        spill.sort(key=lambda p: -p[2])
        for window in keep:
            while window[0] and spill:
                doc, start, length = spill.pop()
                take = min(window[0], length)
                window[1].append((doc, start, take))
                window[0] -= take
                if take < length:
                    spill.append((doc, start + take, length - take))
            if window[0]:
                self.open[tier].append(window)
            else:
                self.close(window[1], tier)
        for piece in spill:
            self.place(piece, self.limit)

    def finish(self) -> None:
        """Join all open pieces, longest tier last, and cut them at the limit, the end at powers of two."""
        pieces = [p for t in reversed(self.tiers) for _, own in self.open[t] for p in own]
        self.open = {t: [] for t in self.tiers}
        total = sum(p[2] for p in pieces)
        pieces.reverse()
        while total:
            size = self.limit if total >= self.limit else 1 << (total.bit_length() - 1)
            window, room = [], size
            while room:
                doc, start, length = pieces.pop()
                take = min(room, length)
                window.append((doc, start, take))
                room -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            self.close(window, size)
            total -= size


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, smallest: int = 256, end_id: int = 1,
         groups: int = 8, most_open: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    check_tokenizer(tokenizer)
    closing = np.array([end_id], dtype="<u4").tobytes()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = WordTokenizer(tokenizer)
        number = TaskContext.get().partitionId()
        packer = Packer(number << 36, limit, smallest, groups, most_open, number)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(packer.rows, columns=names)
            packer.rows = []
            return frame.assign(doc_id=pd.array(frame["doc_id"], dtype="Int64"))

        for batch in batches:
            for at in range(0, len(batch), 500):
                texts = [split_words(x) for x in batch["text"].iloc[at : at + 500]]
                words.add(texts)
                for doc, text in zip(batch["doc_id"].iloc[at : at + 500].tolist(), texts, strict=True):
                    packer.add((None if doc is None else int(doc), words.ids(text) + closing))
            yield out()
        packer.finish()
        yield out()

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(task, SCHEMA)

"""Token counts by distinct pre-token.

The tokenizer never joins pieces across the start of a space run or a line feed, so a text is a
sequence of independent pre-tokens.  Each text is split once, into its distinct pre-tokens and how
often it has each; that table of frequencies is written with a row key.  Each distinct pre-token of
the corpus is tokenised once, and the frequencies join these piece counts and are summed per
document.  Ids are never held.

Skew: a pre-token that makes up more than 1/``head`` of all frequencies is frequent.  There can be
at most ``head`` such pre-tokens, and only those of at most 32 bytes are taken, so their table has a
proven bound (some 150 MB at the default; where the r-th pre-token is 1/r as frequent as the first,
they are a twentieth of that) and is broadcast; they are summed within the task that reads them.
The others are shuffled to their piece counts, once per document that has them.

Defined edge cases: a null or empty text has no tokens; very long texts are split whole, and very
long pre-tokens are tokenised whole; repeated rows and ids are counted row by row; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import with_row_id
from bidloom.sources.shared import Workspace

MARK = "▁"
_PIECE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def pretokens(text: str) -> Counter:
    """Pre-tokens of a text and how often it has each; line feeds are left out, each is one token of its own."""
    found: Counter = Counter()
    for line in (MARK + text.replace(" ", MARK)).split("\n"):
        found.update(_PIECE.findall(line))
    return found


def check_model(path: str) -> None:
    """Refuse a model whose pieces can cross a pre-token's borders."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    if model.encode("\nx")[:2] != [model.piece_to_id(MARK), model.piece_to_id("<0x0A>")]:
        raise ValueError("the model does not treat a line feed as one token of its own")


def frequencies(rows: DataFrame) -> DataFrame:
    """Per row its key, id, bytes, line feeds, and its distinct pre-tokens with their counts.

    Pre-tokens hold no line feed, so they are kept sorted as the lines of one string, which takes
    two thirds of the room of an array.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds what is held besides the batch
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("t").to_pylist()]
                own = [sorted(pretokens(t).items()) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array([t.count("\n") for t in texts], pa.int64()),
                     pa.array(["\n".join(p for p, _ in c) if c else None for c in own], pa.string()),
                     pa.array([[n for _, n in c] for c in own], pa.list_(pa.int32()))],
                    ["rid", "doc_id", "n_bytes", "n_lines", "pieces", "counts"],
                )

    return rows.mapInArrow(task, "rid long, doc_id long, n_bytes long, n_lines long, pieces string, counts array<int>")


def piece_counts(vocabulary: DataFrame, path: str) -> DataFrame:
    """Adds ``n_pieces`` to distinct pre-tokens ``p``; a leading line feed keeps the text as it is."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = ["\n" + p.replace(MARK, " ") for p in batch["p"]]
            yield batch.assign(n_pieces=[len(x) - 2 for x in model.encode(texts, num_threads=1)])

    return vocabulary.mapInPandas(task, "p string, docs long, n_pieces long")


def count(docs: DataFrame, model: str, limit: int = 4096, head: int = 2_000_000, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: n_bytes, n_tokens and whether they are over the limit."""
    check_model(model)
    work = Workspace(docs.sparkSession)
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")))
    rows = work.write(frequencies(rows), "frequencies")
    parts = rows.select("rid", F.inline(F.arrays_zip(F.split("pieces", "\n").alias("p"), F.col("counts").alias("c"))))
    vocabulary = work.write(piece_counts(parts.groupBy("p").agg(F.count("*").alias("docs")), model), "vocabulary")
    total = vocabulary.agg(F.sum("docs")).first()[0] or 0
    frequent = (F.col("docs") * F.lit(head) > F.lit(total)) & (F.octet_length("p") <= 32)
    top = F.broadcast(vocabulary.filter(frequent).select("p", "n_pieces"))
    rest = vocabulary.filter(~frequent).select("p", "n_pieces")
    met = parts.join(top, "p", "left")
    known = met.filter("n_pieces is not null").groupBy("rid").agg(F.sum(F.col("c") * F.col("n_pieces")).alias("n"))
    rare = met.filter("n_pieces is null").drop("n_pieces").hint("shuffle_hash").join(rest.hint("shuffle_hash"), "p")
    rare = rare.groupBy("rid").agg(F.sum(F.col("c") * F.col("n_pieces")).alias("n"))
    none = F.lit(None).cast("long")
    own = rows.select("rid", "doc_id", "n_bytes", F.col("n_lines").alias("n"))
    sums = [x.select("rid", none.alias("doc_id"), none.alias("n_bytes"), "n") for x in (known, rare)]
    out = own.unionByName(sums[0]).unionByName(sums[1]).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")
    )
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

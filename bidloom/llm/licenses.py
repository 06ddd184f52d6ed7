"""License scan by diagonal voting.

Every rolling word 4-gram of every document is joined by its hash to the places of equal grams in
the license templates, and the join compares the four words as well.  A match votes for its
diagonal (place in the document minus place in the template); votes are counted by diagonal,
diagonals at most ``slack`` apart are merged (words that were added or left out shift a copy by a
few places), and a merged span counts when its verified words cover enough of the template.

All of it is JVM expressions.  The templates are a fixed list, so their grams are broadcast.  The
words of each row are written once with a row key, so texts are split once and every later step
sees the same keys; places are generated and joined within one stage, and only matches are
shuffled.  Those of a document are bounded by its length.

Defined edge cases: a null or empty text has no words, labels or places and scores 0; overlapping
spans whose templates fit equally well all give their labels; the work on
a text is linear in its words, so very long texts are scanned whole like any other; repeated rows
and ids are scanned row by row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.common import with_row_id, words_of
from bidloom.sources.shared import Workspace

GRAM = 4

#: Base phrases and their labels (fixed by the contract).
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Templates of the method (fixed texts): label and wording of notices, of short licenses as a whole, and of the openings
#: of long ones.
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the software to deal in the software without restriction including without limitation the rights
     to use copy modify merge publish distribute sublicense and or sell copies of the software"""
_MIT_TERMS = _MIT_GRANT + """ and to permit persons to whom the software is furnished to do so subject to the following
     conditions the above copyright notice and this permission notice shall be included in all copies or substantial
     portions of the software"""
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
     the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors
     or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
     otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_TERMS = """redistribution and use in source and binary forms with or without modification are permitted provided that the
     following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
     conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice
     this list of conditions and the following disclaimer in the documentation and or other materials provided with the
     distribution"""
_BSD_NAMES = """3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
     products derived from this software without specific prior written permission"""
_BSD_WARRANTY = """this software is provided by the copyright holders and contributors as is and any express or implied
     warranties including but not limited to the implied warranties of merchantability and fitness for a particular
     purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
     incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
     or services loss of use data or profits or business interruption however caused and on any theory of liability
     whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
     this software even if advised of the possibility of such damage"""
_ISC_TERMS = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
     granted provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_WARRANTY = """the software is provided as is and the author disclaims all warranties with regard to this software
     including all implied warranties of merchantability and fitness in no event shall the author be liable for any
     special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or
     profits whether in an action of contract negligence or other tortious action arising out of or in connection with
     the use or performance of this software"""
_ZLIB_GRANT = """permission is granted to anyone to use this software for any purpose including commercial applications and to
     alter it and redistribute it freely subject to the following restrictions"""
_VERBATIM = """everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not
     allowed"""
_FSF_2007 = "copyright 2007 free software foundation inc https fsf org " + _VERBATIM
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", _MIT_GRANT),
    ("mit", _MIT_TERMS),
    ("mit", _MIT_WARRANTY),
    ("mit", _MIT_TERMS + " " + _MIT_WARRANTY),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
     with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
     applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
     without warranties or conditions of any kind either express or implied see the license for the specific language
     governing permissions and limitations under the license"""),
    ("apache-2", """apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use
     reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and
     distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity
     authorized by the copyright owner that is granting the license"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted
     provided that the following conditions are met"""),
    ("bsd-2-clause", _BSD_TERMS),
    ("bsd-2-clause", _BSD_TERMS + " " + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_NAMES),
    ("bsd-3-clause", _BSD_TERMS + " " + _BSD_NAMES),
    ("bsd-3-clause", _BSD_TERMS + " " + _BSD_NAMES + " " + _BSD_WARRANTY),
    ("isc", _ISC_TERMS),
    ("isc", _ISC_TERMS + " " + _ISC_WARRANTY),
    ("zlib", _ZLIB_GRANT),
    ("zlib", _ZLIB_GRANT + """ 1 the origin of this software must not be misrepresented you must not claim that you wrote the
     original software if you use this software in a product an acknowledgment in the product documentation would be
     appreciated but is not required 2 altered source versions must be plainly marked as such and must not be
     misrepresented as being the original software 3 this notice may not be removed or altered from any source
     distribution"""),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", """it under the terms of the gnu general public license as published by the free software foundation either
     version 3 of the license or at your option any later version"""),
    ("gpl-3", "gnu general public license version 3 29 june 2007 " + _FSF_2007 + """ preamble the gnu general public license is
     a free copyleft license for software and other kinds of works"""),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", """it under the terms of the gnu general public license as published by the free software foundation either
     version 2 of the license or at your option any later version"""),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc " + _VERBATIM + """
     preamble the licenses for most software are designed to take away your freedom to share and change it by contrast
     the gnu general public license is intended to guarantee your freedom to share and change free software"""),
    ("lgpl-3", """it under the terms of the gnu lesser general public license as published by the free software foundation
     either version 3 of the license"""),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007 " + _FSF_2007 + """ this version of the gnu lesser
     general public license incorporates the terms and conditions of version 3 of the gnu general public license
     supplemented by the additional permissions listed below"""),
    ("agpl-3", """it under the terms of the gnu affero general public license as published by the free software foundation
     either version 3 of the license"""),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 " + _FSF_2007 + """ preamble the gnu affero general
     public license is a free copyleft license for software and other kinds of works specifically designed to ensure
     cooperation with the community in the case of network server software"""),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was
     not distributed with this file you can obtain one at"""),
    ("mpl-2", """mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that
     creates contributes to the creation of or owns covered software 1 2 contributor version means the combination of
     the contributions of others if any used by a contributor and that particular contributor s contribution"""),
    ("boost-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software
     and accompanying documentation covered by this license the software to use reproduce display distribute execute and
     transmit the software and to prepare derivative works of the software and to permit third parties to whom the
     software is furnished to do so all subject to the following"""),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", """to the extent possible under law the person who associated cc0 with this work has waived all copyright and
     related or neighboring rights to this work"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
     publish use compile sell or distribute this software either in source code form or as a compiled binary for any
     purpose commercial or non commercial and by any means"""),
]


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, size, gram, its words and its place in the template."""
    rows = spark.createDataFrame(
        [(k, label, text.split()) for k, (label, text) in enumerate(templates)],
        "template int, label string, tw array<string>",
    )
    return grams(rows.withColumn("t_size", F.size("tw")), "tw", "t_at").select(
        "template", "label", "t_size", "gram", "t_at", F.slice("tw", F.col("t_at") + 1, F.lit(GRAM)).alias("t_words")
    )


def grams(rows: DataFrame, words: str, at: str) -> DataFrame:
    """A row for each place of a word gram: the place and the hash of its words."""
    places = F.expr(f"if(size({words}) < {GRAM}, cast(array() as array<int>), sequence(0, size({words}) - {GRAM}))")
    out = rows.select("*", F.explode(places).alias(at))
    return out.withColumn("gram", F.expr(f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(GRAM))})"))


def spans(rows: DataFrame, templates=TEMPLATES, slack: int = 3, cover: float = 0.7) -> DataFrame:
    """Verified spans: rid, label, template, first_word, end_word, score (share of the template).

    ``rows`` is a written table with ``rid`` and the word array ``w``.
    """
    template = F.broadcast(template_grams(rows.sparkSession, templates))
    # Words are compared where hashes meet, so unequal grams of one hash give no vote.
    same = F.expr(" and ".join(f"w[at + {k}] = t_words[{k}]" for k in range(GRAM)))
    places = grams(rows.select("rid", "w"), "w", "at").alias("d").join(template.alias("t"), F.col("d.gram") == F.col("t.gram"))
    votes = places.filter(same).select("rid", "template", "label", "t_size", "at", "t_at")
    diagonals = (
        votes.groupBy("rid", "template", "label", "t_size", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("t_at").alias("places"))
    )
    order = W.partitionBy("rid", "template").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) <= slack, F.lit(False))
    merged = (
        diagonals.withColumn("new", (~near).cast("int"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("rid", "template", "label", "t_size", "run")
        .agg(F.min("lo").alias("first_word"), (F.max("hi") + GRAM).alias("end_word"),
             F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    )
    covered = F.expr(
        f"aggregate(places, struct(0 as n, -{GRAM} as last), "
        f"(a, x) -> struct(a.n + least({GRAM}, x - a.last) as n, x as last)).n"
    )
    good = merged.withColumn("covered", covered).withColumn("score", F.col("covered") / F.col("t_size"))
    good = good.filter(F.col("score") >= cover).drop("places")
    # Licenses share sentences and lie in each other.  Of spans that overlap those stay whose template has most words
    # covered less words missed: the longer of nested licenses where its own clauses stand, else the shorter one.
    good = good.withColumn("net", F.col("covered") * 2 - F.col("t_size"))
    order = W.partitionBy("rid").orderBy("first_word", "end_word", "template", "run")
    before = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum((F.col("first_word") >= F.coalesce("before", F.lit(0))).cast("int")).over(order)
    good = good.withColumn("before", before).withColumn("island", island)
    good = good.withColumn("best", F.max("net").over(W.partitionBy("rid", "island"))).filter("net = best")
    return good.drop("before", "island", "best", "net", "covered", "run")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         slack: int = 3, cover: float = 0.7) -> DataFrame:
    """One row per input row: base places, labels of base and method, and the best score."""
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w")))
    rows = Workspace(docs.sparkSession).write(rows, "words")
    places, labels = [], []
    for phrase, label in PHRASES:
        words = phrase.split()
        here = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        gate = " and ".join(f"array_contains(w, '{x}')" for x in dict.fromkeys(words))
        found = F.expr(
            f"if({gate} and size(w) >= {len(words)}, filter(sequence(0, size(w) - {len(words)}), i -> {here}), "
            "cast(array() as array<int>))"
        )
        places.append(found.alias(label))
        labels.append(F.when(F.size(f"`{label}`") > 0, F.lit(label)))
    base = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), *places)
    every = F.concat(*[F.col(f"`{label}`") for _, label in PHRASES])
    base = base.select(
        "rid", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("own"), F.lit(None).cast("double").alias("score"),
        F.lit(True).alias("is_base"),
    )
    found = spans(rows, templates, slack, cover).select(
        "rid", F.lit(None).cast("long").alias("doc_id"), *[F.lit(None).cast("long").alias(c) for c in (
            "n_words", "n_base", "first_word", "last_word")],
        F.array("label").alias("own"), "score", F.lit(False).alias("is_base"),
    )
    base = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    both = base.unionByName(found).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        *[F.max(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.flatten(F.collect_set(F.when(F.col("is_base"), F.col("own")))).alias("of_base"),
        F.flatten(F.collect_set("own")).alias("of_all"), F.max("score").alias("score"),
    )
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text("of_base").alias("base_labels"), text("of_all").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )

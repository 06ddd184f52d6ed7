"""Operators whose result is one row per document, against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from bidloom.llm import decontam, licenses, packing, quality, tokens, warc

from .conftest import as_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def key(r):
    return tuple((x is not None, x if not isinstance(x, bool) else int(x)) for x in r)


def test_quality_counts(docs, rows, no_docs):
    out = quality.score(docs)
    got = as_rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc, text in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, hit = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                hit.update((i, i + 1, i + 2))
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((doc, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)),
                     len(lines) - len(set(lines)), len(hit), failed))
    assert got == sorted(want, key=key)
    assert out.filter("kept and base_failed").count() == 0
    assert quality.score(no_docs).count() == 0


def test_label_model_finds_planted_junk():
    good, bad_a, bad_b, short = (1, 1, 1, 1), (-1, 1, 1, 1), (1, 1, -1, 0), (0, 1, 0, 1)
    fit = quality.fit([(good, 8000), (bad_a, 300), (bad_b, 250), (short, 900)])
    post = fit["posterior"]
    assert post[0] > 0.9 and post[3] > 0.5 and post[1] < 0.5 and post[2] < 0.5
    assert len(quality.fit([])["posterior"]) == 0


def benchmark_rows(rows):
    texts = dict((d, t) for d, t in rows if d is not None)
    long = " ".join(words(texts[10])[50:90])
    return [(1, long), (2, "one"), (3, None), (4, ""), (5, "  ,, "), (2, "one"), (12, texts[5][:200].upper()),
            (7, " ".join(words(texts[10])[60:73])), (None, " ".join(words(texts[10])[200:230])), (8, "never seen anywhere in this text " * 4)]


def decontamination(rows, items):
    patterns = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[i : i + n])].update([] if item is None else [str(item)])
    sizes = {len(p) for p in patterns}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := patterns.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [32_000_000, 300])
def test_decontamination(spark, docs, rows, no_docs, block):
    items = benchmark_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = decontam.scan(docs, bench, keep=("text", "rid", "items"), block_bytes=block)
    assert as_rows(out, *columns) == sorted(decontamination(rows, items), key=key)
    assert as_rows(decontam.scan(docs, bench, block_bytes=block), *columns) == as_rows(out, *columns)
    for r in out.select("kept.*", "n_hit", "spans").collect():  # the spans of the original hold the words that are hit
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit and r.rid == "x" and r["items"] == "i"
        assert all(not set(r.text[s.start] + r.text[s.end - 1]) & set(" ,.\n") for s in r.spans)
    assert decontam.scan(no_docs, bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_decontamination_by_blocks_is_whole(spark):
    """Thousands of items that share a window, very long texts and a passage that many rows hold."""
    rng = random.Random(3)
    shared = " ".join(f"s{k}" for k in range(13))
    items = [(k, f"{shared} own{k}") for k in range(3000)] + [(9000 + k, f"short{k}") for k in range(30)]
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(60)) + f" {shared} own{k}") for k in range(40)]
    rows += [(100, "w " * 200_000 + shared + " x" * 10 + " SHORT7, " + shared), (101, shared[:-1]), (102, "short3 short3")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(decontamination(rows, items), key=key)
    for block in (1_000_000_000, 20_000):
        out = decontam.scan(docs, bench, block_bytes=block)
        assert as_rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert [(s.end - s.start) for s in out.filter("doc_id = 100").first().spans] == [len(shared), 6 + 2 + len(shared)]


def test_offsets_map_to_the_original():
    text = "Ünï, THE  cat\nsat."
    assert [text[a:b] for a, b in decontam.char_offsets(text)] == ["Ünï", "THE", "cat", "sat"]


def test_license_base(docs, rows, no_docs):
    out = licenses.scan(docs)
    want = []
    for doc, text in rows:
        w, at, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        want.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert as_rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=key)
    assert out.filter("score < 0 or score > 1").count() == 0
    assert licenses.scan(no_docs).count() == 0


def test_license_diagonals(spark):
    text = dict((k, t) for k, t in licenses.TEMPLATES if k.startswith("gpl"))["gpl-3"].split()
    edited = " ".join(text[:12] + ["added", "words"] + text[12:])
    got = spark.createDataFrame(
        [(1, "x " * 50 + edited), (2, " ".join(text[:8])), (3, "gnu general public license")], "doc_id long, text string"
    )
    out = {r.doc_id: r for r in licenses.scan(got).collect()}
    assert out[1].labels == "gpl-3" and out[1].score > 0.9 and out[2].labels == "" and out[3].score == 0


def plain_labels(w, slack=3, cover=0.7, gram=licenses.GRAM):
    """Labels by diagonal votes, written plainly: one template after the other, one word after the other."""
    found = []
    for label, text in licenses.TEMPLATES:
        t = text.split()
        hits = [(i - j, i, j) for i in range(len(w) - gram + 1) for j in range(len(t) - gram + 1) if w[i : i + gram] == t[j : j + gram]]
        runs = []
        for hit in sorted(hits):
            if runs and hit[0] - runs[-1][-1][0] <= slack:
                runs[-1].append(hit)
            else:
                runs.append([hit])
        for run in runs:
            covered = len({j + k for _, _, j in run for k in range(gram)})
            if covered / len(t) >= cover:
                first, end = min(i for _, i, _ in run), max(i for _, i, _ in run) + gram
                found.append((first, end, 2 * covered - len(t), label))
    labels, island, reach = set(), [], -1
    for span in sorted(found) + [(10**9, 10**9, 0, None)]:
        if span[0] >= reach:
            best = max((x[2] for x in island), default=0)
            labels |= {x[3] for x in island if x[2] == best}
            island = []
        island.append(span)
        reach = max(reach, span[1])
    return ",".join(sorted(labels))


def test_license_labels_of_edited_copies(spark):
    rng = random.Random(5)
    longest = {}
    for label, text in licenses.TEMPLATES:
        longest[label] = max(longest.get(label, ""), text, key=len)
    rows, want = [], {}
    for label, text in longest.items():
        for rate in (0.0, 0.02, 0.04):
            out = [f"filler{rng.randrange(999)}" for _ in range(30)]
            for word in text.split():
                draw = rng.random() / max(rate, 1e-9)
                out += [] if draw < 1 / 3 else ["changed"] if draw < 2 / 3 else [word, "more"] if draw < 1 else [word]
            rows.append((len(rows), " ".join(out + ["filler"] * 20)))
            if rate == 0:
                want[len(rows) - 1] = label
    both = " ".join([longest["mit"], "and then", longest["isc"], longest["gpl-3"]])
    rows.append((len(rows), both))
    want[len(rows) - 1] = "gpl-3,isc,mit"
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want
    plain = {k: plain_labels(t.split()) for k, t in rows}
    base = {k: {label for phrase, label in licenses.PHRASES if phrase in t} for k, t in rows}
    assert got == {k: ",".join(sorted(base[k] | set(filter(None, plain[k].split(","))))) for k in got}
    assert sum(got[k] == label for k, label in zip(range(len(rows) - 1), [x for x in longest for _ in range(3)], strict=True)) >= 0.9 * len(rows)


def test_license_texts_as_they_are_printed(spark):
    bsd_3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Example Corp. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    bsd_2 = bsd_3.split("3. Neither")[0]
    mit = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
    gpl_3 = """GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
    texts = [bsd_3, bsd_2, mit, gpl_3, "The BSD license is a license. The software is provided to the authors as is."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["bsd-3-clause", "bsd-2-clause", "mit", "gpl-3", ""]


def test_license_in_a_very_long_text(spark):
    rng = random.Random(2)
    whole = next(t for k, t in licenses.TEMPLATES if k == "mit" and "permit persons" in t)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    text = f"{filler(100_000)} {whole} {filler(100_000)} under the MIT license"
    began = time.monotonic()
    got = licenses.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert time.monotonic() - began < 60  # a quadratic scan takes hours
    one = next(r for r in got if r.doc_id == 1)
    n = len(whole.split())
    assert (one.n_words, one.n_base, one.first_word, one.labels) == (200_004 + n, 1, 200_000 + n, "mit")
    found = licenses.spans(spark.createDataFrame([(7, text.lower().split())], "rid long, w array<string>")).collect()
    assert [(r.label, r.first_word, r.end_word, r.score) for r in found if r.first_word < 200_000] == [("mit", 100_000, 100_000 + n, 1.0)]


def test_token_counts(docs, rows, no_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [
        (d, len((t or "").encode()), n, n > 4096) for d, t in rows for n in [len(model.encode(t or ""))]
    ]
    for head in (2_000_000, 50):
        got = as_rows(tokens.count(docs, path, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == sorted(want, key=key)
    assert tokens.count(no_docs, path).count() == 0


def test_packing(docs, rows, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    out = packing.pack(docs, path, limit=256, smallest=32, most_open=4)
    pieces = out.collect()
    want = collections.Counter()
    for doc, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc, len(ids)] += 1
    texts = {(d, len(i)): i for d, t in rows for i in [tool.encode(t or "", add_special_tokens=False).ids + [1]]}
    covered = collections.Counter()
    windows = collections.defaultdict(list)
    for p in pieces:
        ids = np.array(texts[p.doc_id, p.doc_tokens][p.start : p.start + p.length], dtype="<u4").tobytes()
        assert zlib.crc32(ids) == p.ids_crc32 and p.length > 0
        covered[p.doc_id, p.doc_tokens] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
    assert covered == {k: n * k[1] for k, n in want.items()}
    padded = 0
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
        padded += 0 if at & (at - 1) == 0 else 256 - at
    assert padded == 0
    assert packing.pack(no_docs, path).count() == 0


def test_step_groups_are_even_across_tasks(spark):
    """Each of 40 tasks has one window of a tier: every group gets as many of them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(0, 40, 1, 40).selectExpr("id as doc_id", "repeat('a ', 39) as text")
    windows = packing.pack(docs, path, limit=64, smallest=8).select("tier", "step_group", "sequence_id").distinct().collect()
    assert collections.Counter((w.tier, w.step_group) for w in windows) == {(t, g): 5 for t in (32, 8) for g in range(8)}


def test_tokenizers_that_cross_white_space_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: k for k, c in enumerate(sorted(set(pre_tokenizers.ByteLevel.alphabet())))}
    spaced = Tokenizer(models.BPE(vocab | {"\u0120a": 256}, [("\u0120", "a")]))
    spaced.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    spaced.save(str(tmp_path / "spaced.json"))
    with pytest.raises(ValueError, match="apart"):
        packing.check_tokenizer(str(tmp_path / "spaced.json"))
    packing.check_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_archives(spark):
    big = "<p>é</p>" * 400
    pages = [(1, "http://a/ b", big), (7, "http://c", big), (3, None, big), (4, "http://d", "small"), (5, "u", "small"),
             (6, "u", None), (None, "u", "WARC/1.1\r\n\r\n\n" * 300), (9, "u", ""), (-2, "u", "z" * 1000),
             (10, "u", "z" * 1000), (11, "u", "y" * 999), (12, "u", "y" * 999)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, sha1 int").repartition(3)
    for per_file in (2, 4096):
        out = warc.archive(df, per_file=per_file)
        got = as_rows(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        top = {}
        for p, _, h in pages:
            if p is not None:
                top[h] = max(p, top.get(h, p))
        want = []
        for p, _, h in pages:
            data = (h or "").encode()
            own = len(data) < 1000 or p is None or top[h] == p
            want.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit",
                         None if own else top[h]))
        assert got == sorted(want, key=key)
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    """Files hold at most the bound before compression; longer texts get files of their own, whole."""
    import gzip

    rng = random.Random(9)
    size = lambda k: 3_000_000 if k == 17 else rng.randrange(20_000)
    rows = [(k, f"http://x/{k}", "".join(rng.choices("abc<>\n é", k=size(k)))) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    arc = warc.write_arc(pages, max_bytes=100_000)
    files = [gzip.decompress(r.content) for r in warc._files(spark, arc).collect()]
    assert len(files) > 8 and sum(len(f) > 101_000 for f in files) == 1
    assert all(f.startswith(b"filedesc://") and f.count(b"filedesc://") == 1 for f in files)
    got = warc.read_warc(spark, warc.convert(spark, arc, max_bytes=100_000), with_payload=True)
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {k: h for k, _, h in rows}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    import io

    blocks = [warc.http_block(k, b"\n" * k + b"URL 1.2.3.4\n") for k in range(4)]
    data = warc.arc_head(version) + b"\n"
    data += b"\n".join(warc.arc_line(version, f"http://x/{k}", warc.DATE, "text/html", b) + b"\n" + b
                       for k, b in enumerate(blocks))
    assert [r[3] for r in warc.arc_records(io.BytesIO(data))] == blocks
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(data[:-3])))


@pytest.mark.parametrize("page", [0, 1, -5, 2**63 - 1, -(2**63)])
def test_record_ids_hold_the_page(page):
    assert warc.page_of(warc.record_id(page, hashlib.sha1(b"x").digest())) == page

"""Source mixing, collocations and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidloom.llm import collocations, mixing, variants
from bidloom.sources.shared import Workspace
from tests.llm.conftest import as_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Mixing ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def sourced(spark, rows):
    """A hot source, small ones that reach their limit, a null one, and columns named like internal ones."""
    source = lambda k: None if k % 11 == 3 else "b" if k % 3 else ("a", "c", "é", "d0", "d1")[k % 5]
    made = [(i, t, source(k), k, "w") for k, (i, t) in enumerate(rows)] + [(900, "tiny source", "zz", 0, "w"), (901, None, "zzz", 0, "w")]
    return spark.createDataFrame(made, "doc_id long, text string, source string, size int, target string")


def shares(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Targets by rounds: what is over a limit is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    shut: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in shut)
        heavy = sum(weight[s] for s in names if s not in shut)
        now = {s: most * sizes[s] if s in shut else weight[s] * left / heavy for s in names}
        over = {s for s in names if s not in shut and now[s] > most * sizes[s]}
        if not over:
            return now
        shut |= over


def test_mix_meets_targets(spark, sourced):
    rows, order = mixing.mix(sourced, keep=("doc_id", "text", "size"))
    got = mixing.taken(rows, order.drop("kept")).join(sourced.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    texts = sourced.collect()
    assert len(mixing.taken(rows, order.drop("kept")).collect()) == len(texts)
    for r in texts:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = shares(sizes)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        if r.doc_id is not None and r.doc_id != 5:  # that id comes twice with two sources
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    by = rows.join(order.groupBy("rid").agg(F.sum("words").alias("words")), "rid", "left").groupBy("target", "source_size").agg(F.sum("words").alias("n"))
    for r in by.collect():
        assert (r.n or 0) == round(r.target)
    times = [r.time for r in order.collect()]
    assert times == sorted(times) and all(0 <= t <= 1 for t in times)
    one = order.filter("doc_id = 10").first()
    assert one.kept.text == next(r.text for r in texts if r.doc_id == 10)


def test_mix_reruns_agree(spark, sourced):
    first = as_rows(mixing.taken(*mixing.mix(sourced)), "doc_id", "size", "taken")
    again = as_rows(mixing.taken(*mixing.mix(sourced.repartition(7))), "doc_id", "size", "taken")
    assert first == again


def test_schedule_is_inverse_of_its_integral(spark):
    for s in mixing.CURRICULUM:
        points = [k / 40 for k in range(41)]
        df = spark.createDataFrame([(p,) for p in points], "share double")
        got = dict(df.select("share", s.time_of(F.col("share")).alias("t")).collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(s.knots, s.knots[1:], strict=False))
        for share, t in got.items():
            done = 0.0
            for (t0, w0), (t1, w1) in zip(s.knots, s.knots[1:], strict=False):
                x = min(max(t - t0, 0), t1 - t0)
                done += x * w0 + (w1 - w0) / (t1 - t0) * x * x / 2
            assert done / area == pytest.approx(share, abs=1e-9)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(*mixing.mix(none)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert as_rows(mixing.taken(*mixing.mix(blank)), "doc_id", "taken", "target") == [(None, 0, 0.0), (1, 0, 0.0)]


# Collocations --------------------------------------------------------------------------------------
def phrases_of(rows, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for s in range(len(words) - k + 1):
                    f[lang, tuple(words[s : s + k])] += 1
    return n, f


def collocations_of(rows, least, top):
    n, f = phrases_of(rows)
    frequent = {k: v for k, v in f.items() if v >= least}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(
            x == lang and len(q) > len(p) and b >= a and any(q[s : s + len(p)] == p for s in range(len(q)))
            for (x, q), b in frequent.items()
        )
        if inside:
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), x, y))
    return sorted(
        (lang, r + 1, p.decode(), -a, x, y, n[lang], -s)
        for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])
    )


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    some = "alpha beta gamma delta Élan épée the of  x and".split(" ")
    text = lambda: "".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rng.randrange(80)))
    rows = [(rng.choice(["en", "fr", None, "und"]), text()) for _ in range(60)]
    rows += [("en", "One two three four five six. " * 40), ("en", None), ("fr", ""), ("en", "the " * 3000), ("en", ",;:"), ("de", "a\x00b c|d a\x00b c|d")]
    return rows + rows[:20]


def test_collocations_equal_brute_force(spark, spoken):
    docs = spark.createDataFrame([(k, x, t, "p", 1) for k, (x, t) in enumerate(spoken)], "doc_id long, lang string, text string, phrase string, n int")
    for least, top, every in ((5, 2000, 3), (10, 7, 24)):
        got = collocations.mine(docs.repartition(3), top=top, least=least, every=every)
        assert as_rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == collocations_of(spoken, least, top)


def test_parse_counts_each_phrase_once(spark, spoken):
    """Chunks with their frequencies hold all phrases of the texts, each once."""
    docs = spark.createDataFrame(spoken, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    n, f = Counter(), Counter()
    book = collocations.parse(docs, 4, 3).collect()
    assert len(book) < sum(r.freq for r in book)
    for r in book:
        words = bytes(r.chunk).decode().replace("\t", " ").split(" ")
        words = [w for w in words if w]
        n[r.lang] += r.freq * r.n_own
        for k in range(1, 6):
            for s in range(min(r.n_own, len(words) - k + 1)):
                f[r.lang, tuple(words[s : s + k])] += r.freq
    assert (n, f) == phrases_of(spoken)


def test_scores_are_exact_beyond_64_bits(spark):
    """1000 * a * n passes 2^63 here, and a quotient that doubles would round."""
    big = 4 * 10**15 + 7
    totals = spark.createDataFrame([("en", 10**16 - 1)], "lang string, n long")
    f = {"a": big + 2, "b": big + 5, "a b": big - 1, "b c": 3 * 10**9, "c": 7 * 10**14 + 1, "a b c": 10**9 + 1}
    phrases = spark.createDataFrame([("en", len(p.split()), p, x) for p, x in f.items()], "lang string, size int, phrase string, f long")
    got = {r.phrase: r.score for r in collocations.scored(totals, phrases, Workspace(spark)).collect()}
    top = lambda p, *cuts: min(1000 * f[p] * (10**16 - 1) // (f[x] * f[y]) for x, y in cuts)
    assert got == {"a b": top("a b", ("a", "b")), "b c": top("b c", ("b", "c")), "a b c": top("a b c", ("a", "b c"), ("a b", "c"))}


def test_full_filters_change_nothing(spark, spoken):
    docs = spark.createDataFrame(spoken, "lang string, text string")
    got = collocations.mine(docs, least=5, most_blocks=2)
    assert as_rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == collocations_of(spoken, 5, 2000)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(none).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


# Spelling variants -----------------------------------------------------------------------------------
def variants_of(rows):
    n: Counter = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    n = Counter({w: c for w, c in n.items() if len(w) >= 7 and c >= 2})

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    others = {w: [v for v in n if v != w and near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in others.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((w, form.get(w), root(w), n[w], len(others[w]), n[form[w]] if w in form else None) for w in n), key=key)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    base = ["bookkeeper", "Élégance", "document", "aaaaaaa", "transition", "naïveté", "commission", "tendering", "÷×signs"]
    letters = "abcdefghijklmnopqrstuvwxyzéïÿ"

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper()])

    pool = base * 60 + [slip(w) for w in base for _ in range(12)] * 2 + [slip(slip(w)) for w in base for _ in range(12)] * 2
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(120)))) for k in range(60)]
    rows += [(73, "chained " * 1100 + "chainad " * 100 + "chainadd " * 9), (None, None), (None, "bookkeeper commission"), (71, ""), (72, "x" * 20000 + " " + "x" * 19999 + " ")]
    return rows + [(72, rows[-1][1])] + rows[:8]


def test_variants_equal_brute_force(spark, spelled):
    docs = spark.createDataFrame([(*r, "x", 1) for r in spelled], "doc_id long, text string, word string, n int").repartition(3)
    want = variants_of(spelled)
    assert any(r[5] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) and max(len(r[0]) for r in want) == 20000
    got = variants.group(docs)
    assert as_rows(got, "word", "form", "root", "n", "n_near", "form_n") == want


def test_small_filters_change_nothing(spark, spelled):
    """A vocabulary in several parts, each with filters of its own."""
    docs = spark.createDataFrame(spelled[:60], "doc_id long, text string")
    got = variants.group(docs, most_blocks=64)
    assert as_rows(got, "word", "form", "root", "n", "n_near", "form_n") == variants_of(spelled[:60])


def test_filters_hold_few_others(spark):
    """Of edits that are no words, the filters let hardly any through."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(3000)]
    df = spark.createDataFrame([(w, 2) for w in set(words)], "word string, n long")
    shards = variants.Shards({12: len(set(words))}, 1 << 20)
    shards.fill(df)
    assert variants.candidates(df, shards).count() < 60


def test_variants_of_nothing(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.group(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect() == []

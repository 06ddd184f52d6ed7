"""Places of pattern matches, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: start and end (exclusive) in code points, rank and name of its kind, its text, and the
#: words before and after it (lower case).
SPAN = "struct<start: int, rank: int, end: int, kind: string, body: string, before: string, after: string>"
#: Set around matches before a text is split; texts that hold it themselves get another control
#: character in its place, which like it is in no pattern's characters and is no space.
CUT, STAND_IN = "\x01", "\x02"
#: Steps of ``running``: enough for arrays of any size.
_STEPS = f"array({', '.join(str(1 << k) for k in range(31))})"


def running(values: str, combine: str, first: str) -> str:
    """SQL of the running combination of an int array, each element with all before it.

    Element i is combined with i - 1, then with i - 2, i - 4 and so on, so n elements take
    n log n steps; appending to an array one element at a time would take n squared.  ``combine``
    is SQL over ``p`` and ``q``, ``first`` what stands before the first element.
    """
    return (
        f"aggregate(filter({_STEPS}, d -> d < size({values})), cast({values} as array<int>), (v, d) -> "
        f"cast(zip_with(v, concat(array_repeat({first}, d), slice(v, 1, size(v) - d)), (p, q) -> {combine}) as array<int>))"
    )


def all_matches(text: str, pattern: str, kind: str, rank: int, ok: str = "true", group: int = 0,
                gate: str = "true") -> Column:
    """Leftmost non-overlapping matches of a pattern in column ``text`` as an array of SPAN.

    The pattern runs once: matches are set off by a mark, and the text is split at the marks into
    gaps and matches in turn, whose lengths add up to places.  The work is n log n in the matches
    of a text, whatever their number.  ``ok`` is SQL over ``x.body`` (the match) and ``x.part``
    (its group); ``gate`` spares texts that cannot match.
    """
    quote = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    empty = f"cast(array() as array<{SPAN}>)"
    marked = f"split(regexp_replace(replace({text}, '{CUT}', '{STAND_IN}'), {quote(pattern)}, '{CUT}$0{CUT}'), '{CUT}')"
    part = f"regexp_extract(p[i], {quote('^' + pattern + '$')}, {group})" if group else "p[i]"
    before = r"lower(reverse(regexp_extract(reverse(p[i - 1]), '^\\s*([^\\s]+)', 1)))"
    after = r"lower(regexp_extract(p[i + 1], '^\\s*([^\\s]+)', 1))"
    # p: gaps and matches in turn; n: where each ends.
    found = (
        f"filter(transform(sequence(1, size(p) - 2, 2), i -> named_struct('start', n[i - 1], 'end', n[i], 'body', p[i], 'part', {part}, "
        f"'i', i)), x -> {ok})"
    )
    made = (
        f"transform({found}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}', "
        f"'body', x.body, 'before', {before.replace('[i ', '[x.i ')}, 'after', {after.replace('[i ', '[x.i ')}))"
    )
    places = running("transform(p, x -> char_length(x))", "p + q", "0")
    spans = f"transform(array({marked}), p -> if(size(p) < 3, {empty}, transform(array({places}), n -> {made})[0]))[0]"
    return F.expr(f"if({gate}, {spans}, {empty})")


def meeting(spans: str, others: str, meets: bool = True) -> Column:
    """Those of ``spans`` that overlap any of ``others`` (or none), by start.

    Both are sorted together by start; a span meets one of the others if one that starts no later
    ends after its start, or one that starts later starts before its end.  Others need a smaller
    rank than the spans or another start.
    """
    every = f"sort_array(concat(transform({others}, x -> named_struct('x', x, 'own', 0)), transform({spans}, x -> named_struct('x', x, 'own', 1))))"
    ends = running("transform(a, y -> if(y.own = 1, 0, y.x.end))", "greatest(p, q)", "0")
    starts = running(f"transform(reverse(a), y -> if(y.own = 1, {2**31 - 1}, y.x.start))", "least(p, q)", str(2**31 - 1))
    test = "(e[i] > y.x.start or s[size(s) - 1 - i] < y.x.end)"
    kept = f"transform(filter(a, (y, i) -> y.own = 1 and {'' if meets else 'not '}{test}), y -> y.x)"
    body = f"transform(array({every}), a -> transform(array({ends}), e -> transform(array({starts}), s -> {kept})[0])[0])[0]"
    none = f"size({spans}) = 0 or size({others}) = 0"
    return F.expr(f"if({none}, {f'cast(array() as array<{SPAN}>)' if meets else spans}, {body})")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of SPAN, by start and kind, comma-joined."""
    return F.array_join(
        F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def normal_tail(z: Column) -> Column:
    """P(|N| > |z|) by a rational approximation, error under 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    powers = [1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
              0.17087277]
    poly = reduce(lambda a, c: c + t * a, reversed(powers[:-1]), F.lit(powers[-1]))
    return F.least(F.lit(1.0), t * F.exp(-x * x - 1.26551223 + t * poly))

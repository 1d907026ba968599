"""Secret scans: known forms, and windows of high Shannon entropy."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bound, whole_text


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The known forms, in the order that settles spans of one start.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = ("(" + "|".join(map(either_case, KEYWORDS)) + ")"
          + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

# Strings that may be secrets without a known form, their character classes (pattern, alphabet,
# bits a character in a window), and what is let through.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", "0123456789ABCDEFabcdef", 3.05),
    ("base64", r"^[A-Za-z0-9+/_=-]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
)
ALLOWED = (
    r"^[^0-9]*$",  # no digit: words, rules, headings
    r"^[0-9=_+/-]*$",  # no letter: numbers, dates, telephone numbers
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # identifiers of the uuid form
    r"(?i)(example|sample|placeholder|changeme|dummy|x{6}|0{8}|12345678|abcdefgh)",
)
SPAN = "array<struct<start:int,end:int,kind:string>>"
# The parts of a path or assignment that hold a word of the last pattern above: from one / or = to
# the next. A look-behind lets a search start at the head of a part alone.
HEAD = "(?<![A-Za-z0-9+_-])"
PART = HEAD + r"[A-Za-z0-9+_-]*" + ALLOWED[-1] + r"[A-Za-z0-9+_-]*"
# Candidates without a digit, of both cases: words have few capitals. Of random letters of both
# cases, 94 (20 letters) to 99.9 (40) of 100 reach these bits with such a share of capitals.
MIXED = r"^(?=[^0-9]*[a-z])(?=[^0-9]*[A-Z])[^0-9]*$"
MIXED_BITS, CAPITALS = 3.7, (0.25, 0.75)


def located(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Spans of the leftmost, non-overlapping matches, in code points.

    What `split` leaves between the matches gives their places. `keep`: array of booleans, one for
    each match. Texts without a match are told by one search and not cut up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    kept = F.transform(found, lambda x: F.lit(True)) if keep is None else keep
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"),
                         found.alias("hit"), kept.alias("kept"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.char_length(part["gap"])
        end = begin + F.char_length(part["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(
            part["kept"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            .alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["spans"])
                  ).otherwise(F.array().cast(SPAN))


def top_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy, in bits a character, of any `window` characters in a row.

    The window moves by one character: one count goes up, one down, and the sum of c * log2(c)
    changes by their terms alone. H = log2(window) - sum / window. The candidate is cut up once,
    and each state is made once: the time is in proportion to the length.
    """
    terms = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    rise = F.array(*[F.lit(b - a) for a, b in zip(terms, terms[1:])])
    size = len(alphabet)
    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"),
                     F.lit(0.0).alias("best"))

    def moved(state: Column, place: Column, by: int) -> Column:
        count = F.get(state["n"], place)
        change = F.get(rise, count) if by > 0 else -F.get(rise, count - 1)
        return F.struct(
            F.concat(F.slice(state["n"], F.lit(1), place), F.array(count + by),
                     F.slice(state["n"], place + 2, F.lit(size))).alias("n"),
            (state["sum"] + change).alias("sum"), state["best"].alias("best"))

    def rated(state: Column, i: Column) -> Column:
        bits = math.log2(window) - state["sum"] / window
        return F.struct(state["n"].alias("n"), state["sum"].alias("sum"), F.when(
            (i >= window - 1) & (bits > state["best"]), bits).otherwise(state["best"])
            .alias("best"))

    def over(places: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            added = moved(state, F.get(places, i), 1)
            left = lambda s: F.when(i >= window, moved(s, F.get(places, i - window), -1)
                                    ).otherwise(s)
            return bound(added, lambda s: bound(left(s), lambda t: rated(t, i)))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step,
                           lambda s: s["best"])

    chars = F.split(candidate, "")
    return bound(F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1), over)


def is_random(candidate: Column, classes=CLASSES, allowed=ALLOWED, window: int = WINDOW) -> Column:
    """Whether the first class that fits the candidate finds its entropy high enough. Candidates of
    both cases without a digit are a class of their own."""
    capitals = F.regexp_count(candidate, F.lit("[A-Z]"))
    share = capitals / F.regexp_count(candidate, F.lit("[A-Za-z]"))
    # The pattern for words is looked at before: it also fits placeholders without a digit.
    verdict = F.when(candidate.rlike(MIXED) & ~candidate.rlike(allowed[-1]) & share.between(
        *CAPITALS), top_entropy(candidate, classes[-1][2], window) >= MIXED_BITS)
    for pattern in allowed:
        verdict = verdict.when(candidate.rlike(pattern), F.lit(False))
    for _, pattern, alphabet, bits in classes:
        verdict = verdict.when(candidate.rlike(pattern),
                               top_entropy(candidate, alphabet, window) >= bits)
    return verdict.otherwise(F.lit(False))


def disjoint(spans: Column) -> Column:
    """Spans in order, those that overlap made one."""
    def step(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        wider = F.struct(last["start"].alias("start"),
                         F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(state) > 0) & (s["start"] < last["end"]), F.concat(
            F.slice(state, F.lit(1), F.size(state) - 1), F.array(wider))
            ).otherwise(F.concat(state, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPAN), step)


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with `put` of each span in its place; spans that overlap are one. Spans are in
    order. The text is cut up once, whatever the number of spans."""
    def piece(chars: Column, apart: Column) -> Callable[[Column, Column], Column]:
        def one(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get(apart, i - 1)["end"])
            gap = F.slice(chars, begin + 1, s["start"] - begin)
            return F.concat(F.array_join(gap, ""), put(s))
        return one

    def joined(chars: Column, apart: Column) -> Column:
        end = F.element_at(apart, -1)["end"]
        tail = F.array_join(F.slice(chars, end + 1, F.size(chars)), "")
        return F.concat(F.array_join(F.transform(apart, piece(chars, apart)), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.split(text, ""), lambda chars: bound(
        disjoint(spans), lambda apart: joined(chars, apart))))


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of each span; all places stay."""
    return replaced(text, spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def scan_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW, classes=CLASSES,
                 allowed=ALLOWED, name: str = "secrets") -> DataFrame:
    """Adds `name`: array of (start, end, kind), by start, then kind as in KINDS.

    Places are code points from 0, `end` is exclusive. Known forms are always kept and may overlap
    each other; what is left of a candidate beside them is judged by itself, so a span of high
    entropy overlaps none of them. A placeholder word lets its own part of a path through (from
    one / or = to the next), not the parts beside it. NULL and empty texts have an empty array. A
    column of that name in the input is replaced. Rows are looked at one by one: no exchange. The
    time is in proportion to the length of a text, and of a candidate.
    """
    return docs.withColumn(name, secrets_of(whole_text(text), window, classes, allowed))


def secrets_of(whole: Column, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> Column:
    """The spans of `scan_secrets` as an expression."""
    none = F.array().cast(SPAN)
    long_values = F.transform(F.regexp_extract_all(whole, F.lit(ASSIGN), 2),
                              lambda v: F.char_length(v) >= MIN_VALUE)
    known = F.concat(located(whole, ASSIGN, "assign", long_values),
                     F.when(whole.contains("AKIA"), located(whole, ACCESS, "access"))
                     .otherwise(none), located(whole, HEX, "hex"))
    rank = F.array(*map(F.lit, KINDS))

    def ordered(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"),
            s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def judged(rest: Column) -> Column:
        random = F.transform(F.regexp_extract_all(rest, F.lit(CANDIDATE), 0),
                             lambda c: is_random(c, classes, allowed, window))
        return located(rest, CANDIDATE, "entropy", random)

    def beside(rest: Column) -> Column:
        """Spans of high entropy in a text whose known forms are blank."""
        words = lambda parts: bound(masked(rest, parts), judged)
        return F.when(rest.rlike(CANDIDATE), bound(located(rest, PART, "part"), words)
                      ).otherwise(none)

    # By start; each step is bound, for lambdas would compute it anew for each element.
    return bound(F.array_sort(known), lambda spans: ordered(F.concat(
        spans, bound(masked(whole, spans), beside))))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", tag: str = "[SECRET]") -> DataFrame:
    """Puts `tag` in the place of each secret; spans that overlap become one. NULL stays NULL."""
    clean = bound(secrets_of(whole_text(text)), lambda spans: replaced(
        F.col(text), spans, lambda s: F.lit(tag)))
    return docs.withColumn(text, clean)

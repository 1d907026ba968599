"""Line dedup, periodic runs and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgauge.llm.lexical_search import ranked_search
from marketgauge.llm.line_dedup import dedup_lines
from marketgauge.llm.periodic_runs import find_runs, runs_of
from marketgauge.llm.queries import with_repeats

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def deduped(rows, min_chars=40, min_docs=5):
    """[(key, text, n_lines, n_dropped, kept)] by hand; a NULL key is below all others."""
    holders = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            k = line.strip(BLANK).translate(LOWER)
            if len(k) >= min_chars:
                holders[k].add(key)
    last = {k: max(v, key=lambda x: (x is not None, x)) for k, v in holders.items()
            if len(v) >= min_docs}
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if last.get(x.strip(BLANK).translate(LOWER), key) == key]
        out.append((key, text, len(lines), len(lines) - len(stay),
                    None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def line_rows():
    shared = ["Licensed under the terms of the common notice, é part one " + c for c in "abcd"]
    short = "a line below forty characters"
    rows = [(i, "\n".join([f"own line number {i}", short, *(shared[:1 + i % 4]), ""]))
            for i in range(12)]
    rows += [(20, "  " + shared[0].upper().replace("É", "é") + "\t\n" + shared[0]), (None, shared[0]),
             (None, shared[1] + "\r\n" + shared[0]), (3, shared[0]), (3, shared[0]), (21, None),
             (22, ""), (23, "\n\n"), (24, "\n".join(shared)), (24, "\n".join(shared)),
             (5, ("x" * 39 + "\n") * 6), (25, "\n".join(f"{n:050d}" for n in range(5000)))]
    return rows


@pytest.mark.parametrize("hot", [100_000, 2, 1])
def test_lines(spark, hot):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dedup_lines(df, hot=hot).select("doc_id", "text", "n_lines", "n_dropped", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == deduped(rows)


def test_lines_of_odd_tables(spark, odd, odd_rows, empty):
    got = dedup_lines(odd, min_chars=20, min_docs=2, names=("n_lines", "n_dropped", "left"))
    assert got.columns == [*odd.columns, "n_lines", "n_dropped", "left"]
    rows = got.select("doc_id", "text", "n_lines", "n_dropped", "left").collect()
    assert sorted((tuple(r) for r in rows), key=str) == deduped(
        [(r[0], r[1]) for r in odd_rows], 20, 2)
    # Names of the operator's own columns in the input.
    clash = odd.select("doc_id", "text", *[F.lit(c).alias(c) for c in (
        "_is", "_id", "_of", "_dropped", "id", "is", "pos", "h1", "last", "line")])
    again = dedup_lines(clash, min_chars=20, min_docs=2)
    assert sorted(map(str, again.select("doc_id", "kept").collect())) == sorted(
        map(str, got.select("doc_id", F.col("left").alias("kept")).collect()))
    assert again.select("_is", "pos").distinct().collect() == [("_is", "pos")]
    assert dedup_lines(empty).count() == 0


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    least = {}
    for start, length, q in sorted(out):
        least.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in least.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def strings():
    r = random.Random(5)
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    out = ["", "a", "a" * 11, "a" * 12, "a" * 500, "ab" * 6, "ab" * 5 + "a", b, "abc" * 4 + "abd" * 4,
           "abcdefghijklm" * 2, "abcdefghijklm" * 2 + "abcdefghijkl", "abcdef" * 2 + "x" + "abcdef" * 3]
    thue = "a"
    while len(thue) < 300:
        thue += thue.translate(str.maketrans("ab", "ba"))
    out.append(thue)
    for size in (2, 3, 5):
        out += ["".join(r.choice("abcdefgh"[:size]) for _ in range(r.randrange(400)))
                for _ in range(25)]
    for _ in range(60):
        unit = "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 70)))
        out.append(unit[:9] + unit * r.randrange(1, 6) + unit[:r.randrange(len(unit) + 1)]
                   + "".join(r.choice("abc") for _ in range(r.randrange(20))))
    return out


def test_runs_match_brute_force():
    texts = strings()
    bounds = np.cumsum([0, *map(len, texts)])
    words = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    start, length, period = runs_of(words, bounds)
    owner = np.searchsorted(bounds, start, "right") - 1
    got = defaultdict(list)
    for k, s, n, q in zip(owner, start, length, period):
        got[k].append((int(s - bounds[k]), int(n), int(q)))
    for k, t in enumerate(texts):
        assert got[k] == brute_runs(t), t
        alone = runs_of(np.array([ord(c) for c in t], dtype=np.int64), np.array([0, len(t)]))
        assert list(zip(*(x.tolist() for x in alone))) == brute_runs(t)


def test_one_word_many_times():
    for n in (100_000, 99_991):
        got = runs_of(np.zeros(n, dtype=np.int64), np.array([0, n]))
        assert [x.tolist() for x in got] == [[0], [n], [1]]


def test_runs_in_tables(spark, odd, odd_rows, empty):
    for words in (1, 200_000):
        out = find_runs(odd, words=words)
        assert out.columns == [*odd.columns, "n_words", "runs", "collapsed"]
        got = sorted((str(r.doc_id), r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                     for r in out.collect())
        want = []
        for row in odd_rows:
            w = WORDS.findall(row[1] or "")
            # The long text of the fixture has no run; by hand it would take minutes.
            runs = brute_runs(w) if len(w) < 5000 else []
            want.append((str(row[0]), row[1] or "", len(w), runs, " ".join(collapsed(w, runs))))
        assert got == sorted(want)
    clash = spark.createDataFrame([(1, "a " * 30, 7, 8)], "doc_id long, text string, runs int, x int")
    row = find_runs(clash).first()
    assert [tuple(r) for r in row.runs] == [(0, 30, 1)] and row.collapsed == "a" and row.x == 8
    assert find_runs(empty).count() == 0


def test_repeats_are_put_in(spark):
    import zlib
    r = random.Random(3)
    rows = [(i, " \n".join(f"w{r.randrange(10 ** 6)}" for _ in range(r.randrange(80))))
            for i in range(300)] + [(None, "a b"), (301, None)]
    got = with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (key, text), out in zip(rows, got):
        w = WORDS.findall(text or "")
        h = -1 if key is None else zlib.crc32(str(key).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)])
        assert tuple(out) == (key, text)


def ranked(docs, items, top=10):
    """[(item, rank, doc, score)] by hand."""
    counts = [(key, Counter(TERMS.findall((text or "").translate(LOWER)))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    held = Counter(t for _, c in counts for t in c)
    docs_n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        terms = set(TERMS.findall((text or "").translate(LOWER)))
        scores = []
        for key, c in counts:
            m = 10 + 90 * sum(c.values()) * docs_n // total
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * held[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"rows_per_task": 7, "postings": 60},
                                      {"block_items": 2, "top": 3}, {"block_terms": 1}])
def test_search(spark, settings):
    r = random.Random(11)
    words = [f"{a}{b}" for a in "abcdé漢" for b in "XYz19"]
    docs = [(i, r.choice([" ", "-", "_ \n"]).join(r.choice(words[:r.randrange(1, 31)])
                                                  for _ in range(r.randrange(40))))
            for i in range(150)]
    # Copies that tie, repeated and NULL keys, texts without a term.
    docs += [(i, docs[3][1]) for i in range(200, 230)] + [(7, "ax aY"), (7, "ax aY"), (None, "ax"),
                                                         (300, None), (301, ""), (302, "-- __ \x7f")]
    items = [(1, "ax cz, DX"), (2, docs[3][1]), (2, "é9 漢1 nothing"), (None, "b1"), (3, None),
             (4, ""), (5, "unseen"), (6, docs[9][1] + " " + docs[20][1]), (7, "ax ax AX")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    out = ranked_search(a, b, **settings)
    assert out.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"),
                          ("score", "bigint")]
    assert sorted((tuple(x) for x in out.collect()), key=str) == ranked(
        docs, items, settings.get("top", 10))


def test_search_in_odd_tables(spark, odd, odd_rows, empty):
    items = odd.filter("doc_id < 9 or doc_id > 10").select(
        "doc_id", "text", *[F.lit(1).alias(c) for c in ("item", "key", "rank", "score", "n")])
    names = items.withColumnRenamed("doc_id", "item_id")
    got = ranked_search(odd, names).collect()
    want = ranked([(r[0], r[1]) for r in odd_rows],
                  [(r[0], r[1]) for r in odd_rows if r[0] is not None and (r[0] < 9 or r[0] > 10)])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert ranked_search(empty, names).count() == 0 == ranked_search(odd, names.limit(0)).count()
    assert ranked_search(odd.filter("text is null"), names).count() == 0

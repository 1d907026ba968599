"""Secret scans of generated texts against brute force, and of very long candidates."""

import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from marketgauge.llm import secret_scan
from marketgauge.llm.oracles import SECRETS
from marketgauge.llm.queries import op9_secret_scan
from marketgauge.llm.secret_scan import described, redact, scan_secrets

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORD = r"(?i:example|sample|placeholder|changeme|dummy|x{6}|0{8}|12345678|abcdefgh)"


def top_bits(s):
    best = 0.0
    for i in range(len(s) - 19):
        w = s[i:i + 20]
        best = max(best, -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)))
    return best


def random_enough(s):
    upper, all_ = len(re.findall("[A-Z]", s)), len(re.findall("[A-Za-z]", s))
    word = re.search(WORD, s)
    if not re.search("[0-9]", s):
        mixed = re.search("[a-z]", s) and upper and not word and 0.25 <= upper / all_ <= 0.75
        return bool(mixed) and top_bits(s) >= 3.7 - 1e-9
    if not re.search("[A-Za-z]", s) or word or re.fullmatch(
            r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
        return False
    return top_bits(s) >= (3.05 if re.fullmatch("[0-9A-Fa-f]+", s) else 3.85) - 1e-9


def brute(text):
    known = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    known += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]{14,}", text)]
    known += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]{16,}", text)]
    rest = list(text)
    for a, _, b, _ in known:
        rest[a:b] = " " * (b - a)
    rest = re.sub(r"[A-Za-z0-9+_-]*" + WORD + "[A-Za-z0-9+_-]*", lambda m: " " * len(m[0]),
                  "".join(rest))
    known += [(m.start(), 3, m.end(), "entropy")
              for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", rest) if random_enough(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(known))


def generated():
    r = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    made = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randrange(lo, hi)))
    pieces = [lambda: made(letters, 5, 60), lambda: made("0123456789abcdef", 10, 40),
              lambda: made("0123456789ABCDEF", 18, 40), lambda: made(letters[:52], 18, 45),
              lambda: "AKIA" + made("ABCXYZ0189", 10, 20), lambda: made("ab1", 20, 60),
              lambda: r.choice(["token: ", "PassWord='", "api_key=", "SECRET\" = \""]),
              lambda: r.choice(["example", "Sample-", "xxxxxx", "/00000000/", "12345678="]),
              lambda: made("0123456789-", 18, 30), lambda: made("eé漢 ", 1, 9)]
    seps = ["", "", " ", "/", "-", "_", "=", "\n", "é"]
    return ["".join(r.choice(pieces)() + r.choice(seps) for _ in range(r.randrange(1, 12)))
            for _ in range(400)] + [None, ""]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(generated())]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache()


def test_generated_texts(spark, texts):
    got = {r.doc_id: r for r in scan_secrets(texts).select(
        "doc_id", "text", described(F.col("secrets")).alias("spans")).collect()}
    assert len(got) == 402
    for r in got.values():
        assert r.spans == brute(r.text or ""), r.text
    assert sum("entropy" in r.spans for r in got.values()) > 50
    for r in redact(texts).collect():
        want, end = "", 0
        before = got[r.doc_id]
        for s in filter(None, before.spans.split(",")):
            _, a, b = s.split(":")
            want += before.text[end:int(a)] + "[SECRET]" if int(a) >= end else ""
            end = max(end, int(b))
        assert r.text == (None if before.text is None else want + before.text[end:])


def test_sql_is_of_the_same_rule(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(SECRETS).fetchall()}
    got = {r[0]: tuple(r) for r in op9_secret_scan(spark, str(tmp_path)).collect()}
    assert got == want


def test_names_of_other_columns(texts):
    names = ["_known", "_rest", "_words", "_added", "_secrets", "kind", "start"]
    wide = texts.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    assert redact(wide).columns == wide.columns
    assert scan_secrets(wide).select(*names).distinct().collect() == [tuple(names)]


def test_time_follows_the_length(spark):
    r = random.Random(2)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    uri = "data:image/png;base64," + "".join(r.choice(chars) for _ in range(100_000))
    many = " ".join("%016x" % r.getrandbits(64) for _ in range(4000))

    def seconds(text):
        df = spark.createDataFrame([(1, text)], "doc_id int, text string").coalesce(1)
        start = time.time()
        row = scan_secrets(df).first()
        return time.time() - start, row.secrets

    seconds("")
    empty, _ = seconds("")
    long, spans = seconds(uri)
    # The slash of the type belongs to the candidate.
    assert spans[-1].kind == "entropy" and spans[-1].end == len(uri) and long < empty + 5
    several, spans = seconds(many)
    assert len(spans) == 4000 and several < empty + 5
    assert secret_scan.WINDOW == 20

"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .curriculum_mix import MAX_READINGS, SHARE, WEIGHTS
from .curriculum_mix import SEED as MIX_SEED
from .lexical_search import TOP
from .line_dedup import MIN_CHARS, MIN_DOCS
from .merkle_fingerprints import LEAF, PARAGRAPH
from .parity_join import PERCENT, SHINGLE
from .secret_scan import (ACCESS, ALLOWED, ASSIGN, CANDIDATE, CAPITALS, CLASSES, HEAD, HEX, KINDS,
                          MIN_VALUE, MIXED_BITS, PART, WINDOW)
from .stratified_shards import SEED as SHARD_SEED
from .stratified_shards import SHARDS
from .suffix_dedup import WINDOW as REPEAT
from .texts import WORD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
  FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM windows WHERE times > 1)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper_case,
    length(t) - length(regexp_replace(t, '[a-zµß-öø-ÿ]', '', 'g')) AS lower_case
  FROM d LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
       OR word_chars NOT BETWEEN 3 * n_words AND 12 * n_words OR 2 * n_dup_lines > n_lines
       OR 10 * upper_case > 6 * (upper_case + lower_case)) AS kept
FROM m"""

# Reflected polynomial of the checksum, and its table by eight shifts of each byte.
SHARDING = rf"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b:     CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                   lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM d, steps),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{SHARD_SEED}',
      coalesce(doc_id::VARCHAR, ''), size::VARCHAR, text_crc32::VARCHAR)), doc_id, size,
      text_crc32) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n
  FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, source NULLS LAST, rank) - 1
    AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, (place * {SHARDS} // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
  place - (shard::BIGINT * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM s"""

WORDS_OF = rf"len(regexp_extract_all(coalesce(text, ''), '{WORD}'))"
MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS_OF} AS size, md5(coalesce(text, '')) AS content FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1)
    % {len(WEIGHTS)} + 1] AS weight, source_size * {MAX_READINGS} AS cap FROM s),
v AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT arg_min(level, k) AS level FROM v WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, weight, CASE WHEN l.level * weight <= cap THEN l.level * weight
    ELSE cap::DOUBLE END AS target FROM v LEFT JOIN l ON true),
b AS (
  SELECT d.doc_id, d.size, t.*, floor(target)::BIGINT AS demand, coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY md5(concat_ws(':', '{MIX_SEED}',
      coalesce(doc_id::VARCHAR, ''), content)), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, greatest(least(demand - before, size), 0) AS once,
    greatest(least(demand - source_size - before, size), 0) AS twice,
    before / target AS share FROM b)
SELECT doc_id, size, source_size, target, once + twice AS taken,
  CASE WHEN once > 0 THEN round(CASE weight
    WHEN 5 THEN CASE WHEN share <= 0 THEN 0
      ELSE 2 * share / (1.5 + sqrt(greatest(1.5 * 1.5 + 2 * (-1.0::DOUBLE) * share, 0))) END
    WHEN 1 THEN CASE WHEN share <= 0 THEN 0
      WHEN share <= 0.375 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * 1.0::DOUBLE * share))
      ELSE 0.5 + 2 * (share - 0.375) / (1 + sqrt(1 + 2 * 1.0::DOUBLE * (share - 0.375))) END
    ELSE share END, 9) END AS position
FROM x"""

TREE = rf"""list_transform(regexp_extract_all(TEXT, {quoted(PARAGRAPH)}), lambda p: list_transform(
  regexp_extract_all(p, {quoted(LEAF)}), lambda x: md5(x)))"""
NODES = "list_transform(LEAVES, lambda p: md5(array_to_string(p, '')))"
MARKED = "list_transform(NODES, lambda n: CASE WHEN regexp_matches(n, '^[01]') THEN n || ';' ELSE n END)"
PRINT = """md5(array_to_string(list_transform(list_filter(string_split(array_to_string(MARKED, ''),
  ';'), lambda s: s <> ''), lambda s: md5(s)), '')) || ':' || array_to_string(list_transform(
  range(1, len(NODES) + 1), lambda i: array_to_string(list_transform(LEAVES[i], lambda h: h[1:8]), '')
  || CASE WHEN regexp_matches(NODES[i], '^[01]') THEN ';' ELSE ',' END), '')"""
PRINT = PRINT.replace("MARKED", MARKED)
ALIKE = """CASE WHEN A[1:32] = B[1:32] THEN 1.0::DOUBLE ELSE coalesce(
  len(list_intersect(LA, LB))::DOUBLE / nullif(len(LA) + len(LB) - len(list_intersect(LA, LB)), 0),
  0) END"""


def alike(a: str, b: str) -> str:
    leaves = "list_distinct(regexp_extract_all(X[34:], '[0-9a-f]{8}'))"
    return (ALIKE.replace("LA", leaves.replace("X", "«")).replace("LB", leaves.replace("X", "»"))
            .replace("A[", "«[").replace("B[", "»[").replace("«", a).replace("»", b))


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id))
    AS following FROM d),
e AS (SELECT *, t[1:length(t) - length(t) // 2] || following[1:length(t) // 2] AS edited FROM n),
l AS (SELECT *, {TREE.replace("TEXT", "t")} AS lt, {TREE.replace("TEXT", "edited")} AS le FROM e),
k AS (SELECT *, {NODES.replace("LEAVES", "lt")} AS nt, {NODES.replace("LEAVES", "le")} AS ne
      FROM l),
f AS (
  SELECT *, {PRINT.replace("NODES", "nt").replace("LEAVES", "lt")} AS fingerprint,
    {PRINT.replace("NODES", "ne").replace("LEAVES", "le")} AS edited_fingerprint FROM k),
g AS (
  SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY doc_id),
    first_value(fingerprint) OVER (ORDER BY doc_id)) AS next_fingerprint FROM f)
SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, fingerprint,
  edited_fingerprint, {alike("fingerprint", "edited_fingerprint")} AS near_edited,
  {alike("fingerprint", "next_fingerprint")} AS near_next
FROM g"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id))
  AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {REPEAT - 1}], ' '))
    AS times FROM d, unnest(range(1, len(w) - {REPEAT - 2})) AS r(i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {REPEAT})) AS i FROM windows WHERE times > 1),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def hits(kind: str, pattern: str, group: int, condition: str, source: str = "d") -> str:
    """Matches with the gap before each; their places follow by running sums."""
    p = quoted(pattern)
    return f"""SELECT doc_id, '{kind}' AS kind, hit, part, e - length(hit) AS start, e AS "end"
  FROM (SELECT doc_id, k, hit, part, sum(length(gap) + length(hit))
      OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS e
    FROM (SELECT doc_id, generate_subscripts(h, 1) AS k, unnest(h) AS hit, unnest(g) AS part,
        unnest(gaps[1:len(h)]) AS gap
      FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {group})
          AS g, string_split_regex(t, {p}) AS gaps FROM {source})))
  WHERE {condition}"""


def blanked(source: str, spans: str) -> str:
    """The texts of `source` with a blank for every character in one of `spans`."""
    return f"""
  SELECT doc_id, t FROM {source} ANTI JOIN {spans} USING (doc_id) UNION ALL
  SELECT c.doc_id, string_agg(CASE WHEN g.i IS NULL THEN c.c ELSE ' ' END, '' ORDER BY c.i) AS t
  FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i
        FROM {source} SEMI JOIN {spans} USING (doc_id)) c
  LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS i FROM {spans}) g
    ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY c.doc_id"""


def letters(pattern: str) -> str:
    return f"length(regexp_replace(hit, '[^{pattern}]', '', 'g'))"


# Letters of both cases alone are a class of their own, unless they hold a placeholder word.
MIXED_SQL = f"""WHEN NOT regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]')
  AND regexp_matches(hit, '[A-Z]') AND NOT regexp_matches(hit, {quoted(ALLOWED[-1])})
  AND {letters('A-Z')} / {letters('A-Za-z')} BETWEEN {CAPITALS[0]} AND {CAPITALS[1]}
  THEN {MIXED_BITS}"""
ENTROPY = " ".join(
    [MIXED_SQL] + [f"WHEN regexp_matches(hit, {quoted(a)}) THEN 99" for a in ALLOWED]
    + [f"WHEN regexp_matches(hit, {quoted(p)}) THEN {bits}" for _, p, _, bits in CLASSES])
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  {hits("assign", ASSIGN, 2, f"length(part) >= {MIN_VALUE}")}
  UNION ALL {hits("access", ACCESS, 0, "true")}
  UNION ALL {hits("hex", HEX, 0, "true")}),
beside AS ({blanked("d", "base")}),
parts AS ({hits("part", PART.removeprefix(HEAD), 0, "true", "beside")}),
rest AS ({blanked("beside", "parts")}),
candidates AS ({hits("entropy", CANDIDATE, 0, "true", "rest")}),
classed AS (SELECT *, CASE {ENTROPY} END AS bits FROM candidates),
letters AS (
  SELECT doc_id, start, i, c, count(*) AS n FROM (
    SELECT doc_id, start, i, unnest(string_split(hit[i:i + {WINDOW - 1}], '')) AS c
    FROM classed, unnest(range(1, length(hit) - {WINDOW - 2})) AS r(i) WHERE bits < 99)
  GROUP BY ALL),
tops AS (
  SELECT doc_id, start, max(h) AS h FROM (
    SELECT doc_id, start, i, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h
    FROM letters GROUP BY doc_id, start, i) GROUP BY doc_id, start),
found AS (
  SELECT doc_id, kind, start, "end" FROM base
  UNION ALL SELECT c.doc_id, c.kind, c.start, c."end" FROM classed c
  JOIN tops p ON p.doc_id = c.doc_id AND p.start = c.start WHERE h >= bits),
told AS (
  SELECT *, concat_ws(':', kind, start::VARCHAR, "end"::VARCHAR) AS s,
    list_position({list(KINDS)}, kind) AS rank FROM found),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base,
    string_agg(s, ',' ORDER BY start, rank) AS spans FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11)
    || chr(12) || chr(13)), {LETTERS}) AS k FROM d, unnest(range(1, len(l) + 1)) AS r(i)),
often AS (
  SELECT k, max(doc_id) AS last FROM e WHERE length(k) >= {MIN_CHARS} GROUP BY k
  HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
told AS (
  SELECT e.*, last IS NOT NULL AND last <> doc_id AS gone FROM e LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""

# Equal runs of six words a period apart, joined to stretches of one diagonal: any run has one.
RUNS = rf"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h
  FROM documents, steps),
planned AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS c FROM hashed),
d AS (
  SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // c) END]) ELSE w END AS w
  FROM planned),
grams AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS g
  FROM d, unnest(range(greatest(n - 5, 0))) AS r(i)),
often AS (SELECT doc_id, g, list(i ORDER BY i) AS spots FROM grams GROUP BY ALL HAVING count(*) > 1),
firsts AS (SELECT doc_id, spots, unnest(range(1, len(spots) + 1)) AS k FROM often),
pairs AS (
  SELECT doc_id, spots[k] AS i, unnest(spots[k + 1:]) - spots[k] AS lag FROM firsts),
islands AS (
  SELECT doc_id, lag, min(i) AS start, count(*) + 5 AS overlap FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS b FROM pairs)
  GROUP BY doc_id, lag, b),
runs AS (
  SELECT doc_id, start, overlap + lag AS length, min(lag) AS period FROM islands
  WHERE overlap >= greatest(12 - lag, lag) GROUP BY doc_id, start, overlap + lag),
spans AS (
  SELECT doc_id, start + period AS a, start + length AS b FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM spans),
told AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}},
      (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS r
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(w[x.i + 1], ' ' ORDER BY x.i) AS c
  FROM d, unnest(range(n)) AS x(i) LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.i = x.i
  WHERE g.i IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length,
  best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM sizes, whole),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""

ORACLES: dict[str, str] = {
    "op1_quality_cascade": QUALITY, "op2_stratified_shards": SHARDING,
    "op3_curriculum_mix": MIXING, "op4_merkle_fingerprints": FINGERPRINTS,
    "op7_parity_join": JACCARD, "op8_suffix_dedup": REPEATS, "op9_secret_scan": SECRETS,
    "op11_line_dedup": LINES, "op12_periodic_runs": RUNS, "op13_lexical_search": SEARCH}

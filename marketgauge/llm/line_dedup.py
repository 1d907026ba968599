"""Line dedup: a line that many documents hold stays in one of them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted
from .texts import bound, spare, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
# Fixed value: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"
# Lines that hold more than one part in so many of all copies meet their rows in a broadcast.
HOT = 100_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z."""
    return F.translate(F.trim(line, F.lit(BLANK)), ascii_uppercase, ascii_lowercase)


def counted_lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(id, is, pos, h1, h2) for each line with a key of `min_chars` code points or more: the
    document, a code of its text, the line's place and 128 bits of its key."""
    # A text below the length has no such line and is not cut up.
    rows = docs.filter(F.char_length(text) >= min_chars).select(
        F.col(key).alias("id"), F.xxhash64(text).alias("is"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.select("id", "is", "pos", line_key(F.col("line")).alias("line")).filter(
        F.char_length("line") >= min_chars)
    return keyed.select("id", "is", "pos", F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit(1), "line").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """(h1, h2, docs, last): line keys of `min_docs` documents or more, and the largest document
    that holds each; written, with their number.

    Documents are counted after an exchange by (line, document), summed in each task before the
    one by line: a line of every document is one row a task there.
    """
    found = lines.groupBy("h1", "h2").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"),
        F.max("id").alias("last"))
    return cut_counted(found.filter(F.col("docs") >= min_docs))


def lines_to_drop(lines: DataFrame, min_docs: int, hot: int = HOT) -> DataFrame:
    """(id, is, dropped): for each text that loses lines, their places.

    Up to `hot` line keys are broadcast. Of more, those with more than 1 / `hot` of all copies, at
    most `hot` many, are; the others are joined by an exchange in which no line is large.
    """
    found, rows = repeated_lines(lines, min_docs)
    same = ["h1", "h2"]
    if rows <= hot:
        lost = lines.join(F.broadcast(found.select(*same, "last")), same)
    else:
        frequent = F.col("docs") * hot > found.agg(F.sum("docs").alias("n")).scalar()
        first = F.broadcast(found.filter(frequent).select(*same, "last"))
        rest = found.filter(~frequent).select(*same, "last")
        others = lines.join(first.select(*same), same, "left_anti")
        lost = lines.join(first, same).unionByName(others.join(rest, same))
    return (lost.filter(~F.col("id").eqNullSafe(F.col("last")))
            .groupBy("id", "is").agg(F.collect_set("pos").alias("dropped")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: int = HOT,
                names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """Adds `n_lines`, `n_dropped` and `kept`, the text without the lines it loses.

    Texts are split at line feeds. A line whose key (`line_key`) has `min_chars` code points or
    more and is found in `min_docs` documents or more goes everywhere but in the largest document
    that holds it, which keeps all its copies. All other lines stay, in their places.

    Rows of one key are one document; a NULL key is a document too, below all others. NULL and
    empty texts are one empty line, and `kept` is NULL or empty. Equal rows fare equally, an empty
    table gives no rows. Other columns go through, columns of the new names are replaced.

    Only codes of lines are exchanged to find repeated ones. Places of lost lines then meet the
    texts by document and code of the text; texts without a long line are spread.
    """
    docs = docs.drop(*names)
    lost = cut(lines_to_drop(counted_lines(docs, key, text, min_chars), min_docs, hot))
    is_, id_, of, dropped = spare(docs, "_is", "_id", "_of", "_dropped")
    lost = lost.select(F.col("id").alias(id_), F.col("is").alias(of),
                       F.col("dropped").alias(dropped))
    # A row that can lose nothing need not meet the others of its key and text.
    chance = (F.rand(1) * 2 ** 62).cast("long")
    marked = docs.withColumn(is_, F.when(F.char_length(text) >= min_chars, F.xxhash64(text))
                             .otherwise(chance))
    joined = marked.join(lost, F.col(key).eqNullSafe(F.col(id_)) & (F.col(is_) == F.col(of)),
                         "left")
    stays = bound(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped),
        lambda i: F.get(lines, i)), "\n"))
    n_lines, n_dropped, kept = names
    count = F.regexp_count(whole_text(text), F.lit("\n")) + 1
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], count.cast("long").alias(n_lines),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(dropped).isNull(), F.col(text)).otherwise(stays).alias(kept))

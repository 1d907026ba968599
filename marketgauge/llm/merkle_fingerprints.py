"""Document fingerprints as hash trees over paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .texts import whole_text

# Fixed values. A paragraph is a line with the line ends behind it. A leaf is a clause: up to 96
# characters and the marks that end it; the leaves of a text put together are the text. A section
# ends after a paragraph whose node begins with 0 or 1: sections find themselves again behind an
# insertion, and hold eight paragraphs on average.
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
LEAF = r"[^\n.,;:!?|]{1,96}[\n.,;:!?|]*|[\n.,;:!?|]+"
SECTION_ENDS = "[01]"
SHORT = 8


def leaf_hashes(text: Column) -> Column:
    """array<array<string>>: for each paragraph the md5 of each of its leaves."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), 0), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(LEAF), 0), lambda x: F.md5(x)))


def paragraph_nodes(leaves: Column) -> Column:
    return F.transform(leaves, lambda p: F.md5(F.array_join(p, "")))


def section_nodes(paragraphs: Column) -> Column:
    """Nodes of the runs of paragraphs that end at a marked one."""
    marked = F.transform(paragraphs, lambda n: F.when(n.rlike("^" + SECTION_ENDS),
                                                      F.concat(n, F.lit(";"))).otherwise(n))
    runs = F.filter(F.split(F.array_join(marked, ""), ";"), lambda s: s != "")
    return F.transform(runs, lambda s: F.md5(s))


def fingerprint_of(leaves: Column, paragraphs: Column) -> Column:
    """root:body. The body has the first 8 digits of each leaf; a comma ends a paragraph, a
    semicolon also its section. Paragraph and section nodes follow from the leaves."""
    body = F.transform(F.arrays_zip(leaves.alias("l"), paragraphs.alias("n")), lambda x: F.concat(
        F.array_join(F.transform(x["l"], lambda h: F.substring(h, 1, SHORT)), ""),
        F.when(x["n"].rlike("^" + SECTION_ENDS), F.lit(";")).otherwise(F.lit(","))))
    root = F.md5(F.array_join(section_nodes(paragraphs), ""))
    return F.concat(root, F.lit(":"), F.array_join(body, ""))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the column `name`: the fingerprint of `text` (NULL: the empty text).

    Equal texts have equal fingerprints; different texts have different roots but for md5
    collisions. The length follows the text's: nothing is sampled.
    """
    return (df.withColumn("_leaves", leaf_hashes(whole_text(text)))
            .withColumn("_nodes", paragraph_nodes(F.col("_leaves")))
            .withColumn(name, fingerprint_of(F.col("_leaves"), F.col("_nodes")))
            .drop("_leaves", "_nodes"))


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaves in a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(
        F.substring(fingerprint, 34, 2 ** 31 - 1), F.lit("[0-9a-f]{8}"), 0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal roots, else the share of distinct leaves that both trees have."""
    mine, other = leaves_of(a), leaves_of(b)
    both = F.size(F.array_intersect(mine, other))
    shared = both / (F.size(mine) + F.size(other) - both)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).otherwise(
        F.coalesce(shared, F.lit(0.0)))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, leaves>>: where b's tree differs from a's.

    Walks down from the root: equal roots or sections end the walk; in the other sections the
    paragraphs that a has nowhere are named by their place (from 0) with their new leaves.
    """
    def sections(fp: Column) -> Column:
        return F.regexp_extract_all(F.substring(fp, 34, 2 ** 31 - 1), F.lit("[^;]*;|[^;]+"), 0)

    def paragraphs(s: Column) -> Column:
        return F.regexp_extract_all(s, F.lit("[^,;]*[,;]"), 0)

    def leaves(p: Column) -> Column:
        return F.regexp_extract_all(p, F.lit("[0-9a-f]{8}"), 0)

    known_sections = sections(a)
    known = F.flatten(F.transform(known_sections, paragraphs))
    known_leaves = leaves(F.substring(a, 34, 2 ** 31 - 1))
    found = F.flatten(F.transform(sections(b), lambda s, i: F.when(
        F.array_contains(known_sections, s), F.array().cast(EDIT)).otherwise(F.filter(F.transform(
            paragraphs(s), lambda p, j: F.when(~F.array_contains(known, p), F.struct(
                i.alias("section"), j.alias("paragraph"),
                F.array_except(leaves(p), known_leaves).alias("leaves")))),
            lambda x: x.isNotNull()))))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast(EDIT)).otherwise(
        found)


EDIT = "array<struct<section:int,paragraph:int,leaves:array<string>>>"


def next_in_order(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) for distinct keys in ascending order, the last followed by the first.

    The keys are range-sorted and written with their place, so that places stay fixed; neighbours
    meet by range, and the ends of ranges by a table of one row for each range.
    """
    placed = cut(ids.select(key).distinct().orderBy(key)
                 .withColumn("_place", F.monotonically_increasing_id())
                 .withColumn("_range", F.shiftright("_place", 33)))
    inside = Window.partitionBy("_range").orderBy("_place")
    near = placed.withColumn("_next", F.lead(key).over(inside))
    heads = placed.groupBy("_range").agg(F.min(key).alias("_head"))
    following = Window.orderBy("_range")
    heads = heads.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.lead("_head").over(following), F.first("_head").over(
            following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .alias("_after"))
    return (near.join(heads, F.col("_range") == F.col("_of"))
            .select(key, F.coalesce("_next", "_after").alias("next_key")))


def edit_fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints each text and an edited text, and rates how alike the trees are.

    Returns the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint,
    near_edited, near_next. The edited text has its last floor(n_chars / 2) code points replaced by
    as many (or all) from the beginning of the text with the next larger key; the last key is
    followed by the first. NULL text is the empty text. Keys are longs above -2 ** 63; a NULL key
    stands before all others. Of
    several texts with one key, the smallest beginning stands for the key as the next text; each
    row is edited by itself. Other columns are dropped; an empty table gives no rows.

    Whole texts cross one exchange, by key, which both joins use; beginnings of half a text's
    length cross a second one. Links are made from keys and lengths alone.
    """
    lowest = F.lit(-2 ** 63)
    texts = docs.select(F.coalesce(F.col(key), lowest).alias("_id"), whole_text().alias("text"))
    needs = (docs.select(F.coalesce(F.col(key), lowest).alias("_id"),
                         F.char_length(whole_text()).alias("_chars"))
             .groupBy("_id").agg(F.max("_chars").alias("_chars")))
    links = next_in_order(needs, "_id").join(needs, "_id").select(
        F.col("next_key").alias("_next"), F.col("_id").alias("_wanted_by"),
        F.expr("_chars div 2").cast("int").alias("_need"))
    served = texts.join(links.hint("shuffle_hash"), F.col("_id") == F.col("_next"))
    served = with_fingerprint(served, F.col("text"), "_fp").groupBy("_wanted_by").agg(F.min(
        F.struct(F.expr("left(text, _need)").alias("beginning"), F.col("_fp").alias("fp")))
        .alias("_n"))
    both = texts.join(served, F.col("_id") == F.col("_wanted_by"))
    half = F.expr("char_length(text) div 2")
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "_edited", F.concat(F.left("text", F.char_length("text") - half),
                            F.left("_n.beginning", half)))
    both = with_fingerprint(both, F.col("text"), "fingerprint")
    both = with_fingerprint(both, F.col("_edited"), "edited_fingerprint")
    return both.select(
        F.nullif(F.col("_id"), lowest).alias(key), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", F.col("_n.fp").alias("next_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_n.fp")).alias("near_next"))

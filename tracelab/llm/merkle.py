"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

#: A paragraph leaf: a line, or the sentences of a line, in pieces of 120 code points at most. The leaves of a text cover it.
LEAF = r"[^.!?\n]{0,120}+[.!?\n]+[ ]*|[^.!?\n]{1,120}"
#: Rows of a range of neighbouring documents, and the most ranges (their bounds are literals of the plan).
RANGE_ROWS, MOST_RANGES = 1024, 20_000
#: Keys of a range that its bounds are chosen from.
SAMPLED = 8


def fingerprint(text: Column) -> Column:
    """root|section;section;... where a section is the comma-separated hashes of its leaves.

    A leaf's hash has 12 hexadecimal digits of its MD5. A section ends after a leaf whose hash starts with 0 or 1, so where
    sections end depends on the text there alone and an edit leaves the other sections as they are. The root is the MD5 of the
    sections' hashes. An empty text has no leaves. Equal texts have equal fingerprints; different ones have different
    fingerprints unless all of their leaves agree in 48 bits.
    """
    hashes = F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.md5(x.cast("binary")), 1, 12))
    ended = F.transform(hashes, lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin("0", "1"), ";").otherwise(",")))
    body = F.regexp_replace(F.array_join(ended, ""), "[;,]$", "")
    root = lambda b: F.md5(F.array_join(F.transform(F.split(b, ";"), section_hash), ",").cast("binary"))
    # a lambda over an array of one, so that the leaves are hashed once for both uses
    return F.element_at(F.transform(F.array(body), lambda b: F.concat_ws("|", root(b), b)), 1)


def section_hash(section: Column) -> Column:
    return F.substring(F.md5(section.cast("binary")), 1, 12)


def sections(fp: Column) -> Column:
    """The sections of a fingerprint, each its leaves' hashes."""
    body = F.substring_index(fp, "|", -1)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ";"))


def nodes(fp: Column) -> Column:
    """The distinct nodes of the tree: root, sections and leaves."""
    leaves = F.filter(F.split(F.substring_index(fp, "|", -1), "[;,]"), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(F.substring_index(fp, "|", 1)), F.transform(sections(fp), lambda s: F.concat(F.lit("s"), section_hash(s))), leaves))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the nodes of two trees given by nodes(): 1 where the roots are equal, and only there."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def changed(a: Column, b: Column) -> Column:
    """The sections of fingerprint b, counted from 0, that a doesn't have: where b was edited."""
    old = sections(a)
    places = F.transform(sections(b), lambda s, i: F.when(F.array_contains(old, s), F.lit(None)).otherwise(i))
    return F.array_compact(places)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text (null: empty) and next_text: the text of the next row in order of id (nulls first), then the MD5 of the
    text; after the last row, that of the first.

    Rows are cut into ranges of about RANGE_ROWS rows of that order, at bounds from a sample of it; so neither rows without
    ids nor those of one id meet in one range, unless their texts are equal as well. Rows equal in id and text that would
    fill ranges of their own are counted where they are: one of them takes part, the others are each other's next. Each
    range is one window, sorted and read through once, and its first row also goes to the range before it as a guard. Texts
    are shuffled once. Beyond MOST_RANGES * RANGE_ROWS rows ranges are larger, not more: their bounds are literals of the plan.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("id", F.md5(F.col("text").cast("binary")).alias("m"))).withColumn("times", F.lit(1).cast("long"))
    kind = ArrayType(rows.schema["key"].dataType)
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    # about SAMPLED rows of each range
    some = [r.key for r in rows.select("key").where(F.rand(7) < SAMPLED * ranges / n).orderBy("key").limit(4 * SAMPLED * ranges).collect()] if ranges > 1 else []
    often = [k for k, times in Counter(some).items() if times > 2 * SAMPLED]
    if often:
        own = F.array_contains(literal(docs.sparkSession, often, kind), F.col("key"))
        alone = rows.where(own).groupBy("key").agg(F.first("key.id").alias("id"), F.first("text").alias("text"), F.sum("times").alias("times"))
        rows = rows.where(~own).unionByName(alone)
        some = sorted({*some} - {*often}, key=some.index)
    ranges = min(ranges, len(some))
    bounds = [some[i * len(some) // ranges] for i in range(1, ranges)]
    out = _followed(rows, bounds, kind)
    if not often:
        return out.select("id", "text", "next_text")
    # RANGE_ROWS copies of a row at a time, dealt out anew
    last = out.withColumn("copies", F.col("times") - 1)
    whole = last.where("copies > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {RANGE_ROWS}")))).repartition("key", "part")
    copies = whole.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RANGE_ROWS), F.col("copies") - F.col("part") * RANGE_ROWS))))
    return out.select("id", "text", "next_text").unionByName(copies.select("id", "text", F.col("text").alias("next_text")))


def literal(spark: SparkSession, keys: list, kind: ArrayType) -> Column:
    """An array of keys as a literal of the plan."""
    if not keys:
        return F.array().cast(kind)
    return F.from_json(F.lit(spark.createDataFrame([(keys,)], StructType([StructField("a", kind)])).select(F.to_json("a").alias("j")).first().j), kind)


def _followed(rows: DataFrame, bounds: list, kind: ArrayType) -> DataFrame:
    """rows (id, text, key, times) in ranges between bounds (ascending keys), with next_text."""
    spark, key = rows.sparkSession, F.col("key")
    # two levels, so that a row looks at about twice the root of the number of bounds
    step = max(1, int(len(bounds) ** 0.5))
    bucket = F.lit(0)
    if bounds:
        coarse = F.size(F.filter(literal(spark, bounds[step - 1 :: step], kind), lambda x: x <= key)) * step
        bucket = coarse + F.size(F.filter(F.slice(literal(spark, bounds, kind), coarse + 1, step), lambda x: x <= key))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # one key for each range at most
    firsts = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect()}
    names = sorted(firsts)
    before = dict(zip(names, [names[-1], *names[:-1]], strict=True)) if names else {}
    places = F.array(F.struct("bucket", F.lit(0).alias("guard")))
    if names:
        every = range(max(names) + 1)
        first = F.element_at(literal(spark, [firsts.get(i) for i in every], kind), F.col("bucket") + 1)
        lent = F.element_at(F.lit([before.get(i, 0) for i in every]), F.col("bucket") + 1)
        guard = F.when(first.eqNullSafe(key), F.array(F.struct(lent.cast("int").alias("bucket"), F.lit(1).alias("guard"))))
        places = F.concat(places, F.coalesce(guard, F.array().cast("array<struct<bucket:int,guard:int>>")))
    placed = rows.withColumn("place", F.explode(places)).select("id", "text", "key", "times", "place.*")
    order = Window.partitionBy("bucket").orderBy("guard", "key")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guard = 0").drop("guard", "bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the fingerprints of its text and of its edited text, and likenesses to the edited and the next text.

    The last floor(n_chars / 2) code points of a text are replaced by the first as many (or all) of the next row's text, in
    ascending order of id; the last row takes the first row's. A null text counts as empty; null ids come first; rows with
    equal ids follow each other in order of their texts' MD5. A table of one row is its own next row. Other columns are not carried.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint")
    )
    rows = rows.withColumns({f"{x}nodes": nodes(F.col(f"{x}fingerprint")) for x in ("", "edited_", "next_")})
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("nodes"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("nodes"), F.col("next_nodes")).alias("near_next"),
        F.concat_ws(",", changed(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("changed_sections"),
    )

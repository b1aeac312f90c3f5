"""Line dedup: lines that many documents share stay in the first of them only.

Lines are exploded with their position and keyed by 128 bits of the normalised line (ends stripped of space and controls
09 to 0D, A-Z lower-cased). Spark counts the distinct documents of each key; a key at the threshold sends the positions of
its lines back to their texts, which are put together again from the positions that are left. Texts are shuffled once,
lines travel as hashes.

A line that stands in a great share of all rows is a hot key: keys with over a thousandth of all lines (so a thousand at
most) are dealt over several tasks by a salt, all others fit one.

Null and empty texts are one empty line. Rows that repeat an id are one document and are judged together, each keeping
what is left of its own text. Rows without an id are together one document that comes after all others. Every row of the
input gives one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written

MIN_CHARS = 10
MIN_DOCUMENTS = 2
#: A key with more than one part in so many of all lines is dealt over tasks.
HOT_PARTS = 1_000
STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(line: Column) -> Column:
    """Stripped line with A-Z in lower case; all other letters stay as they are."""
    line = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(line) == F.length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, text and a 128-bit name of the pair, by which lines find back to their text."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return found.select("*", F.xxhash64("doc_id", "text").alias("n1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("n2"))


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2 (the key's hash), doc_id, n1, n2 (the text's name) and pos of every line whose key is long enough."""
    lines = _named(docs, doc_id, text).select("doc_id", "n1", "n2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "n1", "n2", "pos", normalised(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "n1", "n2", "pos"
    )


def repeated_keys(places: DataFrame, min_docs: int = MIN_DOCUMENTS) -> DataFrame:
    """Keys found in at least ``min_docs`` documents: their lines, and the smallest id, which keeps them."""
    counted = places.groupBy("h1", "h2").agg(
        (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"),
        F.count("*").alias("n_rows"),
        F.min("doc_id").alias("keeper"),
    )
    return counted.filter(F.col("n_docs") >= min_docs)


def dropped_places(places: DataFrame, repeated: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """n1, n2 and the positions that a text loses."""
    total = places.count()
    hot = repeated.filter(F.col("n_rows") * hot_parts > total).select(
        "h1", "h2", F.ceil(F.col("n_rows") * hot_parts / total).alias("salts")
    )
    # Each hot key has over total / hot_parts rows, so there are fewer than hot_parts of them.
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = places.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.pmod("n1", salts)).drop("salts")
    held = repeated.join(F.broadcast(hot), ["h1", "h2"], "left").select(
        "h1", "h2", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
    )
    lost = dealt.join(held, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("n1", "n2").agg(F.collect_set("pos").alias("lost"))


def line_dedup(
    docs: DataFrame, min_docs: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_text for every row of ``docs``.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines but those
    in the document with the smallest id.
    """
    places = written(line_places(docs, min_chars, doc_id, text), "places")
    lost = dropped_places(places, written(repeated_keys(places, min_docs), "repeated"))
    found = _named(docs, doc_id, text).join(lost, ["n1", "n2"], "left").withColumn("lines", F.split("text", "\n"))
    n_lines = F.size("lines")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), n_lines - 1), "lost"))
    rebuilt = F.array_join(F.transform(left, lambda at: F.get("lines", at)), "\n")
    return found.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.array_size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(rebuilt).alias("kept_text"),
    )

"""Merkle fixity audit of archived records.

Records are hashed into leaves; ``fanout`` consecutive records of a file, an ordered range of its offsets, make a node
of the next level, up to one root for each file. Replicas are compared at the roots, and only branches whose hashes
differ are followed down to the records that are changed, missing or surplus.

Archive files are as long as ``max_file_bytes`` allows, whatever the pages are, so neither one host nor copies of one
page make a file long. Null urls and bodies are empty, a null page id stays null; repeated rows are records of their
own; an empty table has no files. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written
from lodgecast.llm.words import rows

MAX_FILE_BYTES = 64 << 20
FANOUT = 16
RECORD_SCHEMA = "file string, nth long, offset long, length long, page_id long, record binary"


def warc_record(url: str, body: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def archive(
    pages: DataFrame, max_file_bytes: int = MAX_FILE_BYTES,
    page_id: str = "page_id", url: str = "url", body: str = "html",
) -> DataFrame:
    """Records with their file and offset; each task fills files of its own, in the order of its rows."""
    chosen = pages.select(
        F.col(page_id).cast("long"), F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, roll, nth, offset = TaskContext.get().partitionId(), 0, 0, 0
        names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for id_, address, text in rows(iter([batch.slice(at, 128)])):
                    record = warc_record(address, text.encode())
                    if offset and offset + len(record) > max_file_bytes:
                        roll, nth, offset = roll + 1, 0, 0
                    out.append((f"{task:06d}-{roll:06d}.warc", nth, offset, len(record), id_, record))
                    nth, offset = nth + 1, offset + len(record)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return chosen.mapInArrow(run, RECORD_SCHEMA)


def read_records(records: DataFrame) -> DataFrame:
    """page_id, url and body of archived records."""
    text = F.decode("record", "UTF-8")
    head = F.substring_index(text, "\r\n\r\n", 1)
    # The body lies between the blank line after the head and the two line ends that close a record.
    body = F.substr(text, F.length(head) + 5, F.length(text) - F.length(head) - 8)
    return records.select(
        "page_id", F.regexp_extract(head, "WARC-Target-URI: ([^\\r\\n]*)", 1).alias("url"), body.alias("body")
    )


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first: file, node, first and end offset, hash.

    A level has a row for every ``fanout`` of the one below; the last has one for each file.
    """
    leaves = records.select(
        "file", F.col("nth").alias("node"), F.col("offset").alias("first"),
        (F.col("offset") + F.col("length")).alias("end"), _digest(F.col("record")).alias("hash"),
    )
    levels = [written(leaves, "leaves")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while True:
        # The hash of a range covers its offsets and the hashes below in their order.
        child = F.struct("first", "end", "node", "hash")
        ordered = F.transform(
            F.sort_array(F.collect_list(child)),
            lambda c: F.concat(F.encode(F.concat_ws(":", c["first"], c["end"]), "UTF-8"), c["hash"]),
        )
        above = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(
            F.min("first").alias("first"), F.max("end").alias("end"),
            _digest(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x))).alias("hash"),
        )
        levels.append(written(above, "nodes"))
        if last < fanout:
            return levels
        last //= fanout


def audit(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file, nth, first, end and status of every record in which two replicas differ.

    Status: changed, missing (only in the left one) or surplus (only in the right one). Replicas may differ in depth.
    """
    suspects = None
    for level in range(max(len(left), len(right)) - 1, -1, -1):
        a, b = (_level(side, level, fanout) for side in (left, right))
        if suspects is not None:
            a, b = (_under(side, suspects, fanout) for side in (a, b))
        a = a.select("file", "node", *[F.col(c).alias(f"a_{c}") for c in ("first", "end", "hash")])
        b = b.select("file", "node", *[F.col(c).alias(f"b_{c}") for c in ("first", "end", "hash")])
        same = F.col("a_hash").eqNullSafe(F.col("b_hash")) & F.col("a_first").eqNullSafe(F.col("b_first"))
        suspects = a.join(b, ["file", "node"], "full").filter(~same)
    status = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "surplus").otherwise("changed")
    return suspects.select(
        "file", F.col("node").alias("nth"), F.coalesce("a_first", "b_first").alias("first"),
        F.coalesce("a_end", "b_end").alias("end"), status.alias("status"),
    )


def _level(levels: list[DataFrame], level: int, fanout: int) -> DataFrame:
    """A level of a tree; above its root the root stands for itself."""
    return levels[min(level, len(levels) - 1)]


def _under(nodes: DataFrame, suspects: DataFrame, fanout: int) -> DataFrame:
    parents = suspects.select("file", F.col("node").alias("_parent"))
    return nodes.withColumn("_parent", F.floor(F.col("node") / fanout)).join(
        parents, ["file", "_parent"], "left_semi"
    ).drop("_parent")

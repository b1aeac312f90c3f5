"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks for each file.

A line break ends a record where the number of quotes before it is even. Every block of a file counts its quotes; a prefix
over the counts says which blocks begin inside a quoted field; then each block cuts its own lines into records, and only the
pieces at the edges of blocks are moved, to be joined with their neighbours. Lines are streamed, so a task holds one record
at a time; the driver gets one row for each block that begins inside a field.

Quotes are doubled inside quoted fields, and a field with a quote in it is quoted, as RFC 4180 has it. A quote that is never
closed makes the rest of its file one record.
"""

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCHEMA = "file string, start long, part int, record string"
_NAMES = ["file", "start", "part", "record"]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.string()]
#: End of a record begun in an earlier block, whole record, begin of a record, block without any end.
_END, _WHOLE, _BEGIN, _MIDDLE = range(4)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def blocks_inside(lines: DataFrame) -> set[tuple[str, int]]:
    """Blocks (file, start) that begin inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("before", F.sum("quotes").over(before)).filter("before % 2 = 1")
    return {(r["file"], r["start"]) for r in inside.select("file", "start").collect()}


def csv_records(spark: SparkSession, path: str | list[str], header: Sequence[str]) -> DataFrame:
    """One column, ``record``, without the files' header records, which must be as stated; empty lines are no records."""
    lines, names = _lines(spark, path), list(header)
    inside_at = blocks_inside(lines)

    def check(record: str) -> None:
        found = next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline="")), [])
        if found != names:
            raise ValueError(f"the header is {found}, not {names}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, inside, kind, first = None, [], False, _WHOLE, False

        def batch_of(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], _NAMES)

        def rest() -> list:
            return [(*block, _MIDDLE if kind == _END else _BEGIN, "\n".join(held))] if held else []

        for batch in batches:
            out = []
            for file, start, line in zip(*(batch.column(n).to_pylist() for n in ("file", "start", "value")), strict=True):
                if (file, start) != block:
                    out += rest()
                    block, held, inside, first = (file, start), [], (file, start) in inside_at, start == 0
                    kind = _END if inside else _WHOLE
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if inside:
                    continue
                record = "\n".join(held).removesuffix("\r")
                if first:
                    check(record)
                elif record or kind == _END:
                    out.append((file, start, kind, record))
                held, kind, first = [], _WHOLE, False
            yield batch_of(out)
        yield batch_of(rest())

    pieces = lines.mapInArrow(cut, _SCHEMA)
    whole = pieces.filter(F.col("part") == _WHOLE).select("record")
    # At most two edges for each block; an end belongs to the last begin before it.
    edges = pieces.filter(F.col("part") != _WHOLE)
    order = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("nth", F.sum((F.col("part") == _BEGIN).cast("int")).over(order))
    joined = edges.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("all"))
    return whole.unionByName(joined.select(F.array_join(F.col("all.record"), "\n").alias("record")))

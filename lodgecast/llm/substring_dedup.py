"""Removal of word passages that occur elsewhere: Rabin-Karp hashes of every window, counted in Spark.

A window is ``width`` consecutive words of one text. A word is removed if a window over it also starts at any other
place, in the same text or another; all windows are judged on the input. Overlapping windows merge into intervals.

How the count stays small. Each task packs its hashes into one binary column for each hash bucket, so a bucket, not a
window, is a row of the shuffle. A hash that a task meets twice is sent once and its places are settled there, so a
passage in a third of all texts costs a bucket one entry for each pack. Before windows are counted, the same counting
runs over *anchors*: in every window the 8-word run with the smallest hash is its anchor, and equal windows have equal
anchors, so windows whose anchor occurs once need no count. Buckets and hashes come from two independent rolling hashes.

Null and empty texts have no windows and keep no words. Rows with equal texts share one outcome; every input row gives
one output row, and a null id is an id like any other. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodgecast.llm.words import SECOND_BASE, first_minima, mixed, rolling, rows, split_words, word_hashes

WIDTH = 35
ANCHOR = 8
#: Entries that one pack holds before it is sent on.
PACK = 1_000_000
#: Characters of input for each hash bucket of a counting round: about a million windows.
CHARS_PER_BUCKET = 6_000_000
#: A task of the counting rounds takes this many buckets, one after another, within these numbers of tasks.
BUCKETS_PER_TASK = 16
FEWEST_TASKS, MOST_TASKS = 200, 20_000

_PACKED = "bucket int, hashes binary, owners binary, places binary, texts binary"
_NAMES = ("bucket", "hashes", "owners", "places", "texts")
_PLACES = "digest long, places binary"


def anchors(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor place of each window, and the hashes of all runs that can be anchors."""
    runs = rolling(word_hashes(words), min(ANCHOR, width))
    return first_minima(runs, width - min(ANCHOR, width) + 1), runs


def _window_hashes(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    values = word_hashes(words)
    return rolling(values, width), rolling(mixed(values), width, SECOND_BASE)


def _pack(parts: list[tuple], buckets: int) -> Iterator[tuple]:
    """Rows for the buckets of one pack. parts: digest, hashes, second hashes and places of each text."""
    texts = np.array([p[0] for p in parts], np.int64)
    hashes = np.concatenate([p[1] for p in parts])
    second = np.concatenate([p[2] for p in parts])
    owners = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[1]) for p in parts])
    places = np.concatenate([p[3] for p in parts]).astype(np.int32)
    bucket = (mixed(second) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((hashes, bucket))
    hashes, owners, places, bucket = hashes[order], owners[order], places[order], bucket[order]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = (hashes[1:] == hashes[:-1]) & (bucket[1:] == bucket[:-1])
    sure, first = same[1:] | same[:-1], ~same[:-1]
    first_bucket = bucket[first]
    edges = np.flatnonzero(np.r_[True, first_bucket[1:] != first_bucket[:-1], True])
    # The first of each hash speaks for the pack in the hash's bucket.
    spoken, spoken_at = owners[first], places[first]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield _row(int(first_bucket[a]), hashes[first][a:b], spoken[a:b], spoken_at[a:b], texts)
    # Places of hashes met twice here are settled: they go along without a hash, to any bucket.
    if sure.any():
        yield _row(int(texts[0] % buckets), hashes[:0], owners[sure], places[sure], texts)


def _row(bucket: int, hashes: np.ndarray, owners: np.ndarray, places: np.ndarray, texts: np.ndarray) -> tuple:
    """Owners become places in the row's own list of texts, which holds only those that it names."""
    known, owners = np.unique(owners, return_inverse=True)
    return bucket, hashes.tobytes(), owners.astype(np.int32).tobytes(), places.tobytes(), texts[known].tobytes()


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(_NAMES))


def _packer(spots: Callable, buckets: int) -> Callable:
    """A task that packs what ``spots`` finds in each row: digest, hashes, second hashes and places."""
    # Rows for very many buckets would be short: packs grow with the buckets, up to four times.
    pack = min(max(PACK, 100 * buckets), 4 * PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {}, 0
        for row in rows(batches):
            part = spots(row)
            # A second copy of a text in one pack adds nothing: copies are counted on their own.
            if part is not None and len(part[1]) and part[0] not in parts:
                parts[part[0]] = part
                held += len(part[1])
            if held >= pack:
                yield _batch(list(_pack(list(parts.values()), buckets)))
                parts, held = {}, 0
        if parts:
            yield _batch(list(_pack(list(parts.values()), buckets)))

    return run


def _by_group(digests: np.ndarray, places: np.ndarray, groups: int) -> pa.RecordBatch:
    """Places on their way back to their texts: one row for each group of texts."""
    group = digests % groups
    order = np.argsort(group, kind="stable")
    digests, places, group = digests[order], places[order].astype(np.int32), group[order]
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
    cut = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(group[edges[:-1]], pa.int32()),
            pa.array([digests[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([places[a:b].tobytes() for a, b in cut], pa.binary()),
        ],
        ["group", "digests", "places"],
    )


def _distinct(digests: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending."""
    digest, place = np.concatenate(digests), np.concatenate(places)
    order = np.lexsort((place, digest))
    digest, place = digest[order], place[order]
    new = np.r_[True, (digest[1:] != digest[:-1]) | (place[1:] != place[:-1])][: len(digest)]
    return digest[new], place[new]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text with its places, ascending. Rows arrive sorted by group; one group is held at a time."""

    def texts() -> pa.RecordBatch:
        digest, place = _distinct(digests, places)
        edges = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1], True])
        cut = zip(edges[:-1], edges[1:], strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest[edges[:-1]]), pa.array([place[a:b].tobytes() for a, b in cut], pa.binary())],
            ["digest", "places"],
        )

    current, digests, places, held = None, [], [], 0
    for batch in batches:
        for group, d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != current and digests:
                yield texts()
                digests, places, held = [], [], 0
            current = group
            digests.append(np.frombuffer(d, np.int64))
            places.append(np.frombuffer(p, np.int32))
            held += len(digests[-1])
            if held > 2 * PACK:  # copies of a text send the same places
                one, two = _distinct(digests, places)
                digests, places, held = [one], [two], 0
    if digests:
        yield texts()


def _counted(packs: list[tuple], groups: int) -> pa.RecordBatch:
    """Places in one bucket whose hash more than one pack sent."""
    hashes = np.concatenate([np.frombuffer(p[1], np.uint64) for p in packs])
    digests = np.concatenate([_digests(p) for p in packs])
    places = np.concatenate([np.frombuffer(p[3], np.int32) for p in packs])
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = hashes[order][1:] == hashes[order][:-1]
    twice = order[same[1:] | same[:-1]]
    return _by_group(digests[twice], places[twice], groups)


def _digests(row: tuple) -> np.ndarray:
    return np.frombuffer(row[4], np.int64)[np.frombuffer(row[2], np.int32)]


def _counter(groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs arrive sorted by bucket; one bucket is held at a time, settled places pass through."""
        current, packs = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[1]:
                    yield _by_group(_digests(row), np.frombuffer(row[3], np.int32), groups)
                    continue
                if row[0] != current and packs:
                    yield _counted(packs, groups)
                    packs = []
                current = row[0]
                packs.append(row)
        if packs:
            yield _counted(packs, groups)

    return run


def reduce_tasks(buckets: int) -> int:
    """Tasks for the buckets of a round. A task sorts its rows on disk and holds one bucket, however many it takes."""
    return min(buckets, max(FEWEST_TASKS, -(-buckets // BUCKETS_PER_TASK)), MOST_TASKS)


def _repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """digest and places of what was packed at more than one place, one row for each text."""
    tasks = reduce_tasks(buckets)
    spread = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    back = spread.mapInArrow(_counter(buckets), "group int, digests binary, places binary")
    return back.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(_gather, _PLACES)


def _unpacked(places: bytes | None) -> np.ndarray:
    return np.frombuffer(places or b"", np.int32)


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows at these ascending starts, as [first, end)."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.r_[0, gaps + 1]]
    last = starts[np.r_[gaps, len(starts) - 1]] + width
    return list(zip(first.tolist(), last.tolist(), strict=True))


def repeated_windows(docs: DataFrame, width: int = WIDTH, chars_per_bucket: int = CHARS_PER_BUCKET) -> DataFrame:
    """digest and places of the repeated windows of every text that has any.

    ``docs`` has the columns doc_id, text and digest.
    """
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = int(total // chars_per_bucket) + 1

    def anchor_spots(row: tuple):
        words = split_words(row[1])
        if len(words) < width:
            return None
        chosen, runs = anchors(words, width)
        chosen = np.unique(chosen)
        hashes = runs[chosen]
        return row[0], hashes, hashes * np.uint64(SECOND_BASE), chosen

    last: list = [None]

    def window_spots(row: tuple):
        _, text, digest, places = row
        if digest == last[0]:  # a copy of the text before it, whose windows are counted already
            return None
        last[0] = digest
        words = split_words(text)
        chosen, _ = anchors(words, width)
        starts = np.flatnonzero(np.isin(chosen, _unpacked(places)))
        first, second = _window_hashes(words, width)
        return digest, first[starts], second[starts], starts

    def window_packs(batches):
        last[0] = None
        return _packer(window_spots, buckets)(batches)

    found = docs.select("digest", "text").mapInArrow(_packer(anchor_spots, buckets), _PACKED)
    candidates = _repeated(found, buckets)
    # Copies of one text lie side by side after the join and are hashed once. All columns go along, so that the
    # exchange of the texts is the one that the final join needs and Spark runs it once.
    texts = docs.join(candidates, "digest").select("doc_id", "text", "digest", "places")
    windows = texts.mapInArrow(window_packs, _PACKED)
    return _repeated(windows, buckets)


def _marked(docs: DataFrame, width: int, doc_id: str, text: str, chars_per_bucket: int) -> DataFrame:
    """The rows of ``docs`` in ``_row``, their text, and the marks of the text."""
    plain = docs.select(
        F.struct("*").alias("_row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
    )
    copies = plain.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    marks = repeated_windows(plain.drop("_row"), width, chars_per_bucket).join(copies, "digest", "full")
    return plain.join(marks, "digest", "left")


def _cut(words: list[bytes], places: bytes | None, copies: int | None, width: int) -> list[tuple[int, int]]:
    if copies and len(words) >= width:
        return [(0, len(words))]  # every window of a text with copies starts elsewhere too
    return intervals(_unpacked(places), width)


def _kept(words: list[bytes], cut: list[tuple[int, int]]) -> str:
    edges = [0, *(e for c in cut for e in c), len(words)]
    return b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]).decode()


def substring_dedup(
    docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    chars_per_bucket: int = CHARS_PER_BUCKET,
) -> DataFrame:
    """doc_id, n_words, removed (intervals of word places) and kept_text for every row of ``docs``.

    Kept words are joined by one space.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for id_, body, places, copies in rows(iter([batch.slice(start, 256)])):
                    words = split_words(body)
                    cut = _cut(words, places, copies, width)
                    out.append((id_, len(words), [{"first": a, "end": b} for a, b in cut], _kept(words, cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "n_words", "removed", "kept_text"],
                )

    return (
        _marked(docs, width, doc_id, text, chars_per_bucket)
        .select("doc_id", "text", "places", "copies")
        .mapInArrow(
            remove, "doc_id long, n_words long, removed array<struct<first:long,end:long>>, kept_text string"
        )
    )


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    chars_per_bucket: int = CHARS_PER_BUCKET,
) -> DataFrame:
    """All rows and columns of ``docs``; texts that lose words have the rest joined by one space, others stay as is."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for body, places, copies in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = split_words(body)
                    cut = _cut(words, places, copies, width)
                    texts.append(_kept(words, cut) if cut else body)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    marked = _marked(docs, width, doc_id, text, chars_per_bucket).select("_row", "text", "places", "copies")
    kind = StructType([marked.schema["_row"], StructField("_text", StringType())])
    shortened = marked.mapInArrow(shorten, kind)
    return shortened.select(*[F.col("_text" if c == text else f"_row.`{c}`").alias(c) for c in docs.columns])

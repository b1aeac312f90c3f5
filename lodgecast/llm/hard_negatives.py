"""Hard-negative mining by slots of the score range.

An anchor's positives are its best rows of the same label. Each positive asks for the best rows of other labels whose score
lies between a share of the positive's score and that score. These windows overlap, so none is searched by itself: the
positives' scores, as upper limits, split the score range into disjoint slots. Every task keeps the best ``k`` rows for each
anchor and slot, Spark merges them, and running from the lowest slot up, the best ``k`` of a slot and all below it come from
merging the slot with the answer of the one beneath. Cutting such an answer at a positive's lower limit gives its window.

Rows are packed in chunks, anchors in blocks, both of bounded size. Every block meets every chunk: chunks go once to each
block, blocks once to each lane of ``CHUNKS_PER_LANE`` chunks, and a task holds one block and one lane. What a lane gives back
for an anchor is ``k`` rows a slot, however many rows tie.

Vectors are integers; a score is an exact inner product (products beyond 64 bits fail the job). Higher scores come first,
ties go to the smaller id. Rows with a null id, label, vector or component take no part. Vectors of different lengths have
no score. Rows that share the anchor's id are neither its positives nor its negatives, rows with one id and one score count
once, and repeated anchor rows are one anchor. An anchor without positives or negatives gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written

ROWS_PER_CHUNK = 4096
ANCHORS_PER_BLOCK = 4096
CHUNKS_PER_LANE = 64
#: Anchors whose scores with a chunk stand in memory at once.
TILE = 256
_PACK = "dim int, ids array<bigint>, labels array<bigint>, vectors binary"
_LONGS = pa.list_(pa.int64())


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    found = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<bigint>").alias("vector"),
    )
    return found.dropna().filter(F.forall("vector", lambda x: x.isNotNull()))


def _packs(ids: np.ndarray, labels: np.ndarray, vectors: list) -> list[tuple]:
    """(dim, ids, labels, vectors) of rows of equal length, each pack in order of the ids, plus the rows' places."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    found = []
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        at = at[np.argsort(ids[at], kind="stable")]
        matrix = np.array([vectors[i] for i in at], np.int64).reshape(len(at), dim)
        found.append((int(dim), ids[at], labels[at], _narrow(matrix).tobytes(), at))
    return found


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes each where they fit."""
    small = np.iinfo(np.int16)
    fits = not matrix.size or (matrix.min() >= small.min and matrix.max() <= small.max)
    return matrix.astype(np.int16) if fits else matrix


def _columns(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids, labels and vectors (views into one array of components) of Arrow rows."""
    vectors = table.column("vector")
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = np.cumsum(np.asarray(vectors.value_lengths()))[:-1] if len(vectors) else []
    parts = np.split(np.asarray(vectors.flatten()), ends) if len(vectors) else []
    return (np.asarray(table.column("vec_id")), np.asarray(table.column("label")), parts)


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """All rows in packs of at most ``size`` rows of one partition and one length."""

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                packs = _packs(*_columns(batch.slice(start, size)))
                names = ["dim", "ids", "labels", "vectors"]
                kinds = (pa.int32(), _LONGS, _LONGS, pa.binary())
                columns = [pa.array([p[i] for p in packs], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(pack, _PACK).withColumn("chunk", F.monotonically_increasing_id())


def _blocks(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Distinct anchors in blocks of about ``size``; ``nths`` numbers the anchors of a block."""
    distinct = written(anchors.distinct(), "anchors")
    count = max(1, -(-distinct.count() // size))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(count)))

    def pack(key, table):
        packs = _packs(*_columns(table))
        names = ["dim", "ids", "labels", "vectors", "nths"]
        kinds = (pa.int32(), _LONGS, _LONGS, pa.binary(), _LONGS)
        columns = [pa.array([p[i] for p in packs], k) for i, k in enumerate(kinds)]
        return pa.table([pa.array([key[0].as_py()] * len(packs), pa.int64()), *columns], ["block", *names])

    return dealt.groupBy("block").applyInArrow(pack, f"block long, {_PACK}, nths array<bigint>"), count


class _Pack:
    """Arrays of one packed row."""

    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.nths = np.array(row.get("nths"), np.int64) if "nths" in row else None
        n, dim = len(self.ids), row["dim"]
        kind = np.int64 if len(row["vectors"]) == 8 * n * dim else np.int16
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim)
        self.reach = max(abs(int(self.vectors.min())), abs(int(self.vectors.max()))) if self.vectors.size else 0
        self.repeats = len(np.unique(self.ids)) < n


def _scores(left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """Exact inner products: in doubles where every sum is below 2 ** 53, else in 64-bit integers."""
    bound = reach * max(1, left.shape[1])
    if bound < 1 << 53:
        return left.astype(np.float64) @ right.astype(np.float64).T
    if bound * 100 >= 1 << 63:
        raise ValueError("scores of these vectors may exceed 64 bits")
    return left.astype(np.int64) @ right.astype(np.int64).T


def _best(scores: np.ndarray, allowed: np.ndarray, chunk: _Pack, k: int):
    """Up to ``k`` allowed columns of each row, best first: (rows, columns, scores). Columns stand in order of the ids, and
    the first of equal maxima is taken, so ties go to the smaller id."""
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    left = np.where(allowed, scores, none)
    live = np.flatnonzero(allowed.any(axis=1))
    for _ in range(k):
        if not len(live):
            return
        columns = left[live].argmax(axis=1)
        found = left[live, columns]
        live, columns, found = (x[found > none] for x in (live, columns, found))
        yield live, columns, found
        left[live, columns] = none
        if chunk.repeats:
            same = (chunk.ids[None, :] == chunk.ids[columns][:, None]) & (left[live] == found[:, None])
            left[live] = np.where(same, none, left[live])


class _Kept:
    """Rows that a task gives back, best ``k`` of each anchor and slot so far."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, nths, slots, ids, scores):
        self.parts.append(np.array([nths, slots, ids, scores.astype(np.int64)], np.int64))

    def merge(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        rows = np.concatenate(self.parts, axis=1)
        nths, slots, ids, scores = rows
        rows = rows[:, np.lexsort((ids, -scores, slots, nths))]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, new]
        head = np.ones(rows.shape[1], bool)
        head[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        first = np.flatnonzero(head)
        place = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.append(first, rows.shape[1])))
        self.parts = [rows[:, place < self.k]]
        return self.parts[0]


def _met(chunks: DataFrame, blocks: DataFrame, n_blocks: int, search, k: int) -> DataFrame:
    """block, nth, slot, vec_id, score: what ``search`` finds where every block meets every chunk."""
    lanes = max(1, -(-chunks.count() // CHUNKS_PER_LANE))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    left = chunks.select("*", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).alias("lane"), F.explode(numbers).alias("block"))
    lane_numbers = F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))
    right = blocks.select("*", F.explode(lane_numbers).alias("lane"))

    def meet(key, rows, anchors):
        kept = _Kept(k)
        packs = [(_Pack(a), a) for a in anchors.to_pylist()]
        for at in range(rows.num_rows if packs else 0):
            row = rows.slice(at, 1).to_pylist()[0]
            chunk = _Pack(row)
            for pack, anchor in packs:
                if anchor["dim"] == row["dim"]:
                    search(pack, anchor, chunk, kept)
            if len(kept.parts) > 64:
                kept.merge()
        nths, slots, ids, scores = kept.merge()
        block = np.full(len(nths), key[0].as_py(), np.int64)
        return pa.table({"block": block, "nth": nths, "slot": slots, "vec_id": ids, "score": scores})

    met = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane"))
    found = met.applyInArrow(meet, "block long, nth long, slot long, vec_id long, score long")
    # Equal rows get one rank, so a row read twice takes one place.
    order = Window.partitionBy("block", "nth", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k)
    return ranked.dropDuplicates(["block", "nth", "slot", "place"])


def _tiles(anchors: _Pack, chunk: _Pack):
    for start in range(0, len(anchors.ids), TILE):
        part = slice(start, start + TILE)
        yield part, _scores(anchors.vectors[part], chunk.vectors, anchors.reach * chunk.reach)


def positives(chunks: DataFrame, blocks: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """block, nth, place, vec_id, score: the best ``k`` rows of the anchor's label with another id."""

    def search(anchors: _Pack, row: dict, chunk: _Pack, kept: _Kept) -> None:
        for part, scores in _tiles(anchors, chunk):
            allowed = anchors.labels[part, None] == chunk.labels[None, :]
            allowed &= anchors.ids[part, None] != chunk.ids[None, :]
            for at, columns, found in _best(scores, allowed, chunk, k):
                kept.add(anchors.nths[part][at], np.zeros(len(at), np.int64), chunk.ids[columns], found)

    return _met(chunks, blocks, n_blocks, search, k).drop("slot")


def slot_negatives(chunks: DataFrame, blocks: DataFrame, n_blocks: int, k: int, low: int, high: int) -> DataFrame:
    """block, nth, slot, vec_id, score: the best ``k`` rows of other labels in every slot of an anchor.

    ``blocks`` carries ``limits``, an array of (nth, score) of the anchors' positives. Slot 0 ends at the highest score, the
    last slot begins at the lowest lower limit.
    """

    def limits_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct upper limits of each anchor in falling order, filled up with the smallest number, and how many."""
        own: dict[int, set[int]] = {}
        for x in row["limits"] or []:
            own.setdefault(x["nth"], set()).add(x["score"])
        nths = row["nths"]
        width = max((len(s) for s in own.values()), default=0)
        table = np.full((len(nths), width), np.iinfo(np.int64).min, np.int64)
        counts = np.zeros(len(nths), np.int64)
        for at, nth in enumerate(nths):
            falling = sorted(own.get(nth, ()), reverse=True)
            table[at, : len(falling)] = falling
            counts[at] = len(falling)
        return table, counts

    def search(anchors: _Pack, row: dict, chunk: _Pack, kept: _Kept) -> None:
        if "upper" not in row:
            row["upper"], row["count"] = limits_of(row)
        for part, scores in _tiles(anchors, chunk):
            upper, count = row["upper"][part], row["count"][part]
            other = (anchors.labels[part, None] != chunk.labels[None, :]) & (anchors.ids[part, None] != chunk.ids[None, :])
            for slot in range(upper.shape[1]):
                live = np.flatnonzero(count > slot)
                top = upper[live, slot]
                inside = other[live] & (scores[live] <= top[:, None])
                last = count[live] == slot + 1
                if slot + 1 < upper.shape[1]:
                    inside &= last[:, None] | (scores[live] > upper[live, slot + 1][:, None])
                # ceil(low * top / high), in integers
                floor = -((-low * top) // high)
                inside &= ~last[:, None] | (scores[live] >= floor[:, None])
                for at, columns, found in _best(scores[live], inside, chunk, k):
                    kept.add(anchors.nths[part][live[at]], np.full(len(at), slot), chunk.ids[columns], found)

    return _met(chunks, blocks, n_blocks, search, k)


def _suffix_merges(found: DataFrame, k: int) -> DataFrame:
    """block, nth, merged: for each slot the best ``k`` of it and all slots below it, in order of the slots."""
    entries = F.array_sort(F.collect_list(F.struct("slot", "place", "vec_id", "score"))).alias("entries")
    by_slot = found.groupBy("block", "nth").agg(entries)
    slots = F.array_sort(F.array_distinct(F.transform("entries", lambda e: -e["slot"])))

    def step(merged: Column, minus: Column) -> Column:
        own = F.filter("entries", lambda e: e["slot"] == -minus)
        below = F.coalesce(F.get(merged, F.lit(0))["best"], F.slice("entries", 1, 0))
        best = F.slice(F.concat(own, below), 1, k)
        return F.concat(F.array(F.struct((-minus).alias("slot"), best.alias("best"))), merged)

    entry = "struct<slot:bigint,place:int,vec_id:bigint,score:bigint>"
    start = F.array().cast(f"array<struct<slot:bigint,best:array<{entry}>>>")
    return by_slot.select("block", "nth", F.aggregate(slots, start, step).alias("merged"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column vec_id. A negative of a positive satisfies
    ``low * positive_score <= high * negative_score <= high * positive_score``; the first ``n_negatives`` are returned.
    """
    known = usable(rows, vec_id, vector, label)
    chunks = written(_chunks(known, ROWS_PER_CHUNK), "chunks")
    blocks, n_blocks = _blocks(known.filter(is_anchor), ANCHORS_PER_BLOCK)
    blocks = written(blocks, "blocks")
    good = written(positives(chunks, blocks, n_blocks, n_positives), "positives")
    # A block has about ANCHORS_PER_BLOCK anchors with n_positives limits each.
    limits = good.groupBy("block").agg(F.collect_list(F.struct("nth", "score")).alias("limits"))
    found = slot_negatives(chunks, blocks.join(limits, "block"), n_blocks, n_negatives, low, high)
    merged = _suffix_merges(found, n_negatives)
    # A positive's slot is the number of distinct higher scores among the positives of its anchor.
    slot = F.dense_rank().over(Window.partitionBy("block", "nth").orderBy(F.desc("score"))) - 1
    asked = good.select(
        "block", "nth", slot.cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    suffix = F.get(F.filter("merged", lambda m: m["slot"] >= F.col("slot")), F.lit(0))["best"]
    window = F.filter(suffix, lambda e: e["score"] * high >= F.col("positive_score") * low)
    answered = asked.join(merged, ["block", "nth"]).select("*", F.posexplode(window).alias("at", "negative"))
    ids = blocks.select("block", F.explode(F.arrays_zip("nths", "ids")).alias("anchor"))
    named = ids.select("block", F.col("anchor.nths").alias("nth"), F.col("anchor.ids").alias("anchor_id"))
    return answered.join(named, ["block", "nth"]).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score"),
    )

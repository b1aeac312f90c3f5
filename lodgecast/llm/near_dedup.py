"""Near-duplicate documents: MinHash with tensored banding, then exact links on full shingle sets.

Tensored banding: two small collections of bands are computed from ``first * first_rows + second * second_rows`` hash
minima; every pair of a band of the first and one of the second is a table key. So 54 tables need 24 minima, not 162.

1. One row for each document: size and digest of its shingle set, and the minima. Equal sets form a class.
2. Table keys of the classes; a bucket links each member to its smallest and largest member. A candidate link stays if
   the *sketches* of its two sets agree: a sketch keeps one byte for the smallest hash in each of 128 bins, found in one
   pass over the set, and estimates the similarity with a deviation of 0.04 at the threshold. So documents that share
   only boilerplate do not chain. Members of a bucket that resemble neither end are dealt once more, by the bucket and
   each of their bands, so that a pair hidden in a bucket of boilerplate still meets.
3. Components of the candidate links are clusters. Inside a cluster all sets are compared exactly, by walking from text
   to text over those not reached yet. A cluster above ``block_shingles`` is dealt into blocks and each pair of blocks is
   a task, so no task holds more than two blocks, and a task returns one link for each text at most.
4. Components of the exact links give the result.

Rows whose id is null have a size but no links, and are kept. Rows that share an id belong together: what links to one
of them links to all. Null and empty texts have an empty set. Every row of the input gives one row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.components import components
from lodgecast.llm.scratch import written
from lodgecast.llm.words import mixed, rolling, rows, word_hashes

SHINGLE = 5
PERCENT = 75
FIRST, FIRST_ROWS = 9, 2
SECOND, SECOND_ROWS = 6, 1
BINS = 128
#: A candidate link may estimate this much below the threshold: over four deviations of a sketch's estimate.
SLACK_PERCENT = 17
BLOCK_SHINGLES = 1_500_000

_MINIMA = FIRST * FIRST_ROWS + SECOND * SECOND_ROWS
_SEEDS = mixed(np.arange(1, _MINIMA + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    found = rolling(word_hashes(words), min(width, len(words)))
    # A short text must not meet the shingle of a longer one by its words alone.
    return np.unique(found if len(words) >= width else found ^ np.uint64(len(words)))


def minima(found: np.ndarray) -> np.ndarray:
    return np.array([mixed(found ^ seed).min() for seed in _SEEDS[:-1]], np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """One byte for each bin: 0 where no hash falls, else a digest of the smallest hash there."""
    hashes = np.sort(mixed(found ^ _SEEDS[-1]))
    places = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.r_[True, places[1:] != places[:-1]]
    out = np.zeros(BINS, np.uint8)
    out[places[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out


def bands(least: np.ndarray) -> tuple[list[int], list[int]]:
    """Hashes of the bands of the two collections."""
    cut = FIRST * FIRST_ROWS
    first = _row_hashes(least[:cut].reshape(FIRST, FIRST_ROWS))
    second = _row_hashes(least[cut:].reshape(SECOND, SECOND_ROWS))
    return first, second


def _row_hashes(table: np.ndarray) -> list[int]:
    """One hash for each row, which also depends on the row's place."""
    total = np.arange(1, len(table) + 1, dtype=np.uint64)
    for column in table.T:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64).tolist()


_SIGNED = "doc_id long, digest long, n_shingles long, set_id binary, sketch binary, first array<long>, second array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [part.split()[0] for part in _SIGNED.split(", ")]
    for batch in batches:
        out = []
        for id_, digest, text in rows(iter([batch])):
            found = shingles(text)
            if not len(found):
                out.append((id_, digest, 0, None, None, None, None))
                continue
            least = minima(found)
            first, second = bands(least)
            set_id = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            out.append((id_, digest, len(found), set_id, sketch(found).tobytes(), first, second))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
        ) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)


def signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, digest, text."""
    return docs.select("doc_id", "digest", "text").mapInArrow(_sign, _SIGNED)


def table_keys(classes: DataFrame) -> DataFrame:
    """node and key: all pairs of a first and a second band."""
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    return classes.select("node", F.explode(pairs).alias("key"))


def members(keys: DataFrame) -> DataFrame:
    """node, key, low and high: members of the buckets that hold more than one, with the bucket's ends."""
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return keys.join(ends, "key").select("node", "key", "low", "high")


def similar(met: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """a, b: members and ends whose sketches agree in ``least`` percent of the bins that either uses."""
    # Members of one group meet the same ends in bucket after bucket: each such triple is kept once before it is written
    # out as links. Both ends in one pass over the members; a bucket of two gives its one link once.
    pairs = met.select("node", "low", "high").distinct().select(
        F.col("node").alias("a"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("node") != F.col("low"), F.col("low")),
            F.when((F.col("node") != F.col("low")) & (F.col("node") != F.col("high")), F.col("high")),
        ))).alias("b"),
    ).distinct()
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    pairs = pairs.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, BINS) for n in ("x", "y"))
            common = ((x == y) & (x > 0)).sum(1)
            used = ((x > 0) | (y > 0)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= least * used))

    return pairs.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def unsettled(met: DataFrame, links: DataFrame) -> DataFrame:
    """node and key: members that resemble neither end of their bucket."""
    rest = met.filter("node <> low and node <> high")
    for end in ("low", "high"):
        rest = rest.join(links.select(F.col("a").alias("node"), F.col("b").alias(end)), ["node", end], "left_anti")
    return rest.select("node", "key")


def finer_keys(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """node and key: each bucket is dealt by every band of its members."""
    bands_of = classes.select("node", F.concat("first", "second").alias("bands"))
    return rest.join(bands_of, "node").select(
        "node", F.explode(F.transform("bands", lambda band: F.xxhash64("key", band))).alias("key")
    )


def candidate_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: members of one bucket whose sketches say that they may be linked."""
    least = percent - SLACK_PERCENT
    sketches = classes.select("node", "sketch")
    met = written(members(table_keys(classes)), "met")
    links = written(similar(met, sketches, least), "links")
    finer = finer_keys(unsettled(met, links), classes)
    return links.union(similar(members(finer), sketches, least))


def _linked(left: np.ndarray, right_sizes: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (len(left) + right_sizes - common)


def _walk(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of each set to the smallest node of its component, found by walking over sets not reached yet."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")
    members, edges = owner[order], np.searchsorted(where[order], np.arange(len(values) + 1))
    starts = np.r_[0, np.cumsum(sizes)]
    fresh = np.ones(len(sets), bool)
    links = []
    for seed in np.argsort(nodes, kind="stable"):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue and fresh.any():
            at = queue.pop()
            mine = where[starts[at] : starts[at + 1]]
            begin, count = edges[mine], edges[mine + 1] - edges[mine]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            common = np.bincount(members[np.repeat(begin, count) + inside], minlength=len(sets))
            reached = np.flatnonzero(fresh & _linked(sets[at], sizes, common, percent))
            fresh[reached] = False
            queue.extend(reached.tolist())
            links.extend((nodes[seed], nodes[k]) for k in reached)
    return links


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by task; one task's texts are held at a time, as sets."""

        def links() -> pa.RecordBatch:
            found = [p for p in _walk(nodes, sets, percent) if p[0] != p[1]] if len(nodes) > 1 else []
            columns = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

        current, nodes, sets, seen = None, [], [], set()
        for task, node, digest, text in rows(batches):
            if task != current:
                yield links()
                current, nodes, sets, seen = task, [], [], set()
            if (node, digest) in seen:  # a repeated row
                continue
            seen.add((node, digest))
            nodes.append(node)
            sets.append(shingles(text))
        yield links()

    return run


def exact_links(
    docs: DataFrame, clusters: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """a, b: links that connect what is similar within each cluster.

    docs: doc_id, digest, text. clusters: component, node, doc_id, digest and n_shingles of one document of each class.
    """
    sizes = clusters.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    blocks = (F.col("total") / block_shingles).cast("int") + 1
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = clusters.join(sizes.withColumn("blocks", blocks), "component").withColumn("block", block)
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.xxhash64("component", F.least("block", k), F.greatest("block", k)),
    )
    tasks = dealt.select("node", "doc_id", "digest", others.alias("tasks"))
    # A text is read by its place, moved once, and copied only to the block pairs of a cluster with several blocks.
    texts = docs.join(tasks, ["doc_id", "digest"])
    spread = texts.select(F.explode("tasks").alias("task"), "node", "digest", "text")
    return spread.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(percent), "a long, b long")


def near_dedup(
    docs: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        F.col(text).alias("text"),
    )
    # A class of equal sets is a node; rows without an id or without words belong to none.
    node = F.when(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull(), F.xxhash64("set_id"))
    signed = written(signatures(plain).withColumn("node", node).drop("set_id"), "signed")
    classes = (
        signed.filter("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "digest", "n_shingles", "sketch", "first", "second")).alias("one"))
        .select("node", "one.*")
    )
    classes = written(classes, "classes")
    clusters = components(candidate_links(classes, percent))
    clustered = clusters.join(classes.select("node", "doc_id", "digest", "n_shingles"), "node")
    # Rows that share an id belong together, whatever their sets.
    known = signed.select("doc_id", "node").filter("node is not null")
    shared = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    shared = shared.join(known, "doc_id").select("a", F.col("node").alias("b"))
    found = components(exact_links(plain, clustered, percent, block_shingles).union(shared))
    result = signed.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    result = result.withColumn("component", F.coalesce("component", "node"))
    smallest = result.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    result = result.join(smallest, "component", "left")
    component = F.coalesce("smallest", "doc_id")
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )

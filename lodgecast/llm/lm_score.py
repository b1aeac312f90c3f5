"""Masked pseudo-likelihood: a window network predicts every word from the two words on either side.

Every distinct word of the corpus has its own count. A block of texts sends its distinct words once, the task that gets a
word from all blocks adds up its count, and the count goes back to the word's place in each block. Words
fall into ``CLASSES * MEMBERS`` groups by their counts: a frequent word is a group of its own, rarer ones share a group of
about the same mass. A document's score is the sum over its words of log P(group | words on both sides) + log P(word |
group): the network gives the first, the counts the second, so every word has a probability. The group's probability is
a class and a member of the class, two small softmax layers, which keeps a word's cost at ``CLASSES + MEMBERS`` outputs.

Training is in numpy inside tasks and covers every document once: the corpus is dealt by a digest of id and text into
parts of about ``PART_WORDS`` words (``rounds`` parts at least), the gradient of each part is summed over its words in all
tasks, and the driver takes one Adam step with the mean. So steps grow with the corpus; neither they nor their sizes
depend on the number of partitions. Gradients are summed in Spark by slices. What reaches the driver is ``SLICES``
gradients, and for each distinct count the number of words that have it, at most about the root of twice the corpus.

Null and empty texts have no words and score 0. Each row gives one row, a null id stays null; repeated rows repeat and
count as often. An empty table trains nothing and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written
from lodgecast.llm.words import rows, split_words, word_hashes

CLASSES, MEMBERS = 32, 32
GROUPS = CLASSES * MEMBERS
EDGE = GROUPS  # stands for what lies outside the text
SIDE = 2
EMBEDDING, HIDDEN = 12, 24
ROUNDS = 24
PART_WORDS = 1 << 21
VOCABULARY_WORDS = 1 << 21  # words of a block of texts whose distinct words are looked up together
PIECES = 8  # files of a part
RATE = 0.1
SLICES = 64
BLOCK = 16_384
SEED = 17

_SHAPES = {
    "embedding": (GROUPS + 1, EMBEDDING), "mix": (2 * SIDE * EMBEDDING, HIDDEN), "mix_bias": (HIDDEN,),
    "class": (HIDDEN, CLASSES), "class_bias": (CLASSES,),
    "member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS),
}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        found[name] = flat[at : at + n].reshape(shape)
        at += n
    return found


def first_model(group_counts: np.ndarray) -> np.ndarray:
    """Small random weights, and biases that give each group its share of the corpus."""
    draw = np.random.default_rng(SEED)
    flat = np.zeros(_SIZE, np.float32)
    model = unflat(flat)
    for name in ("embedding", "mix", "class", "member"):
        model[name][...] = draw.normal(0, 0.3 if name in ("embedding", "mix") else 0.1, _SHAPES[name])
    shares = (group_counts + 0.5).reshape(CLASSES, MEMBERS)
    model["class_bias"][...] = np.log(shares.sum(1) / shares.sum())
    model["member_bias"][...] = np.log(shares / shares.sum(1, keepdims=True))
    return flat


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Groups of all words, and those of the words around each."""
    gap = np.full(SIDE, EDGE, np.int32)
    line = np.concatenate([part for text in texts for part in (text, gap)])
    line = np.concatenate([gap, line])
    at = np.flatnonzero(line != EDGE)
    around = np.stack([line[at + k] for k in range(-SIDE, SIDE + 1) if k], 1)
    return line[at], around


def _chosen(values: np.ndarray, choice: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of the chosen row of each column of ``values``, and its gradient where it is asked for."""
    every = np.arange(len(choice))
    values -= values.max(0)
    picked = values[choice, every]
    np.exp(values, out=values)
    total = values.sum(0)
    result = picked - np.log(total)
    if not learn:
        return result, None
    values /= -total
    values[choice, every] += 1
    return result, values


def forward(model: dict, target: np.ndarray, around: np.ndarray, gradient: dict | None = None) -> np.ndarray:
    """Log-probability of each word's group; adds the gradient of their sum to ``gradient``.

    Words are taken in order of their class, and layers are laid out with a column for each word, so that the words of a
    class are a slice and every sum over classes or members runs along whole rows.
    """
    learn = gradient is not None
    kind = (target // MEMBERS).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    target, around = target[order], around[order]
    kind, member = target // MEMBERS, target % MEMBERS
    inputs = model["embedding"][around].reshape(len(target), -1).T
    hidden = np.tanh(model["mix"].T @ inputs + model["mix_bias"][:, None])
    result, error = _chosen(model["class"].T @ hidden + model["class_bias"][:, None], kind, learn)
    if learn:
        gradient["class"] += hidden @ error.T
        gradient["class_bias"] += error.sum(1)
        back = model["class"] @ error
    for c in range(CLASSES):
        mine = slice(edges[c], edges[c + 1])
        if edges[c] == edges[c + 1]:
            continue
        own = hidden[:, mine]
        found, error = _chosen(model["member"][c].T @ own + model["member_bias"][c][:, None], member[mine], learn)
        result[mine] += found
        if learn:
            gradient["member"][c] += own @ error.T
            gradient["member_bias"][c] += error.sum(1)
            back[:, mine] += model["member"][c] @ error
    if learn:
        back *= 1 - hidden * hidden
        gradient["mix"] += inputs @ back.T
        gradient["mix_bias"] += back.sum(1)
        inner = (model["mix"] @ back).reshape(2 * SIDE, EMBEDDING, -1)
        for places, own in zip(np.ascontiguousarray(around.T, dtype=np.int64), inner, strict=True):
            for k in range(EMBEDDING):
                gradient["embedding"][:, k] += np.bincount(places, own[k], GROUPS + 1)
    unordered = np.empty_like(result)
    unordered[order] = result
    return unordered


def _blocks(texts: Iterator[tuple], size: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows (..., words) in blocks of about ``size`` words, an empty text as one; longer texts end a block."""
    held, n = [], 0
    for row in texts:
        held.append(row)
        n += max(1, len(row[-1]))
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _by_blocks(model: dict, texts: list[np.ndarray], gradient: dict | None) -> np.ndarray:
    target, around = windows(texts)
    found = [
        forward(model, target[a : a + BLOCK], around[a : a + BLOCK], gradient) for a in range(0, len(target), BLOCK)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.float32)


_BLOCK_ROWS = (
    "block long, ids array<long>, digests array<long>, sizes array<long>, vocabulary binary, tallies binary, codes binary"
)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint32)


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: the hashes and tallies of their distinct words, and all words as places among these.

    Frequent words have low places, so that the places pack well. docs: doc_id, digest, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _BLOCK_ROWS.split(", ")]
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, longs, longs, pa.binary(), pa.binary(), pa.binary()]
        texts = ((i, digest, word_hashes(split_words(text))) for i, digest, text in rows(batches))
        block = TaskContext.get().partitionId() << 32
        for held in _blocks(texts, VOCABULARY_WORDS):
            ids, digests, words = zip(*held, strict=True)
            codes, own = pd.factorize(np.concatenate(words).view(np.int64))
            tallies = np.bincount(codes, minlength=len(own))
            order = np.argsort(-tallies, kind="stable")
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            row = (
                block, ids, digests, [len(w) for w in words], own[order].tobytes(), _packed(tallies[order]),
                _packed(place[codes]),
            )
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return docs.mapInArrow(run, _BLOCK_ROWS)


def block_words(blocks: DataFrame) -> DataFrame:
    """A row for each distinct word of each block: block, place, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, vocabulary, tallies in rows(batches):
            word = np.frombuffer(vocabulary, np.int64)
            tallies = _unpacked(tallies, len(word)).astype(np.int64)
            for a in range(0, len(word), BLOCK):
                own = word[a : a + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), block)), pa.array(np.arange(a, a + len(own), dtype=np.int32)),
                        pa.array(own), pa.array(tallies[a : a + BLOCK]),
                    ],
                    ["block", "place", "word", "n"],
                )

    chosen = blocks.select("block", "vocabulary", "tallies")
    return chosen.mapInArrow(run, "block long, place int, word long, n long")


def counted_words(blocks: DataFrame) -> DataFrame:
    """block, place, total (the word's count in the corpus), and first, true in one block of each word.

    A word comes once from each block, so even the most frequent one is a row for a block.
    """
    own = Window.partitionBy("word")
    first = F.min("block").over(own) == F.col("block")
    return block_words(blocks).select("block", "place", F.sum("n").over(own).alias("total"), first.alias("first"))


def groups_by_count(totals: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each distinct count and words of the corpus in each group.

    totals: distinct counts, ascending; holders: the number of words that have each. From the highest count down a group
    is closed once it holds its share of what is left for the groups that are left.
    """
    group, mass = np.zeros(len(totals), np.int32), np.zeros(GROUPS, np.int64)
    left, at = int((totals * holders).sum()), 0
    for k in range(len(totals) - 1, -1, -1):
        group[k] = at
        mass[at] += totals[k] * holders[k]
        if at < GROUPS - 1 and mass[at] * (GROUPS - at) >= left:
            left -= int(mass[at])
            at += 1
    return group, mass


def grouped(blocks: DataFrame, counted: DataFrame, totals, group, mass, rounds: int) -> DataFrame:
    """doc_id, part, cells (groups of the words, two bytes each) and inside (sum of log P(word | group)) of every row."""
    inside = np.log(np.maximum(totals, 1) / mass[group])
    shared = blocks.sparkSession.sparkContext.broadcast((totals, group.astype(np.uint16), inside))
    longs = {"doc_id": pa.int64(), "part": pa.int32(), "piece": pa.int32(), "cells": pa.binary(), "inside": pa.float64()}

    def place_counts(own, found):
        """The block's row meets the counts of its words."""
        values, groups, logs = shared.value
        block = own.to_pylist()[0]
        at = np.zeros(found.num_rows, np.int64)
        at[np.asarray(found.column("place"))] = np.searchsorted(values, np.asarray(found.column("total")))
        sizes, digests = np.array(block["sizes"], np.int64), np.array(block["digests"], np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        at = at[_unpacked(block["codes"], int(edges[-1]))]
        sums = np.diff(np.r_[0, np.cumsum(logs[at])][edges])
        line = groups[at]
        cells = [line[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = [block["ids"], digests % rounds, (digests >> 32) % PIECES, cells, sums]
        return pa.table([pa.array(c, k) for c, k in zip(columns, longs.values(), strict=True)], list(longs))

    carried = blocks.select("block", "ids", "digests", "sizes", "codes")
    answers = counted.select(F.col("block").alias("of"), "place", "total")
    met = carried.groupBy("block").cogroup(answers.groupBy("of"))
    placed = met.applyInArrow(place_counts, "doc_id long, part int, piece int, cells binary, inside double")
    return placed.repartition("part", "piece").drop("piece")


def _summed(frame: DataFrame, kind: str) -> DataFrame:
    """Sums of the vectors ``values`` by slot; a task holds one vector at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "values"]
            )

        for batch in batches:
            for key, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(values, kind)
                if key != slot:
                    if slot is not None:
                        yield done()
                    slot, total = key, np.zeros(len(values), kind)
                total += values
        if slot is not None:
            yield done()

    ordered = frame.repartition("slot").sortWithinPartitions("slot")
    return ordered.mapInArrow(run, "slot int, values binary")


def _gradient(corpus: DataFrame, flat: np.ndarray) -> tuple[float, np.ndarray]:
    """Words of the corpus and the summed gradient of their log-probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unflat(flat)
        total = np.zeros(_SIZE + 1)
        gradient = unflat(total[:-1])
        texts = ((np.frombuffer(x, np.uint16).astype(np.int32),) for (x,) in rows(batches))
        for block in _blocks(texts):
            total[-1] += len(_by_blocks(model, [x for (x,) in block], gradient))
        slot = TaskContext.get().partitionId() % SLICES
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "values"]
        )

    found = _summed(corpus.select("cells").mapInArrow(run, "slot int, values binary"), "float64").collect()
    total = sum((np.frombuffer(r["values"]) for r in found), np.zeros(_SIZE + 1))
    return total[-1], total[:-1]


def train(corpus: DataFrame, group_counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """One pass over the corpus, one Adam step for each of its parts."""
    flat = first_model(group_counts)
    mean, square = np.zeros(_SIZE), np.zeros(_SIZE)
    step = 0
    for part in range(rounds):
        words, gradient = _gradient(corpus.filter(F.col("part") == part), flat)
        if not words:
            continue
        step += 1
        gradient = gradient / words
        mean = 0.8 * mean + 0.2 * gradient
        square = 0.95 * square + 0.05 * gradient**2
        rise = mean / (1 - 0.8**step) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
        flat = (flat + rate * (1 - part / (rounds + 1)) * rise).astype(np.float32)
    return flat


def score_grouped(corpus: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, n_words and summed log-probability of every row of a grouped corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(flat)
    schema = "doc_id long, n_words long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unflat(shared.value)
        for block in _blocks((i, inside, np.frombuffer(x, np.uint16).astype(np.int32)) for i, inside, x in rows(batches)):
            ids, inside, texts = zip(*block, strict=True)
            sizes = np.array([len(t) for t in texts])
            found = _by_blocks(model, list(texts), None)
            sums = np.diff(np.r_[0, np.cumsum(found, dtype=np.float64)][np.r_[0, np.cumsum(sizes)]]) + np.array(inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums)], ["doc_id", "n_words", "score"]
            )

    return corpus.select("doc_id", "inside", "cells").mapInArrow(run, schema)


def grouped_corpus(
    docs: DataFrame, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, np.ndarray, int]:
    """Every row with the groups of its words, written by parts; the words in each group; the number of parts."""
    chosen = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("digest"),
        F.col(text).alias("text"),
    )
    blocks = written(word_blocks(chosen), "blocks")
    counted = written(counted_words(blocks), "words")
    found = sorted(tuple(r) for r in counted.filter("first").groupBy("total").count().collect())
    totals, holders = np.array(found, np.int64).reshape(-1, 2).T
    group, mass = groups_by_count(totals, holders)
    rounds = max(rounds, -(-int(mass.sum()) // PART_WORDS))
    return written(grouped(blocks, counted, totals, group, mass, rounds), "grouped", "part"), mass, rounds


def lm_score(
    docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, score and mean_score (null without words) of every row of ``docs``."""
    corpus, mass, rounds = grouped_corpus(docs, rounds, doc_id, text)
    found = score_grouped(corpus, train(corpus, mass, rounds, rate))
    return found.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))

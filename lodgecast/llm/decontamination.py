"""Benchmark decontamination: pigeonhole pieces of test items, exact piece hits, Myers distance.

Texts and items are lower-cased and their white space runs become one space. An item of ``n`` characters has an error
budget of ``errors_percent`` of n. It is split into budget + 1 pieces; a passage within the budget leaves at least one
piece untouched, so every such passage has an exact piece hit. One automaton per block of items finds all hits in a pass
over the text; around each hit Myers' bit-parallel distance decides. A row says where an item ends best in a document.

The item table may be of any size: it is read in blocks of ``items_per_block`` items, and only one block at a time is
sent to the tasks. Items without words and null items match nothing. Null and empty texts match nothing. Rows that share
an id give a row each; repeated rows repeat. Items are known by their id and text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.words import rows

ERRORS_PERCENT = 5
ITEMS_PER_BLOCK = 5_000
MATCH_SCHEMA = "doc_id long, item_id long, distance int, first long, end long"


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their places; fewer for an item of fewer characters."""
    count = min(budget + 1, len(item))
    edges = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], length: int, text: str, least: int) -> tuple[int, int]:
    """Smallest distance of the pattern to any substring of ``text`` and the first place where one such ends.

    Stops early below ``least``. One column of the distance matrix is two integers of ``length`` bits.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & full
        plus = (down | ~(xh | up)) & full
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = (minus | ~(xv | plus)) & full
        down = plus & xv
        if score < best:
            best, end = score, at
            if best <= least:
                break
    return best, end


class Matcher:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], errors_percent: int):
        self.items = []
        automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            budget = len(text) * errors_percent // 100
            for place, piece in pieces(text, budget):
                owners.setdefault(piece, []).append((len(self.items), place))
            self.items.append((item_id, text, budget, _masks(text), _masks(text[::-1])))
        for piece, own in owners.items():
            automaton.add_word(piece, (len(piece), own))
        self.automaton = automaton
        if owners:
            automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """item_id, distance, first and end of the best passage for each item found in a plain text."""
        if not self.items or not text:
            return
        spans: dict[int, list[list[int]]] = {}
        for last, (length, own) in self.automaton.iter(text):
            for item, place in own:
                # All passages with this hit lie within the item's length and budget around it.
                _, body, budget, _, _ = self.items[item]
                begin = last - length + 1 - place - budget
                known = spans.setdefault(item, [])
                if known and begin <= known[-1][1]:
                    known[-1][0] = min(known[-1][0], begin)
                    known[-1][1] = max(known[-1][1], begin + len(body) + 2 * budget)
                else:
                    known.append([begin, begin + len(body) + 2 * budget])
        for item, known in spans.items():
            item_id, body, budget, masks, reverse = self.items[item]
            best = None
            for begin, end in known:
                begin = max(0, begin)
                distance, at = myers(masks, len(body), text[begin:end], 0)
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, begin + at
            if best is not None:
                # The passage read backwards ends where it begins.
                low = max(0, best[1] - len(body) - budget)
                first = best[1] - myers_to_start(reverse, len(body), text[low : best[1]][::-1], best[0])
                yield item_id, best[0], first, best[1]


def myers_to_start(masks: dict[str, int], length: int, text: str, distance: int) -> int:
    """Length of the shortest prefix of ``text`` at this distance from the pattern; both are given backwards."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    if score <= distance:
        return 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & full
        plus = (down | ~(xh | up)) & full
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | 1) & full  # anchored at the start: the first row grows by one
        minus = minus << 1 & full
        up = (minus | ~(xv | plus)) & full
        down = plus & xv
        if score <= distance:
            return at
    return len(text)


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[int, str]], errors_percent: int) -> Matcher:
    key = (hash(tuple(items)), len(items), errors_percent)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, errors_percent)
    return _MATCHERS[key]


def item_blocks(items: DataFrame, item_id: str, text: str, items_per_block: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of distinct items; the driver holds one block at a time."""
    chosen = items.select(F.col(item_id).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).distinct()
    block: list[tuple[int, str]] = []
    for row in chosen.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == items_per_block:
            yield block
            block = []
    yield block


def contaminated(
    docs: DataFrame, items: DataFrame, errors_percent: int = ERRORS_PERCENT, items_per_block: int = ITEMS_PER_BLOCK,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, distance, first, end for each item found in each document; places are in the plain text."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _matcher(block, errors_percent).find
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = [part.split()[0] for part in MATCH_SCHEMA.split(", ")]
            for batch in batches:
                out = [(id_, *hit) for id_, body in rows(iter([batch])) for hit in find(plain(body))]
                columns = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
                )

        return chosen.mapInArrow(run, MATCH_SCHEMA)

    return reduce(DataFrame.union, [scan(b) for b in item_blocks(items, item_id, item_text, items_per_block)])


def clean(
    docs: DataFrame, items: DataFrame, errors_percent: int = ERRORS_PERCENT, items_per_block: int = ITEMS_PER_BLOCK,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; decided in the row, without a join."""
    place = docs.columns.index(text)

    def without(frame: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _matcher(block, errors_percent).find
            for batch in batches:
                free = [next(find(plain(body)), None) is None for body in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    return reduce(without, item_blocks(items, item_id, item_text, items_per_block), docs)

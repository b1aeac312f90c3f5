"""Cross-tokenizer alignment: two tokenizations of one text, cut wherever both end a token.

A worker encodes a text by both tokenizers, takes every token as its bytes, and divides: it looks for a byte offset near the
middle of an interval where a token of each side ends, by bisecting the other side's ends, splits there, and goes on in both
halves. An interval without such an offset inside is a group. All intervals of many texts are split at once, level by level,
so a level is a few array operations; candidates are tried from the middle outwards in steps that double.

Inside a group, tokens of both sides whose bytes overlap are linked. Links are counted corpus-wide by their pair of ids:
a block of texts sends one row for each distinct pair, Spark adds them up, finds the highest count of each B id, and returns
both to the block, where they meet the texts' own pairs. So a frequent pair costs a row a block, and nothing grows with a
single key. Blocks hold about ``BLOCK_LINKS`` links, or one text if that has more.

Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: counts of zero and an empty
digest. Rows may share an id or have none; each row of the input gives one row, repeated rows count as often as they come.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.packing import ODD_SPACE, Encoder
from lodgecast.llm.scratch import written
from lodgecast.llm.words import rows

#: Links after which a block is closed.
BLOCK_LINKS = 4_000_000
#: Characters that are encoded and aligned at once.
STEP_CHARS = 400_000
#: Parts of texts whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED_PARTS = 500_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Spelling:
    """Byte strings by number, laid end to end, so that a sequence of numbers is spelled in one array operation."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.size = len(entries)

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each entry ends."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.flat[shift + np.arange(len(shift))], ends


class Side(Spelling):
    """A tokenizer: the bytes of every id, ids of whole texts, and ids of parts that stand between spaces, all end to end
    with how many each part has."""

    def __init__(self, entries: list[bytes], whole, after_space):
        super().__init__(entries)
        self.whole, self.after_space = whole, after_space


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


class Parts:
    """Ids of texts by both tokenizers, each distinct part between spaces encoded once by a worker.

    A text is cut at its spaces once for both sides, its parts become numbers, and the ids of a number lie in one array for
    each side. The byte-level side may be cut like this unless a part is empty or begins with white space, the piece side
    unless one is empty or holds the sign for a space: merges never cross from a part to the space after it where no piece
    has a space behind another character. Such texts are encoded whole, as is every text where a model has other pieces.
    """

    def __init__(self, sides: tuple[Side, Side], cuts: bool, remembered: int = REMEMBERED_PARTS):
        self.sides, self.cuts, self.remembered = sides, cuts, remembered
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.safe = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.uint32) for _ in self.sides]
        self.lengths = [np.zeros(0, np.int64) for _ in self.sides]
        self.starts = self.lengths

    def _learn(self, new: list[str]) -> None:
        """Give the parts the next numbers. Parts that make a text unsafe to cut have no ids."""
        safe = np.array([bool(p) and not p[0].isspace() and p[0] not in ODD_SPACE and "▁" not in p for p in new], bool)
        some = [p for p, good in zip(new, safe.tolist(), strict=True) if good]
        self.numbers.update(zip(new, range(len(self.safe), len(self.safe) + len(new)), strict=True))
        self.safe = np.append(self.safe, safe)
        for i, side in enumerate(self.sides):
            flat, counts = side.after_space(some)
            lengths = np.zeros(len(new), np.int64)
            lengths[safe] = counts
            self.flat[i] = np.concatenate([self.flat[i], flat])
            self.lengths[i] = np.concatenate([self.lengths[i], lengths])
        self.starts = [np.cumsum(x) - x for x in self.lengths]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts end to end, and how many each text has."""
        if len(self.numbers) > self.remembered:
            self._forget()
        cut = [text.split(" ") if self.cuts else [] for text in texts]
        flat = list(chain.from_iterable(cut))
        found = list(map(self.numbers.get, flat))
        if None in found:
            self._learn(list(dict.fromkeys(p for p, n in zip(flat, found, strict=True) if n is None)))
            found = map(self.numbers.__getitem__, flat)
        found = np.fromiter(found, np.int64, len(flat))
        edges = np.cumsum([0, *map(len, cut)])
        safe = np.logical_and.reduceat(self.safe[found], edges[:-1]) if texts and self.cuts else np.zeros(len(texts), bool)
        found = found[np.repeat(safe, np.diff(edges))]
        own = np.diff(edges) * safe
        rest = [text for text, good in zip(texts, safe.tolist(), strict=True) if not good]
        result = []
        for side, ids, lengths, starts in zip(self.sides, self.flat, self.lengths, self.starts, strict=True):
            sizes = lengths[found]
            ends = np.cumsum(sizes)
            at = np.repeat(starts[found] - (ends - sizes), sizes)
            body = ids[at + np.arange(len(at))]
            counts = np.diff(np.append(0, ends)[np.append(0, np.cumsum(own))])
            if rest:
                whole, more = _joined(side.whole(rest))
                counts[~safe] = more
                mixed = np.empty(len(body) + len(whole), np.uint32)
                cutted = np.repeat(safe, counts)
                mixed[cutted], mixed[~cutted] = body, whole
                body = mixed
            result.append((body, counts))
        return result


def byte_level_side(path: str) -> Side:
    encoder = Encoder(path)
    encoder.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    letters = _byte_letters()
    entries = [b""] * encoder.tokenizer.get_vocab_size()
    for entry, at in encoder.tokenizer.get_vocab().items():
        entries[at] = bytes(letters[c] for c in entry)
    return Side(
        entries, lambda texts: encoder.ids([" " + t for t in texts]), lambda parts: _joined(encoder.ids_after_space(parts))
    )


def piece_side(path: str) -> tuple[Side, bool]:
    """The side, and whether its texts may be cut at spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(at: int) -> bytes:
        piece = model.id_to_piece(at)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in model.encode(texts, num_threads=1)]

    def parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, counts.sum()), counts

    cuts = not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return Side([entry(i) for i in range(model.get_piece_size())], ids, parts), cuts


def shared_cuts(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of two rising sequences of token ends: the index of the last A and the last B token of each, in order.

    ``a_bounds`` and ``b_bounds`` are the first tokens of the texts and the end of the last; texts end together and none is
    empty. Divide and conquer over all texts at once: of every open interval, the common end next to its middle A end.
    """
    low_a, high_a, low_b, high_b = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    leaf_a, leaf_b = [], []
    while len(low_a):
        # The last end of an interval is common already; those inside are low_a .. high_a - 2.
        inside = high_a - low_a - 1
        middle = low_a + inside // 2
        found_a, found_b = np.full(len(low_a), -1), np.full(len(low_a), -1)
        open_ = np.flatnonzero((inside > 0) & (high_b - low_b > 1))
        near, far = 0, 1
        while len(open_):
            steps = np.arange(near, far)
            steps = np.stack([steps, -steps], 1).ravel()[near == 0 :]
            tried = middle[open_, None] + steps
            valid = (tried >= low_a[open_, None]) & (tried < high_a[open_, None] - 1)
            tried[~valid] = 0
            at = np.searchsorted(b, a[tried])
            hit = valid & (b[at] == a[tried])
            first = hit.argmax(axis=1)
            some = hit[np.arange(len(open_)), first]
            found_a[open_[some]] = tried[some, first[some]]
            found_b[open_[some]] = at[some, first[some]]
            open_ = open_[~some & valid.any(axis=1)]
            near, far = far, 2 * far
        leaf = found_a < 0
        leaf_a.append(high_a[leaf] - 1)
        leaf_b.append(high_b[leaf] - 1)
        low_a, high_a, low_b, high_b, cut_a, cut_b = (x[~leaf] for x in (low_a, high_a, low_b, high_b, found_a + 1, found_b + 1))
        # Both halves next to each other: intervals stay in order.
        low_a, high_a, low_b, high_b = (
            np.stack(halves, 1).ravel() for halves in ((low_a, cut_a), (cut_a, high_a), (low_b, cut_b), (cut_b, high_b))
        )
    return np.sort(np.concatenate(leaf_a)), np.sort(np.concatenate(leaf_b))


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (A index, B index) whose bytes overlap: one link for each stretch between neighbouring ends of either side."""
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Aligned:
    """Texts of one step, laid end to end: ids, groups and links."""

    def __init__(self, parts: Parts, texts: list[str]):
        raw = [(" " + text).encode() if text else b"" for text in texts]
        sides, ids = parts.sides, parts.encode(texts)
        same = np.logical_and(*(self._same(side, *own, raw) for side, own in zip(sides, ids, strict=True)))
        (self.a, self.a_bounds), (self.b, self.b_bounds) = (
            (own[np.repeat(same, counts)].astype(np.int64), np.append(0, np.cumsum(counts * same))) for own, counts in ids
        )
        ends_a, ends_b = np.cumsum(sides[0].lengths[self.a]), np.cumsum(sides[1].lengths[self.b])
        full = np.flatnonzero(np.diff(self.a_bounds))
        if len(full):
            bounds = [np.append(x[full], x[-1]) for x in (self.a_bounds, self.b_bounds)]
            self.group_a, self.group_b = shared_cuts(ends_a, ends_b, *bounds)
        else:
            self.group_a = self.group_b = np.zeros(0, np.int64)
        self.link_a, self.link_b = linked(ends_a, ends_b)
        self.group_bounds = np.searchsorted(self.group_a, self.a_bounds)
        self.link_bounds = np.searchsorted(self.link_a, self.a_bounds)

    @staticmethod
    def _same(side: Side, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which texts are not empty and are spelled by their tokens byte for byte."""
        spelled, ends = side.spell(ids)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        equal = np.diff(bounds) == np.fromiter(map(len, raw), np.int64, len(raw))
        if equal.all():
            wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(raw), np.uint8))
            equal[np.searchsorted(bounds, wrong, "right") - 1] = False
        else:
            spelled = spelled.tobytes()
            equal &= [spelled[x:y] == own for x, y, own in zip(bounds, bounds[1:], raw)]
        return equal & (np.diff(bounds) > 0)

    def written_groups(self, forms: Spelling, b_first: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text. ``forms`` holds each id followed by what closes it: first all A ids with a
        comma, all B ids with a comma, then A ids with a bar and B ids with a semicolon."""
        half = forms.size // 2
        form_a, form_b = self.a.copy(), self.b + b_first
        form_a[self.group_a] += half
        form_b[self.group_b] += half
        # A token stands after the tokens of both sides in earlier groups; within a group, A goes first.
        place_a, place_b = (
            np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1)) for ends in (self.group_a, self.group_b)
        )
        b_before = np.append(0, self.group_b + 1)[place_a]
        a_before = self.group_a[place_b] + 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + b_before] = form_a
        order[np.arange(len(self.b)) + a_before] = form_b
        spelled, ends = forms.spell(order)
        bounds = np.append(0, ends)[self.a_bounds + self.b_bounds].tolist()
        spelled = spelled.tobytes()
        return [spelled[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:])]


_SIDES: dict[tuple[str, str], tuple] = {}


def sides(path_a: str, path_b: str) -> tuple[Parts, Spelling]:
    """The worker's encoders and written ids for these files; workers outlive their tasks."""
    if (path_a, path_b) not in _SIDES:
        a, (b, cuts) = byte_level_side(path_a), piece_side(path_b)
        ids = [str(i).encode() for own in (a, b) for i in range(own.size)]
        forms = [i + b"," for i in ids] + [i + (b"|" if n < a.size else b";") for n, i in enumerate(ids)]
        _SIDES[path_a, path_b] = Parts((a, b), cuts), Spelling(forms)
    return _SIDES[path_a, path_b]


_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
        "groups_sha256": pa.string(), "groups": pa.string()}
_TYPES = {pa.int64(): "bigint", pa.string(): "string"}


class _Block:
    """Texts until ``BLOCK_LINKS`` links: their rows, and how often each has each pair of ids."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, ids: list, found: Aligned, groups: list[bytes], b_size: int, whole: bool) -> None:
        self.pairs.append(found.a[found.link_a] * b_size + found.b[found.link_b])
        sizes = (np.diff(x) for x in (found.a_bounds, found.b_bounds, found.group_bounds, found.link_bounds))
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        texts = [g.decode() for g in groups] if whole else [None] * len(groups)
        self.docs.extend(zip(ids, *(s.tolist() for s in sizes), digests, texts, strict=True))
        self.links.append(np.diff(found.link_bounds))

    def row(self) -> dict:
        """Pairs of the block with their counts, and for each text its pairs (as steps in the block's list) and counts."""
        codes, pairs = pd.factorize(np.concatenate(self.pairs))
        sizes = np.concatenate(self.links)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        own, times = np.unique(doc * max(1, len(pairs)) + codes, return_counts=True)
        doc, code = np.divmod(own, max(1, len(pairs)))
        starts = np.searchsorted(doc, np.arange(len(sizes) + 1))
        steps = np.diff(code, prepend=0)
        first = starts[:-1][np.diff(starts) > 0]
        steps[first] = code[first]
        columns = list(zip(*self.docs, strict=True))
        return {name: list(c) for name, c in zip(_DOC, columns, strict=True)} | {
            "starts": starts, "n_steps": len(steps),
            "steps": pa.compress(steps.astype(np.uint32).tobytes(), codec="zstd", asbytes=True),
            "times": pa.compress(times.astype(np.uint32).tobytes(), codec="zstd", asbytes=True),
            "pairs": pairs, "counts": np.bincount(codes, minlength=len(pairs)),
        }


_BLOCK = pa.schema(
    [("block", pa.int64()), *[(n, pa.list_(k)) for n, k in _DOC.items()], ("starts", pa.list_(pa.int64())),
     ("n_steps", pa.int64()), ("steps", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())),
     ("counts", pa.list_(pa.int64()))]
)
_BLOCK_DDL = ", ".join(
    ["block bigint", *[f"{n} array<{_TYPES[k]}>" for n, k in _DOC.items()], "starts array<bigint>", "n_steps bigint",
     "steps binary", "times binary", "pairs array<bigint>", "counts array<bigint>"]
)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``STEP_CHARS`` characters at a time."""
    ids, texts, chars = [], [], 0
    for id_, text in rows(batches):
        ids.append(id_)
        texts.append(text or "")
        chars += len(texts[-1])
        if chars >= STEP_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def aligned_blocks(
    docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS, whole: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each block of texts. ``whole`` also writes the groups out."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, forms = sides(path_a, path_b)
        a, b = parts.sides
        number = TaskContext.get().partitionId() << 32

        def closed(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": number, **block.row()}], schema=_BLOCK)

        block, links = _Block(), 0
        for ids, texts in _steps(batches):
            found = Aligned(parts, texts)
            block.add(ids, found, found.written_groups(forms, a.size), b.size, whole)
            links += len(found.link_a)
            if links >= block_links:
                yield closed(block)
                block, links, number = _Block(), 0, number + 1
        if block.docs:
            yield closed(block)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(blocks, _BLOCK_DDL)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    zipped = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    return zipped.select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """pair, n (links of it in all texts), is_best (no other pair of its B id has more). A window holds the pairs of one B
    id, at most one for each A id."""
    totals = _pair_rows(blocks).groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair") % b_size))
    return totals.withColumn("is_best", F.col("n") == highest)


def cross_align(
    docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS, whole: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row; with ``whole`` also groups.

    ``path_a`` is a byte-level tokenizer file, which gets a space before each text, ``path_b`` a sentence-piece model that
    adds one. ``n_best`` counts links whose pair is among the most frequent of its B id, ``count_sum`` adds up the corpus-wide
    counts of a text's links.
    """
    b_size = piece_side(path_b)[0].size
    blocks = written(aligned_blocks(docs, path_a, path_b, block_links, whole, doc_id, text), "blocks")
    answers = _pair_rows(blocks).select("block", "at", "pair").join(pair_counts(blocks, b_size), "pair")
    names = [n for n in _DOC if whole or n != "groups"]

    def resolve(own, counts):
        """The block's row meets the corpus-wide counts of its pairs."""
        block = own.to_pylist()[0]
        at = np.asarray(counts.column("at"))
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        n[at], best[at] = np.asarray(counts.column("n")), np.asarray(counts.column("is_best"))
        steps, times = (
            np.frombuffer(pa.decompress(block[c], 4 * block["n_steps"], "zstd", asbytes=True), np.uint32).astype(np.int64)
            for c in ("steps", "times")
        )
        starts = np.array(block["starts"])
        through = np.append(0, np.cumsum(steps))
        code = through[1:] - np.repeat(through[starts[:-1]], np.diff(starts))
        columns = {name: block[name] for name in names}
        for name, value in (("n_best", best[code] * times), ("count_sum", n[code] * times)):
            columns[name] = np.diff(np.append(0, np.cumsum(value))[starts])
        schema = pa.schema([(name, _DOC.get(name, pa.int64())) for name in columns])
        return pa.table({k: pa.array(v, schema.field(k).type) for k, v in columns.items()}, schema)

    out = ", ".join([*[f"{n} {_TYPES[_DOC[n]]}" for n in names], "n_best bigint, count_sum bigint"])
    carried = blocks.select("block", *names, "starts", "n_steps", "steps", "times")
    counted = answers.select(F.col("block").alias("of"), "at", "n", "is_best")
    met = carried.groupBy("block").cogroup(counted.groupBy("of"))
    return met.applyInArrow(resolve, out)

"""Best-fit decreasing packing of token sequences into bins of one capacity.

The method needs only how many pieces there are of each length, so it packs *runs* of equal pieces: lengths go from long
to short, a segment tree over remaining capacities finds the tightest open bins that still fit, and one step fills as
many of these bins as the run needs. The result is that of best-fit decreasing piece by piece. The driver holds one count
for each length (at most ``capacity`` numbers, whatever the input) and a plan of such steps; the pieces themselves are
numbered and placed by tasks.

Null and empty texts give one piece that holds only the closing id. Repeated rows are packed as often as they come. Rows
may share an id or have none: pieces are told apart by all their columns, and equal ones may swap places.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written

CAPACITY = 1024
CLOSING_ID = 2
#: Parts of texts whose ids a worker remembers, in each of two generations.
REMEMBERED_PARTS = 500_000
#: Parts seen for the first time that are encoded as one text.
PARTS_AT_ONCE = 512
#: Pieces that one numbering group holds.
PIECES_PER_GROUP = 50_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: What a tokenizer may take for white space, beyond what Python does.
_UNSAFE = object()
ODD_SPACE = "\u180e\u200b\u200c\u200d\ufeff"


class Encoder:
    """Ids of texts by a tokenizer whose pre-tokens never hold a space after another character.

    A text is cut before its spaces, and each distinct part is encoded once by a worker. That is the same as encoding the
    text, unless a part that follows a space is empty or begins with white space: such a text is encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_PARTS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        # Ids of a space and the part; no bytes at all where the part makes a text unsafe to cut.
        self.young: dict[str, bytes | object] = {}
        self.old: dict[str, bytes | object] = {}
        #: Tokens that begin with a space byte, in the byte-level alphabet.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def ids_after_space(self, parts: list[str]) -> list[bytes]:
        """Ids of a space and each part. Many parts go as one text: each holds one space byte, in its first token."""
        found = []
        for at in range(0, len(parts), PARTS_AT_ONCE):
            some = parts[at : at + PARTS_AT_ONCE]
            joined = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(joined[0].ids, "<u4")
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(some) or begins[0]:  # an added token that takes the space before it
                found += self.ids([" " + p for p in some])
                continue
            body, edges = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
            found += [body[i:j] for i, j in zip(edges, edges[1:])]
        return found

    def _learn(self, parts: set[str]) -> None:
        new = []
        for p in parts:
            if p in self.old:
                self.young[p] = self.old[p]
            elif not p or p[0].isspace() or p[0] in ODD_SPACE:
                self.young[p] = _UNSAFE
            else:
                new.append(p)
        self.young.update(zip(new, self.ids_after_space(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [text.split(" ") for text in texts]
        heads = self.ids([parts.pop(0) for parts in cut])
        found = [list(map(self.young.get, parts)) for parts in cut]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = {parts[i] for parts, gap in zip(cut, gaps, strict=True) for i in gap}
        if new:
            self._learn(new)
        result = []
        for text, head, parts, ids, gap in zip(texts, heads, cut, found, gaps, strict=True):
            for i in gap:
                ids[i] = self.young[parts[i]]
            try:
                result.append(head + b"".join(ids))
            except TypeError:  # an unsafe part
                result.append(self.ids([text])[0])
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        return result


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; workers outlive their tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encoded texts with a closing id, cut into pieces of ``capacity`` ids from the end; the first may be shorter."""
    closing = np.array([closing_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                out = []
                for id_, body in zip(ids, encode([t or "" for t in texts]), strict=True):
                    tokens = body + closing
                    n = len(tokens) // 4
                    start = 0
                    for piece in range(-(-n // capacity)):
                        end = start + ((n - 1) % capacity + 1 if piece == 0 else capacity)
                        out.append((id_, piece, start, end - start, zlib.crc32(tokens[4 * start : 4 * end])))
                        start = end
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, PIECE_SCHEMA)


class Capacities:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` with an open bin."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, count, each, bin, offset) of best-fit decreasing.

    Pieces first .. first + count - 1 of that length go, ``each`` to a bin, to bins bin, bin + 1, ... from ``offset`` on.
    """
    tree = Capacities(capacity)
    open_bins: dict[int, list[list[int]]] = {}  # by remaining capacity: [first bin, number of bins]
    plan, bins = [], 0

    def reopen(first: int, n: int, left: int) -> None:
        if n and left:
            open_bins.setdefault(left, []).append([first, n])
            tree.add(left, n)

    for length in sorted(lengths, reverse=True):
        done, total = 0, lengths[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, min(-(-(total - done) // each), total - done)
                bins += n
            else:
                each = room // length
                first, n = open_bins[room][-1]
                used = min(n, -(-(total - done) // each))
                if used < n:
                    open_bins[room][-1] = [first + used, n - used]
                else:
                    open_bins[room].pop()
                tree.add(room, -used)
                n = used
            count = min(total - done, n * each)
            plan.append((length, done, count, each, first, capacity - room))
            done += count
            full, rest = divmod(count, each)
            reopen(first, full, room - each * length)
            reopen(first + full, 1 if rest else 0, room - rest * length)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` column of at most ``capacity``.

    ``pieces`` should be a written table: it is read twice and must be the same both times.
    """
    keys = [F.col(c) for c in pieces.columns]
    sizes = pieces.groupBy("length").count().collect()  # one row for each length, at most `capacity`
    plan = best_fit_plan({r["length"]: r["count"] for r in sizes}, capacity)
    groups = int(sum(r["count"] for r in sizes) // pieces_per_group) + 1
    # A group is a slice of one length's pieces, so a length that most pieces have is numbered by many tasks.
    spread = pieces.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))
    before = spread.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    window = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_group", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_group").orderBy(*[c.asc_nulls_first() for c in keys])
    numbered = spread.withColumn("_rank", F.row_number().over(inside)).join(before, ["length", "_group"])
    numbered = numbered.withColumn("_nth", F.col("_before") + F.col("_rank") - 1)
    steps = pd.DataFrame(plan, columns=["length", "first", "count", "each", "bin", "offset"])
    by_length = {int(k): v.to_numpy(np.int64)[:, 1:] for k, v in steps.groupby("length")}
    kinds = pieces.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                step = by_length[int(value)]
                at = step[np.searchsorted(step[:, 0], nth[mine], side="right") - 1]
                inner = nth[mine] - at[:, 0]
                sequence[mine] = at[:, 3] + inner // at[:, 2]
                offset[mine] = at[:, 4] + inner % at[:, 2] * value
            names = kinds.names
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all texts with their sequence and offset."""
    return pack(written(token_pieces(docs, tokenizer, capacity, doc_id=doc_id, text=text), "pieces"), capacity)

"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark before it, as UTF-8 bytes. Its best segmentation maximises the sum of piece
scores. All pre-tokens of a task go into one trie; the forward score of a prefix, the best over all pieces that end there,
is computed once for every node however many words share it, and a terminal node keeps the token count of its word.

Pieces and scores come from a published vocabulary file; it lists pieces by rank only, so a piece of rank r scores
``-log(r + RANK_OFFSET)``, Zipf's law without its constant. Every single byte is a piece, so each word has a count.

The trie of a task is dropped and begun anew above ``max_nodes`` nodes: counts never depend on it. Null and empty texts
have no pre-tokens. Each row gives one row, a null id stays null, other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.words import rows, split_words

WORD_MARK = b" "
RANK_OFFSET = 2.7
MAX_NODES = 600_000
COUNT_SCHEMA = "doc_id long, n_pretokens long, n_tokens long, score double"


def read_scores(path: str) -> dict[bytes, float]:
    """Scores of the pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    scores = {piece: -math.log(rank + RANK_OFFSET) for piece, rank in ranks.items()}
    least = min(scores.values())
    for byte in range(256):
        scores.setdefault(bytes([byte]), least)
    return scores


class Trie:
    """Prefixes of pre-tokens with their forward score, last piece and token count."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.max_nodes = max_nodes
        # All ends of pieces; those that are pieces have a score. No piece ends like a text that is not among them.
        self.ends: dict[bytes, float | None] = {p[k:]: None for p in scores for k in range(len(p))}
        self.ends.update(scores)
        self.terminals: dict[bytes, tuple[int, float]] = {}
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}  # node << 8 | byte -> node
        self.score, self.count = [0.0], [0]
        self.terminals.clear()

    def __call__(self, word: bytes) -> tuple[int, float]:
        """Token count and score of a pre-token."""
        found = self.terminals.get(word)
        return found if found is not None else self.insert(word)

    def insert(self, word: bytes) -> tuple[int, float]:
        if len(self.score) > self.max_nodes:
            self._clear()
        children, score, count, ends = self.children, self.score, self.count, self.ends
        path = [0]
        for end, byte in enumerate(word, 1):
            key = path[-1] << 8 | byte
            node = children.get(key)
            if node is None:
                best, pieces = -math.inf, 0
                for begin in range(end - 1, -1, -1):
                    part = word[begin:end]
                    if part not in ends:
                        break
                    piece = ends[part]
                    if piece is not None:
                        total = score[path[begin]] + piece
                        # Of equal scores the fewest pieces, so that counts do not depend on the order of words.
                        if total > best or total == best and count[path[begin]] + 1 < pieces:
                            best, pieces = total, count[path[begin]] + 1
                node = children[key] = len(score)
                score.append(best)
                count.append(pieces)
            path.append(node)
        found = self.terminals[word] = count[path[-1]], score[path[-1]]
        return found


_TRIES: dict[tuple[str, int], Trie] = {}


def token_counts(
    docs: DataFrame, vocabulary: str, max_nodes: int = MAX_NODES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and the summed score of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vocabulary, max_nodes
        if key not in _TRIES:  # workers outlive their tasks
            _TRIES[key] = Trie(read_scores(vocabulary), max_nodes)
        trie = _TRIES[key]
        names = [part.split()[0] for part in COUNT_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            out = []
            for id_, body in rows(iter([batch])):
                words = Counter(split_words(body))
                tokens, parts = 0, []
                for word, n in words.items():
                    count, score = trie(WORD_MARK + word)
                    tokens += n * count
                    parts.append(n * score)
                out.append((id_, words.total(), tokens, math.fsum(parts)))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, COUNT_SCHEMA)

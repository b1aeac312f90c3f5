"""Plain versions of the operators for small inputs, written without their code."""

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def words(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(texts):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in inverted[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def removed_words(texts, width=35):
    """doc_id -> (words, mask of removed words)."""
    split = {i: words(t) for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + width]) for w in split.values() for k in range(len(w) - width + 1))
    found = {}
    for i, w in split.items():
        mask = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                mask[k : k + width] = [True] * width
        found[i] = w, mask
    return found


def substring_row(w, mask):
    kept = b" ".join(x for x, gone in zip(w, mask) if not gone)
    return len(w), sum(mask), hashlib.sha256(kept).hexdigest()


def best_distance(pattern, text):
    """Smallest edit distance of the pattern to any substring of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
        before = row
    return min(before)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1))
        before = row
    return before[-1]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts, capacity=1024):
    """Pieces are the texts' ids, sequences have no gaps, and there are few of them."""
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array(TOKENIZER.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert n == 0 or r["length"] == capacity
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        total += at
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-total // capacity) * 1.03 + 1


def line_rows(texts, min_docs=2, min_chars=10):
    """doc_id -> (lines, dropped lines, digest of the rest)."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    gone = {k: min(own) for k, own in holders.items() if len(k) >= min_chars and len(own) >= min_docs}
    found = {}
    for i, text in texts.items():
        lines = (text or "").split("\n")
        left = [line for line in lines if gone.get(key(line), i) == i]
        found[i] = len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()
    return found


def _bytes_a():
    """Token bytes by id of the byte-level vocabulary, from the letters of all 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    return {i: bytes(letter[c] for c in entry) for entry, i in PLAIN.get_vocab().items()}


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _bytes_b(i):
    piece = PIECES.id_to_piece(i)
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def alignment(texts):
    """Rows of texts in order: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    table = _bytes_a()
    links, shapes = [], []
    for text in texts:
        a = [(i, table[i]) for i in PLAIN.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, _bytes_b(i)) for i in PIECES.encode(text or "")]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            shapes.append((0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        own, j = [], 0
        for i, first, end in spans[0]:
            while spans[1][j][2] <= first:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                own.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        parts = [[[] for _ in cuts] for _ in spans]
        for side, own_groups in zip(spans, parts):
            for i, _, end in side:
                own_groups[bisect_left(cuts, end)].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*parts)]
        shapes.append((len(a), len(b), len(cuts), ";".join(groups)))
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, n_groups, len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), groups)
        for (n_a, n_b, n_groups, groups), own in zip(shapes, links)
    ]


def hard_negative_rows(rows, is_anchor, n_positives=5, n_negatives=5, low=80, high=100):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, vector)."""
    found = []
    for anchor in {(i, label, tuple(v)) for i, label, v in rows if is_anchor(i)}:
        scores = {
            (-sum(x * y for x, y in zip(anchor[2], v)), i, label == anchor[1])
            for i, label, v in rows if i != anchor[0] and len(v) == len(anchor[2])
        }
        for p, i, _ in sorted(x for x in scores if x[2])[:n_positives]:
            window = sorted(x for x in scores if not x[2] and low * -p <= high * -x[0] <= high * -p)
            found += [(anchor[0], i, n, j, -p, -m) for n, (m, j, _) in enumerate(window[:n_negatives], 1)]
    return sorted(found)

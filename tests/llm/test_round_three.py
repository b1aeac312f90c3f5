"""Line dedup, cross-tokenizer alignment and hard-negative mining against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tests.llm import brute
from pyspark.sql import functions as F

from lodgecast.llm import cross_tokenizer as cross
from lodgecast.llm import hard_negatives as negatives
from lodgecast.llm import line_dedup as lines
from lodgecast.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "doc_id long, text string, lines string, h1 long, n1 long, lost int, block int, at int"


def _docs(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in pairs], CLASHING)


def _all(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_line_query_equals_plain_version(spark, small):
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_line_dedup"](spark, small).collect()}
    assert found == brute.line_rows(_all(spark, small))


FOOTER = "  All Rights Reserved, 2024 \t"


def test_line_edges(spark):
    pairs = [
        (5, f"one\n{FOOTER}\r\nkept line of five"), (3, f"{FOOTER}\n{FOOTER.upper().strip()}\nshort\n"), (9, "short\nshort"),
        (7, None), (8, ""), (2, "\n\n"), (11, "Äußere Zeile hier\nälter"), (12, "äUßERE ZEILE HIER\näußere zeile hier"),
        (13, "ÄUSSERE ZEILE HIER"), (14, "123456789\n1234567890"), (15, "123456789\n1234567890"),
        (16, "long " * 60_000 + "\n" + FOOTER),
    ]
    found = {r["doc_id"]: r for r in lines.line_dedup(_docs(spark, pairs)).collect()}
    for i, want in brute.line_rows(dict(pairs)).items():
        r = found[i]
        assert (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) == want
    assert found[3]["n_dropped"] == 0 and found[5]["kept_text"] == "one\nkept line of five"
    assert found[7]["kept_text"] == "" and found[7]["n_lines"] == 1 and found[2]["n_lines"] == 3


def test_line_rows_that_share_or_lack_an_id(spark):
    line, other = "a line that is shared", "another one that is not"
    pairs = [(1, f"{line}\nx"), (1, f"{line}\ny"), (1, f"{line}\ny"), (None, f"{other}\n{line}"), (None, other), (4, f"z\n{line}")]
    found = sorted((r["doc_id"] or 0, r["kept_text"]) for r in lines.line_dedup(_docs(spark, pairs)).collect())
    # Rows of document 1 keep the line, rows without an id are one document and the last.
    assert found == [(0, other), (0, other), (1, f"{line}\nx"), (1, f"{line}\ny"), (1, f"{line}\ny"), (4, "z")]


def test_line_threshold_and_hot_keys(spark):
    texts = {i: f"the footer of all pages\nline number {i % 50}\nown line {i}" for i in range(300)}
    docs = _docs(spark, texts.items())
    for least in (2, 6, 7, 301):
        found = {r["doc_id"]: r for r in lines.line_dedup(docs, min_docs=least).collect()}
        want = brute.line_rows(texts, min_docs=least)
        assert {i: (r["n_lines"], r["n_dropped"]) for i, r in found.items()} == {i: w[:2] for i, w in want.items()}
    places = lines.line_places(docs)
    salted = lines.dropped_places(places, lines.repeated_keys(places), hot_parts=20)
    assert salted.select(F.sum(F.size("lost"))).first()[0] == 299 + 250


def test_line_empty_table(spark):
    assert lines.line_dedup(_docs(spark, [])).count() == 0


def test_alignment_query_equals_plain_version(spark, small):
    texts = _all(spark, small)
    want = dict(zip(texts, brute.alignment(list(texts.values())), strict=True))
    for r in QUERIES["op12_cross_tokenizer"](spark, small).collect():
        groups = want[r["doc_id"]][6]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == want[r["doc_id"]][:6]
        assert r["groups_sha256"] == digest


HOSTILE = [
    "plain words here", "", None, " leading and  double   spaces ", "\n\t tabs\x0b\x0c", "<|endoftext|> </s><s> <unk> <0x41> [INST]",
    "a▁b lower eighth block", "naïve café — “quotes” …", "日本語のテキスト と 한국어", "🙂🙃 emoji 👩‍👩‍👧", "é combining  nbsp​",
    "ﬁ ligature ½ ㎏", "x" * 5_000, "0123456789 " * 300, "\x00 nul \x01", "plain words here", "end ", " ", "word　wide ﻿bom",
]


@pytest.mark.parametrize("block_links", [1, 400, 4_000_000])
def test_alignment_edges(spark, block_links):
    ids = [None if i % 5 == 2 else i // 2 for i in range(len(HOSTILE))]
    docs = _docs(spark, zip(ids, HOSTILE, strict=True)).repartition(3)
    found = cross.cross_align(docs, *PATHS, block_links=block_links, whole=True).collect()
    own = sorted((r["doc_id"] or -1, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found)
    want = brute.alignment(HOSTILE)
    assert own == sorted((i or -1, *w) for i, w in zip(ids, want, strict=True))
    assert sum(w[0] == 0 for w in want) >= 3


def test_alignment_of_random_texts(spark):
    draw = random.Random(3)
    letters = "abcdefgh ETAOIN  \n.,0159áß日▁"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 120))) for _ in range(150)]
    found = cross.cross_align(_docs(spark, enumerate(texts)), *PATHS, whole=True).collect()
    want = brute.alignment(texts)
    for r in found:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == want[r["doc_id"]]


def test_shared_cuts_of_random_ends():
    draw = np.random.default_rng(5)
    for _ in range(200):
        texts = [draw.integers(1, 60) for _ in range(draw.integers(1, 5))]
        ends, a_bounds, b_bounds, at = ([], []), [0], [0], 0
        for size in texts:
            for side in range(2):
                inner = draw.choice(np.arange(1, size + 1), draw.integers(0, size + 1), replace=False)
                ends[side].extend(sorted({at + int(x) for x in inner} | {at + int(size)}))
            a_bounds.append(len(ends[0]))
            b_bounds.append(len(ends[1]))
            at += int(size)
        a, b = (np.array(x) for x in ends)
        cut_a, cut_b = cross.shared_cuts(a, b, np.array(a_bounds), np.array(b_bounds))
        common = np.intersect1d(a, b)
        assert a[cut_a].tolist() == common.tolist() == b[cut_b].tolist()


def test_shared_cuts_far_from_the_middle():
    a = np.append(np.arange(1, 20_001, 2), 20_001)
    b = np.append([3], np.append(np.arange(4, 20_001, 2), 20_001))
    cut_a, _ = cross.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert a[cut_a].tolist() == [3, 20_001]


def test_alignment_empty_table(spark):
    assert cross.cross_align(_docs(spark, []), *PATHS).count() == 0


VECTORS = "vec_id long, label int, embedding array<bigint>, block long, nth int, slot string, score double"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows], VECTORS)


def _mined(spark, rows, **settings):
    found = negatives.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, **settings).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in found)


def _random_rows(n, dims, labels, reach, seed):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.randrange(-reach, reach + 1) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("reach,share", [(1, 80), (3, 50), (200, 80), (200, 0), (10**7, 95)])
def test_hard_negatives_equal_plain_version(spark, monkeypatch, reach, share):
    monkeypatch.setattr(negatives, "ROWS_PER_CHUNK", 16)
    monkeypatch.setattr(negatives, "ANCHORS_PER_BLOCK", 4)
    monkeypatch.setattr(negatives, "CHUNKS_PER_LANE", 3)
    rows = _random_rows(240, 4, 3, reach, reach + share)
    assert _mined(spark, rows, low=share) == brute.hard_negative_rows(rows, lambda i: i % 10 == 0, low=share)


def test_hard_negatives_counts(spark):
    rows = _random_rows(120, 3, 4, 9, 1)
    want = brute.hard_negative_rows(rows, lambda i: i % 10 == 0, n_positives=3, n_negatives=2)
    assert _mined(spark, rows, n_positives=3, n_negatives=2) == want


def test_hard_negatives_edges(spark):
    rows = [
        (10, 1, [2, 2]), (10, 1, [2, 2]), (10, 2, [1, 0]), (1, 1, [2, 1]), (1, 1, [2, 1]), (2, 1, [0, 0]), (3, 2, [2, 1]), (3, 2, [1, 2]),
        (4, 2, [1, 1]), (5, 2, [3, -3]), (20, 7, [1, 1]), (30, 1, [1, 1, 1]), (6, 2, [1, 1, 1]), (7, 1, [1, 1, 1]), (8, 2, []), (40, 2, []),
        (9, 1, []), (50, 1, [-1, -1]), (11, 3, [-1, 0]),
    ]
    odd = [(None, 1, [1, 1]), (12, None, [1, 1]), (13, 1, None), (14, 2, [None, 5]), (60, 2, None)]
    assert _mined(spark, rows + odd) == brute.hard_negative_rows(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_equal_vectors(spark):
    rows = [(i, i % 2, [1, 1]) for i in range(100)]
    assert _mined(spark, rows) == brute.hard_negative_rows(rows, lambda i: i % 10 == 0)


def test_hard_negatives_empty_and_without_anchors(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []
    assert _mined(spark, [(10, 1, [1]), (2, 2, [1])]) == []


def test_hard_negatives_refuse_scores_beyond_a_long(spark):
    with pytest.raises(Exception, match="64 bits"):
        _mined(spark, [(10, 1, [2**40]), (2, 1, [2**40])])


def test_negative_query_takes_odd_rows(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, draw.randrange(10), [draw.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    odd = [(400, None, [0.1, 0.2, 0.3]), (500, 1, None), (401, 2, [float("nan"), 0.0, 0.0]), (402, 3, [float("inf"), 0.0, 0.0]),
           (403, 4, [None, 0.0, 0.0]), (None, 5, [0.1, 0.1, 0.1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    scaled = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, label, v in rows
    ]
    assert sorted(tuple(r) for r in found) == brute.hard_negative_rows(scaled, lambda i: i % 100 == 0)

"""Every operator and stage takes nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodgecast.llm.chat_format import chat_digests, format_chats
from lodgecast.llm.decontamination import clean, contaminated
from lodgecast.llm.license_scan import license_scan
from lodgecast.llm.lm_score import lm_score
from lodgecast.llm.near_dedup import near_dedup
from lodgecast.llm.packing import pack_documents
from lodgecast.llm.quality_rules import quality_filter, quality_rules
from lodgecast.llm.substring_dedup import remove_repeats, substring_dedup
from lodgecast.llm.token_counts import token_counts
from lodgecast.llm.warc_fixity import archive, audit, tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest long, kept boolean, node long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + " " + "y" * 200_000
ROWS = [
    (1, "same text " * 30, "en", None, None, 5, None, 1),
    (1, "same text " * 30, "en", None, None, 5, None, 1),
    (2, None, None, None, None, None, None, None),
    (3, "", None, "s", 0, 1, True, 3),
    (None, "a text without an id that is long enough to be more than a few words of it", "en", "s", 1, 1, True, 3),
    (None, None, None, None, None, None, None, None),
    (4, LONG, "en", "s", 1, 1, True, 3),
    (5, " \n\t ", "en", "s", 1, 1, True, 3),
    (6, "short", "en", "s", 1, 1, True, 3),
]
ITEMS = "item_id long, text string, doc_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "text without an id that is long enough", 3)], ITEMS)


def _vocabulary():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


ROW_FOR_ROW = {
    "token_counts": lambda d: token_counts(d, _vocabulary()),
    "near_dedup": near_dedup,
    "lm_score": lambda d: lm_score(d, rounds=2),
    "quality_rules": quality_rules,
    "substring_dedup": substring_dedup,
    "remove_repeats": remove_repeats,
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_one_row_for_each_row(docs, nothing, name):
    found = ROW_FOR_ROW[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert ROW_FOR_ROW[name](nothing).collect() == []


def test_token_counts(docs):
    found = {r["doc_id"]: r for r in token_counts(docs.filter("doc_id is not null"), _vocabulary()).collect()}
    assert (found[2]["n_tokens"], found[3]["n_tokens"], found[5]["n_tokens"]) == (0, 0, 0)
    assert found[4]["n_pretokens"] == 60_001


def test_near_dedup(docs):
    found = near_dedup(docs).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["component_id"] == 1 and by[1]["kept"]
    assert [by[i]["n_shingles"] for i in (2, 3, 5, 6)] == [0, 0, 0, 1]
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)


def test_lm_score(docs):
    found = [r for r in lm_score(docs, rounds=2).collect() if r["n_words"] == 0]
    assert found and all(r["score"] == 0 and r["mean_score"] is None for r in found)


def test_quality(docs, nothing):
    found = {r["doc_id"]: r for r in quality_rules(docs.filter("doc_id is not null")).collect()}
    assert all(found[i]["base_failed"] and not found[i]["kept"] for i in (1, 2, 3, 5, 6))
    assert quality_filter(docs).columns == docs.columns
    line = "the cat saw birds"
    few = "\n".join([line, line, " ".join(f"word{k}" for k in range(30))])
    many = "\n".join(f"{line} {k // 2}" for k in range(8))
    frame = docs.sparkSession.createDataFrame([(1, few), (2, many)], "doc_id long, text string")
    by = {r["doc_id"]: r for r in quality_rules(frame).collect()}
    assert (by[1]["n_dup_lines"], by[1]["kept"], by[2]["n_dup_lines"], by[2]["kept"]) == (1, True, 4, False)
    assert quality_filter(nothing).collect() == []


def test_substring_dedup(docs):
    found = {r["doc_id"]: r for r in substring_dedup(docs.filter("doc_id is not null")).collect()}
    assert found[1]["kept_text"] == "" and found[1]["n_words"] == 60
    assert (found[2]["n_words"], found[2]["kept_text"], found[2]["removed"]) == (0, "", [])
    assert found[4]["kept_text"] == LONG
    kept = remove_repeats(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[5] == " \n\t "


def test_decontamination(docs, nothing, items):
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(docs, items).collect()] == [(None, 3, 0)]
    assert clean(docs, items).count() == len(ROWS) - 1
    assert contaminated(docs, items.limit(0)).collect() == []
    assert clean(docs, items.limit(0)).count() == len(ROWS)
    assert contaminated(nothing, items).collect() == []


def test_license_scan(docs, nothing):
    assert license_scan(docs).collect() == []
    assert license_scan(nothing).collect() == []


def test_packing(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = pack_documents(docs, path).collect()
    assert sorted(str(i) for i in {r["doc_id"] for r in found}) == sorted(str(i) for i in {r[0] for r in ROWS})
    assert [(r["length"], r["start"]) for r in found if r["doc_id"] in (2, 3)] == [(1, 0), (1, 0)]
    assert sum(r["doc_id"] == 1 for r in found) == 2
    assert pack_documents(nothing, path).collect() == []


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, nth long"
    rows = [
        (1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, None, None, "first", 1), (None, 1, "assistant", "x", 1),
        (2, 0, "assistant", "z" * 300_000, 1), (3, 1, "assistant", "b", 1), (3, 1, "assistant", "a", 1),
    ]
    found = {r["conv_id"]: r for r in chat_digests(format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert {k: v["n_turns"] for k, v in found.items()} == {1: 3, None: 1, 2: 1, 3: 2}
    assert found[2]["loss_chars"] == 300_000
    assert chat_digests(format_chats(spark.createDataFrame([], schema))).collect() == []


def test_warc(spark):
    schema = "page_id long, url string, html string, file string"
    rows = [(1, "u", "h", "f"), (1, "u", "h", "f"), (2, None, None, None), (None, "v", "é" * 100_000, "f")]
    records = archive(spark.createDataFrame(rows, schema))
    assert records.count() == 4
    assert audit(tree(records), tree(records)).collect() == []
    empty = archive(spark.createDataFrame([], schema))
    assert audit(tree(empty), tree(empty)).collect() == []
    assert {r["status"] for r in audit(tree(records), tree(empty)).collect()} == {"missing"}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, nothing, small, stage):
    name, function = stage
    found = function(spark, docs, small)
    if name != "packing":
        assert found.columns == docs.columns
    assert found.count() > 0 or name == "quality_rules"
    assert function(spark, nothing, small).collect() == []


def test_near_stage_keeps_other_texts_of_an_id(spark, docs, small):
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in "ab"]
    rows = [(1, t) for t in texts for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1))
    found = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, small)
    assert found.columns == frame.columns and sorted(r["text"] for r in found.collect()) == texts


def test_stages_keep_nulls_apart(spark, docs, small):
    stages = dict(corpus_pipeline.STAGES)
    found = stages["near_dedup"](spark, docs, small)
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "2", "3", "4", "5", "6", "None", "None"]
    cut = stages["substring_dedup"](spark, docs, small)
    assert cut.filter(F.length("text") == 0).count() == 0

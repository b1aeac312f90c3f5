"""Operators against plain versions, exact round trips and held-out text."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodgecast.llm import chat_format as chat
from lodgecast.llm import decontamination as benchmark
from lodgecast.llm import license_scan as licenses
from lodgecast.llm import lm_score as lm
from lodgecast.llm import near_dedup as near
from lodgecast.llm import packing
from lodgecast.llm import warc_fixity as warc
from lodgecast.llm.components import components
from lodgecast.llm.near_dedup import near_dedup
from lodgecast.llm.queries import QUERIES
from lodgecast.llm.scratch import written
from lodgecast.llm.substring_dedup import substring_dedup
from lodgecast.llm.token_counts import Trie, read_scores
from tests.llm import brute


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def rows_of(spark, name, small):
    return QUERIES[name](spark, small).collect()


def test_trie_gives_the_best_segmentation(spark, small, texts):
    scores = {b"a": -3.0, b"b": -3.0, b"c": -3.0, b"ab": -2.0, b"abc": -2.5, b"bc": -1.0, b" ": -1.0}
    trie = Trie(scores, max_nodes=20)

    def best(word):
        if not word:
            return 0.0, 0
        found = []
        for k in range(1, len(word) + 1):
            if word[:k] in scores:
                score, n = best(word[k:])
                found.append((score + scores[word[:k]], -(n + 1)))
        score, n = max(found)
        return score, -n

    draw = random.Random(1)
    for _ in range(300):
        word = bytes(draw.choice(b"abc ") for _ in range(draw.randint(1, 9)))
        count, score = trie(word)
        want = best(word)
        assert math.isclose(score, want[0]) and count == want[1]


def test_token_counts_are_whole(spark, small, texts):
    import public_tokenizers

    found = {r["doc_id"]: r for r in rows_of(spark, "op1_token_counts", small)}
    trie = Trie(read_scores(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert set(found) == set(texts)
    for i, text in list(texts.items())[:40]:
        w = brute.words(text)
        assert found[i]["n_pretokens"] == len(w)
        assert found[i]["n_tokens"] == sum(trie(b" " + x)[0] for x in w)


def test_chat_round_trip(spark, small):
    found = {r["conv_id"]: tuple(r) for r in rows_of(spark, "op2_chat_format", small)}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    hostile = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", hostile), (1, "assistant", hostile)]
    assert set(found) == set(turns)
    for conv, own in turns.items():
        own = [(role, text) for _, role, text in sorted(own)]
        loss = "".join(text for role, text in own if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in own)
        formatted = chat.marked_template(own)
        assert chat.parse(formatted) == own
        assert found[conv] == (
            conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), len(formatted),
        )


def test_escapes_are_reversible():
    draw = random.Random(2)
    parts = ["<", "|", ">", "s", "/", "[", "INST", "]", "\\", "<|", "[/INST]", "<<SYS>>", "é", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL_STRINGS)


@pytest.mark.parametrize("window", [3, 32])
def test_prefixes_of_templates(window):
    """Spans join to the whole rendering, for templates that look back and for one that rewrites."""

    def plain(turns):
        return "BEGIN " + chat.marked_template(turns)

    def looks_back(turns):
        return "".join(f"({len(turns[:k])}:{r}:{t})" for k, (r, t) in enumerate(turns))

    def rewrites(turns):
        return "".join(f"({r}:{t if k == len(turns) - 1 else t[:1]})" for k, (r, t) in enumerate(turns))

    turns = [("user" if k % 2 else "assistant", f"text {k} probe") for k in range(11)]
    for template in (chat.marked_template, plain, looks_back):
        prefixes = chat.Prefixes(template, window, 2)
        whole = ""
        for turn in turns:
            piece, start, first, end, changed = prefixes.add(turn)
            assert not changed and start == len(whole)
            whole += piece
            assert whole[first:end] == turn[1]
        assert whole == template(turns)
    prefixes = chat.Prefixes(rewrites, 32)
    assert [prefixes.add(t)[4] for t in turns] == [False] + [True] * 10


@pytest.mark.parametrize("n", [45, 80])
def test_prefixes_of_templates_beyond_the_window(n):
    """Only a template declared turn-local may restart; others are rendered with every turn, however many there are."""

    def last_forty(turns):
        return chat.marked_template(turns[-40:])

    def system_in_last_user(turns):
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
        said = turns[0][1] if turns else ""
        return "".join(f"[{r}:{said + ' ' if k == last else ''}{t}]" for k, (r, t) in enumerate(turns) if k)

    turns = [("system", "be kind")] + [("user" if k % 2 else "assistant", f"text {k}") for k in range(1, n)]
    for template in (last_forty, system_in_last_user):
        prefixes, whole = chat.Prefixes(template), ""
        for k, turn in enumerate(turns):
            piece, start, _, _, changed = prefixes.add(turn)
            assert changed == (not template(turns[: k + 1]).startswith(template(turns[:k])))
            whole = whole[:start] + piece
            assert whole == template(turns[: k + 1])
    prefixes = chat.Prefixes(chat.marked_template)
    assert all(not prefixes.add(t)[4] and len(prefixes.turns) <= chat.WINDOW_TURNS for t in turns)
    with pytest.raises(ValueError, match="turn_local"):
        prefixes = chat.Prefixes(chat.turn_local(system_in_last_user))
        for turn in turns:
            prefixes.add(turn)


def test_warc_round_trip_and_damage(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    records = written(warc.archive(pages, max_file_bytes=100_000), "archive")
    back = {r["page_id"]: (r["url"], r["body"]) for r in warc.read_records(records).collect()}
    assert back == {r["page_id"]: (r["url"] or "", r["html"] or "") for r in pages.collect()}
    ends = defaultdict(int)
    for r in records.orderBy("file", "nth").collect():
        assert r["offset"] == ends[r["file"]] and r["length"] == len(r["record"])
        ends[r["file"]] += r["length"]
    left = warc.tree(records, fanout=3)
    assert warc.audit(left, warc.tree(records, fanout=3), fanout=3).collect() == []
    fewer = records.filter("page_id not in (3, 4, 30)")
    found = warc.audit(left, warc.tree(fewer, fanout=3), fanout=3)
    lost = {r["page_id"] for r in found.join(records, ["file", "nth"]).collect()}
    assert lost == {3, 4, 30}
    assert {r["status"] for r in warc.audit(warc.tree(fewer, fanout=3), left, fanout=3).collect()} == {"surplus"}


def test_best_fit_by_runs_is_best_fit():
    draw = random.Random(3)
    for _ in range(100):
        capacity = draw.choice([7, 16, 50, 1024])
        chosen = draw.sample(range(1, capacity + 1), min(capacity, draw.randint(1, 30)))
        lengths = {k: draw.randint(1, 40) for k in chosen}
        used = defaultdict(int)
        for length, _, count, each, first, offset in packing.best_fit_plan(lengths, capacity):
            for i in range(count):
                assert used[first + i // each] == offset + i % each * length
                used[first + i // each] += length
        bins = []
        for length in sorted((k for k, n in lengths.items() for _ in range(n)), reverse=True):
            fit = [i for i, room in enumerate(bins) if room >= length]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
        assert len(used) == len(bins) and max(used.values()) <= capacity


def test_packing(spark, small, texts):
    brute.check_packing(rows_of(spark, "op4_best_fit_packing", small), texts)


def test_encoder_cuts_only_where_ids_stay():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=500)
    draw = random.Random(4)
    parts = ["a", "Foo", " ", " ", "\n", "\t", "1", "!", "'s", "é", "x y", "\r", "word.", "word..", " ", "<|endoftext|>"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(4000)]
    want = [brute.TOKENIZER.encode(text, add_special_tokens=False).ids for text in texts]
    for text, ids in zip(texts, want, strict=True):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids
    # New parts of many texts are encoded together.
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=500)
    for at in range(0, len(texts), 250):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[at : at + 250])]
        assert found == want[at : at + 250]


def test_license_spans(spark):
    notice = licenses.TEMPLATES["MIT"].split()
    changed = [w for k, w in enumerate(notice) if k % 20]  # a twentieth of the words is missing
    text = "a b c " + " ".join(changed) + " d e f Released under the MIT License. g"
    frame = spark.createDataFrame([(7, text), (8, "the license of this work is not named here at all")], "doc_id long, text string")
    found = {r["template"]: r for r in licenses.license_scan(frame).collect()}
    assert set(found) == {"MIT", "MIT line"}
    assert found["MIT"]["matched"] == len(changed)
    assert (found["MIT"]["first_word"], found["MIT"]["end_word"]) == (3, 3 + len(changed))
    at = 3 + len(changed) + 3
    assert (found["MIT line"]["first_word"], found["MIT line"]["end_word"], found["MIT line"]["coverage"]) == (at, at + 5, 1.0)


def test_license_query(spark, small, texts):
    found = {r["doc_id"] for r in rows_of(spark, "op5_license_scan", small)}
    lines = [" ".join(t.lower().split()) for n, t in licenses.TEMPLATES.items() if n.endswith("line")]
    assert found == {i for i, t in texts.items() if any(x in " ".join((t or "").lower().split()) for x in lines)}


def test_license_line_of_three_words(spark, small, texts):
    """The bare line is found in every document that has it, whatever words stand around it."""
    found = {r["doc_id"] for r in rows_of(spark, "op5_license_scan", small) if r["template"] == "All rights reserved line"}
    want = {i for i, t in texts.items() if "all rights reserved." in " ".join((t or "").lower().split())}
    assert want and found == want
    find = licenses.Index(licenses.TEMPLATES, licenses.COVERAGE_PERCENT).find
    for k in range(200):
        assert find(f"one{k} two{k} three{k} All rights reserved. four{k} five{k} six{k}") == [
            ("All rights reserved line", 3, 1.0, 3, 6)
        ]


def test_near_dedup(spark, small, texts):
    want = brute.near_components(texts)
    found = rows_of(spark, "op6_minhash_near_dedup", small)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_dedup_chains_and_blocks(spark):
    """Copies that link only through others, in one block and in many."""
    draw = random.Random(6)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(60):
        for at in draw.sample(range(len(base)), 1 + k % 4):
            base[at] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join(f"y{draw.randrange(10**6)}" for _ in range(50))) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_components(dict(rows))
    for block in (1_500_000, 1_000):
        found = near_dedup(frame, block_shingles=block).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def _with_footer(draw, shared, pairs, alone):
    """Texts of 200 words that all end in the same ``shared`` words; copies of the first few differ in a few words."""
    footer = [f"f{k}" for k in range(shared)]
    texts = {}
    for k in range(pairs + alone):
        own = [f"{draw.randrange(10**9)}" for _ in range(200 - shared)]
        texts[k] = " ".join(own + footer)
        if k < pairs:
            for at in draw.sample(range(len(own)), 2):
                own[at] = "changed"
            texts[10_000 + k] = " ".join(own + footer)
    return texts


@pytest.mark.parametrize("shared", [60, 100, 120])
def test_boilerplate_does_not_chain(spark, shared):
    """Candidate clusters are no larger than the true ones, and no pair of near copies is lost."""
    texts = _with_footer(random.Random(shared), shared, 60, 700)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near_components(texts)
    signed = near.signatures(docs.withColumn("digest", F.xxhash64("text")))
    clusters = components(near.candidate_links(signed.withColumnRenamed("doc_id", "node")))
    assert {r["count"] for r in clusters.groupBy("component").count().collect()} == {2}


def test_pairs_hidden_in_one_bucket(spark):
    """Near copies that meet in a bucket whose ends resemble neither are found by the finer buckets."""
    texts = _with_footer(random.Random(1), 60, 40, 200)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = near.signatures(docs.withColumn("digest", F.xxhash64("text"))).withColumnRenamed("doc_id", "node")
    one_bucket = near.members(signed.select("node", F.lit(1).alias("key")))
    sketches = signed.select("node", "sketch")
    first = near.similar(one_bucket, sketches, 58)
    rest = near.unsettled(one_bucket, first)
    pairs = {(r["a"], r["b"]) for r in near.similar(near.members(near.finer_keys(rest, signed)), sketches, 58).collect()}
    assert sum((10_000 + k, k) in pairs or (k, 10_000 + k) in pairs for k in range(1, 39)) >= 37


def test_rows_that_share_an_id(spark):
    """Each text of an id finds its own copies, and all that links to one of them links to all."""
    draw = random.Random(3)
    one, two, three = (" ".join(f"{draw.randrange(10**9)}" for _ in range(80)) for _ in range(3))
    rows = [(9, one), (9, two), (4, one + " more"), (7, two + " more"), (5, three), (None, two)]
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [
        (0, 0, True), (4, 4, True), (5, 5, True), (7, 4, False), (9, 4, False), (9, 4, False)
    ]


def test_sketch():
    draw = np.random.default_rng(5)
    off = []
    for size in (8, 40, 400, 4_000):
        for _ in range(200):
            union = draw.integers(0, 2**64, size, np.uint64)
            x, y = near.sketch(np.sort(union)), near.sketch(np.sort(union[: size * 3 // 4]))
            off.append(((x == y) & (x > 0)).sum() / ((x > 0) | (y > 0)).sum() - 0.75)
    assert min(off) > -near.SLACK_PERCENT / 100 and abs(np.mean(off)) < 0.02


def test_components(spark):
    draw = random.Random(7)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_masked_model(spark):
    draw = np.random.default_rng(0)
    flat = lm.first_model(draw.integers(1, 50, lm.GROUPS)).astype(np.float64)
    target, around = lm.windows([draw.integers(0, lm.GROUPS, 50).astype(np.int32) for _ in range(3)])
    gradient = np.zeros(lm._SIZE)
    lm.forward(lm.unflat(flat), target, around, lm.unflat(gradient))
    for i in draw.integers(0, lm._SIZE, 20):
        step = np.zeros(lm._SIZE)
        step[i] = 1e-5
        up, down = (lm.forward(lm.unflat(flat + s), target, around).sum() for s in (step, -step))
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-4 * (1 + abs(gradient[i]))


def test_masked_model_learns_and_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    corpus, mass, rounds = lm.grouped_corpus(docs, 12)
    seen, held = (written(corpus.filter(f"doc_id % 10 {sign} 3"), "half") for sign in ("<>", "="))
    trained = lm.train(seen, mass, rounds)
    again = lm.train(seen.repartition(7), mass, rounds)
    assert np.abs(trained - again).max() < 1e-2
    plain = lm.first_model(mass)
    for name in ("class", "member"):
        lm.unflat(plain)[name][...] = 0  # the word shares alone

    def mean(flat):
        found = lm.score_grouped(held, flat).collect()
        return sum(r["score"] for r in found) / sum(r["n_words"] for r in found)

    assert mean(trained) > mean(plain) + 0.05


def _plain_log_probability(model, line, at):
    """One word's group from the two groups on either side, layer by layer."""

    def log_softmax(x):
        return x - x.max() - math.log(np.exp(x - x.max()).sum())

    around = [line[at + k] if 0 <= at + k < len(line) else lm.EDGE for k in (-2, -1, 1, 2)]
    hidden = np.tanh(np.concatenate([model["embedding"][g] for g in around]) @ model["mix"] + model["mix_bias"])
    kind, member = divmod(line[at], lm.MEMBERS)
    return (
        log_softmax(hidden @ model["class"] + model["class_bias"])[kind]
        + log_softmax(hidden @ model["member"][kind] + model["member_bias"][kind])[member]
    )


@pytest.mark.parametrize("block_words", [300, 1 << 21])
def test_masked_model_scores_equal_a_plain_forward_pass(spark, small, texts, monkeypatch, block_words):
    """Every document's score, word by word, from counts of the corpus and a model that is not trained."""
    monkeypatch.setattr(lm, "VOCABULARY_WORDS", block_words)
    flat = lm.first_model(np.arange(1, lm.GROUPS + 1)).astype(np.float32)
    monkeypatch.setattr(lm, "train", lambda *_: flat)
    found = {r["doc_id"]: r for r in lm.lm_score(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    split = {i: brute.words(t) for i, t in texts.items()}
    n = defaultdict(int)
    for own in split.values():
        for w in own:
            n[w] += 1
    sizes = defaultdict(int)
    for count in n.values():
        sizes[count] += 1
    totals = sorted(sizes)
    group, mass = lm.groups_by_count(np.array(totals), np.array([sizes[t] for t in totals]))
    group_of = dict(zip(totals, group.tolist(), strict=True))
    model = lm.unflat(flat.astype(np.float64))
    for i in sorted(split)[:60]:
        line = [group_of[n[w]] for w in split[i]][:3_000]
        want = sum(_plain_log_probability(model, line, at) for at in range(len(line)))
        want += sum(math.log(n[w] / mass[group_of[n[w]]]) for w in split[i][:3_000])
        assert found[i]["n_words"] == len(split[i])
        if len(split[i]) <= 3_000:
            assert abs(found[i]["score"] - want) < 1e-3 * (1 + abs(want)), i


def test_masked_model_counts_every_word(spark, small, texts, monkeypatch):
    """Probabilities inside groups come from exact counts of distinct words, and steps grow with the corpus."""
    steps = []
    real = lm.train

    def train(corpus, mass, rounds, rate):
        rows = corpus.collect()
        steps.append((rounds, mass, {r["doc_id"]: (np.frombuffer(r["cells"], np.uint16), r["inside"]) for r in rows}))
        return real(corpus, mass, 1, rate)

    monkeypatch.setattr(lm, "train", train)
    monkeypatch.setattr(lm, "PART_WORDS", 1_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lm.lm_score(docs, rounds=2).collect()
    rounds, mass, found = steps[0]
    split = {i: brute.words(t) for i, t in texts.items()}
    n = defaultdict(int)
    for own in split.values():
        for w in own:
            n[w] += 1
    total = sum(n.values())
    assert rounds == -(-total // 1_000) and mass.sum() == total
    group = {}
    for i, own in split.items():
        cells, inside = found[i]
        assert len(cells) == len(own)
        for w, g in zip(own, cells.tolist(), strict=True):
            assert group.setdefault(w, g) == g
        want = sum(math.log(n[w] / mass[g]) for w, g in zip(own, cells.tolist(), strict=True))
        assert math.isclose(inside, want, abs_tol=1e-6)
    for g in set(group.values()):
        assert mass[g] == sum(n[w] for w, own in group.items() if own == g)


def test_substring_dedup(spark, small, texts):
    want = {i: brute.substring_row(*x) for i, x in brute.removed_words(texts).items()}
    found = rows_of(spark, "op9_substring_dedup", small)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want


def test_substring_dedup_in_many_buckets(spark):
    draw = random.Random(8)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(80):
        own = [f"w{draw.randrange(40)}" for _ in range(draw.randint(0, 90))]
        cut = draw.randint(0, 30)
        rows.append((k, " ".join(own + (shared[cut : cut + 36] if k % 3 else []) + own[:40])))
    rows.append((99, rows[5][1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = {i: x for i, x in brute.removed_words(dict(rows)).items()}
    for r in substring_dedup(frame, chars_per_bucket=900).collect():
        w, mask = want[r["doc_id"]]
        gone = [any(x["first"] <= k < x["end"] for x in r["removed"]) for k in range(len(w))]
        assert gone == mask


def test_edit_matching():
    draw = random.Random(5)
    for _ in range(150):
        items = [(i, "".join(draw.choice("abcd") for _ in range(draw.randint(5, 70)))) for i in range(4)]
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 60)))
        for _, item in items:
            if draw.random() < 0.6:
                body = list(item)
                for _ in range(draw.randint(0, 6)):
                    body[draw.randrange(len(body))] = draw.choice(["", "a", "bc"])
                text += "".join(body)
        found = {i: (d, a, b) for i, d, a, b in benchmark.Matcher(items, 10).find(text)}
        for i, item in items:
            best = brute.best_distance(item, text)
            assert (i in found) == (best <= len(item) * 10 // 100)
            if i in found:
                d, a, b = found[i]
                assert d == best == brute.distance(item, text[a:b])


def test_items_in_blocks(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = benchmark.contaminated(docs, items).collect()
    assert sorted(whole) == sorted(benchmark.contaminated(docs, items, items_per_block=7).collect())
    texts = {r["doc_id"]: benchmark.plain(r["text"]) for r in docs.collect()}
    exact = {(i, r["item_id"]) for r in items.collect() for i, t in texts.items() if benchmark.plain(r["text"]) in t}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in whole}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in whole} == {
        r["doc_id"] for r in benchmark.clean(docs, items, items_per_block=7).collect()
    }


def test_pipeline(spark, small, texts):
    """All stages against plain versions, each on its own input."""
    quality = {r["doc_id"] for r in rows_of(spark, "op8_quality_rules", small) if r["kept"]}
    left = {i: t for i, t in texts.items() if i in quality}
    left = {i: left[i] for i, (_, c) in brute.near_components(left).items() if c == i}
    cut = {}
    for i, (w, mask) in brute.removed_words(left).items():
        text = b" ".join(x for x, gone in zip(w, mask) if not gone).decode() if any(mask) else left[i]
        if text:
            cut[i] = text
    items = [benchmark.plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {}
    for i, text in cut.items():
        body = benchmark.plain(text)
        if not any(item in body for item in items):
            clean[i] = text
    brute.check_packing(corpus_pipeline.run(spark, small).collect(), clean)

"""Parts of texts are cut and looked up once for both tokenizers; ids are those of whole texts."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lodgecast.llm import cross_tokenizer as cross

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "\tx y", "x \ty", "a ​b", "▁a b", "é ü", "<|endoftext|> z", "<s> </s>", "　 k", "0 0\n1"]


def parts(remembered: int) -> cross.Parts:
    b, cuts = cross.piece_side(PATHS[1])
    assert cuts
    return cross.Parts((cross.byte_level_side(PATHS[0]), b), cuts, remembered)


def texts() -> list[str]:
    draw = random.Random(6)
    words = ["the", "Unter", "x1", "é", "a-b", "\n", "日本", "it's", "", "​q", "▁"]
    return ODD + [" ".join(draw.choices(words[: 8 if i % 2 else 11], k=i % 30)) for i in range(300)]


def test_ids_are_those_of_whole_texts():
    whole_a = Tokenizer.from_file(PATHS[0])
    whole_a.encode_special_tokens = True
    whole_b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shared = parts(remembered=5)  # begun anew at every step
    for some in (texts()[:100], texts()[100:], [], [""]):
        (a, n_a), (b, n_b) = shared.encode(some)
        want_a = [whole_a.encode(" " + t, add_special_tokens=False).ids for t in some]
        want_b = [whole_b.encode(t) for t in some]
        assert (n_a.tolist(), n_b.tolist()) == ([len(x) for x in want_a], [len(x) for x in want_b])
        np.testing.assert_array_equal(a, [i for x in want_a for i in x])
        np.testing.assert_array_equal(b, [i for x in want_b for i in x])


def test_a_model_that_may_not_be_cut_gets_whole_texts():
    shared = parts(remembered=1000)
    want = shared.encode(texts())
    uncut = cross.Parts(shared.sides, False)
    for (ids, counts), (own, sizes) in zip(want, uncut.encode(texts()), strict=True):
        np.testing.assert_array_equal(ids, own)
        np.testing.assert_array_equal(counts, sizes)
    assert not uncut.numbers


def test_each_part_is_encoded_once_for_each_side():
    shared = parts(remembered=1000)
    seen = []
    for side in shared.sides:
        side.after_space = lambda some, own=side.after_space: seen.append(list(some)) or own(some)
    shared.encode(["a b a", "b c"])
    shared.encode(["c b a"] * 5)
    assert seen == [["a", "b", "c"]] * 2

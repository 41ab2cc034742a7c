"""New words of texts: ids as the library gives them for whole texts, and how much the library is asked."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.llm.tokenizing import MARK, Encoder, tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
#: What pre-tokens depend on: white space of several kinds, contractions, digits, combining marks, letters that normalizers take apart, punctuation.
ODD = [" ", " ", " ", "\n", "\t", "\xa0", "　", "a", "b", "é", "İ", "́", "語", "1", ".", ",", "&&", "_", "'s", MARK]


@pytest.mark.parametrize("file", FILES)
def test_odd_texts_have_the_ids_of_the_library(file):
    rng = random.Random(7)
    texts = ["b \xa0 \xa0", "\na \xa0 \xa0\na", *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    e = Encoder(tokenizer_path(file), cache_words=300)
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("file", FILES)
def test_words_of_letters_are_learned_without_a_marker_and_punctuation_once(file):
    e = Encoder(tokenizer_path(file))
    library, asked = e.library, []

    class Asked:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    e.library = Asked()
    words = ["".join(p) for p in zip("abcdefgh" * 20, "stuvwxyzo" * 20, "mnpqrlk" * 20)]
    text = "x " + " ".join(f"{w}{end}" for w in words for end in ("", ",", ".", "&&&"))
    ids = e.encode([text])[0]
    assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, asked)) <= 1 + 4 * len(set(words)) + len(",.&&&") and not any(MARK in x for x in asked)


@pytest.mark.parametrize("file", FILES)
def test_words_around_line_breaks_and_capitals_are_asked_for_once(file):
    e = Encoder(tokenizer_path(file))
    library, asked = e.library, []

    class Asked:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    e.library = Asked()
    words = sorted({"".join(p) for p in zip("abcdefgh" * 20, "stuvwxyzo" * 20, "mnpqrlk" * 20)})
    texts = ["x " + " ".join(f"{a}.\n{b.title()}" for a, b in zip(words, words[k:])) for k in range(9)]
    texts.append(" ".join(words).replace(" ", "\n\n"))
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    # a word after a space, after a line break and after two; or once, where neither white space nor case is told
    kinds = {"byte_bpe_50k.json": 4 + 4 + 5, "word_bpe_49k.json": 4}[file]
    assert sum(map(len, asked)) <= 4 + kinds * len(words)


@pytest.mark.parametrize("file", FILES)
def test_texts_with_runs_of_white_space_have_the_ids_of_the_library(file):
    rng = random.Random(11)
    runs = [" ", " ", " ", " ", "\n", "\n", "\n\n", ".\n", "\n\n\n", "\n ", " \n", "\t", "\r\n", "\xa0\n", "\n\xa0", "ab", "Cd", "Éà", "Œuf", "ŒUF.", "Foo", ",", "1", "'S", MARK]
    texts = ["".join(rng.choice(runs) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    e = Encoder(tokenizer_path(file), cache_words=1000)
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_that_are_not_cut_are_not_remembered():
    e = Encoder(tokenizer_path("byte_bpe_50k.json"))
    e.encode([f"two  spaces {k} " * 40 for k in range(20)])
    assert sum(map(len, e.known)) < 1000


@pytest.mark.parametrize("file", FILES)
def test_words_of_letters_go_to_the_model_as_pretokens(file):
    e = Encoder(tokenizer_path(file))
    model, library, given, asked = e.model, e.library, [], []

    def noting(tokenizer, into):
        class Noted:
            def encode_batch_fast(self, texts, **how):
                into.extend(texts)
                return tokenizer.encode_batch_fast(texts, **how)

        return Noted()

    e.model, e.library = noting(model, given), noting(library, asked)
    text = "x " + " ".join(f"{a}{b}" for a in ("été", "Übel", "straße", "ñandú", "plain", "Word") for b in ("mente", "LICH", ",", ".\nOnion", "\nÀ"))
    assert np.frombuffer(e.encode([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, given)) > 100 and sum(map(len, asked)) < 10

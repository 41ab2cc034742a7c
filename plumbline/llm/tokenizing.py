"""Encoding whole texts with a public tokenizer file, bounded in memory."""

from __future__ import annotations

import operator
import os
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import parts, remembers

#: Words whose ids a worker remembers (about 200 bytes each), beyond which its memory is emptied: beside a sort of texts, where it serves this operator alone, and where it serves others too.
CACHE_WORDS, LARGE_CACHE_WORDS, SMALL_CACHE_WORDS = 1_000_000, 1_250_000, 200_000

#: A control character, a word of its own between chunks that are encoded together, and how many those are. Where spaces are part of tokens, a word that begins with it begins with a line break instead of a space.
MARK, JOINED = "\x01", 1024

#: How a vocabulary writes the byte of a space, and the end of a word where that is part of a token.
SPACE, WORD_END = "\u0120", "</w>"

#: Strings with which a text is not cut where spaces are part of tokens: between two characters a token may begin before the second, for a no-break space goes into tokens with the spaces around it.
UNCUT = ("  ", "\xa0 ", MARK)

#: A line break beside other white space, or the first of three: a text with one is cut at spaces alone.
UNCUT_LINE = re.compile(r"\n(?:(?<=[^\S\n]\n)|(?=[^\S\n]|\n\n))")

#: Characters that are punctuation or symbols to both kinds of tokenizer; an apostrophe may begin a contraction. Those of a word's end at most.
PUNCTUATION, MOST_TAIL = string.punctuation.replace("'", ""), 4

#: Texts that a worker remembers whole, and the characters they have at most.
COPIES, COPY_CHARS = 1_000, 16_384

#: Characters of a first word at most that a worker remembers.
FIRST_CHARS = 200

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Both kinds of tokenizer files start a new pre-token at a space after a
    character that is no space, whatever follows, and at a line break between
    two of those. So a text is cut there, each distinct chunk is encoded once by
    the library, and the ids are strung together. Where spaces are part of
    tokens, a text with two spaces in a row, or a space after a no-break space,
    is encoded as one chunk, for there the pre-tokens depend on what follows; where
    they are not, every space and line break ends a pre-token. Words of letters go to the
    file's model as the pre-tokens they are. Special tokens' strings in a text
    are ordinary text.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # the same model, not a copy, for words of letters that are pre-tokens as they are given
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.model.encode_special_tokens = True
        self.copies: dict[str, bytes] = {}
        self._forget()
        # how the vocabulary writes bytes, with a space between words that are given to the model
        alone = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.writing = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in alone)} | {b: chr(b) for b in alone}
        self.mark = " " + MARK
        self.mark_ids = self.library.encode(self.mark, add_special_tokens=False).ids
        vocabulary = self.library.get_vocab()
        # by id: tokens that begin with a space, as bytes are written in a vocabulary, and tokens that end a pre-token
        self.spaces, self.ends = (np.zeros(max(vocabulary.values()) + 1, dtype=bool) for _ in range(2))
        self.spaces[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.spaces_stay = bool(self.spaces[self.library.encode(" a b", add_special_tokens=False).ids].sum() == 2)
        self.writing |= {ord(" "): " " + SPACE, ord("\n"): f" {self.writing[10]} "} if self.spaces_stay else {ord(" "): " "}
        self.line_id, self.lowers = self.library.encode("\n", add_special_tokens=False).ids[:1], not self.spaces_stay and len(set(self._ask(["\xc0B", "\xe0b"]))) == 1

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = dict(zip([""], self._ask([" "])))
        self.tails: dict[str, bytes] = {"": b""}

    def _learn(self, new: list[str]) -> None:
        """Has the library encode new words, many in one text, which costs less than one by one.

        Where spaces are part of tokens, a word's ids begin at a token with its
        space, or at a line break. Else a word of letters is one pre-token and
        ends at a token that ends one, and other words have a marker between
        them. A group of which the number of words does not come out is encoded
        one by one. A word of letters with punctuation after it is put together
        from both, and has the ids of its small letters where case is not told.
        """
        spaced, others, made, heads, tails = self.spaced, [], [], [], []
        asked = set() if self.lowers else set(filter(str.isalpha, new))
        for x in new if self.lowers else [x for x in new if not x.isalpha()]:
            head = x.rstrip(PUNCTUATION)
            word = head[1:] if self.spaces_stay and head[:1] == MARK else head
            plain = self._plain(word)
            if not word.isalpha() or x != head and (not plain or len(x) - len(head) > MOST_TAIL):
                others.append(x)
                continue
            tail = x[len(head) :]
            if self.lowers and plain:
                head = head.lower()
            if head not in spaced:
                asked.add(head)
            if head != x:
                made.append(x)
                heads.append(head)
                tails.append(tail)
        alone = [x for x in others if not x or x.strip() != x or MARK in x or "  " in x]
        others = list(set(others).difference(alone))
        if self.spaces_stay:
            after_space = lambda ids: np.append(np.flatnonzero(self.spaces[ids])[1:], len(ids))
            after_line = lambda ids: np.append(np.flatnonzero(ids == self.line_id)[1:], len(ids))
            lines = [x for x in asked if x[0] == MARK]
            alone += self._learn_joined(list(asked.difference(lines)), after_space, by_model=True)
            alone += self._learn_joined(lines, after_line, by_model=True)
            alone += self._learn_joined(others, after_space)
        else:
            plain = [x for x in asked if self._plain(x)]
            at_end = lambda ids: np.flatnonzero(self.ends[ids]) + 1
            alone += self._learn_joined(plain, at_end, by_model=True)
            alone += self._learn_joined(list(asked.difference(plain)), at_end)
            alone += self._learn_joined(others, lambda ids: np.flatnonzero(ids == self.mark_ids[-1]) + 1, self.mark)
        spaced.update(zip(alone, self._ask([self._as_text(x) for x in alone])))
        ends = list(set(tails).difference(self.tails))
        self.tails.update(zip(ends, self._ask(ends)))
        spaced.update(zip(made, map(operator.concat, map(spaced.__getitem__, heads), map(self.tails.__getitem__, tails))))

    def _as_text(self, word: str) -> str:
        return word.replace(MARK, "\n") if self.spaces_stay and word[:1] == MARK else " " + word

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether all of its characters are ones that normalizers do no more with than lowering their case."""
        return word.isascii() or len(word.encode("latin-1", "ignore")) == len(word)

    def _learn_joined(self, new: list[str], ends_of: Callable[[np.ndarray], np.ndarray], mark: str = "", by_model: bool = False) -> list[str]:
        """Words of groups for which ends_of (the ends of the words' ids, each with those of the mark) does not give one end for each.

        by_model: words of letters, which the model gets as pre-tokens in the vocabulary's writing. Where case is not told, they have small letters.
        """
        own = len(self.mark_ids) if mark else 0
        left, groups = [], [new[at : at + JOINED] for at in range(0, len(new), JOINED)]
        for at in range(0, len(groups), 16):
            texts = [mark.join(map(self._as_text, group))[not self.spaces_stay :] + mark for group in groups[at : at + 16]]
            if by_model:
                texts = [x.encode().decode("latin-1").translate(self.writing) for x in texts]
            library = self.model if by_model else self.library
            for group, e in zip(groups[at : at + 16], library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = ends_of(ids)
                if len(ends) != len(group):
                    left += group
                    continue
                data, ends = ids.tobytes(), (ends * 4).tolist()
                self.spaced.update(zip(group, [data[a : b - own * 4] for a, b in zip([0, *ends], ends)]))
        return left

    def _ask(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: Iterable[str | None], end: bytes = b"") -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers (null: none), and then `end`.

        A text that comes twice is encoded once and remembered, for it is likely to come again.
        """
        texts = [x or "" for x in texts]
        times = Counter(texts)
        known = self.copies if len(self.copies) < COPIES else {}
        fresh = [x for x in times if x not in known]
        ids = dict(zip(fresh, [x for part in parts(fresh) for x in self._encode(part, end)]))
        out = [ids[x] if x in ids else known[x] for x in texts]
        self.copies = known | {x: ids[x] for x in fresh if times[x] > 1 and len(x) < COPY_CHARS}
        return out

    def _encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if len(self.known) + len(self.spaced) + len(self.tails) > self.cache_words:
            self._forget()
        spaced, firsts, cut = self.spaced, [], []
        for text in texts:
            if not self.spaces_stay:
                text, first = " " + text.replace("\n", " "), 0
            elif any(x in text for x in UNCUT):
                first = len(text)
            else:
                if "\n" in text and not UNCUT_LINE.search(text):
                    text = text.replace("\n", " " + MARK).replace(MARK + " " + MARK, MARK * 2)
                first = at if (at := text.find(" ")) >= 0 else len(text)
            firsts.append(self._first(text[:first]))
            cut.append(text[first:])
        # the words of all texts in one column, an empty one for the first of each: each distinct one is looked up once
        words = pc.split_pattern(pa.array([" ".join(cut)], pa.large_string()), " ").values.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        found = list(map(spaced.get, distinct))
        if new := [x for x, ids in zip(distinct, found) if ids is None]:
            self._learn(new)
            found = [spaced[x] if ids is None else ids for x, ids in zip(distinct, found)]
        ids = pa.array(found + firsts, pa.large_binary())
        at, starts = words.indices.to_numpy().copy(), np.cumsum([0, *(x.count(" ") + 1 for x in cut)])
        at[starts[:-1]] = np.arange(len(distinct), len(ids))
        _, offsets, data = ids.take(pa.array(at)).buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[starts].tolist()
        data = memoryview(data or b"")
        return [b"".join((data[a:b], end)) for a, b in zip(bounds, bounds[1:])]

    def _first(self, chunk: str) -> bytes:
        """Ids of what no space goes before: a text's first word, which is remembered, or a text that is not cut."""
        if len(chunk) > FIRST_CHARS:
            return self._ask([chunk])[0]
        if chunk and chunk not in self.known:
            self.known[chunk] = self._ask([chunk])[0]
        return self.known[chunk] if chunk else b""


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One for each worker process and file, until another operator needs the memory."""
    remembers("tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].cache_words = cache_words
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

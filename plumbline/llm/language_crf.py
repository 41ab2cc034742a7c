"""Languages of words and texts by a linear-chain conditional random field.

Each word with a letter has a label; its score for a language sums weights of
hashed features: affixes and inner n-grams of its UTF-8 bytes, and the word
itself (lexicon). Learned transitions tie neighbouring words, so that a switch of
language in mid-text costs something and a lone doubtful word follows its
neighbours. Forward-backward gives each word's marginals over the whole text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, parts, remembers, small_batches

#: Labelled texts of each language that are used for training, those of least hash: the only bounded part.
TEXTS_A_LANGUAGE = 150
#: Words of a training text are taken in runs of so many; all of them are used.
RUN = 32
#: Weights: hash space, n-gram lengths, passes, step, weight decay.
SPACE, GRAMS, PASSES, STEP, DECAY = 1 << 17, (1, 2, 3, 4), 12, 0.5, 1e-6
#: Words whose scores a worker remembers.
WORDS = 300_000
#: Words whose features are in memory at once.
FEATURED = 8_192
#: Words of a block of the chain whose transfer matrices are multiplied side by side.
BLOCK = 64

UNKNOWN = "und"
#: Mean marginal under which a text has no language; of two languages in equal parts one has half.
LEAST_SCORE = 0.4

_MARKS = string.punctuation + "“”„«»‘’…–—¿¡"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, and where each word's begin. Every word has at least its own."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw) + b"\0" * max(GRAMS), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in raw], dtype=np.int64)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(end))
    prime = np.uint64(0x9E3779B97F4A7C15)
    rolled, found, owners = np.zeros(len(end), dtype=np.uint64), [], []
    owner = np.repeat(np.arange(len(words)), size)
    for n in range(1, max(GRAMS) + 1):
        rolled = (rolled ^ data[at + n - 1]) * prime
        rolled ^= rolled >> np.uint64(29)
        if n in GRAMS:
            fits = at + n <= end
            found.append((rolled[fits] * prime >> np.uint64(40)) % np.uint64(SPACE))
            owners.append(owner[fits])
    whole = np.zeros(len(words), dtype=np.uint64)
    start = np.cumsum(size) - size
    mixed = (data[at] + np.uint64(1)) * prime ** ((at - start[owner]).astype(np.uint64) + np.uint64(1))
    np.add.at(whole, owner, mixed) if len(words) < 64 else None
    if len(words) >= 64:
        whole = np.add.reduceat(mixed, start)
    found.append((whole * prime >> np.uint64(40)) % np.uint64(SPACE))
    owners.append(np.arange(len(words)))
    feature, of = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return feature[order], np.searchsorted(of[order], np.arange(len(words)))


def clean(token: str) -> str:
    """The word that a token between white space holds: lower case without marks around it; empty if it has no letter."""
    word = token.strip(_MARKS).lower()
    return word if word.isalpha() or any(map(str.isalpha, word)) else ""


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of every word. scores: (words of all texts, labels); lengths: words of each text.

    Exact for whole texts: a text is cut into blocks, the blocks' transfer
    matrices are built side by side, messages go from block to block, and then
    through all blocks side by side.
    """
    n, k = scores.shape
    if not n or not k:
        return scores
    move = np.exp(transition)
    heat = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    lengths = lengths[lengths > 0]
    per_text = -(-lengths // BLOCK)
    first_block = np.cumsum(per_text) - per_text
    n_blocks = int(per_text.sum())
    text_of = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(n_blocks) - first_block[text_of]
    first_word = (np.cumsum(lengths) - lengths)[text_of] + nth * BLOCK
    held = np.minimum(BLOCK, lengths[text_of] - nth * BLOCK)
    # blocks by falling length: at each step the blocks that still have a word come first
    order = np.argsort(-held, kind="stable")
    first_word, held = first_word[order], held[order]
    rank = np.empty(n_blocks, dtype=np.int64)
    rank[order] = np.arange(n_blocks)
    live = [int(np.searchsorted(-held, -j, side="left")) for j in range(int(held[0]))]
    product = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for j, m in enumerate(live):
        step = product[:m] @ move * heat[first_word[:m] + j][:, None, :]
        product[:m] = step / step.max(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((n_blocks, k)), np.ones((n_blocks, k))
    enter[rank[first_block]] = np.exp(start)
    for t in range(1, int(per_text.max())):
        on = first_block[per_text > t] + t
        a = np.einsum("bi,bij->bj", enter[rank[on - 1]], product[rank[on - 1]])
        enter[rank[on]] = a / a.sum(axis=1, keepdims=True)
    for t in range(int(per_text.max()) - 2, -1, -1):
        on = first_block[per_text > t + 1] + t
        b = np.einsum("bij,bj->bi", product[rank[on + 1]], leave[rank[on + 1]])
        leave[rank[on]] = b / b.sum(axis=1, keepdims=True)
    out = np.empty((n, k))
    a = enter
    for j, m in enumerate(live):
        at = first_word[:m] + j
        a = a[:m] @ move * heat[at]
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    b = leave
    for j in range(len(live) - 1, -1, -1):
        m = live[j]
        at = first_word[:m] + j
        out[at] *= b[:m]
        back = b[:m] * heat[at] @ move.T
        b[:m] = back / back.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.transition, self.start = labels, weights, transition, start

    def scores(self, words: list[str]) -> np.ndarray:
        """A row a word; few words at a time, for each has some dozens of features."""
        out = np.empty((len(words), len(self.labels)), dtype=np.float32)
        for at in range(0, len(words), FEATURED):
            feature, begin = word_features(words[at : at + FEATURED])
            out[at : at + FEATURED] = np.add.reduceat(self.weights[feature], begin, axis=0)
        return out


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text). Runs of words of two languages are joined half of the time, so that switches are learned."""
    labels = sorted({lang for lang, _ in texts})
    k = len(labels)
    runs = []
    for lang, text in sorted(texts):
        words = [w for w in map(clean, text.split()) if w]
        runs += [(labels.index(lang), words[i : i + RUN]) for i in range(0, len(words), RUN)]
    model = Model(labels, np.zeros((SPACE, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k))
    if not runs or k < 2:
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, run in runs for w in run))}
    words, found, sizes = list(vocabulary), [], []
    for at in range(0, len(words), FEATURED):
        own, start = word_features(words[at : at + FEATURED])
        found.append(own.astype(np.int32))
        sizes.append(np.diff(np.append(start, len(own))))
    feature, per_word = np.concatenate(found), np.concatenate(sizes)
    begin = np.cumsum(per_word) - per_word
    owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), per_word)
    rng = np.random.default_rng(seed)
    sums, sums_t = np.full((SPACE, k), 1e-8), np.full((k, k), 1e-8)
    weights, transition = np.zeros((SPACE, k)), np.zeros((k, k))
    ids = [np.array([vocabulary[w] for w in run]) for _, run in runs]
    for _ in range(PASSES):
        order = rng.permutation(len(runs))
        for part in np.array_split(order, max(1, len(runs) // 2_000)):
            joined, truth, lengths, i = [], [], [], 0
            while i < len(part):
                many = 2 if rng.random() < 0.5 and i + 1 < len(part) else 1
                for r in part[i : i + many]:
                    joined.append(ids[r])
                    truth.append(np.full(len(ids[r]), runs[r][0]))
                lengths.append(sum(len(ids[r]) for r in part[i : i + many]))
                i += many
            word, label, lengths = np.concatenate(joined), np.concatenate(truth), np.array(lengths)
            score = np.stack([np.add.reduceat(weights[feature, c], begin) for c in range(k)], axis=1)[word]
            marginal = forward_backward(score, lengths, transition, np.zeros(k))
            miss = -marginal
            miss[np.arange(len(word)), label] += 1
            by_word = np.stack([np.bincount(word, miss[:, c], len(vocabulary)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(feature, by_word[owner, c], SPACE) for c in range(k)], axis=1) / len(word) * 100 - DECAY * weights
            sums += grad**2
            weights += STEP * grad / np.sqrt(sums)
            inner = np.ones(len(word), dtype=bool)
            inner[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (label[at], label[at + 1]), 1)
            pair = marginal[at][:, :, None] * np.exp(transition)[None] * (np.exp(score[at + 1] - score[at + 1].max(axis=1, keepdims=True)))[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            grad_t = (seen - pair.sum(axis=0)) / max(1, len(at)) * 10
            sums_t += grad_t**2
            transition += STEP * 0.3 * grad_t / np.sqrt(sums_t)
    return Model(labels, weights.astype(np.float32), transition, np.zeros(k))


class _Scorer:
    """Word scores of a model, remembered by token."""

    def __init__(self, model: Model):
        remembers("language", self._empty)
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.labels)), dtype=np.float32)

    def rows_of(self, texts: list[list[str]]) -> list[list[int]]:
        if len(self.rows) > WORDS:
            self._empty()
        if new := list(set().union(*texts).difference(self.rows)):
            words = list(map(clean, new))
            kept = sorted({w for w in words if w})
            at = {w: len(self.table) + i for i, w in enumerate(kept)}
            if kept:
                self.table = np.concatenate([self.table, self.model.scores(kept)])
            self.rows.update(zip(new, [at.get(w, 0) for w in words]))
        row_of = self.rows.__getitem__
        return [list(map(row_of, x)) for x in texts]


def label_texts(model: Model, texts: list[str | None], scorer: _Scorer | None = None) -> tuple[list[str], list[float], list[np.ndarray]]:
    """For each text its language, the mean marginal of it, and the marginals of its words (tokens without a letter have none)."""
    scorer = scorer or _Scorer(model)
    langs, scores, words = [], [], []
    for part in parts(texts):
        for out, own in zip((langs, scores, words), _label_part(model, part, scorer)):
            out += own
    return langs, scores, words


def _label_part(model: Model, texts: list[str | None], scorer: _Scorer) -> tuple[list[str], list[float], list[np.ndarray]]:
    rows = [np.array(x, dtype=np.int64) for x in scorer.rows_of([(x or "").split() for x in texts])]
    rows = [x[x > 0] for x in rows]
    lengths = np.array([len(x) for x in rows], dtype=np.int64)
    marginal = forward_backward(scorer.table[np.concatenate(rows)] if len(rows) else np.zeros((0, len(model.labels))), lengths, model.transition, model.start)
    langs, scores, words, at = [], [], [], 0
    for n in lengths.tolist():
        part = marginal[at : at + n]
        at += n
        words.append(part)
        if not n or not model.labels:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        mean = part.mean(axis=0)
        best = int(mean.argmax())
        langs.append(model.labels[best])
        scores.append(float(min(1.0, mean[best])))
    return langs, scores, words


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame, texts_a_language: int = TEXTS_A_LANGUAGE) -> Model:
    """A model from at most texts_a_language labelled texts of each language: those of least hash of the id.

    Null texts, languages and ids teach nothing. No labelled text: a model
    without labels, which calls every text unknown.
    """
    usable = docs.filter("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((SPACE, 0), dtype=np.float32), np.zeros((0, 0)), np.zeros(0))
    space = 1 << 30
    # twice the share that is needed, so that enough are left; fewer than 2^-9 of the draws fall short, and then by a few texts
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(space, space * 2 * texts_a_language // n)))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    rows = usable.select("lang", "text", drawn.alias("drawn")).filter(F.col("drawn") < share[F.col("lang")]).collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["drawn"], r["text"])):
        own = taken.setdefault(r["lang"], [])
        if len(own) < texts_a_language:
            own.append((r["lang"], r["text"]))
    return train([x for own in taken.values() for x in own])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text alone; null text or no letter: 'und', 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            langs, scores, _ = label_texts(shared.value, batch.column(1).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(label, "doc_id long, lang_pred string, score double")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_on(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def of_known_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language: the model's score for it is least_score at least. All columns stay; a null language is filled with the model's.

    Null texts and texts without a letter go, and so do texts whose words the
    model takes for no one language: of none that was learned, or of many.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema
    fill = docs.columns.index(lang_col) if lang_col in docs.columns and dict(docs.dtypes)[lang_col] == "string" else -1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            langs, scores, _ = label_texts(shared.value, batch.column(at).to_pylist(), scorer)
            if fill >= 0:
                known = pc.coalesce(batch.column(fill), pa.array(langs, batch.schema.field(fill).type))
                batch = pa.RecordBatch.from_arrays([known if k == fill else c for k, c in enumerate(batch.columns)], batch.schema.names)
            yield batch.filter(pa.array([x != UNKNOWN and y >= least_score for x, y in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(keep, schema)

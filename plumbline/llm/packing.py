"""Packing of documents into sequences of a fixed number of tokens.

The number of sequences is made small by a configuration linear program over
the histogram of piece lengths: a variable for each way to fill a sequence
(a configuration), a covering constraint for each length. Multiplicative
weights solve it without listing the configurations: a length's weight falls as
its constraint is covered, and the next configurations are those of most weight,
found by a knapsack dynamic program over the capacity. The weights are also
prices of a dual solution, which bounds the number of sequences from below.

The fractional counts are rounded down; what that leaves (all of it where there
are few pieces of a length) is priced on, with configurations taken in whole
numbers and only of pieces that are left. The last small part of all tokens,
mostly short pieces, is put best-fit in decreasing order into the room that is
left in the sequences, and into new ones.

Only the histogram (at most `capacity` rows) goes to the driver, and only the
plan, whose size depends on the number of lengths and not on the number of
documents, goes back. A piece finds its sequence from its length and its rank
among the pieces of that length, so no task gathers a sequence's or a length's
rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, salted_rank, small_batches, written
from plumbline.llm.tokenizing import LARGE_CACHE_WORDS, encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: How fast a length's weight falls as it is covered, and the part of the pieces at hand that one configuration takes.
RATE, STEP = 3.0, 0.5
#: Configurations taken from one pricing, and classes of neighbouring lengths that it tells apart; one in EXACT_PRICINGS is by all lengths, for the lower bound.
PER_PRICING, CLASSES, EXACT_PRICINGS = 32, 128, 100
#: Parts of one sequence in which the program's numbers are counted.
FRACTION = 8
#: Powers of a length's share of the capacity that are its first weight; each is solved until the bound is met. Over 1, a long piece is worth more than short ones of the same length together, which are kept to fill up others.
POWERS = (1.1, 2.0, 1.0)
#: A configuration that fills a sequence to the last token is taken if it is worth this part of the pricing's best.
FULL = 0.95
#: Parts of all tokens that are left to the last, best-fit step; each is tried.
TAILS = (0.1, 0.07, 0.05)
#: Part of the bound that a plan may have more sequences than it, without another of the POWERS being tried.
GAP = 1e-4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Plan = list[tuple[tuple[int, ...], int]]


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the most value within each capacity. As many capacities are done at once as the shortest length has tokens, for these do not depend on each other."""
    best, shortest = np.zeros(capacity + 1), int(lengths[0])
    for c in range(shortest, capacity + 1, shortest):
        own = np.arange(c, min(c + shortest, capacity + 1))
        k = int(np.searchsorted(lengths, own[-1], side="right"))
        at = own[None, :] - lengths[:k, None]
        got = np.where(at >= 0, best[np.maximum(at, 0)] + values[:k, None], 0.0).max(axis=0)
        best[own] = np.maximum.accumulate(np.maximum(got, best[c - 1]))
    return best


def _priced(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The pricing by the worthiest length of each capacity / CLASSES neighbours, without lengths under one such class where there are longer ones."""
    kind = lengths * CLASSES // capacity
    order = np.lexsort((lengths, -weights, kind))
    first = order[np.flatnonzero(np.diff(kind[order], prepend=-1))]
    if (kind[first] > 0).any():
        first = first[kind[first] > 0]
    return price(weights[first], lengths[first], capacity)


def _fill(c: int, best: np.ndarray, values: np.ndarray, lengths: np.ndarray, left: np.ndarray) -> list[int]:
    """Lengths that fill c as the pricing says, no more of a length than left (by length) has.

    One or two pieces that fill it to the last token go before the pricing's
    next choice, which supposes that there are enough of each length.
    """
    out: list[int] = []
    while c > 0:
        free = left[: c + 1] > 0
        if free[c]:
            one, pair = [c], values[c]
        else:
            both = free & free[::-1]
            if c % 2 == 0 and left[c // 2] < 2:
                both[c // 2] = False
            at = np.flatnonzero(both)
            one, pair = [], -1.0
            if len(at):
                worth = values[at] + values[c - at]
                k = int(at[worth.argmax()])
                one, pair = [k, c - k], float(worth.max())
        if one and pair >= FULL * best[c]:
            out += one
            for x in one:
                left[x] -= 1
            break
        k = int(np.searchsorted(lengths, c, side="right"))
        got = np.where(left[lengths[:k]] > 0, best[c - lengths[:k]] + values[lengths[:k]], -1.0)
        if not k or (j := int(got.argmax())) < 0 or got[j] < 0:
            break
        x = int(lengths[j])
        out.append(x)
        left[x] -= 1
        c -= x
    for x in out:
        left[x] += 1
    return out


def cover(counts: dict[int, int], capacity: int, power: float, tail: float, bounded: bool = False) -> tuple[Plan, dict[int, int], float]:
    """Configurations and whole numbers of them for all but a part `tail` of the tokens, the pieces left, and a lower bound of any solution, fractional ones too.

    Multiplicative weights: a length's weight falls as it is covered. Under a
    pricing the least covered lengths ask in turn, the longest first, for the
    best configuration that has them. The bound: prices under which no
    configuration is worth more than one give the pieces a total worth that no
    solution is below.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    left, plan = np.zeros(capacity + 1, dtype=np.int64), []
    left[lengths] = [counts[int(x)] for x in lengths]
    total = float((need * lengths).sum())
    bound, values, pricings = total / capacity, np.zeros(capacity + 1), 0
    while (now := left[lengths]) @ lengths > tail * total:
        weights = np.where(now > 0, (lengths / capacity) ** power * np.exp(-RATE * (1 - now / need)), 0.0)
        open_ = np.flatnonzero(now)
        values[:] = 0
        values[lengths[open_]] = weights[open_]
        if bounded and pricings % EXACT_PRICINGS == 0:
            bound = max(bound, float((need * weights).sum() / price(weights[open_], lengths[open_], capacity)[capacity]))
        pricings += 1
        best = _priced(weights[open_], lengths[open_], capacity)
        asking = lengths[open_[np.lexsort((-lengths[open_], -np.round(now[open_] / need[open_], 2)))][:PER_PRICING]].tolist()
        for x in asking:
            if not left[x]:
                continue
            left[x] -= 1
            held = [x, *_fill(capacity - x, best, values, lengths, left)]
            left[x] += 1
            kinds, times = np.unique(held, return_counts=True)
            many = max(1, int(STEP * int((left[kinds] // times).min())))
            left[kinds] -= many * times
            plan.append((tuple(sorted(held, reverse=True)), many))
    return plan, {int(x): int(left[x]) for x in lengths if left[x]}, bound


def best_fit_decreasing(counts: dict[int, int], capacity: int, opened: Plan | None = None) -> Plan:
    """Best fit over the histogram: sequences of one content are one entry, and equal pieces are placed together. opened: sequences to fill up."""
    by_room: dict[int, list[list]] = {}
    for held, many in opened or []:
        by_room.setdefault(capacity - sum(held), []).append([held, many])
    rooms: list[int] = sorted(by_room)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for held, many in ((each, n // each), (n % each, 1)):
                    if held and many:
                        room = capacity - held * length
                        if room not in by_room:
                            bisect.insort(rooms, room)
                        by_room.setdefault(room, []).append([(length,) * held, many])
                break
            room = rooms[at]
            entry = by_room[room][-1]
            held, many = entry
            each = room // length
            full = min(many, n // each)
            if full == 0:
                each, full = n, 1
            entry[1] -= full
            if not entry[1]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            rest = room - each * length
            if rest not in by_room:
                bisect.insort(rooms, rest)
            by_room.setdefault(rest, []).append([held + (length,) * each, full])
            n -= each * full
    return [(held, many) for entries in by_room.values() for held, many in entries]


def rounded(solution: Plan, counts: dict[int, int], capacity: int, power: float) -> Iterator[tuple[Plan, dict[int, int]]]:
    """Whole sequences from a solution in FRACTIONs of a sequence, and the pieces that these leave, for each of TAILS.

    The numbers are rounded down; what that leaves is covered by whole configurations.
    """
    left, plan = dict(counts), []
    for held, parts in sorted(solution, key=lambda c: (-c[1], c[0])):
        times = Counter(held)
        if (many := min(parts // FRACTION, *(left[k] // t for k, t in times.items()))) > 0:
            plan.append((held, many))
            for k, t in times.items():
                left[k] -= many * t
    left = {k: n for k, n in left.items() if n}
    total = sum(k * n for k, n in counts.items())
    for tail in TAILS:
        if rest := sum(k * n for k, n in left.items()):
            more, left, _ = cover(left, capacity, power, min(1.0, tail * total / rest))
            plan = plan + more
        yield plan, left


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, figures: dict | None = None) -> Plan:
    """Contents of sequences (lengths in descending order) and how many there are of each. Every piece is in exactly one.

    Of the POWERS of the first weights that is taken which leads to the fewest
    sequences; no more are tried once the bound is met, but for a part GAP. Where plain best-fit in
    decreasing order should need fewer, its plan is taken. figures receives the
    bound, the fractional optimum's estimate, the sequences, how many of them
    begin as a configuration, and what plain best-fit needs.
    """
    left = {int(k): int(v) for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a piece has a length outside 1..capacity")
    whole: Plan = [((capacity,), left.pop(capacity))] if capacity in left else []
    number = lambda plan: sum(m for _, m in plan)
    plain = best_fit_decreasing(left, capacity)
    best, found = plain, {"plain": number(plain), "from_configurations": 0}
    for power in POWERS if left else ():
        solution, _, lower = cover({k: n * FRACTION for k, n in left.items()}, capacity, power, 0.0, bounded=True)
        found["bound"] = max(found.get("bound", 0), math.ceil(lower / FRACTION - 1e-6))
        found["fractional"] = min(found.get("fractional", math.inf), number(solution) / FRACTION)
        for plan, rest in rounded(solution, left, capacity, power):
            filled = best_fit_decreasing(rest, capacity, plan)
            if number(filled) < number(best) or number(filled) == number(best) and number(plan) > found["from_configurations"]:
                best, found["from_configurations"] = filled, number(plan)
        if number(best) <= found["bound"] * (1 + GAP) and found["from_configurations"]:
            break
    if figures is not None:
        figures.update(found, sequences=number(best))
    return whole + [(tuple(sorted(held, reverse=True)), many) for held, many in best]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_words: int = LARGE_CACHE_WORDS) -> DataFrame:
    """The token pieces of every whole text: only texts of more than `capacity` tokens are cut.

    A null or empty text is the end id alone. A null doc_id and repeated rows
    are kept as they are. Columns other than doc_id and text are not read.
    with_ids adds the ids themselves.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, cache_words), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, data in enumerate(enc.encode(batch.column(1).to_pylist(), end)):
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    of.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length; pieces must be a written table, for it is read twice."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, first_sequence, used = [], 0, dict.fromkeys(counts, 0)
    for held, many in plan_sequences(counts, capacity):
        offset = 0
        for length in held:
            slots.append((length, used[length], first_sequence, offset))
            used[length] += many
            offset += length
        first_sequence += many
    slots.sort()
    kinds = np.array(sorted(counts), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([counts[int(k)] for k in kinds])]).astype(np.int64)
    of = np.array(slots, dtype=np.int64).reshape(-1, 4)
    low = base[np.searchsorted(kinds, of[:, 0])] + of[:, 1]
    sequence, offsets = of[:, 2], of[:, 3]

    ranked = salted_rank(pieces, ["length"], [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], "__rank")
    place_at, length_at, names = ranked.columns.index("__rank"), ranked.columns.index("length"), pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(length_at).to_numpy(), batch.column(place_at).to_numpy()
            at = base[np.searchsorted(kinds, length)] + rank
            k = np.searchsorted(low, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence[k] + at - low[k]), pa.array(offsets[k])], [*names, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces with ids: sequence_id, tokens, doc_ids and offsets. A group is one sequence, at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces_of(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")), "pieces"))

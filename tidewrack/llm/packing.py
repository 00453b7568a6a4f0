"""Best-fit packing of documents into sequences by linear grouping.

Documents become token ids, end with ``END`` and are cut into pieces only where longer than a sequence. What has to be
packed is then a histogram of at most ``SIZE`` lengths, whatever the corpus holds. The plan is made from the histogram:
large lengths are divided into ``GROUPS`` groups of equal cardinality and rounded up to the largest of
their group; the few-size problem is optimised over configurations (linear program by column generation, rounded down);
the actual lengths are substituted, longest first; what rounding left over and the small lengths are placed best-fit,
longest first. The plan is a list of runs of equal sequences. Pieces are numbered within their length, in two levels so
that a frequent length is no one task's, and number k of a length goes to the plan's k-th place for that length.

Defined cases: a null or empty text is the end token alone; very long texts are many pieces; rows that repeat are packed
as documents of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.rows import slices
from tidewrack.session import cut, lookup

SIZE = 2048
END = 0
GROUPS = 48
#: Lengths above SIZE // s are large. Each s is tried until a plan needs no more sequences than the tokens fill.
SMALL = (4, 3, 2)
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; as many again from before, as long as they are met again.
REMEMBERED = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Words:
    """Token ids of texts, word by word: white space never stands inside a token of this vocabulary, so a word's ids don't
    depend on its neighbours. Plain words go to the BPE model directly; any other goes through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.symbols = _byte_symbols()
        self.odd = {chr(c) for c in range(0x1C, 0x20)}  # white space to str.split(), but not to the tokenizer

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_word(self, word: str) -> bytes:
        if (found := self.older.get(word)) is not None:
            return self.remember(word, found)
        low = word.lower()
        core, mark = (low[:-1], low[-1]) if low[-1] in ".," and len(low) > 1 else (low, "")
        if mark:
            ends = self.known.get(mark) or self.remember(mark, self.pack(self.tokenizer.encode(mark, add_special_tokens=False).ids))
            if (found := self.known.get(core) or self.older.get(core)) and core.isalpha():
                return self.remember(word, found + ends)
        if core.isalpha() and (core.isascii() or (max(core) < "ɐ" and unicodedata.is_normalized("NFC", core))):
            mapped = core if core.isascii() else "".join(self.symbols[b] for b in core.encode())
            found = self.remember(core, self.pack([t.id for t in self.model.tokenize(mapped)]))
            return self.remember(word, found + ends) if mark else self.remember(word, found)
        return self.remember(word, self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids))

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 40:
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in self.odd):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, of_word = self.known.get, self.of_word
        return b"".join([known(w) or of_word(w) for w in text.split()])


def _words(path: str) -> Words:
    """One per Python worker, also across tasks."""
    held = sys.modules.setdefault("_words_of_this_worker", types.ModuleType("_words_of_this_worker"))
    if not hasattr(held, path):
        setattr(held, path, Words(path))
    return getattr(held, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece. ``tokenizer`` is a path that every executor can read; the
    default is the installed package's file."""
    end = np.array([END], "<u4").tobytes()

    def apply(batches):
        words = _words(tokenizer or default_tokenizer())
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.ids(text or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(apply, PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """The linear program: how often to use which configuration (count of each size) so that demands are met with the
    fewest sequences. Column generation; the basis starts with one configuration a size."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(np.float64)
    need = np.array(demand, np.float64)
    for _ in range(50 * k + 200):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        gain, column = _knapsack(sizes, price, capacity)
        if gain <= 1 + 1e-7:
            break
        use, step = inverse @ need, inverse @ column
        steps = np.full(k, np.inf)
        up = step > 1e-9
        steps[up] = np.maximum(use[up], 0) / step[up]
        basis[:, int(np.argmin(steps))] = column
    use = np.linalg.solve(basis, need)
    return [(tuple(int(a) for a in basis[:, i]), float(max(0.0, u))) for i, u in enumerate(use)]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price."""
    size = np.array(sizes)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(size.min())
    order = np.argsort(size)
    ordered, worth = size[order], price[order]
    limit = np.searchsorted(ordered, np.arange(capacity + 1), "right")
    for c in range(least, capacity + 1):
        n = limit[c]
        values = best[c - ordered[:n]] + worth[:n]
        i = int(values.argmax())
        if values[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = values[i], order[i]
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c >= least:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= size[choice[c]]
    return float(best[capacity]), column


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> list[tuple[int, list[int]]]:
    """Runs (sequences, lengths in each of them) that place every length as often as the histogram has it: of the plans
    for each limit of large lengths the one with the fewest sequences."""
    filled, best, fewest = sum(x * n for x, n in histogram.items()), [], None
    for s in small:
        runs = grouped_plan(histogram, size, groups, s)
        count = sum(many for many, _ in runs)
        if fewest is None or count < fewest:
            best, fewest = runs, count
        if fewest * size < filled + size:
            break
    return best


def grouped_plan(histogram: dict[int, int], size: int, groups: int, small: int) -> list[tuple[int, list[int]]]:
    runs: list[tuple[int, list[int]]] = [(histogram[size], [size])] if histogram.get(size) else []
    left = {length: n for length, n in histogram.items() if n and length < size}
    large = sorted((x for x in left if x > size // small), reverse=True)
    total = sum(left[x] for x in large)
    if large:
        queues: list[list[list[int]]] = [[]]
        filled, each = 0, -(-total // groups)
        for length in large:
            n = left.pop(length)
            while n:
                if filled == each:
                    queues.append([])
                    filled = 0
                part = min(n, each - filled)
                queues[-1].append([length, part])
                filled, n = filled + part, n - part
        # Groups that begin with the same length are one size.
        merged: dict[int, list[list[int]]] = {}
        for q in queues:
            merged.setdefault(q[0][0], []).extend(q)
        sizes = list(merged)
        waiting = [merged[s] for s in sizes]
        for shape, use in configurations(sizes, [sum(n for _, n in q) for q in waiting], size):
            if (many := int(use + 1e-6)) and any(shape):
                runs += _substituted(shape, many, waiting)
        for q in waiting:
            for length, n in q:
                if n:
                    left[length] = left.get(length, 0) + n
    return _best_fit(runs, left, size)


def _substituted(shape: tuple[int, ...], many: int, waiting: list[list[list[int]]]) -> list[tuple[int, list[int]]]:
    """``many`` sequences of one configuration with the next actual lengths of each group in its places."""
    lanes = []
    for group, count in enumerate(shape):
        for _ in range(count):
            lane, need, queue = [], many, waiting[group]
            while need and queue:
                part = min(need, queue[0][1])
                lane.append((queue[0][0], part))
                need -= part
                queue[0][1] -= part
                if not queue[0][1]:
                    queue.pop(0)
            lanes.append(lane)
    ends = sorted({many} | {int(e) for lane in lanes for e in np.cumsum([n for _, n in lane])})
    out, at = [], 0
    for end in ends:
        lengths = []
        for lane in lanes:
            upto = 0
            for length, n in lane:
                upto += n
                if at < upto:
                    lengths.append(length)
                    break
        if lengths:
            out.append((end - at, lengths))
        at = end
    return out


def _best_fit(runs: list[tuple[int, list[int]]], left: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Places what is left, longest first, each in the fullest sequences that still have room, whole runs at a time."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for many, lengths in runs:
        by_room[size - sum(lengths)].append((many, lengths))
    for length in sorted(left, reverse=True):
        n = left[length]
        room = length
        while n:
            while room < size and not by_room.get(room):
                room += 1
            if room < size:
                many, lengths = by_room[room].pop()
            else:
                many, lengths = -(-n // (size // length)), []
            each = room // length
            full = min(many, n // each)
            if full:
                by_room[room - each * length].append((full, lengths + [length] * each))
                n -= full * each
            if full < many and n:
                by_room[room - n * length].append((1, lengths + [length] * n))
                full, n = full + 1, 0
            if full < many and room < size:
                by_room[room].append((many - full, lengths))
    return [run for room in sorted(by_room) for run in by_room[room]]


class Places:
    """For every length the plan's places in order: first number, sequences before, places a sequence, offset."""

    def __init__(self, runs: list[tuple[int, list[int]]]):
        table: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        upto: dict[int, int] = defaultdict(int)
        sequence = 0
        for many, lengths in runs:
            offset, at = 0, 0
            while at < len(lengths):
                length, n = lengths[at], 1
                while at + n < len(lengths) and lengths[at + n] == length:
                    n += 1
                table[length].append((upto[length], sequence, n, offset))
                upto[length] += many * n
                offset, at = offset + n * length, at + n
            sequence += many
        self.sequences = sequence
        self.table = {length: np.array(rows, np.int64) for length, rows in table.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length):
            own = np.flatnonzero(length == value)
            rows = self.table[int(value)]
            row = rows[np.searchsorted(rows[:, 0], number[own], "right") - 1]
            bins, nth = np.divmod(number[own] - row[:, 0], row[:, 2])
            sequence[own], offset[own] = row[:, 1] + bins, row[:, 3] + nth * value
        return sequence, offset


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    found = cut(pieces(docs, size, tokenizer))
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    places = found.sparkSession.sparkContext.broadcast(Places(plan(histogram, size)))
    slices = max(8, sum(histogram.values()) // 20_000)
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    along = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    numbered = sliced.join(lookup(cut(sums)), ["length", "slice"]).withColumn("number", F.col("before") + F.row_number().over(within) - 1)
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")

    def apply(batches):
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(apply, PIECES + ", sequence_id long, offset long")


def op6_linear_grouping(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return pack(table(spark, sf_dir, "documents"))

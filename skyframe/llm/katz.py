"""Language-model scores of whole texts by Katz backoff over word pairs, learned from a part of the same documents.

Texts become blocks of tokens, written once as a stage table. Blocks ask parts: a block sends what it holds of a part (its words, then its pairs
with their training counts), the part adds up what all blocks sent and answers each block with the totals for what it asked. So every count is
exact, what moves is pre-aggregated per block, and no task holds more than one block or one part. Words fall to parts by hash. Pairs fall to parts
by their context; frequent contexts are split further by the following word, and their parts' sums meet again in the asking block.

P(w | c), c seen in training:   d(r) r / (n(c) + 1)      if the pair occurs r > 0 times,
                                alpha(c) P(w)            otherwise,
with Good-Turing discounts d(r) for r <= `largest`, one pseudo-count that keeps mass for the unseen where every pair is frequent, and alpha(c) such
that the sum over all words and the unknown word is exactly 1. P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)); unseen contexts back off to it with weight 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.session import settle

FOLDS = 5
HELD_OUT = 1
LARGEST = 5
BLOCK_TOKENS = 1_000_000
PART_BYTES = 6 << 20
START, END = b" S", b" E"  # no word holds a space
ROW = "block long, kind int, part int, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = ["block", "kind", "part", "a", "b", "c", "d", "e", "f"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
STATE, WORDS, PAIRS, TOTALS = 0, 1, 2, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is scored only; documents without an id are learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def packed(values: np.ndarray) -> bytes:
    """Non-negative whole numbers as compressed planes of bytes."""
    values = np.ascontiguousarray(values, dtype="<i8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _rows(rows: list[list]) -> pa.RecordBatch:
    rows = [r + [None] * (9 - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)] if rows else [pa.array([], t) for t in TYPES], names=NAMES)


def _blocks(parts: int, block_tokens: int):
    """Documents to blocks. a: ids, b: which have one, c: tokens per document, d: tokens, e: words, f: their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words: dict[bytes, int] = {START: 0, END: 1}
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            where = np.array([xxhash.xxh64_intdigest(w) % parts for w in words], dtype=np.int64)
            known = np.array([i is not None for i in ids])
            plain = np.array([i or 0 for i in ids], dtype=np.int64)
            return _rows([[number, STATE, 0, packed(plain.view(np.uint8)), packed(known.astype(np.int64)), packed(np.array([len(t) for t in tokens])),
                           packed(np.concatenate(tokens)), zstandard.compress(b"\n".join(words), 3), packed(where)]])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                found.append(END)
                number_of = words.setdefault
                tokens.append(np.fromiter((number_of(w, len(words)) for w in found), dtype=np.int32, count=len(found)))
                ids.append(key.as_py())
                held += len(found)
                if held >= block_tokens:
                    yield block()
                    number, words, ids, tokens, held = number + 1, {START: 0, END: 1}, [], [], 0
        if ids:
            yield block()

    return run


class Block:
    """A block as it was stored, with training counts of its own."""

    def __init__(self, row: dict) -> None:
        self.number = row["block"]
        plain = unpacked(row["a"]).astype(np.uint8).view("<i8")
        self.ids = [int(i) if k else None for i, k in zip(plain, unpacked(row["b"]))]
        self.sizes, self.tokens, self.part = unpacked(row["c"]), unpacked(row["d"]).astype(np.int32), unpacked(row["f"])
        self.out = np.array([held_out(i) for i in self.ids])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.out, self.sizes)
        self.by_part = np.argsort(self.part, kind="stable")
        self.words = row["e"]

    def counts(self) -> np.ndarray:
        found = np.bincount(self.tokens[self.train], minlength=len(self.part))
        found[0] = int((~self.out).sum())
        return found

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(part, numbers of its words here)."""
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(self.part[self.by_part]) != 0)))
        for lo, hi in zip(cuts, [*cuts[1:], len(self.by_part)]):
            yield int(self.part[self.by_part[lo]]), self.by_part[lo:hi]


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            words, counts = zstandard.decompress(block.words).split(b"\n"), block.counts()
            yield _rows([[block.number, WORDS, part, zstandard.compress(b"\n".join([words[i] for i in which.tolist()]), 3), packed(counts[which])]
                         for part, which in block.slices()])


def _answer_words(parts: int):
    """Per block the numbers and counts of the words it asked for; with block -1 the tokens and distinct words of the part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, total, asked = key[0].as_py(), {}, []
        for row in table.to_pylist():
            words, counts = zstandard.decompress(row["a"]).split(b"\n"), unpacked(row["b"]).tolist()
            for w, c in zip(words, counts):
                total[w] = total.get(w, 0) + c
            asked.append((row["block"], words))
        place = {w: i for i, w in enumerate(total)}
        known = [c for w, c in total.items() if c and w != START]
        out = [[b, WORDS, part, packed(np.array([place[w] for w in words]) * parts + part), packed(np.array([total[w] for w in words]))] for b, words in asked]
        out.append([-1, WORDS, part, packed(np.array([sum(known), len(known)]))])
        return pa.Table.from_batches([_rows(out)])

    return run


class Pairs:
    """The pairs of a block by (part, context, word), and the contexts it asks parts about."""

    def __init__(self, block: Block, answers: list[dict], parts: int, total: int) -> None:
        self.name, self.count = np.zeros(len(block.part), dtype=np.int64), np.zeros(len(block.part), dtype=np.int64)
        slices = dict(block.slices())
        for row in answers:
            which = slices[row["part"]]
            self.name[which], self.count[which] = unpacked(row["a"]), unpacked(row["b"])
        before = np.empty_like(block.tokens)
        before[1:] = block.tokens[:-1]
        before[block.starts] = 0  # the start
        self.context = before
        self.known = (self.count[before] > 0) & (self.count[block.tokens] > 0)
        width = len(block.part)
        key = before[self.known].astype(np.int64) * width + block.tokens[self.known]
        pair, place = np.unique(key, return_inverse=True)
        self.place = place.astype(np.int32)
        learned = np.bincount(self.place[block.train[self.known]], minlength=len(pair))
        context, word = pair // width, pair % width
        splits = 1 + self.count // max(1, total // (2 * parts))
        part = self._part(context, (self.name[word].astype(np.uint64) * MIX >> np.uint64(40)).astype(np.int64) % splits[context], parts)
        order = np.lexsort((word, context, part))
        self.back = np.empty(len(pair), dtype=np.int64)
        self.back[order] = np.arange(len(pair))
        self.pair_part, self.pair_context, self.pair_word, self.learned = part[order], context[order], word[order], learned[order]
        seen = np.unique(before[self.count[before] > 0])
        wide = np.repeat(seen, splits[seen])
        nth = np.arange(len(wide)) - np.repeat(np.cumsum(splits[seen]) - splits[seen], splits[seen])
        asked = np.unique(self._part(wide, nth, parts) * width + wide)
        self.ask_part, self.ask_context = asked // width, asked % width
        self.wanted = np.zeros(width, dtype=bool)
        self.wanted[before[(self.count[before] > 0) & (self.count[block.tokens] == 0)]] = True
        self.wanted |= splits > 1
        size = np.searchsorted(self.pair_part * width + self.pair_context, np.stack((asked, asked + 1)))
        self.ask_size = size[1] - size[0]

    def _part(self, context: np.ndarray, nth: np.ndarray, parts: int) -> np.ndarray:
        mixed = (self.name[context].astype(np.uint64) * np.uint64(0x100000001B3) + nth.astype(np.uint64)) * MIX
        return ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(part, its contexts here, its pairs here)."""
        for part in np.unique(self.ask_part).tolist():
            yield part, slice(*np.searchsorted(self.ask_part, [part, part + 1])), slice(*np.searchsorted(self.pair_part, [part, part + 1]))


def _split(table: pa.Table) -> tuple[Block, dict[int, list[dict]]]:
    kinds: dict[int, list[dict]] = {}
    for row in table.to_pylist():
        kinds.setdefault(row["kind"], []).append(row)
    return Block(kinds[STATE][0]), kinds


def _ask_pairs(parts: int, total: int):
    """a: numbers of contexts, b: pairs of each, c: whether the block needs the context's sums anyway, d: words, e: their counts, f: the pairs' counts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, kinds = _split(table)
        pairs = Pairs(block, kinds[WORDS], parts, total)
        out = []
        for part, asks, own in pairs.slices():
            contexts, words = pairs.ask_context[asks], pairs.pair_word[own]
            out.append([block.number, PAIRS, part, packed(pairs.name[contexts]), packed(pairs.ask_size[asks]), packed(pairs.wanted[contexts]),
                        packed(pairs.name[words]), packed(pairs.count[words]), packed(pairs.learned[own])])
        return pa.Table.from_batches([_rows(out)])

    return run


def _answer_pairs(largest: int):
    """Per block the totals of its pairs (a) and, where needed, sums over all pairs of a context (b: which, c: how many pairs occur once, twice ...,
    d: occurrences of more frequent ones, e: twice the sum of n(w) + 0.5 of their words); with block -1 the numbers of pairs by their count."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asks = [(unpacked(r["a"]), unpacked(r["b"]), unpacked(r["c"]) > 0) for r in rows]
        names, at = np.unique(np.concatenate([a for a, _, _ in asks]), return_inverse=True)
        context = np.repeat(at, np.concatenate([b for _, b, _ in asks]))
        word = np.concatenate([unpacked(r["d"]) for r in rows])
        heads, word_at = np.unique(word, return_inverse=True)
        pair, first, back = np.unique(context * max(1, len(heads)) + word_at, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([unpacked(r["f"]) for r in rows]), minlength=len(pair)).astype(np.int64)
        of = context[first]
        spread = 2 * np.concatenate([unpacked(r["e"]) for r in rows])[first] + 1
        few = [np.bincount(of[total == r], minlength=len(names)) for r in range(1, largest + 1)]
        many = np.bincount(of[total > largest], weights=total[total > largest], minlength=len(names)).astype(np.int64)
        mass = np.bincount(of[total > 0], weights=spread[total > 0], minlength=len(names)).astype(np.int64)
        out, lo, head = [], 0, 0
        for row, (_, sizes, wanted) in zip(rows, asks):
            own = total[back[lo:lo + int(sizes.sum())]]
            lo += len(own)
            here = at[head:head + len(sizes)]
            head += len(sizes)
            unseen = np.zeros(len(sizes), dtype=bool)
            unseen[np.repeat(np.arange(len(sizes)), sizes)[own == 0]] = True
            which = np.flatnonzero(wanted | unseen)
            out.append([row["block"], TOTALS, key[0].as_py(), packed(own), packed(which), packed(np.concatenate([f[here[which]] for f in few])),
                        packed(many[here[which]]), packed(mass[here[which]])])
        out.append([-1, TOTALS, key[0].as_py(), packed(np.bincount(np.minimum(total, largest + 2), minlength=largest + 3))])
        return pa.Table.from_batches([_rows(out)])

    return run


def discounts(numbers: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """d(0..largest) from the numbers of pairs that occur 0, 1, 2 ... times; 1 where Good-Turing gives no share between 0 and 1."""
    out, n = np.ones(largest + 1), [float(x) for x in numbers]
    rest = (largest + 1) * n[largest + 1] / n[1] if n[1] else 1.0
    for r in range(1, largest + 1):
        if n[r] and rest < 1:
            share = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            out[r] = share if 0 < share <= 1 else 1.0
    return out


def _score(parts: int, total: int, distinct: int, discount: np.ndarray):
    largest = len(discount) - 1
    whole = total + 0.5 * (distinct + 1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, kinds = _split(table)
        pairs = Pairs(block, kinds[WORDS], parts, total)
        slices = {part: (asks, own) for part, asks, own in pairs.slices()}
        totals = np.zeros(len(pairs.pair_part), dtype=np.int64)
        few = np.zeros((largest, len(block.part)))
        many, mass = np.zeros(len(block.part)), np.zeros(len(block.part))
        for row in kinds.get(TOTALS, []):
            asks, own = slices[row["part"]]
            totals[own] = unpacked(row["a"])
            which = pairs.ask_context[asks][unpacked(row["b"])]
            few[:, which] += unpacked(row["c"]).reshape(largest, len(which))
            many[which] += unpacked(row["d"])
            mass[which] += unpacked(row["e"]) / 2
        kept = (discount[1:, None] * np.arange(1, largest + 1)[:, None] * few).sum(axis=0) + many
        weight = np.log10((1 - kept / (pairs.count + 1)) / (1 - mass / whole))
        single = np.log10((pairs.count + 0.5) / whole)
        times = np.zeros(len(block.tokens), dtype=np.int64)
        times[pairs.known] = totals[pairs.back[pairs.place]]
        before = pairs.count[pairs.context]
        share = np.where(times <= largest, discount[np.minimum(times, largest)], 1.0)
        pair = np.log10(np.maximum(share * times, 1e-300) / (before + 1))
        value = np.where(times > 0, pair, np.where(before > 0, weight[pairs.context], 0.0) + single[block.tokens])
        plain = single[block.tokens]
        columns = [pa.array(block.ids, pa.int64()), pa.array(block.out), pa.array(block.sizes),
                   pa.array(np.add.reduceat((pairs.count[block.tokens] > 0).astype(np.int64), block.starts)),
                   pa.array(np.full(len(block.ids), total, dtype=np.int64)), pa.array(np.add.reduceat(plain, block.starts)),
                   pa.array(np.add.reduceat(value, block.starts))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, block_tokens: int = BLOCK_TOKENS,
                part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Tokens: words after lower-casing A-Z, then one end. Null texts count as empty and have one token, the end. Rows without an id are learned from.
    Repeated rows count as often as they come; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    state = settle(rows.mapInArrow(_blocks(parts, block_tokens), ROW))
    words = settle(state.mapInArrow(_ask_words, ROW).groupBy("part").applyInArrow(_answer_words(parts), ROW))
    sums = [unpacked(r["a"]) for r in words.filter("block = -1").select("a").collect()]  # two numbers per part
    total, distinct = (int(sum(s[i] for s in sums)) for i in range(2))
    told = state.union(words.filter("block >= 0"))
    pairs = settle(told.groupBy("block").applyInArrow(_ask_pairs(parts, total), ROW).groupBy("part").applyInArrow(_answer_pairs(largest), ROW))
    numbers = sum((unpacked(r["a"]) for r in pairs.filter("block = -1").select("a").collect()), np.zeros(largest + 3, dtype=np.int64))
    scored = told.union(pairs.filter("block >= 0")).groupBy("block").applyInArrow(
        _score(parts, total, distinct, discounts(numbers, largest)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored

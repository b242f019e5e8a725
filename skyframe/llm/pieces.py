"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is one leading space and itself; no piece crosses from a character into a following space or across a line end, so the lattice falls into
units (spaces and the word after them) that are filtered once per batch however often they occur. Backward sampling runs over all units of a
batch at once; its random numbers are a function of (seed, row key, unit, step), so a row gets the same pieces wherever and however often it runs.
The vocabulary's scores are merge ranks; a piece of rank r gets the weight (r + 1) ** -sharpness. Characters no piece covers become bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import pieces as cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 42
BATCH_CHARS = 1 << 20
LATTICE_CHARS = 1 << 16
UNIT = re.compile(r" *[^ \n]+| +|\n")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Vocabulary:
    """Pieces with spaces in place of their mark, as a trie in arrays, with their weights and what each decodes to."""

    def __init__(self, model: str, sharpness: float) -> None:
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = np.zeros(256, dtype=np.int32)
        self.surface: list[bytes] = []
        pieces: dict[str, int] = {}
        for i in range(found.get_piece_size()):
            piece = found.id_to_piece(i)
            if found.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif found.is_control(i) or found.is_unknown(i):
                self.surface.append(b"")
            else:
                pieces[piece.replace("▁", " ")] = i
                self.surface.append(piece.replace("▁", " ").encode())
        if not 0 <= sharpness <= 3:
            raise ValueError("sharpness must be between 0 and 3")
        self.weight = (np.arange(len(self.surface)) + 1.0) ** -sharpness
        letters, self.longest = sorted({c for p in pieces for c in p}), max(map(len, pieces))
        self.letter = np.full(0x110000, -1, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        place, steps, ends = {"": 0}, {}, [-1]
        for piece in sorted(pieces):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in place:
                    place[piece[:n]] = len(ends)
                    ends.append(-1)
                    steps[place[piece[: n - 1]] * len(letters) + int(self.letter[ord(piece[n - 1])])] = place[piece[:n]]
            ends[place[piece]] = pieces[piece]
        self.letters, self.ends = len(letters), np.array(ends, dtype=np.int32)
        self.leaf = np.ones(len(ends), dtype=bool)
        self.leaf[[k // len(letters) for k in steps]] = False
        self.shift = np.uint64(64 - 20)
        self.keys, self.next = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=np.int32)
        for key, to in steps.items():
            slot = (key * int(MIX[0]) & (1 << 64) - 1) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << 20) - 1
            self.keys[slot], self.next[slot] = key, to

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after the letters, -1 where there is none."""
        key = state * np.int64(self.letters) + letter
        slot = ((key.astype(np.uint64) * MIX[0]) >> self.shift).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == key, self.next[slot], -1)
        open_ones = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_ones):
            slot[open_ones] = slot[open_ones] + 1 & (1 << 20) - 1
            seen = self.keys[slot[open_ones]]
            out[open_ones] = np.where(seen == key[open_ones], self.next[slot[open_ones]], -1)
            open_ones = open_ones[(seen != key[open_ones]) & (seen >= 0)]
        return out

    def lattices(self, units: list[str], most: int = LATTICE_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`lattice` of all units, worked out in blocks of `most` characters (or one unit that has more), so that sorting edges takes bounded memory."""
        ends = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)))
        found, lo, base = [], 0, 0
        while lo < len(units):
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            bounds, before, names, after = self.lattice(units[lo:hi])
            before[before >= 0] += base
            bounds += base
            found.append((bounds, before, names, after + base))
            lo, base = hi, int(ends[hi - 1])
        return tuple(np.concatenate(columns) for columns in zip(*found))

    def lattice(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every edge into every character of the joined units, by character: character + cumulative probability of the edge backwards, the
        character it comes from (-1: start of the unit), and its piece (below 0: -1 minus the code point, which no piece covers); last, the first
        character after each unit. The probabilities are those of backward sampling: forward sum of the edge's start times its weight, over the
        forward sum of its end."""
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        after = np.cumsum(sizes)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        place = np.arange(len(codes)) - np.repeat(after - sizes, sizes)
        room = np.repeat(sizes, sizes) - place
        letter = self.letter[codes]
        live, state, length = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        starts, ends, names = [], [], []
        while len(live):
            known = letter[live + length]
            good = known >= 0
            to = np.full(len(live), -1, dtype=np.int64)
            to[good] = self.step(state[good], known[good])
            hit = np.where(to >= 0, self.ends[to], -1)
            at = np.flatnonzero(hit >= 0)
            starts.append(live[at])
            ends.append(live[at] + length)
            names.append(hit[at])
            if not length:
                bare = np.flatnonzero(hit < 0)
                starts.append(bare)
                ends.append(bare)
                names.append(-1 - codes[bare].astype(np.int32))
            length += 1
            on = np.flatnonzero((to >= 0) & (room[live] > length) & ~self.leaf[to])
            live, state = live[on], to[on]
        start, end, name = np.concatenate(starts), np.concatenate(ends), np.concatenate(names)
        weight = np.where(name >= 0, self.weight[name], self.weight[-1])
        # by place of the end in its unit, so that all units advance together
        order = np.lexsort((start, end, place[end]))
        start, end, name, weight = start[order], end[order], name[order], weight[order]
        begins = place[start] == 0
        level = place[end]
        cuts = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        ups = np.concatenate((np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1]))), [len(end)]))
        forward, share = np.zeros(len(codes)), np.empty(len(end))
        by_cut = np.searchsorted(cuts, ups)
        for lo, hi, first, last in zip(ups, ups[1:], by_cut, by_cut[1:]):
            part = np.where(begins[lo:hi], 1.0, forward[start[lo:hi] - 1]) * weight[lo:hi]
            own = cuts[first:last] - lo
            sums = np.add.reduceat(part, own)
            part /= np.repeat(sums, np.diff(np.append(own, hi - lo)))
            share[lo:hi] = part
            forward[end[cuts[first:last]]] = sums
            if sums.min() < 1e-250 or sums.max() > 1e250:
                self._rescale(forward, end[cuts[first:last]], place)
        order = np.argsort(end, kind="stable")
        start, end, name, share, begins = start[order], end[order], name[order], share[order], begins[order]
        cuts = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        total = np.cumsum(share)
        total -= np.repeat(total[cuts] - share[cuts], np.diff(np.append(cuts, len(end))))
        bounds = end + np.minimum(total, 1.0)
        bounds[np.append(cuts[1:], len(end)) - 1] = end[np.append(cuts[1:], len(end)) - 1] + 1.0
        return bounds, np.where(begins, -1, start - 1), name, after

    def _rescale(self, forward: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
        """Scale the last forward sums of long units before they get too small or too large: only ratios within the reach of a piece matter."""
        for i in at[(forward[at] < 1e-200) | (forward[at] > 1e200)].tolist():
            forward[i - min(int(place[i]), self.longest):i + 1] /= forward[i]


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    return Vocabulary(model, sharpness)


def row_key(key: int | None, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(b"" if key is None else int(key).to_bytes(8, "little", signed=True), seed)


def _uniform(state: np.ndarray) -> np.ndarray:
    z = state.copy()
    z ^= z >> np.uint64(30)
    z *= MIX[1]
    z ^= z >> np.uint64(27)
    z *= MIX[2]
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str | None], keys: list[int], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, offsets of the texts): one sampled segmentation each. Null and empty texts have no pieces."""
    local: dict[str, int] = {}
    tokens: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = UNIT.findall(" " + text)
            counts[i] = len(found)
            tokens += [local.setdefault(u, len(local)) for u in found]
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if not tokens:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    bounds, before, names, after = words.lattices(list(local))
    unit = np.array(tokens, dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    state = np.array(keys, dtype=np.uint64)[row] + (np.arange(len(unit)) - offsets[row]).astype(np.uint64) * MIX[1]
    active, node = np.arange(len(unit)), after[unit] - 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    length = np.zeros(len(unit), dtype=np.int64)
    while len(active):
        state += MIX[0]
        edge = np.searchsorted(bounds, node + _uniform(state), side="right")
        steps.append((active, names[edge]))
        length[active] += 1
        node = before[edge]
        on = node >= 0
        active, node, state = active[on], node[on], state[on]
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]), dtype=np.int32)
    for k, (which, what) in enumerate(steps):
        out[ends[which] - 1 - k] = what
    return _spelled(out, np.concatenate(([0], ends))[offsets], words)


def _spelled(out: np.ndarray, offsets: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Code points that stand in place of pieces become their bytes."""
    if not (out < 0).any():
        return out, offsets
    code = np.where(out < 0, -1 - out, 0)
    wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(wide)))
    wanted, which = np.repeat(out, wide), np.repeat(np.arange(len(out)), wide)
    back = wide[which] - 1 - (np.arange(len(which)) - ends[which])  # how many bytes follow within the character
    lead = (back == wide[which] - 1)
    value = (code[which] >> (6 * back)) & 0x3F | 0x80
    value = np.where(lead, np.where(wide[which] == 1, code[which], (code[which] >> (6 * back)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide[which]]), value)
    return np.where(wanted < 0, words.bytes[np.where(wanted < 0, value, 0)], wanted).astype(np.int32), ends[offsets]


def decode(ids, words: Vocabulary) -> str:
    """The text of a list of pieces: their bytes in order without the leading space."""
    surface = words.surface
    return b"".join([surface[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: bool = False, out_col: str = "pieces", model: str = MODEL,
           sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: the key, the pieces (array of int), and whether they decode to the text; with `keep` all columns of docs first.

    A null text has null pieces, an empty one none; both count as lossless. Rows without a key share one key. A column of docs that is called
    `out_col` or "lossless" is replaced. `model` is a path that every executor reads; the vocabulary is of fixed size.
    """
    rows = docs.select(*[c for c in docs.columns if c not in (out_col, "lossless")]) if keep else docs.select(key_col, text_col)
    out = rows.schema if keep else rows.select(key_col).schema
    width, at_key, at_text = len(out), rows.columns.index(key_col), rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model, sharpness)
        for batch in cut(batches, text_col, BATCH_CHARS):
            texts = batch.column(at_text).to_pylist()
            ids, offsets = sample(texts, [row_key(k, seed) for k in batch.column(at_key).to_pylist()], words)
            same = [not t or decode(ids[a:b].tolist(), words) == t for t, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), lists, pa.array(same)],
                                             names=[*batch.schema.names[:width], out_col, "lossless"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return rows.mapInArrow(run, f"{names}, `{out_col}` array<int>, lossless boolean")


def decoded(rows: DataFrame, ids_col: str = "pieces", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """rows with the text that the pieces stand for; null pieces give a null text."""

    @F.udf("string", useArrow=True)
    def text_of(ids):
        return None if ids is None else decode(list(ids), vocabulary(model))

    return rows.withColumn(out_col, text_of(ids_col))

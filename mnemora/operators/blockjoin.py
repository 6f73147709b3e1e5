"""Similar sets of one group, compared block by block without shuffling tokens once per partner.

Where the least Jaccard similarity is low (0.2 under a shared concept), nearly every two texts of a language meet in
some token, so a join on tokens makes more rows than there are pairs. Here a group's rows are written once, as blocks of
numbered tokens, to the folder that all machines share; a task compares two blocks in memory, in chunks of rows of one
profile and of like lengths. A product of two matrices bounds every overlap of two chunks from above; what can still reach
the threshold is counted exactly. Equal rows are one class. Disk grows with the rows, memory with a block; the time of a
group grows with the square of its classes, by some ten nanoseconds a pair.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: Classes a block holds at most, and its tokens; rows compared at once; tokens of the matrix; meetings counted at once.
BLOCK, TOKENS, ROWS, DENSE, MEETINGS = 4096, 1 << 22, 512, 4096, 1 << 18
#: Columns of a bound's matrix, powers of two; rows of a profile that make a chunk of their own; bytes of marks at once.
COLUMNS, ALONE, MARKS = (64, 16384), 64, 1 << 24
#: Nanoseconds of a pair per column and of an exact count per token; how far pairs are from the mean of overlaps, and of bounds.
MULTIPLY, COUNT, UNLIKE = 0.02, 10, (0.4, 0.15)
#: A token that more than this share of a block's classes hold goes to the matrix.
SHARE = 0.05
SUMMARY = "run string, path string, fresh boolean, lo int, hi int"
PAIRS = "a string, b string, score double"


@dataclass
class Sets:
    """Sets of 64-bit hashes, one after the other, sorted within a set."""

    flat: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Sets:
        sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
        return cls(np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]

    def part(self, lo: int, hi: int) -> Sets:
        return Sets(self.flat[self.at[lo] : self.at[hi]], self.at[lo : hi + 1] - self.at[lo])


def jaccard(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(shared, a + b - shared, out=np.zeros(np.broadcast(shared, a, b).shape), where=(a > 0) & (b > 0))


class Index:
    """What holds each token among some sets, to count overlaps with others."""

    def __init__(self, sets: Sets):
        self.n = len(sets.at) - 1
        order = np.argsort(sets.flat, kind="stable")
        self.rows = np.repeat(np.arange(self.n), sets.sizes)[order]
        self.tokens, self.start, self.count = np.unique(sets.flat[order], return_index=True, return_counts=True)
        often = np.flatnonzero(self.count > max(self.n * SHARE, 4))
        often = often[np.argsort(-self.count[often], kind="stable")[:DENSE]]
        self.column = np.full(len(self.tokens), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((self.n, len(often)), np.float32)
        for i, k in enumerate(often):
            self.matrix[self.rows[self.start[k] : self.start[k] + self.count[k]], i] = 1

    def overlaps(self, sets: Sets) -> np.ndarray:
        """Members that each of ``sets`` shares with each set of the index."""
        m = len(sets.at) - 1
        if not len(self.tokens):
            return np.zeros((m, self.n))
        k = np.minimum(np.searchsorted(self.tokens, sets.flat), len(self.tokens) - 1)
        known = self.tokens[k] == sets.flat
        row, k = np.repeat(np.arange(m), sets.sizes)[known], k[known]
        column = self.column[k]
        dense, rare = column >= 0, column < 0
        ones = np.zeros((m, self.matrix.shape[1]), np.float32)
        ones[row[dense], column[dense]] = 1
        out = (ones @ self.matrix.T).astype(np.float64).ravel()
        row, k = row[rare], k[rare]
        ends = np.cumsum(self.count[k])
        lo = 0
        while lo < len(k):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEETINGS)), lo + 1)
            n = self.count[k[lo:hi]]
            first = np.repeat(self.start[k[lo:hi]] - (np.cumsum(n) - n), n)
            met = self.rows[np.arange(len(first)) + first] + np.repeat(row[lo:hi] * self.n, n)
            out += np.bincount(met, minlength=len(out))
            lo = hi
        return out.reshape(m, self.n)


@dataclass
class Block:
    """Classes of equal facts of one group (or of several small ones), by profile and size within a group."""

    tokens: np.ndarray  # sorted; w holds places in it
    w: Sets
    t: Sets  # of profiles
    c: Sets
    profile: np.ndarray  # a class's place in t and c
    fresh: np.ndarray
    ids: list[list[str]]
    groups: list[tuple[int, int, int]]  # group's concept token, first class, end

    def __post_init__(self):
        self.column = ((self.tokens.view(np.uint64) >> np.uint64(11)) & np.uint64(COLUMNS[1] - 1)).astype(np.int32)  # of each token

    @classmethod
    def of(cls, groups: list[tuple[int, list[tuple]]]) -> Block:
        profiles: dict[tuple, int] = {}
        rows, bounds = [], []
        for token, classes in groups:
            bounds.append((token, len(rows), len(rows) + len(classes)))
            rows += sorted(classes, key=lambda x: (profiles.setdefault((x[1], x[2]), len(profiles)), len(x[0])))
        of = [profiles[t, c] for _, t, c, _, _ in rows]
        w = Sets.of([r[0] for r in rows])
        tokens, places = np.unique(w.flat, return_inverse=True)
        return cls(
            tokens, Sets(places.astype(np.int32), w.at), Sets.of([np.array(t, np.int64) for t, _ in profiles]),
            Sets.of([np.array(c, np.int64) for _, c in profiles]), np.array(of, np.int64), np.array([r[3] for r in rows], bool),
            [r[4] for r in rows], bounds,
        )


def cut_blocks(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (agent_id, g, n, node_id, fresh, t, c, w) sorted by group; groups of up to a block are packed together.

    Rows of equal sets follow each other and become one class.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def write(run: str, groups: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
        block, name = Block.of(groups), f"block-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(block, protocol=5))
        sizes = block.w.sizes
        row = {"run": [run], "path": [f"{folder}/{name}"], "fresh": [bool(block.fresh.any())], "lo": [int(sizes.min())], "hi": [int(sizes.max())]}
        types = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(row.values(), types, strict=True)], names=list(row))

    packed: list[tuple[int, list[tuple]]] = []
    classes: list[tuple] = []
    here, held, count, members = None, 0, 0, 0
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        plain = {n: col[n].to_pylist() for n in ("agent_id", "g", "n", "node_id", "fresh", "t", "c")}
        flat, at = np.asarray(col["w"].values), np.asarray(col["w"].offsets)
        for i in range(batch.num_rows):
            group = (plain["agent_id"][i], plain["g"][i], plain["n"][i])
            w = flat[at[i] : at[i + 1]]
            if not len(w):
                continue
            own = (tuple(plain["t"][i]), tuple(plain["c"][i]), plain["fresh"][i])
            if group == here and classes and classes[-1][1:4] == own and np.array_equal(classes[-1][0], w):
                classes[-1][4].append(plain["node_id"][i])
                continue
            full = count >= BLOCK or held + len(w) > TOKENS
            if here is not None and (group != here or (full and here[2] is not None)):
                if here[2] is None:
                    packed.append((here[1], classes))
                else:
                    yield write(f"{here[0]}\x1f{here[1]}", [(here[1], classes)])
                    held, count = held - sum(len(x[0]) for x in classes), count - len(classes)
                classes = []
                if packed and (full or count >= BLOCK):
                    yield write(uuid.uuid4().hex, packed)
                    packed, held, count = [], 0, 0
            here = group
            classes.append((w.copy(), *own, [plain["node_id"][i]]))
            held, count = held + len(w), count + 1
    if classes:
        if here[2] is None:
            packed.append((here[1], classes))
        else:
            yield write(f"{here[0]}\x1f{here[1]}", [(here[1], classes)])
    if packed:
        yield write(uuid.uuid4().hex, packed)


def _base(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of tags and of concepts between all profiles of two blocks."""
    each = lambda a, b: jaccard(Index(b).overlaps(a), a.sizes[:, None], b.sizes[None, :])
    return each(x.t, y.t), each(x.c, y.c)


class Chunk:
    """Rows ``lo`` to ``hi`` of a block, which are compared at once."""

    def __init__(self, block: Block, lo: int, hi: int):
        self.block, self.lo, self.hi = block, lo, hi
        self.sizes, self.profile, self.fresh = block.w.sizes[lo:hi], block.profile[lo:hi], block.fresh[lo:hi]
        self.least, self.most, self.mean = int(self.sizes.min()), int(self.sizes.max()), float(self.sizes.mean())
        self.known, self._roots = np.unique(self.profile), {}
        self.column = block.column[block.w.flat[block.w.at[lo] : block.w.at[hi]]]
        counts, self.loads = np.bincount(self.column, minlength=COLUMNS[1]) / (hi - lo), {}
        for k in range(COLUMNS[1].bit_length() - 1, COLUMNS[0].bit_length() - 2, -1):
            self.loads[1 << k] = (counts / np.sqrt(1 + counts)).astype(np.float32)  # about the mean of the roots
            counts = counts[: len(counts) // 2] + counts[len(counts) // 2 :]

    def roots(self, columns: int) -> np.ndarray:
        """Square roots of how many tokens of a row fall in each column."""
        if columns not in self._roots:
            cell = np.repeat(np.arange(self.hi - self.lo, dtype=np.int32) * np.int32(columns), self.sizes) + (self.column & np.int32(columns - 1))
            counts = np.bincount(cell, minlength=(self.hi - self.lo) * columns).astype(np.float32)
            self._roots[columns] = np.sqrt(counts, out=counts).reshape(-1, columns)
        return self._roots[columns]


def chunks(x: Block, lo: int, hi: int) -> list[Chunk]:
    """Rows ``lo`` to ``hi`` in chunks of one profile each; of profiles with few rows several together."""
    ends = [lo + 1 + int(k) for k in np.flatnonzero(np.diff(x.profile[lo:hi]))] + [hi]
    cuts, at, sizes = [lo], lo, x.w.sizes[lo:hi]
    for end in ends:
        if end - at >= ALONE:
            cuts.append(at)
            while at < end:  # rows are sorted by size: none of a chunk is half as long again as its first, if it holds enough
                like = int(np.searchsorted(sizes[at - lo : end - lo], sizes[at - lo] * 1.5, side="right"))
                at = min(at + min(max(like, ALONE), ROWS), end)
                cuts.append(at)
        elif end - cuts[-1] >= ROWS:
            cuts.append(end)
        at = end
    cuts = sorted({*cuts, hi})
    return [Chunk(x, m, n) for m, n in zip(cuts, cuts[1:], strict=False)]


def _columns(a: Chunk, b: Chunk, share: float) -> int:
    """Columns for which the product and the exact counts it leaves should take the least time together, by the mean of the bound."""
    needed, best = share * (a.mean + b.mean), (float("inf"), 0)
    columns, shared = COLUMNS[0], float(a.loads[COLUMNS[1]] @ b.loads[COLUMNS[1]])
    while columns <= COLUMNS[1] and columns * MULTIPLY < best[0]:
        met = float(a.loads[columns] @ b.loads[columns])
        spread = (met + (UNLIKE[0] * shared) ** 2 + (UNLIKE[1] * met) ** 2 + 1e-9) ** 0.5
        left = math.erfc((needed - met) / spread / 2**0.5) / 2
        best = min(best, (columns * MULTIPLY + left * b.mean * COUNT, columns))
        columns *= 2
    return best[1]


def exact_overlaps(x: Block, i: np.ndarray, y: Block, j: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Tokens that class ``i`` of ``x`` shares with class ``j`` of ``y``, for each pair; ``i`` ascends, ``places`` are x's tokens in ``y``."""
    out, width = np.zeros(len(i), np.int64), len(y.tokens) + 1  # the last place: not in y
    sizes, first = y.w.sizes[j], y.w.at[j]
    ends, tall, lo = np.cumsum(sizes), max(MARKS // width, 1), 0
    while lo < len(i):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEETINGS)), lo + 1)
        hi = min(hi, lo + int(np.searchsorted(np.cumsum(np.diff(i[lo:hi], prepend=i[lo]) > 0), tall)))
        rows, row = np.unique(i[lo:hi], return_inverse=True)
        mark = np.zeros((len(rows), width), np.uint8)
        for k, r in enumerate(rows):
            mark[k, places[x.w[r]]] = 1
        mark[:, -1] = 0
        n = sizes[lo:hi]
        cell = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n)
        cell += np.arange(len(cell))
        cell = np.repeat((row * width).astype(np.int32), n) + y.w.flat[cell]
        hits = np.flatnonzero(mark.ravel()[cell])
        out[lo:hi] = np.bincount(np.searchsorted(np.cumsum(n), hits, side="right"), minlength=hi - lo)
        lo = hi
    return out


def _places(x: Block, y: Block) -> np.ndarray:
    k = np.minimum(np.searchsorted(y.tokens, x.tokens), len(y.tokens) - 1)
    return np.where(y.tokens[k] == x.tokens, k, len(y.tokens))


def similar_classes(x: Block, y: Block, left: list[Chunk], right: list[Chunk], base: tuple, places: np.ndarray, threshold: float, weights: tuple) -> Iterator[tuple[int, int, float]]:
    """``(i, j, score)`` of classes i of ``x`` and j of ``y`` in the given chunks; of one list with itself each pair once."""
    wt, tt, ct = weights
    for a in left:
        for b in right:
            if left is right and b.lo < a.lo or not (a.fresh.any() or b.fresh.any()):
                continue
            best = np.ix_(a.known, b.known)
            need = (threshold - (tt * base[0][best] + ct * base[1][best]).max()) / wt - 1e-9
            if need > 1 or a.most < b.least * need or b.most < a.least * need:
                continue
            # a shared token is in one column on both sides, and min(m, n) <= sqrt(m * n); single precision is off by less than a thousandth
            share = need / (1 + need)
            columns, enough = _columns(a, b, share), np.float32(share * 0.999)
            bound = a.roots(columns) @ b.roots(columns).T
            i, j = np.nonzero(bound >= (enough * a.sizes.astype(np.float32) - np.float32(1e-3))[:, None] + (enough * b.sizes.astype(np.float32))[None, :])
            m, n = a.sizes[i], b.sizes[j]
            fine = (np.minimum(m, n) >= np.maximum(m, n) * need) & (a.fresh[i] | b.fresh[j])
            if a is b:
                fine &= i < j
            i, j, m, n = i[fine], j[fine], m[fine], n[fine]
            if not len(i):
                continue
            shared, p, q = exact_overlaps(x, i + a.lo, y, j + b.lo, places), a.profile[i], b.profile[j]
            score = jaccard(shared, m, n) * wt + base[0][p, q] * tt + base[1][p, q] * ct
            keep = score >= threshold - 1e-12
            yield from zip((i[keep] + a.lo).tolist(), (j[keep] + b.lo).tolist(), score[keep].tolist(), strict=True)


def compare(threshold: float, weights: tuple[float, float, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar pairs of facts in pairs of blocks (l, r); a block with itself where both are the same."""

    def load(path: str) -> Block:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as source:
            return pickle.loads(source.read())

    def once(x: Block, i: int, y: Block, j: int, token: int) -> bool:
        """Facts that share several concept words are compared under the least of them."""
        a, b = x.c[x.profile[i]], y.c[y.profile[j]]
        return len(a) == 1 or len(b) == 1 or int(np.intersect1d(a, b)[0]) == token

    def pairs(x: Block, y: Block) -> Iterator[tuple[str, str, float]]:
        base, places = _base(x, y), _places(x, y)
        for g, (token, lo, hi) in enumerate(x.groups):
            mine = at_once(x, g)
            for i, j, score in similar_classes(x, y, mine, mine if x is y else at_once(y, g), base, places, threshold, weights):
                if once(x, i, y, j, token):
                    for m in x.ids[i]:
                        for n in y.ids[j]:
                            yield (m, n, score) if m < n else (n, m, score)
            if x is y:  # equal facts
                for i in range(lo, hi):
                    profile = x.profile[i]
                    score = weights[0] + weights[1] * bool(x.t.sizes[profile]) + weights[2]
                    if len(x.ids[i]) > 1 and x.fresh[i] and score >= threshold - 1e-12 and once(x, i, x, i, token):
                        ids = sorted(x.ids[i])
                        for k, m in enumerate(ids):
                            for n in ids[k + 1 :]:
                                yield m, n, score

    cut: dict[int, list[Chunk]] = {}  # of the left block: its matrices serve all right ones

    def at_once(x: Block, g: int) -> list[Chunk]:
        if x is not left:
            return chunks(x, *x.groups[g][1:])
        if g not in cut:
            cut[g] = chunks(x, *x.groups[g][1:])
        return cut[g]

    def shaped(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
        a, b, score = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score, pa.float64())], names=["a", "b", "score"])

    at, left = None, None
    for batch in batches:
        for l_path, r_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if l_path != at:
                at, left = l_path, load(l_path)
                cut.clear()
            rows = []
            for row in pairs(left, left if l_path == r_path else load(r_path)):
                rows.append(row)
                if len(rows) >= 50_000:
                    yield shaped(rows)
                    rows = []
            if rows:
                yield shaped(rows)

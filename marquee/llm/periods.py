"""Periodic run detection: all maximal repetitions of whole words in a text, by internal pattern matching.

Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of consecutive words with smallest period q and at least
max(`min_length`, 2q) words that neither neighbour extends. A text is collapsed by dropping every word that
some run contains after its first q words.

1. Names. Prefix doubling names every block of 2^k words of a text, for all k with a repeated block; only
   positions whose name is still shared are sorted again. The last names order the suffix array. Names also
   give, exactly, how far two positions agree to the right and to the left: one comparison per level.
2. Dyadic blocks. A run of period q holds, one period before its end, a block of 2^k words that starts at a
   multiple of 2^k, with 2^k about q/4 to q/2; the block occurs again q words on. So each block asks for its
   occurrences in the window of 2^(k+2) words behind it: a range successor query on the stretch of the suffix
   array that holds its occurrences, answered by a wavelet tree over the positions. Blocks without another
   occurrence in their text ask nothing.
3. Candidate periods. The distance to an occurrence is a candidate. Occurrences that overlap by half lie on a
   progression whose step d is the block's period; they fill a stretch of period d, and the query goes on
   behind it, so a block meets a bounded number of stretches however often it occurs. For two stretches
   [s1, e1) and [s2, e2) of the same d the run's period aligns their starts or their ends; where they touch
   or overlap it may also be any distance in the progression up to those two, or the next beyond either.
4. Every candidate is extended to both sides and kept if it is long enough; of candidates with the same
   stretch the smallest period counts.

A task handles slices of about 2 MB of whole texts; a text of n words needs about 4 n log2(n) bytes.

Edge cases: a null or empty text has no words, no runs and an empty collapsed text; texts of any length are
handled whole; repeated rows give equal results; null and repeated ids are allowed (no step uses the id); an
empty table gives no rows; other input columns are not kept, so clashing names do not matter.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, raw_texts, slices, words_column

MIN_LENGTH = 12


class Names:
    """Names of the blocks of 2^k items, k = 0, 1, ...: equal blocks of one text have equal names, blocks cut
    off by the end of their text have a name of their own. A name is the rank of the first such suffix."""

    def __init__(self, items: np.ndarray, text: np.ndarray):
        n = items.size
        at = np.lexsort((items, text))
        new = np.concatenate(([True], (np.diff(items[at]) != 0) | (np.diff(text[at]) != 0)))
        first = np.flatnonzero(new)
        names = np.full(n + 1, -1, np.int64)
        names[at] = np.repeat(first, np.diff(np.append(first, n)))
        self.levels: list[np.ndarray] = []       # names by level, -1 past the end
        self.shared: list[np.ndarray] = []       # positions whose name is shared, by level
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []  # (shared name, rank behind its last suffix)
        size = 1
        shared = self._keep(names, at)
        while shared.size:
            far = shared + size
            far_name = np.where((far < n) & (text[np.minimum(far, n - 1)] == text[shared]),
                                names[np.minimum(far, n)], -1)
            order = np.lexsort((far_name, names[shared]))
            at, near_name, far_name = shared[order], names[shared][order], far_name[order]
            old = np.concatenate(([True], np.diff(near_name) != 0))
            new = old | np.concatenate(([True], np.diff(far_name) != 0))
            index = np.arange(at.size)
            rank = near_name + index - np.maximum.accumulate(np.where(old, index, 0))
            names = names.copy()
            names[at] = rank[np.maximum.accumulate(np.where(new, index, 0))]
            size *= 2
            shared = self._keep(names, at)
        self.rank = names[:n]                    # all different: the suffix array's inverse

    def _keep(self, names: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Record a level; `at`: positions that may share a name, in order of name. Returns those that do."""
        name = names[at]
        first = np.flatnonzero(np.concatenate(([True], np.diff(name) != 0)))
        sizes = np.diff(np.append(first, at.size))
        more = sizes > 1
        shared = at[np.repeat(more, sizes)]
        if shared.size:
            self.levels.append(names.astype(np.int32))
            self.shared.append(shared)
            self.ends.append((name[first[more]], name[first[more]] + sizes[more]))
        return shared

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree from i and j on to the right, i != j in one text."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in reversed(range(len(self.levels))):
            names = self.levels[k]
            step = (names[i] == names[j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items agree before i and j."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in reversed(range(len(self.levels))):
            names = self.levels[k]
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (b >= 0) & (names[a] == names[b])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


class RangeSuccessor:
    """Wavelet tree (as a matrix of packed bits with counts) over different values 0..n-1."""

    def __init__(self, values: np.ndarray):
        n = values.size
        self.levels = []
        values = values.astype(np.int64)
        for bit in reversed(range(max(1, int(n - 1).bit_length()))):
            ones = (values >> bit) & 1
            packed = np.packbits(np.append(ones.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8)),
                                 bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32)
            self.levels.append((bit, packed, counts, int(n - ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        _, packed, counts, _ = level
        word = i >> 6
        inside = packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return counts[word] + np.bitwise_count(inside).astype(np.int64)

    def _descend(self, lo, hi, pick):
        """Walk [lo, hi) down; `pick(bit, zeros)` says which queries go to the ones."""
        for level in self.levels:
            a, b = self._ones(level, lo), self._ones(level, hi)
            up = pick(level[0], (hi - lo) - (b - a))
            lo, hi = np.where(up, level[3] + a, lo - a), np.where(up, level[3] + b, hi - b)

    def after(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Smallest value > x in each [lo, hi), -1 if there is none."""
        below = np.zeros(lo.size, np.int64)

        def along(bit, zeros):
            up = (x >> bit) & 1 == 1
            below[up] += zeros[up]
            return up

        self._descend(lo, hi, along)
        k = below + 1                            # x itself is one of the values
        out = np.zeros(lo.size, np.int64)

        def kth(bit, zeros):
            up = k >= zeros
            k[up] -= zeros[up]
            out[up] += 1 << bit
            return up

        some = k < hi - lo
        k = np.where(some, k, 0)
        self._descend(lo, hi, kth)
        return np.where(some, out, -1)


def _blocks(names: Names):
    """(start, level, first rank, last rank + 1) of the dyadic blocks of two items or more that occur again."""
    out = []
    for k in range(1, len(names.levels)):
        at = names.shared[k]
        at = at[at & ((1 << k) - 1) == 0]
        name = names.levels[k][at].astype(np.int64)
        known, ends = names.ends[k]
        out.append((at, np.full(at.size, k), name, ends[np.searchsorted(known, name)]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _class_members(first: np.ndarray, step: np.ndarray, last: np.ndarray):
    """(row, value) of first, first + step, ... up to last."""
    many = np.maximum((last - first) // step + 1, 0)
    row = np.repeat(np.arange(many.size), many)
    nth = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)
    return row, first[row] + nth * step[row]


def _stretch(names: Names, at: np.ndarray, d: np.ndarray):
    """Start and end of the stretch of period d around the block at `at`."""
    return at - names.backward(at, at + d), at + d + names.forward(at, at + d)


def candidates(names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, level, distance): for every run, one of its blocks with the run's period among the distances."""
    begin, level, lo, hi = _blocks(names)
    if not begin.size:
        return begin, level, begin
    found = []
    used = np.sort(names.shared[1])
    order = used[np.argsort(names.rank[used])]
    ranks = names.rank[order]
    tree = RangeSuccessor(np.searchsorted(used, order))
    lo, hi = np.searchsorted(ranks, lo), np.searchsorted(ranks, hi)
    x = begin
    while begin.size:
        place = tree.after(lo, hi, np.searchsorted(used, x))
        y = used[place]
        live = (place >= 0) & (y <= begin + (4 << level) - 2)
        begin, level, lo, hi, x, y = (v[live] for v in (begin, level, lo, hi, x, y))
        if not begin.size:
            break
        found.append((begin, level, y - begin))
        near = 2 * (y - x) <= 1 << level         # the two lie on a progression
        b, k, p = begin[near], level[near], x[near]
        d = y[near] - p
        s2, e2 = _stretch(names, p, d)
        far = p != b
        if far.any():
            found += _between(names, b[far], k[far], p[far], d[far], s2[far], e2[far])
        x = y.copy()
        x[near] = p + (e2 - (1 << k) - p) // d * d   # the last occurrence of the progression
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(v) for v in zip(*found))


def _between(names: Names, b, k, p, d, s2, e2):
    """Candidates between the stretch of the block b and the stretch [s2, e2) of its occurrence p."""
    s1, e1 = _stretch(names, b, d)
    starts, ends = s2 - s1, e2 - e1
    out = [(b, k, starts), (b, k, ends)]
    meet = e1 >= s2
    if meet.any():
        b, k, d, gap = b[meet], k[meet], d[meet], (p - b)[meet]
        low, high = np.minimum(starts, ends)[meet], np.maximum(starts, ends)[meet]
        for bound in (low, high):                # the next of the progression beyond either
            out.append((b, k, bound + 1 + (gap - bound - 1) % d))
        least = (1 << k) - d                     # the run's first part holds the block
        row, q = _class_members(least + (gap - least) % d, d, low)
        out.append((b[row], k[row], q))
    return out


def find_runs(items: np.ndarray, text: np.ndarray, min_length: int = MIN_LENGTH):
    """(start, end, period) of all runs, by start and period. `items`: numbers of the words of several texts
    one after the other, `text`: number of the text of each word, not falling."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if items.size < 2:
        return none
    names = Names(items, text)
    b, k, q = candidates(names)
    if not b.size:
        return none
    # the word at b and the word q on must be in the text and the block must be the same in both places
    ok = (q > 0) & (b + q < items.size)
    b, k, q = b[ok], k[ok], q[ok]
    agree = names.forward(b, b + q)
    ok = agree >= 1 << k
    b, q, agree = b[ok], q[ok], agree[ok]
    start, end = b - names.backward(b, b + q), b + q + agree
    ok = end - start >= np.maximum(min_length, 2 * q)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.concatenate(([True], (np.diff(start) != 0) | (np.diff(end) != 0)))[:start.size]
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _slice_runs(texts: pa.Array, min_length: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    lists = [t.split() for t in raw_texts(texts)]
    sizes = np.array([len(t) for t in lists], np.int64)
    words = [w for t in lists for w in t]
    items = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(sizes.size), sizes)
    begins = np.cumsum(sizes) - sizes
    start, end, q = find_runs(items, text, min_length)
    owner = text[start]
    change = np.zeros(items.size + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    keep = np.cumsum(change[:-1]) == 0
    shrunk = np.zeros(sizes.size, bool)
    shrunk[owner] = True
    collapsed = []
    for t, cut, at in zip(lists, shrunk.tolist(), begins.tolist()):
        collapsed.append(b" ".join(compress(t, keep[at:at + len(t)].tolist()) if cut else t))
    many = np.bincount(owner, minlength=sizes.size)
    offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(end - start), pa.array(q)],
                                      fields=list(RUN))
    return (pa.ListArray.from_arrays(pa.array(offsets), rows),
            pa.array(collapsed, pa.binary()).cast(pa.string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, runs, collapsed_text) per row of `docs`; runs: array of (start, length, period) by start, then
    period."""

    def detect(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *_slice_runs(part.column("body"), min_length)], ["id", "runs", "collapsed_text"])

    lines = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = lines.schema["id"].dataType.simpleString()
    found = lines.mapInArrow(detect, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, "
                                     f"collapsed_text string")
    return found.withColumnRenamed("id", id_col)


def longest_run(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("below"))))
    return F.when(best.isNotNull(), F.struct((-best["before"]).alias("start"), best["length"].alias("length"),
                                             (-best["below"]).alias("period")))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a periodic tail in every tenth text (by the CRC-32 of the id as decimal text): from word
    a on, the words a..a+p-1 follow each other again and again. A null id plants nothing."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")), lambda v: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), v["n"] - 1), lambda i: F.get(
                v["w"], F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"])).cast("int"))), " "))

    words = words_column(F.col(text_col))
    planted = F.when((F.pmod(h, F.lit(10)) == 0) & (F.size(words) > 0), let(words, tail))
    return docs.withColumn(text_col, F.coalesce(planted, F.col(text_col)))

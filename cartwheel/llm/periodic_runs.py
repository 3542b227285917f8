"""Operator 11: periodic runs of words by difference-cover LCE queries.

A run is a stretch of words with smallest period q whose words q apart are
identical, that no neighbouring word extends, of at least ``max(min_length,
2 * q)`` words. All runs of a text are found as follows:

1. Harmonic grid. For every period p the places 0, p, 2p, ... of a text are
   paired with their successors. A run of period p holds such a pair whose two
   words are equal, so n ln n pairs meet every run, and one comparison of words
   drops most of them.
2. Longest common extensions. How far the rest agree ahead of and behind the
   pair gives the stretch. ``DifferenceCoverLCE`` answers both: only suffixes
   at places of a difference cover modulo v are sorted (by their first v words,
   then by doubling); of two places at most v words are compared until both
   reach the cover, and the rest is a range minimum over the common prefixes
   of neighbours in sorted order, read from a sparse table.
3. Stretches with one begin and end are one run, whose period is the smallest.

Texts are independent rows of an Arrow map; numpy handles many short texts at
once, and only texts with a pair that survives its first v words are sorted. A
text is one row and one task's work; the arrays take about 150 bytes a word.

Defined results: a null or blank text has no words and no runs, its collapsed
text is ''; repeated rows and equal ids are judged alike; an empty table gives
an empty result; other columns pass by unread, whatever their names, unless
named ``runs`` or ``collapsed``, which raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cartwheel.llm.bytehash import text_buffers, text_groups

MIN_LENGTH = 12
#: Perfect difference set: every difference modulo V is met by one pair.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Grid pairs handled at once.
PAIRS = 1 << 18

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def cover_shifts() -> np.ndarray:
    """x[d]: the element of COVER for which x + d modulo V is in COVER too."""
    x = np.zeros(V, np.int64)
    for a in COVER:
        for b in COVER:
            x[(b - a) % V] = a
    return x


SHIFTS = cover_shifts()


class DifferenceCoverLCE:
    """Common extensions ahead of two places of one text.

    ``words``: ids of the words of all texts, one after another; ``ends``: for
    every place the end of its text. An extension never leaves its text.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.words, self.ends = words, ends
        self.table: list[np.ndarray] | None = None

    def sort_cover(self) -> None:
        """Sorts the suffixes at cover places and prepares range minima."""
        n = len(self.words)
        sampled = np.isin(np.arange(n) % V, COVER)
        self.places = np.flatnonzero(sampled)
        self.index = np.cumsum(sampled) - 1
        m = len(self.places)
        end = self.ends[self.places]
        head = np.zeros((m, V + 1), ">u4")  # the text, then the first V words, 0 behind its end
        head[:, 0] = np.unique(end, return_inverse=True)[1] + 1
        for k in range(V):
            at = self.places + k
            inside = at < end
            head[inside, k + 1] = self.words[at[inside]] + 1
        rank = np.unique(head.view(f"S{4 * (V + 1)}").ravel(), return_inverse=True)[1].astype(np.int64)
        levels, step = [rank], V
        while rank.max(initial=0) + 1 < m:
            ahead = np.zeros(m, np.int64)
            inside = self.places + step < end
            ahead[inside] = rank[self.index[self.places[inside] + step]] + 1
            rank = np.unique(rank * (m + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        a, b = self.places[order[:-1]].copy(), self.places[order[1:]].copy()
        ea, eb = end[order[:-1]], end[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            live = np.flatnonzero((a < ea) & (b < eb))
            same = live[levels[k][self.index[a[live]]] == levels[k][self.index[b[live]]]]
            same = same[(a[same] + (V << k) <= ea[same]) & (b[same] + (V << k) <= eb[same])]
            common[same] += V << k
            a[same] += V << k
            b[same] += V << k
        live = np.flatnonzero(ea == eb)
        for _ in range(V):
            live = live[(a[live] < ea[live]) & (b[live] < eb[live])]
            live = live[self.words[a[live]] == self.words[b[live]]]
            common[live] += 1
            a[live] += 1
            b[live] += 1
        common[ea != eb] = 0
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def walk(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words compared one by one up to the cover: the number of equal ones
        and whether both reached it with no difference (i < j in one text)."""
        goal = (SHIFTS[(j - i) % V] - i) % V
        last = np.minimum(goal, self.ends[j] - j)
        found = np.zeros(len(i), np.int64)
        live = np.flatnonzero(last > 0)
        k = 0
        while len(live):
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            k += 1
            found[live] = k
            live = live[last[live] > k]
        return found, (found == goal) & (j + goal < self.ends[j])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on; i < j, or j at the text's end."""
        found, on = self.walk(i, j)
        on = np.flatnonzero(on)
        if len(on):
            if self.table is None:
                self.sort_cover()
            a = self.rank[self.index[i[on] + found[on]]]
            b = self.rank[self.index[j[on] + found[on]]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            more = np.empty(len(on), np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                more[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
            found[on] += more
        return found


def grid_pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of grid pairs of equal words. Texts are ordered from the
    longest on, so the texts that have room for 2 * p words come first."""
    longest = int(sizes[0]) if len(sizes) else 0
    if longest < 2:
        return
    reach = np.arange(1, longest // 2 + 1)
    # places up to the end of the last text with at least 2 * p words
    fitting = len(sizes) - np.searchsorted(sizes[::-1], 2 * reach)
    stop = starts[fitting - 1] + sizes[fitting - 1]
    count = np.maximum((stop - 1) // reach, 0)
    total = np.concatenate(([0], np.cumsum(count)))
    p = 0
    while p < len(reach):
        q = max(p + 1, int(np.searchsorted(total, total[p] + PAIRS, side="right")) - 1)
        for lo in range(0, int(total[q] - total[p]), PAIRS):  # one small period alone may be more
            hi = min(lo + PAIRS, int(total[q] - total[p]))
            flat = np.arange(total[p] + lo, total[p] + hi)
            which = np.searchsorted(total, flat, side="right") - 1 if hi - lo < total[q] - total[p] else np.repeat(np.arange(p, q), count[p:q])
            period = reach[which]
            place = (flat - total[which]) * period
            equal = words[place] == words[place + period]
            yield place[equal], period[equal]
        p = q


def lce_both_ways(line: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[DifferenceCoverLCE, DifferenceCoverLCE]:
    """LCE of texts laid one after another, and of their mirror images."""
    return (DifferenceCoverLCE(line, np.repeat(start + size, size)),
            DifferenceCoverLCE(line[::-1].copy(), len(line) - np.repeat(start, size)[::-1]))


def all_runs(words: np.ndarray, sizes: np.ndarray, min_length: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts laid one after another
    in ``words`` (ids), ordered by text, start and period."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(min_length, 2)]
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    size = sizes[order].astype(np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    line = words[np.repeat(begin[order] - start, size) + np.arange(int(size.sum()))].astype(np.int64) if len(order) else np.empty(0, np.int64)
    n = len(line)
    text = np.repeat(np.arange(len(order)), size)
    ends = np.repeat(start + size, size)
    ahead, behind = lce_both_ways(line, start, size)
    kept: list[tuple] = []
    open_pairs: list[tuple] = []
    for i, p in grid_pairs(line, start, size):
        inside = i + p < ends[i]
        i, p = i[inside], p[inside]
        f, on = ahead.walk(i, i + p)
        b = np.zeros(len(i), np.int64)
        back = np.flatnonzero(i > start[text[i]])
        b[back], more = behind.walk(n - (i[back] + p[back]), n - i[back])
        on[back[more]] = True
        open_pairs.append((i[on], p[on]))
        good = ~on & (f + b >= p) & (f + b + p >= min_length)
        kept.append((i[good] - b[good], i[good] + p[good] + f[good], p[good]))
    if open_pairs:  # sort the texts that still have pairs, no others
        i, p = (np.concatenate(x) for x in zip(*open_pairs))
        some = np.unique(text[i])
        shift = np.zeros(len(order), np.int64)
        shift[some] = start[some] - np.concatenate(([0], np.cumsum(size[some])))[:-1]
        part = line[np.isin(text, some)]
        m, begin_of = len(part), start[some] - shift[some]
        ahead, behind = lce_both_ways(part, begin_of, size[some])
        for lo in range(0, len(i), PAIRS):
            x, q = i[lo:lo + PAIRS], p[lo:lo + PAIRS]
            moved = shift[text[x]]
            f = ahead(x - moved, x - moved + q)
            b = np.zeros(len(x), np.int64)
            back = np.flatnonzero(x > start[text[x]])
            y = x[back] - moved[back]
            b[back] = behind(m - (y + q[back]), m - y)
            good = (f + b >= q) & (f + b + q >= min_length)
            kept.append((x[good] - b[good], x[good] + q[good] + f[good], q[good]))
    if not kept:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    s, e, p = (np.concatenate(x) for x in zip(*kept))
    by = np.lexsort((p, e, s))
    s, e, p = s[by], e[by], p[by]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[first], e[first], p[first]
    t = text[s] if n else s
    row, at = order[t], s - start[t]
    by = np.lexsort((p, at, row))
    return row[by], at[by], (e - s)[by], p[by]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds behind its first period."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def batch_runs(column: pa.Array, min_length: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed) of the texts of a column."""
    data, offsets = text_buffers(column)
    sizes, flat, texts = [], [], []
    for i, j in text_groups(offsets):
        raw = data[offsets[i]:offsets[j]].tobytes()
        split = [raw[a:b].split() for a, b in zip((offsets[i:j] - offsets[i]).tolist(), (offsets[i + 1:j + 1] - offsets[i]).tolist())]
        size = np.array([len(s) for s in split], np.int64)
        ids = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode().indices.to_numpy()
        row, start, length, period = all_runs(ids, size, min_length)
        bounds = np.searchsorted(row, np.arange(len(split) + 1))
        for k, s in enumerate(split):
            part = slice(bounds[k], bounds[k + 1])
            texts.append(collapse(s, start[part], length[part], period[part]))
        sizes.append(np.diff(bounds))
        flat.append(np.stack([start, length, period]))
    sizes_all = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    values = np.concatenate(flat, axis=1) if flat else np.empty((3, 0), np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(sizes_all))).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(RUN_ARROW)))
    return lists, pa.array(texts, pa.binary()).cast(pa.string())


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents' columns, ``runs`` (start, length and period in words, by
    start and period) and ``collapsed`` (the text without the words that a run
    holds behind its first period, words joined by a space)."""
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    clash = {c.lower() for c in docs.columns} & {"runs", "collapsed"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be given twice")
    columns = docs.columns
    at = [c.lower() for c in columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = batch_runs(batch.column(at), min_length)
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, collapsed], names=[*columns, "runs", "collapsed"])

    schema = StructType([*docs.schema.fields, StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return docs.mapInArrow(run, schema)

"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a maximal stretch of words that keeps its smallest period q over at
least 2q words.  The automaton of a text has one state per set of end places;
its suffix links form a tree, and the path from the root to the state of the
first i + 1 words holds every suffix that ends at word i.  Appending word i
*accesses* that path in a link-cut forest: the path is recoloured with i, and
the segments it is cut from still carry the end at which their suffixes
occurred last.  A segment whose deepest state on the path has length L and
whose colour is e says that the L words that end at e and at i are equal and
that the L + 1 words are not.  With d = i - e <= L this is a square of period
d, and d is primitive (a shorter period would have left a later colour).  The
run of each period meets d = L exactly once, when its first square is
complete, so its start is i - 2d + 1; its end follows by comparing words d
apart.

Only places that can lie in a run of ``min_length`` words go through the
automaton.  With k = min_length // 2, each word of such a run lies in a k-gram
that occurs again, whole, q words away in the run (k-grams that begin before
length - q - k + 1 repeat to the right, those that begin at q or later repeat
to the left, and together they cover the run).  Words outside such repeats
therefore cut a text into regions that hold every run whole.  Equal hashes of
unequal k-grams only widen a region; the automaton decides on the words.

A text is one unit of work: its words must fit in a task's memory (about 200
bytes a word inside regions).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .grams import mix

MIN_LENGTH = 12
TRIMS = 8  # at most so many passes that shrink the regions; fewer passes only leave them wider
FLUSH_BYTES = 16 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def repeated_regions(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """[low, high) stretches of ``ids`` covered by k-grams that occur twice inside the same stretch."""
    count = len(ids) - k + 1
    if count < 2:
        return []
    mixed = mix(ids.astype(np.uint64) + np.uint64(1))
    hashes = np.zeros(count, np.uint64)
    for j in range(k):
        hashes = hashes * _STEP + mixed[j:j + count]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = ranked[1:] == ranked[:-1]
    first, second = order[:-1][again], order[1:][again]  # neighbouring places of equal k-grams
    regions: list[tuple[int, int]] = []
    for _ in range(TRIMS):
        if not len(first):
            return []
        edge = np.zeros(len(ids) + 1, np.int64)
        for places in (first, second):
            np.add.at(edge, places, 1)
            np.add.at(edge, places + k, -1)
        covered = np.cumsum(edge[:-1]) > 0
        change = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).view(np.int8)))
        regions = list(zip(change[::2].tolist(), change[1::2].tolist()))
        region = np.searchsorted(change[::2], np.arange(len(ids)), "right")
        inside = region[first] == region[second]
        if inside.all():
            break
        first, second = first[inside], second[inside]
    return regions


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(length and suffix link of each state, state of each prefix) for words numbered from 0.

    The first transition of a state lies in two lists and only further ones in
    a dictionary of its own, since nearly all states have a single one.
    """
    length, link, word, to = [0], [-1], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    prefix = []
    last = 0
    for w in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(0)
        p, q = last, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, state
            else:
                extra = more.get(p)
                if extra is None:
                    more[p] = {w: state}
                elif w in extra:
                    q = extra[w]
                    break
                else:
                    extra[w] = state
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[state] = clone
                while p >= 0:
                    if word[p] == w:
                        if to[p] != q:
                            break
                        to[p] = clone
                    else:
                        extra = more.get(p)
                        if extra is None or extra.get(w) != q:
                            break
                        extra[w] = clone
                    p = link[p]
        last = state
        prefix.append(state)
    return length, link, prefix


class LastOccurrences:
    """Link-cut forest over the suffix links; each preferred path carries the end that accessed it last.

    Nodes are states + 1 and 0 is none.  ``left`` is towards the root of the
    tree; the colour of a path lies at the root of its splay tree.
    """

    def __init__(self, link: list[int]):
        self.up = [0] + [p + 1 for p in link]
        self.left = [0] * len(self.up)
        self.right = [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:  # p was the root of its splay tree
            self.colour[x] = self.colour[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``state``; (deepest state, former colour) of its segments."""
        right, up, colour = self.right, self.up, self.colour
        segments = []
        node, below = state + 1, 0
        while node:
            self._splay(node)
            former = colour[node]
            if former >= 0:
                segments.append((node - 1, former))
            if right[node]:
                colour[right[node]] = former
            right[node] = below
            node, below = up[node], node
        colour[below] = end
        return segments


def _run_end(ids: np.ndarray, at: int, period: int) -> int:
    """First place from ``at`` on whose word differs from the one ``period`` before."""
    step = 64
    while at < len(ids):
        high = min(len(ids), at + step)
        differs = ids[at:high] != ids[at - period:high - period]
        if differs.any():
            return at + int(differs.argmax())
        at, step = high, 2 * step
    return at


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` words, by start, then period."""
    found = []
    for low, high in repeated_regions(ids, max(1, min_length // 2)):
        if high - low < min_length:
            continue
        part = ids[low:high]
        length, link, prefix = suffix_automaton(part.tolist())
        last = LastOccurrences(link)
        for end, state in enumerate(prefix):
            for deepest, former in last.access(state, end):
                period = end - former
                if period == length[deepest]:  # the first square of a run is complete
                    start = end - 2 * period + 1
                    size = _run_end(part, end + 1, period) - start
                    if size >= min_length:
                        found.append((low + start, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: each run keeps its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words), collapsed text per row.

    Words are separated by ASCII white space and compared byte by byte.  A word
    that some run repeats (beyond the run's first period) leaves the collapsed
    text, whose words are joined by one blank.  A null or empty text has no
    words, no runs and an empty collapsed text.  Null and repeated ids are kept
    row by row; an empty table gives an empty result; other columns are not read.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batch_of(ids: list, counts: list, runs: list, texts: list) -> pa.RecordBatch:
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(run_type)),
             pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = runs_of(ids, min_length)
                kept = b" ".join(collapse(words, runs))
                for column, value in zip(out, (doc_id, len(words), runs, kept)):
                    column.append(value)
                size += len(kept)
                if size >= FLUSH_BYTES:
                    yield batch_of(*out)
                    out, size = ([], [], [], []), 0
            if out[0]:
                yield batch_of(*out)

    found = id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from chainlake.llm import periodic_runs as p
from chainlake.llm import queries


def brute(words, min_length=12):
    """(start, length, period) by comparing all words q apart, for every q."""
    w = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.empty(0)
    found, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        equal = np.concatenate(([False], w[q:] == w[:-q], [False])).astype(np.int8)
        change = np.flatnonzero(np.diff(equal))
        for low, high in zip(change[::2].tolist(), change[1::2].tolist()):
            run = (low, high - low + q)
            if run[1] >= max(min_length, 2 * q) and run not in seen:  # a smaller period of the same stretch came first
                seen.add(run)
                found.append((*run, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("min_length", [2, 5, 12])
def test_random_words_equal_brute_force(min_length):
    draw = random.Random(min_length)
    for _ in range(400):
        n, kinds = draw.randint(0, 70), draw.choice([1, 2, 3, 6])
        words = [draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randint(0, 3)):  # plant repetitions
            if n:
                at, q = draw.randrange(n), draw.randint(1, 12)
                words[at:at + 3 * q] = (words[at:at + q] * 3)[:len(words[at:at + 3 * q])]
        assert p.runs_of(np.array(words, np.int64), min_length) == brute(words, min_length)


def test_regions_hold_whole_runs_whatever_the_filter(monkeypatch):
    """Hashes that collide for all k-grams, or no trimming, widen the regions and change no run."""
    draw = random.Random(5)
    words = np.array([draw.randrange(4) for _ in range(300)] + [1, 2, 3, 4, 5, 6, 7] * 4, np.int64)
    want = brute(words.tolist())
    assert p.runs_of(words) == want and want
    monkeypatch.setattr(p, "mix", lambda x: x * np.uint64(0))
    assert p.repeated_regions(words, 6) == [(0, len(words))] and p.runs_of(words) == want


def test_fibonacci_word_and_single_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert p.runs_of(np.array(b)) == brute(b)
    assert p.runs_of(np.zeros(500, np.int64)) == [(0, 500, 1)]
    assert p.runs_of(np.zeros(11, np.int64)) == []


def test_long_text_is_near_linear():
    """120,000 words with one long and many short periods: seconds, where comparing all pairs takes minutes."""
    draw = random.Random(3)
    base = [draw.randrange(5000) for _ in range(30000)]
    words = np.array(base + base + [7] * 60000, np.int64)
    runs = p.runs_of(words)
    assert (0, 60000, 30000) in runs and any(n >= 60000 and q == 1 for _, n, q in runs)


def test_edge_rows(spark, docs_frame):
    line = "a b c d e f g"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, " ".join([line] * 3)), (4, " ".join([line] * 3)), (None, "x " * 20),
            (5, " x " * 12), (6, "y\x0b" * 13 + "z"), (7, "unique words only here")]
    got = p.find_runs(docs_frame(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted([
        ("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 21, [(0, 21, 7)], line), ("4", 21, [(0, 21, 7)], line),
        ("None", 20, [(0, 20, 1)], "x"), ("5", 12, [(0, 12, 1)], " x"), ("6", 14, [(0, 13, 1)], "y z"),
        ("7", 4, [], "unique words only here")])
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert p.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        p.find_runs(empty, min_length=1)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]


def test_query_equals_brute_force(spark, small_dir):
    docs = pq.read_table(f"{small_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = []
    for d in docs:
        words = planted(d["doc_id"], d["text"])
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d["doc_id"], len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(words, runs)).hexdigest()))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, small_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)


def test_planting_edge_rows(spark):
    texts = (None, "", " ", "a b  c\td é f g h i j", "one")
    rows = [(i, texts[i % 5]) for i in range(300)] + [(None, "a b c d e f g")]
    got = queries.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, b" ".join((r.text or "").encode().split())) for r in got} == {(i, b" ".join(planted(i, t))) for i, t in rows}

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from chainlake.llm import lm_score as m

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = m.vocabulary(PATH)


def brute_paths(word, pieces):
    """All segmentations of a word into (piece id, ...), bytes for characters without a piece."""
    text = m.WORD_START + word

    def from_(s):
        if s == len(text):
            yield ()
            return
        for size in range(1, min(VOCAB.longest, len(text) - s) + 1):
            part = text[s:s + size]
            if part in pieces:
                for rest in from_(s + size):
                    yield (pieces[part], *rest)
            elif size == 1:
                for rest in from_(s + 1):
                    yield (*(int(VOCAB.byte[b]) for b in part.encode()), *rest)
    return list(from_(0))


PIECES = {VOCAB.pieces[i]: int(i) for i in VOCAB.ids}


@pytest.mark.parametrize("word", ["a", "the", "erthion", "é\U00013000x", "ab\x01", "日本", "▁▁"])
def test_lattice_equals_enumeration(word):
    weights = VOCAB.first_weights()
    paths = brute_paths(word, PIECES)
    logs = [sum(weights[p] for p in path) for path in paths]
    want = np.logaddexp.reduce(logs)
    lattice = m.Lattice([m.WORD_START + word], VOCAB, weights)
    assert lattice.total[0] == pytest.approx(want)
    counts = np.zeros(len(weights))
    for path, log in zip(paths, logs):
        for p in path:
            counts[p] += 3 * math.exp(log - want)
    np.testing.assert_allclose(lattice.expected(np.array([3.0]), VOCAB), counts, atol=1e-9)


def test_batches_equal_single_words():
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 12))).encode() for _ in range(200)] + [b"x" * 30_000]
    weights = VOCAB.first_weights()
    got = np.empty(len(words))
    for at, lattice in m.lattices(words, VOCAB, weights):
        got[at] = lattice.total
    for w, g in list(zip(words, got))[:40]:
        assert g == pytest.approx(m.Lattice([m.WORD_START + w.decode()], VOCAB, weights).total[0])
    assert np.isfinite(got).all()


def brute(rows, weights):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            train.update((t or "").encode().lower().split())
            train[m.END] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), m.END]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(weights[VOCAB.end] if w == m.END else
                    m.Lattice([m.WORD_START + w.decode()], VOCAB, weights).total[0] for w in tokens) / math.log(10)
        held = zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
        out.append((i, held, len(tokens), sum(train[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("common", [3, 100_000])
def test_equals_brute_force(spark, docs_frame, monkeypatch, common):
    monkeypatch.setattr(m, "COMMON", common)
    rng = random.Random(5)
    words = ["The", "the", "É", "thé\x0b", "x", "日本", "word", "ning"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t"), (None, "the null id unseen"), (5, rows[5][1]), (103, "big " * 50_000 + "z" * 5000)]
    docs = docs_frame(rows)
    caught = []
    train = m.train_weights
    monkeypatch.setattr(m, "train_weights", lambda *a: caught.append(train(*a)) or caught[-1])
    got = m.score_documents(docs, PATH).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in got), key=str)
    want = brute(rows, caught[0])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6, atol=1e-5)
    assert np.exp(caught[0]).sum() == pytest.approx(1)


def test_empty_and_untrained(spark, docs_frame):
    docs = docs_frame([(i, "some text") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3])
    got = m.score_documents(docs, PATH).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.n_tokens == 3 for r in got)
    assert all(r.base_score == pytest.approx(0) and r.score < 0 for r in got)
    assert m.score_documents(docs.limit(0), PATH).count() == 0

"""Toxicity by a linear-chain conditional random field over tokens.

Training (on a bounded sample of labelled documents, see ``fit``):
1. Labels exist per document only.  Token labels come from a lexicon of words
   and word beginnings that explains the toxic documents: the feature that
   occurs in the most unexplained toxic documents is taken, if it is far more
   frequent in toxic than in clean ones, until none is left; equally telling
   features of many toxic documents are added.
2. A two-state linear-chain CRF (clean, toxic) is fitted to these token labels
   by gradient steps on the exact log-likelihood.  Its features are the word
   and its first 3, 4 and 5 characters, so that inflected forms that were never
   seen share weights with known ones.
3. A logistic function maps a document's token marginals to a score.

A chain is a line.  Scoring runs the forward-backward recursion over all lines
of whole texts, those of a batch side by side; tokens with a marginal of 0.5 or more are the
offending ones and are returned as character offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, id_and_text, ship_package

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WORD_OR_BREAK = re.compile(TOKEN.pattern + rb"|\n")
SAMPLE = 1200          # labelled documents of each class that are fitted at most
SAMPLE_BYTES = 200_000  # longer documents are left out of the sample (they are scored whole)
STEPS = 30
MIN_LOG_ODDS = 3.0
SURE_LOG_ODDS = 4.5
LEAST_WEIGHT = 0.02    # features with smaller weights are left out of the model
CACHE = 400_000        # words whose weight a worker remembers


PREFIXES = (3, 4, 5)


def features(word: bytes) -> list[tuple[int, str]]:
    """Features of a lower-cased word: itself (kind 0) and its first 3, 4 and 5 characters."""
    text = word.decode("utf-8", "replace")
    return [(0, text)] + [(n, text[:n]) for n in PREFIXES if len(text) >= n]


@dataclass
class Model:
    weights: dict[int, dict[str, float]]  # score of toxic over clean, by kind and text of a feature
    bias: float
    transitions: np.ndarray  # (2, 2) log potentials, from state to state
    calibration: np.ndarray  # intercept and slopes over ``summary``

    def emission(self, word: bytes) -> float:
        text = word.decode("utf-8", "replace")
        total = self.bias + self.weights[0].get(text, 0.0)
        for n in PREFIXES:
            if len(text) >= n:
                total += self.weights[n].get(text[:n], 0.0)
        return total


class Emissions(dict):
    """word -> emission score; forgets everything when it is full."""

    def __init__(self, model: Model):
        super().__init__({b"\n": np.nan})
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
            self[b"\n"] = np.nan
        self[word] = value = self.model.emission(word)
        return value


def _tokens(text: bytes) -> list[bytes]:
    """Lower-cased words with a line feed after each line."""
    return WORD_OR_BREAK.findall(text.lower() + b"\n")


def line_lengths(breaks: np.ndarray) -> np.ndarray:
    """Words of each line, from the places of the line feeds among all tokens."""
    at = np.flatnonzero(breaks)
    return np.diff(at, prepend=-1) - 1


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: their order, their first tokens, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    reach = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    return order, first, reach


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the toxic state, expected transition counts, sum of log partition values.

    ``scores`` holds the chains one after another, ``lengths`` their lengths.
    Potentials are relative to the clean state's emission.  Each state pair is
    scaled to sum to one at every step, so no length under- or overflows.
    """
    e = np.exp(np.clip(scores, -60, 60))
    a = np.exp(transitions)
    _, first, reach = _layout(lengths)
    fwd = np.empty((len(scores), 2))
    scale = np.empty(len(scores))
    for t, k in enumerate(reach):
        at = first[:k] + t
        if t:
            prior = fwd[at - 1]
            clean = prior[:, 0] * a[0, 0] + prior[:, 1] * a[1, 0]
            toxic = (prior[:, 0] * a[0, 1] + prior[:, 1] * a[1, 1]) * e[at]
        else:
            clean, toxic = np.ones(k), e[at]
        total = clean + toxic
        scale[at] = total
        fwd[at, 0] = clean / total
        fwd[at, 1] = toxic / total
    back = np.ones((len(scores), 2))
    for t in range(len(reach) - 2, -1, -1):
        at = first[:reach[t + 1]] + t
        after = back[at + 1] / scale[at + 1, None]
        toxic = after[:, 1] * e[at + 1]
        back[at, 0] = a[0, 0] * after[:, 0] + a[0, 1] * toxic
        back[at, 1] = a[1, 0] * after[:, 0] + a[1, 1] * toxic
    marginal = fwd[:, 1] * back[:, 1]
    pairs = np.zeros((2, 2))
    inner = np.ones(len(scores), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    to = np.flatnonzero(inner)
    for i in (0, 1):
        for j in (0, 1):
            w = fwd[to - 1, i] * a[i, j] * back[to, j] / scale[to]
            pairs[i, j] = (w * e[to] if j else w).sum()
    return marginal, pairs, float(np.log(scale).sum())


def summary(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, 3): highest marginal, log of the sum of those above 0.1, share of toxic tokens."""
    out = np.zeros((len(lengths), 3))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        clear = np.where(marginals >= 0.1, marginals, 0.0)
        total = np.add.reduceat(clear, starts)
        out[full, 0] = np.maximum.reduceat(marginals, starts)
        out[full, 1] = np.log1p(total)
        out[full, 2] = np.sqrt(total / lengths[full])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1)) * max(1, len(x) / 100)
    for _ in range(25):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def _lexicon(docs: list[np.ndarray], toxic: np.ndarray, dim: int) -> list[int]:
    """Features that together explain the toxic documents (see the module's text)."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    clean = np.bincount(np.concatenate([d for d, y in zip(docs, toxic) if not y]), minlength=dim)
    rate = np.log((clean + 0.5) / (n_clean + 1))
    left = [d for d, y in zip(docs, toxic) if y]
    everywhere = np.bincount(np.concatenate(left), minlength=dim)
    odds = np.log((everywhere + 0.5) / (n_toxic + 1)) - rate
    allowed = odds >= MIN_LOG_ODDS
    least = max(2, n_toxic // 400)
    chosen = np.zeros(dim, bool)
    while left:
        covered = np.bincount(np.concatenate(left), minlength=dim) - n_toxic * clean / n_clean
        covered = np.where(allowed, covered, 0)
        best = covered.max()
        if best < least:
            break
        # word beginnings of equal reach explain the same documents: all are taken
        chosen |= covered > best - 0.5
        left = [d for d in left if not chosen[d].any()]
    # features of many toxic documents count even where others explain these already
    chosen |= (odds >= SURE_LOG_ODDS) & (everywhere >= max(5, n_toxic // 20))
    return np.flatnonzero(chosen).tolist()


def fit_model(texts: list[bytes], labels: list[int]) -> Model:
    """CRF and calibration for labelled UTF-8 texts; with one class only, a constant score."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        base = 5.0 if len(toxic) and toxic.all() else -5.0
        return Model({k: {} for k in (0, *PREFIXES)}, -10.0, np.zeros((2, 2)), np.array([base, 0, 0, 0]))
    words: dict[bytes, int] = {b"\n": -1}
    rows = [np.array([words.setdefault(w, len(words) - 1) for w in _tokens(t)], np.int64) for t in texts]
    del words[b"\n"]
    tokens = np.concatenate(rows)
    lines = line_lengths(tokens < 0)
    tokens = tokens[tokens >= 0]
    chains = [r[r >= 0] for r in rows]
    known: dict[tuple[int, str], int] = {}
    own = [[known.setdefault(f, len(known)) for f in features(w)] for w in words]
    dim, width = len(known), max(map(len, own))
    table = np.full((len(own), width), dim, np.int64)  # feature ``dim`` pads and has no weight
    for row, f in zip(table, own):
        row[:len(f)] = f
    bags = [np.unique(table[np.unique(c)]) for c in chains]
    bags = [b[b < dim] for b in bags]
    lexicon = np.zeros(dim + 1, bool)
    lexicon[_lexicon(bags, toxic, dim)] = True
    marked = lexicon[table].any(axis=1)
    lengths = np.array([len(c) for c in chains])
    gold = marked[tokens] & np.repeat(toxic, lengths)
    starts = np.zeros(len(tokens), bool)
    starts[(np.cumsum(lines) - lines)[lines > 0]] = True
    to = np.flatnonzero(~starts)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[to - 1].astype(int), gold[to].astype(int)), 1)
    gold_counts = np.bincount(tokens, gold, len(own))
    # Adam on the mean log-likelihood over toxic tokens, with a ridge
    size = dim + 1
    theta, m, v = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    theta[size] = -3.0
    norm = max(1.0, gold.sum())
    flat = table.ravel()
    for step in range(1, STEPS + 1):
        by_word = theta[:size][table].sum(axis=1) + theta[size]
        marginal, pairs, _ = forward_backward(by_word[tokens], lines, theta[size + 1:].reshape(2, 2))
        gap = gold_counts - np.bincount(tokens, marginal, len(own))
        grad = np.concatenate([np.bincount(flat, np.repeat(gap, width), size), [gap.sum()],
                               (gold_pairs - pairs).ravel()]) / norm - 1e-4 * theta
        grad[dim] = 0  # the padding
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights: dict[int, dict[str, float]] = {k: {} for k in (0, *PREFIXES)}
    for (kind, text), i in known.items():
        if abs(theta[i]) >= LEAST_WEIGHT:
            weights[kind][text] = float(theta[i])
    model = Model(weights, float(theta[size]), theta[size + 1:].reshape(2, 2), np.zeros(4))
    by_word = np.array([model.emission(w) for w in words])
    marginal, _, _ = forward_backward(by_word[tokens], lines, model.transitions)
    model.calibration = _calibrate(summary(marginal, lengths), toxic.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", folds: int = 5, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` documents of each class, chosen by a hash of the id,
    those of over ``sample_bytes`` bytes left out (all are scored whole): the driver
    reads at most ``2 * sample * sample_bytes`` bytes of text.

    Rows whose crc32(id as text) mod ``folds`` is 0 are never read.  A document
    with several labels counts as toxic if one of them says so; null labels and
    null ids are left out.  Of equal texts one is used.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()
                    & (crc_remainder(F.col("doc_id"), folds) != 0))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", "left_semi")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r.doc_id for y in (0, 1)
              for r in known.where((F.col("y") > 0) == bool(y)).orderBy(*by_hash).limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")  # 2 * sample rows at most
    rows = (id_and_text(docs, id_col, text_col).where(F.length("text") <= sample_bytes)
            .join(F.broadcast(ids), "doc_id", "left_semi").join(known, "doc_id")
            .groupBy("text").agg(F.max("y").alias("y")).orderBy(F.xxhash64("text"), "text").limit(2 * sample).collect())
    return fit_model([bytes(r.text) for r in rows], [r.y > 0 for r in rows])


def score_texts(model: Model, texts: list[bytes], cache: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, marginal of each token, tokens of each text."""
    get = cache.__getitem__
    parts = [np.array(list(map(get, _tokens(t))), np.float64) for t in texts]
    scores = np.concatenate([np.empty(0), *parts])
    breaks = np.isnan(scores)
    lengths = np.array([np.count_nonzero(~np.isnan(p)) for p in parts], np.int64)
    marginals, _, _ = forward_backward(scores[~breaks], line_lengths(breaks), model.transitions)
    x = summary(marginals, lengths)
    return _sigmoid(model.calibration[0] + x @ model.calibration[1:]), marginals, lengths


def _groups(sizes: list[int], limit: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes of text (one row at least)."""
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans) per row of ``docs``, in one pass without a shuffle.

    spans are the (start, end) character offsets of tokens with a marginal of
    0.5 or more.  A null or wordless text has no tokens and gets the score of
    an empty one; null and repeated ids are kept row by row; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in _groups([len(t) for t in texts]):
                got, marginals, lengths = score_texts(shared.value, texts[low:high], cache)
                spans: list[list] = [[] for _ in range(high - low)]
                starts = np.cumsum(lengths) - lengths
                for token in np.flatnonzero(marginals >= 0.5).tolist():
                    d = int(np.searchsorted(starts, token, "right")) - 1
                    spans[d].append(token - int(starts[d]))
                for d in (d for d, s in enumerate(spans) if s):
                    text, wanted = texts[low + d], set(spans[d])
                    places = [m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in wanted]
                    spans[d] = _in_characters(text, places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(got),
                     pa.array((got >= 0.5).astype(np.int32)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "score", "predicted", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>")


def _in_characters(text: bytes, places: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets as character offsets, in one pass over the text."""
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(before[s]), "end": int(before[e])} for s, e in places]


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score below ``threshold``, all columns as they were, without a shuffle."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(shared.value)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            for low, high in _groups([len(t) for t in texts]):
                got, _, _ = score_texts(shared.value, texts[low:high], cache)
                yield batch.slice(low, high - low).filter(pa.array(got < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Language-model scores from a subword lattice.

The model is a unigram distribution over the pieces of an existing vocabulary.
Its first weights follow the file's scores (merge ranks, as a Zipf law); then
expectation-maximisation over all training words re-estimates them, with the
vocabulary fixed.  The probability of a text sums over all its segmentations:
no piece crosses white space, so it is the product of the words' marginals,
each from a forward recursion in log space over the word's lattice, and of the
end symbol's.  Characters without a piece are spelt in the file's byte pieces.

Words are counted once for the whole corpus and every distinct word's lattice
is run once.  The ``COMMON`` most frequent words are broadcast for the scan of
the texts; all others meet their scores in an equality join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, cut_lineage, id_and_text

WORD_START = "▁"
END_PIECE = "</s>"
END = b""            # the end symbol's row among the words; no word is empty
COMMON = 100_000     # words that are broadcast; only speed depends on it
EM_ROUNDS = 2
PIECE_SMOOTHING = 0.1
BASE_SMOOTHING = 0.1
ZIPF_SHIFT = 10.0
FLUSH = 400_000      # distinct words that a task holds before it passes their counts on
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CELLS = 1 << 19     # lattice cells of a batch


class Vocabulary:
    """Pieces of a sentencepiece model file, findable by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.byte = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)])
        self.end = self.pieces.index(END_PIECE)
        spelt = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.longest = max(len(self.pieces[i]) for i in spelt)
        hashes = np.array([_hash(self.pieces[i]) for i in spelt], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(spelt)[order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def first_weights(self) -> np.ndarray:
        """Natural log probabilities by a Zipf law over the ranks that the scores are."""
        rank = np.where(self.scores < 0, np.minimum(-self.scores, 1e6), len(self.pieces))
        w = 1 / (rank + ZIPF_SHIFT)
        return np.log(w / w.sum())


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _codes(words: list[str]) -> np.ndarray:
    """(words, characters) code points of words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base, np.uint64))))[:n]


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    terms = (codes + np.uint64(1)) * _powers(_BASE, codes.shape[1])
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def _finish(x: np.ndarray, length: int) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return x ^ (x >> np.uint64(31))


def _hash(piece: str) -> int:
    return int(_finish(_prefix_sums(_codes([piece]))[:, -1], len(piece))[0])


class Lattice:
    """Lattices of words of equal length n: pieces[L][w, s] is the id of the piece of L characters at s."""

    def __init__(self, words: list[str], vocab: Vocabulary, weights: np.ndarray):
        codes = _codes(words)
        self.n = n = codes.shape[1]
        sums, inverse = _prefix_sums(codes), _powers(_INVERSE, n)
        self.pieces, self.logs = {}, {}
        padded = np.append(weights, -np.inf)
        for size in range(1, min(vocab.longest, n) + 1):
            part = (sums[:, size:] - sums[:, :-size]) * inverse[:n - size + 1]
            ids = vocab.find(_finish(part, size))
            if size == 1 or (ids >= 0).any():
                self.pieces[size], self.logs[size] = ids, padded[ids]
        self.bytes: list[tuple[int, int, bytes]] = []  # characters that have no piece
        for w, s in np.argwhere(self.pieces[1] < 0).tolist():
            spelt = words[w][s].encode("utf-8", "replace")
            self.bytes.append((w, s, spelt))
            self.logs[1][w, s] = weights[vocab.byte[list(spelt)]].sum()
        self.forward = np.full((len(words), n + 1), -np.inf)
        self.forward[:, 0] = 0
        for e in range(1, n + 1):
            paths = [self.forward[:, e - size] + log[:, e - size] for size, log in self.logs.items() if size <= e]
            self.forward[:, e] = np.logaddexp.reduce(paths)
        self.total = self.forward[:, n]

    def expected(self, times: np.ndarray, vocab: Vocabulary) -> np.ndarray:
        """Expected number of each piece over all segmentations, word w counted times[w]."""
        n = self.n
        backward = np.full((len(times), n + 1), -np.inf)
        backward[:, n] = 0
        for s in range(n - 1, -1, -1):
            paths = [backward[:, s + size] + log[:, s] for size, log in self.logs.items() if s + size <= n]
            backward[:, s] = np.logaddexp.reduce(paths)
        counts = np.zeros(len(vocab.pieces))
        for size, log in self.logs.items():
            share = np.exp(self.forward[:, :n - size + 1] + log + backward[:, size:] - self.total[:, None]) * times[:, None]
            ids = self.pieces[size]
            counts += np.bincount(ids[ids >= 0], share[ids >= 0], len(counts))
            if size == 1:
                for w, s, spelt in self.bytes:
                    np.add.at(counts, vocab.byte[list(spelt)], share[w, s])
        return counts


def lattices(words: list[bytes], vocab: Vocabulary, weights: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices of all words with their places in ``words``, in batches of equal length."""
    texts = [WORD_START + w.decode("utf-8", "replace") for w in words]
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            step = max(1, _CELLS // int(lengths[group[0]]))
            for low in range(0, len(group), step):
                at = group[low:low + step]
                yield at, Lattice([texts[i] for i in at], vocab, weights)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) for every distinct word and the end symbol; c counts training rows only.

    ``docs`` has text and train.  Tasks count what they read before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "c"])
        seen: Counter = Counter()
        for batch in batches:
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist()):
                words = text.lower().split()
                if train:
                    seen.update(words)
                    seen[END] += 1
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text", "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_weights(words: DataFrame, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Natural log probability of each piece after EM over all words with c > 0."""
    spark = words.sparkSession
    weights = vocabulary(path).first_weights()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # one number per piece of the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(path)
            counts = np.zeros(len(vocab.pieces))
            for batch in batches:
                texts, times = batch.column("word").to_pylist(), batch.column("c").to_numpy()
                own = np.array([t == END for t in texts], bool)
                counts[vocab.end] += times[own].sum()
                at = np.flatnonzero(~own)
                for part, lattice in lattices([texts[i] for i in at], vocab, shared.value):
                    counts += lattice.expected(times[at[part]].astype(float), vocab)
            ids = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids])], names=["piece", "n"])

        counted = (words.where("c > 0").mapInArrow(run, "piece long, n double")
                   .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # a row per piece at most
        counts = np.full(len(weights), PIECE_SMOOTHING)
        for r in counted:
            counts[r.piece] += r.n
        weights = np.log(counts / counts.sum())
    return weights


def score_words(words: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(word, c, lattice): log10 probability of each word, or of the end symbol."""
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column("word").to_pylist()
            found = np.full(len(texts), shared.value[vocab.end])
            at = np.flatnonzero([t != END for t in texts])
            for part, lattice in lattices([texts[i] for i in at], vocab, shared.value):
                found[at[part]] = lattice.total
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found / np.log(10))],
                                             names=["word", "c", "lattice"])

    return words.mapInArrow(run, "word binary, c long, lattice double")


def _least_common(words: DataFrame) -> float:
    """A count that fewer than ``COMMON`` words reach, from a histogram of at most 1024 rows."""
    steps = 16  # bins for each doubling of the count
    found = (words.where("c > 0").groupBy(F.floor(F.log2("c") * steps).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("bin").desc()).collect())
    least, total = float("inf"), 1  # the end symbol comes along
    for r in found:
        total += r.n
        if total > COMMON:
            break
        least = 2.0 ** (r.bin / steps)
    return least


def _scan(docs: DataFrame, common: list) -> DataFrame:
    """Per row: sums over the words in ``common`` and the end, and the other words with their numbers."""
    places = {bytes(r.word): i for i, r in enumerate(common)}
    known = np.array([r.c > 0 for r in common] + [False])
    base = np.array([r.base for r in common] + [0.0])
    lattice = np.array([r.lattice for r in common] + [0.0])
    shared = docs.sparkSession.sparkContext.broadcast((places, known, base, lattice))  # COMMON words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known, base, lattice = shared.value
        get, rest, end = places.get, len(base) - 1, places[END]
        for batch in batches:
            n, n_known, sums, marginals, words, times = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = text.lower().split()
                at = np.array([get(w, rest) for w in own] + [end])
                others = Counter(own[i] for i in np.flatnonzero(at == rest).tolist())
                n.append(len(at))
                n_known.append(int(known[at].sum()))
                sums.append(float(base[at].sum()))
                marginals.append(float(lattice[at].sum()))
                words.append(list(others))
                times.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums),
                 pa.array(marginals), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "words", "times"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double, "
             "words array<binary>, times array<long>")


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Training rows are those whose crc32(id as text) mod ``folds`` is not 0 (a
    null id counts as the empty text, remainder 0).  Tokens are the words of
    the text with A-Z lower-cased and one end symbol, so a null or empty text
    has one token.  Repeated rows are counted and scored row by row; with no
    training row every count is 0; an empty table gives an empty result; other
    columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("train", crc_remainder(F.col("doc_id"), folds) != 0)
    counts = cut_lineage(count_words(rows))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    weights = train_weights(counts, vocabulary_path)
    base = F.log10((F.col("c") + BASE_SMOOTHING) / F.lit(total.n + BASE_SMOOTHING * (total.v + 1)))
    scored = cut_lineage(score_words(counts, vocabulary_path, weights).withColumn("base", base))
    common = scored.where((F.col("word") == F.lit(END)) | (F.col("c") >= _least_common(scored))).collect()
    if not any(bytes(r.word) == END for r in common):  # no training row: the end symbol was never counted
        end = float(weights[vocabulary(vocabulary_path).end] / np.log(10))
        unseen = float(np.log10(BASE_SMOOTHING / (total.n + BASE_SMOOTHING * (total.v + 1))))
        common = [scored.sparkSession.createDataFrame([(END, 0, end, unseen)], scored.schema).first(), *common]
    found = cut_lineage(_scan(rows, common)).withColumn("row", F.monotonically_increasing_id())  # written: stable
    others = (found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
              .join(scored, F.col("words") == F.col("word"))
              .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
                                  F.sum(F.col("times") * F.col("base")).alias("base"),
                                  F.sum(F.col("times") * F.col("lattice")).alias("lattice")))
    return found.drop("words", "times").join(others, "row", "left").select(
        "doc_id", (crc_remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("lattice", F.lit(0.0))).alias("score"))

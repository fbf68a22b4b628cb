"""Personal data: exact patterns and information-theoretic disclosure of terms.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers: the protected entities.  A term (a word) *reveals* an entity if its
presence tells much of the entity's information.  From the whole corpus:

    T       words
    n(e)    mentions of entity e             P(e) = n(e) / T
    n(t)    occurrences of term t
    n(t, e) mentions of e with t among the ``WINDOW`` words on either side

    disclosure(t, e) = log(P(e | t) / P(e)) / -log P(e),  P(e | t) = n(t, e) / n(t)

is the pointwise mutual information of term and entity as a share of the
entity's own information: 1 if t never occurs without e, 0 if t says nothing.
A pair counts only if it was seen in at least ``SUPPORT`` different contexts
(different windows of words), so that copies of one text prove nothing.  Terms
at ``REMOVE`` or more are removed, those at ``GENERALISE`` or more are replaced
by their class (a number or a word), wherever they occur.

Counts are combined within each batch and then in Spark's own map-side
aggregation, so a hot entity or word costs a few rows per task.  Only windows
of a fixed width are paired, never all terms of a text with all its entities.
Occurrences are counted for the terms of such pairs alone, behind a bitmap of
fixed size; spans are found the same way and joined by text with copies of the
term table that spread a hot term over ``SALTS`` tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text
from .grams import FILTER_BITS, Words, clean, filter_test, hash_filter

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 8
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.95
SALTS = 16
FLUSH_ROWS = 1 << 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches any number, so no place is tried twice
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of a lower-cased text
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@domain``, leftmost first, in time linear in the text.

    A local part is a stretch of its characters that ends at an ``@``, so the
    leftmost match begins where that stretch (or the previous match) ends.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
        free = match.end() if match else at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four consecutive groups of a dotted number, from its start, if none is above 255."""
    for match in _DOTTED.finditer(text):
        groups = match.group().split(".")
        at = match.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of every pattern match, by kind, then start; code points."""
    spans = [(0, s, e) for s, e in _emails(text)]
    spans += [(1, s, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and a separator before each but the first
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return spans


def entity_key(kind: int, value: str) -> str:
    """One name for all ways to write an entity: lower case, numbers without separators."""
    return f"{KINDS[kind]}:" + (value.translate(_LOWER) if kind < 2 else _digits(value))


def _touching(places: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each (start, end) overlaps a span."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(s[1:] for s in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    if not starts:
        return np.zeros(len(places), bool)
    nxt = np.searchsorted(ends, places[:, 0], "right")  # the first span that ends after the place begins
    return (nxt < len(starts)) & (np.array(starts)[np.minimum(nxt, len(starts) - 1)] < places[:, 1])


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[str, int, list[str]]]:
    """(entity, hash of the context, distinct terms of the context) per mention.

    The context is up to ``window`` words on either side of the mention,
    without words that touch any mention.
    """
    low = text.translate(_LOWER)
    places = np.array([m.span() for m in _WORD.finditer(low)], np.int64).reshape(-1, 2)
    places = places[~_touching(places, spans)]
    for kind, start, end in spans:
        at = int(np.searchsorted(places[:, 0], start))
        near = [low[s:e] for s, e in places[max(0, at - window):at + window].tolist()]
        digest = xxhash.xxh64_intdigest(" ".join(near)) - (1 << 63)
        yield entity_key(kind, text[start:end]), digest, sorted(set(near))


def count_mentions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, entity, context, n): mentions of each entity next to each term in each context.

    Rows without a term count all mentions of an entity; the row without
    either counts all words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(zip(*((*key, n) for key, n in counts.items()))) or [()] * 4
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["term", "entity", "context", "n"])

        for batch in batches:
            for value in batch.column("text"):
                raw = value.as_py()
                counts[None, None, None] += word_count(raw)
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                for entity, context, terms in contexts(text, spans, window) if spans else ():
                    counts[None, entity, None] += 1
                    counts.update((t, entity, context) for t in terms)
                if len(counts) >= FLUSH_ROWS:
                    yield flush()
        yield flush()

    return (docs.select("text").mapInArrow(run, "term string, entity string, context long, n long")
            .groupBy("term", "entity", "context").agg(F.sum("n").alias("n")))


def word_count(text: bytes) -> int:
    raw = np.frombuffer(clean(text), np.uint8) != 0x20
    return int(np.count_nonzero(raw[1:] & ~raw[:-1])) + int(len(raw) > 0 and raw[0])


def terms_bitmap(terms: DataFrame) -> bytes:
    """Bitmap of the hashes of ``term``: 2 MB per partition of at most 8 reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            words = b" ".join(t.encode() for t in batch.column("term").to_pylist())
            bits |= np.frombuffer(hash_filter(Words(words).hashes), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in terms.select("term").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def count_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): occurrences of each of ``terms`` in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms_bitmap(terms))  # 2 MB always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_match = filter_test(shared.value) if any(shared.value) else None
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()),
                                                pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return found

        for batch in batches:
            for value in batch.column("text") if may_match else ():
                words = Words(value.as_py())
                counts.update(words.gram(i, 1) for i in np.flatnonzero(may_match(words.hashes)).tolist())
                if len(counts) >= FLUSH_ROWS:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted.join(terms.select("term"), "term", "left_semi")


def revealing_terms(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE,
                    remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, entity, disclosure, action) of each term that reveals an entity, with the entity it reveals most.

    ``action`` is "remove" or "generalise".  Ties between entities go to the
    smaller name.  Without entities or pairs of enough support: no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    counts = cut_lineage(count_mentions(rows, window))
    pairs = cut_lineage(counts.where("term is not null").groupBy("term", "entity")
                        .agg(F.count(F.lit(1)).alias("seen"), F.sum("n").alias("n_te")).where(F.col("seen") >= support))
    words = count_terms(rows, pairs.select("term").distinct())
    mentions = counts.where("term is null and entity is not null").select("entity", F.col("n").alias("n_e"))
    total = counts.where("term is null and entity is null").agg(F.sum("n").alias("total"))  # one row
    p_e = F.col("n_e") / F.col("total")
    # a word may stand near two mentions at once, so n(t, e) can pass n(t)
    share = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    scored = (pairs.join(words, "term").join(mentions, "entity").join(F.broadcast(total)).where("n_e < total")
              .withColumn("disclosure", F.log(share / p_e) / -F.log(p_e)).where(F.col("disclosure") >= generalise))
    best = scored.groupBy("term").agg(F.min(F.struct((-F.col("disclosure")).alias("back"), "entity")).alias("best"))
    disclosure = -F.col("best.back")
    return best.select("term", F.col("best.entity").alias("entity"), disclosure.alias("disclosure"),
                       F.when(disclosure >= remove, "remove").otherwise("generalise").alias("action"))


SPAN = "struct<kind: string, start: long, end: long, action: string>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
_HIT = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(rows: DataFrame, terms: DataFrame, keep_text: bool) -> DataFrame:
    """(doc_id, base, hits, text): pattern matches, and words outside them that may be a revealing term."""
    shared = rows.sparkSession.sparkContext.broadcast(terms_bitmap(terms))  # 2 MB always

    def hits_of(raw: bytes, spans: list, may_match) -> list[dict]:
        words = Words(raw)
        at = np.flatnonzero(may_match(words.hashes))
        if not len(at):
            return []
        before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points
        places = np.stack((before[words.starts[at]], before[words.ends[at]]), axis=1)
        free = ~_touching(places, spans)
        return [{"term": words.gram(i, 1).decode("utf-8", "replace"), "start": s, "end": e}
                for i, (s, e) in zip(at[free].tolist(), places[free].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_match = filter_test(shared.value) if any(shared.value) else None
        for batch in batches:
            base, hits = [], []
            for value in batch.column("text"):
                raw = value.as_py()
                spans = base_spans(raw.decode("utf-8", "replace"))
                base.append([{"kind": KINDS[k], "start": s, "end": e, "action": "remove"} for k, s, e in spans])
                hits.append(hits_of(raw, spans, may_match) if may_match else [])
            columns = [batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(hits, pa.list_(_HIT))]
            columns += [batch.column("text")] if keep_text else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "hits", "text"][:len(columns)])

    return rows.mapInArrow(run, f"doc_id long, base array<{SPAN}>, hits array<struct<term: string, start: long, end: long>>"
                           + (", text binary" if keep_text else ""))


def find_personal_data(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE,
                       remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text",
                       keep_text: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end, action) per row; with ``keep_text`` also the text (binary).

    Spans are in code points, end exclusive: the pattern matches by kind, then
    start, and after them the revealing terms (kind "term") by start.  Terms
    inside a pattern match are left to it.  A null text is empty and has no
    spans.  Null and repeated ids are kept row by row; copies of a text count
    as one context; an empty table gives an empty result; other columns are
    not read.
    """
    terms = cut_lineage(revealing_terms(docs, window, support, generalise, remove, id_col, text_col))
    found = cut_lineage(_scan(id_and_text(docs, id_col, text_col), terms, keep_text))
    found = found.withColumn("row", F.monotonically_increasing_id())  # over written rows: stable
    salted = terms.select(F.col("term").alias("known"), "action",
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    hits = found.select("row", F.explode("hits").alias("h")).select(
        "row", "h.*", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    span = F.struct(F.lit(TERM).alias("kind"), "start", "end", "action").cast(SPAN)
    by_row = (hits.join(salted, (F.col("term") == F.col("known")) & (F.col("salt") == F.col("part")))
              .groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("terms")))
    spans = F.concat("base", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))).alias("spans")
    return found.join(by_row, "row", "left").select("doc_id", spans, *(["text"] if keep_text else []))


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with each span replaced by its class; spans that overlap become one, named by the first."""
    out, at, upto = [], 0, 0
    for kind, start, end, action in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= upto:
            word = text[start:end]
            general = "NUMBER" if word.isdigit() else "WORD"
            out += [text[at:start], f"[{kind.upper()}]" if kind != TERM else f"[{general}]" if action == "generalise" else "[REMOVED]"]
        at = upto = max(upto, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, text (sanitised), spans per row; parameters and cases as in ``find_personal_data``."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, keep_text=True, **parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sanitised(t.decode("utf-8", "replace"), [tuple(s.values()) for s in spans])
                     for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("spans")],
                                             names=["doc_id", "text", "spans"])

    return found.mapInArrow(run, f"doc_id long, text string, spans array<{SPAN}>")

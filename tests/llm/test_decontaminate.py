import random
import re

from hypothesis import given
from hypothesis import strategies as st

from chainlake.llm import decontaminate as d
from chainlake.llm.grams import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    n = min(5, len(words))
    return {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(docs, items):
    out = set()
    for i, t in docs:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        for k, u in items:
            q = shingles(u)
            n = len(next(iter(q)).split()) if q else 5
            own = {" ".join(words[a:a + n]) for a in range(len(words) - n + 1)}
            if q and len(q & own) / len(q) >= 0.8:
                out.add((i, k, len(q & own), len(q)))
    return out


def rows(df):
    return {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect()}


@given(st.text(max_size=60))
def test_words_equal_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    words = Words(text.encode())
    want = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    assert [words.gram(i, 1).decode() for i in range(len(words))] == want


def test_hashes_of_long_texts_do_not_depend_on_chunks():
    text = b"alpha beta gamma " * 40_000
    long, short = Words(text), Words(b"x alpha beta gamma")
    assert set(long.rolling(3).tolist()) >= {short.rolling(3).tolist()[1]}
    assert len(set(long.rolling(3).tolist())) == 3


@given(st.integers(1, 500))
def test_sketch_is_longer_than_what_may_be_missing(q):
    assert d.sketch_length(q, 0.8) > q - d.least_shared(q, 0.8)


def test_equals_brute_force(spark, docs_frame):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 17, 33, 64, 120])]
    items += [(50, None), (51, "?!"), (2, "clash of ids in six words")]
    docs = []
    for i in range(60):
        noise = rng.choices(vocabulary, k=rng.choice((0, 3, 60, 400)))
        words = items[rng.randrange(10)][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, len(words) // 10))):
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(noise) + "\n" + ", ".join(words).upper() + ". " + " ".join(noise)))
    docs += [(100, None), (101, ""), (None, items[8][1]), (7, docs[7][1]), (102, "x " * 60_000 + items[9][1]),
             (103, items[-1][1] + " ok")]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    frame = docs_frame(docs)
    want = brute(docs, items)
    assert len(want) > 20 and rows(d.contaminated(frame, bench)) == want
    kept = d.drop_contaminated(frame, bench)
    bad = {(i, t) for i, t in docs if brute([(i, t)], items)}
    assert kept.columns == frame.columns
    assert sorted((str((r.doc_id, r.text)) for r in kept.collect())) == sorted(str(x) for x in docs if x not in bad)
    assert d.contaminated(frame.limit(0), bench).count() == 0
    assert d.contaminated(frame, bench.limit(0)).count() == 0


def test_candidates_come_from_the_sketches(spark):
    """A set with shingles outside the sketch alone is no candidate; a candidate is counted over all shingles."""
    index = spark.createDataFrame([(i, 9, bytes([g]), 4, g < 2) for i in (1, None) for g in range(4)],
                                  "item_id long, item_key long, gram binary, q long, in_sketch boolean")
    pairs = spark.createDataFrame([("a", bytes([2])), ("a", bytes([3])), ("b", bytes([0])), ("b", bytes([2])), ("b", bytes([7]))],
                                  "grams_key string, gram binary")
    found = d.sketch_candidates(pairs, index)
    assert {(r.grams_key, r.item_id) for r in found.collect()} == {("b", 1), ("b", None)}
    assert {(r.grams_key, r.item_id, r.n_shared) for r in d.verified(found, pairs, index).collect()} == {("b", 1, 2), ("b", None, 2)}

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chainlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


def ids(text):
    return EXACT.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \t\n\r  \x1c\x85ab'sé1,.#\U0001f600", max_size=24) | st.text(max_size=30))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "a  ", "  a", "a\n \nb", "x<|endoftext|> y", "don't  I'll \n", "a  b"])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == ids(text)


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def brute_best_fit(sizes, capacity, open_bins):
    """Plain list of open bins: best fit, the fullest closes first."""
    bins, made, out = {}, 0, []
    for s in sizes:
        fit = [f for f in bins.values() if f >= s] if s < capacity else []
        if fit:
            free = min(fit)
            bins.pop(next(b for b, f in bins.items() if f == free))
        else:
            free, made = capacity, made + 1
        out.append(capacity - free)
        if free - s:
            if len(bins) >= open_bins:
                least = min(bins.values())
                bins.pop(next(b for b, f in bins.items() if f == least))
            bins[len(out)] = free - s
    return made, out


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_best_fit_equals_brute_force(open_bins):
    rng = random.Random(open_bins)
    sizes = [rng.randint(1, 100) for _ in range(600)]
    packer = packing.BestFit(100, open_bins)
    placed = [packer.place(s) for s in sizes]
    made, offsets = brute_best_fit(sizes, 100, open_bins)
    assert packer.bins == made and [o for _, o in placed] == offsets
    assert packer.n_open <= open_bins


def check_packing(rows, texts, length=1024):
    spans, content = {}, {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        content.setdefault(r.doc_id, []).append(r)
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    for doc, text in texts:
        want = ids(text or "") + [2]
        mine = sorted(content[doc], key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(want)
        for r in mine:
            part = np.array(want[r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    return len(spans)


def test_query_packs_everything(spark, small_dir):
    from chainlake.llm.queries import QUERIES
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_best_fit_packing"](spark, small_dir).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs])
    assert used <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_hard_cases(spark, docs_frame):
    rows = [(1, None), (2, ""), (None, "null id"), (4, "word " * 30_000), (5, "same"), (5, "same")]
    docs = docs_frame(rows)
    got = packing.pack_documents(docs, PATH).collect()
    assert sum(r.doc_id == 5 for r in got) == 2
    by = {r.doc_id: r for r in got if r.doc_id in (1, 2)}
    assert by[1].length == by[2].length == 1 and by[1].ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))
    assert sum(r.length for r in got if r.doc_id == 4) == len(ids(rows[3][1])) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_many_packers(spark):
    rng = random.Random(0)
    parts = spark.createDataFrame([(i, 0, rng.randint(1, 1024)) for i in range(3000)], "doc_id long, piece int, length long")
    rows = packing.pack(parts, packer_tokens=100_000).collect()
    assert len(rows) == 3000 and len({r.sequence_id >> 40 for r in rows}) > 5
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        assert sum(n for _, n in s) <= 1024
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]

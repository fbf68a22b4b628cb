import itertools
import random

import numpy as np

from chainlake.llm import toxicity as t


def brute_chain(scores, a):
    """Marginals, pair counts and log partition of one chain over all state sequences."""
    total, marginal, pairs = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(sum(s * y for s, y in zip(scores, states)) + sum(a[i, j] for i, j in zip(states, states[1:])))
        total += w
        marginal += w * np.array(states)
        for i, j in zip(states, states[1:]):
            pairs[i, j] += w
    return marginal / total, pairs / total, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) * 2 for n in (3, 0, 1, 7, 5, 0)]
    lengths = np.array([len(c) for c in chains])
    marginal, pairs, logz = t.forward_backward(np.concatenate(chains), lengths, a)
    want = [brute_chain(c, a) for c in chains if len(c)]
    np.testing.assert_allclose(marginal, np.concatenate([w[0] for w in want]))
    np.testing.assert_allclose(pairs, sum(w[1] for w in want))
    np.testing.assert_allclose(logz, sum(w[2] for w in want))


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "ander", "hesta", "rely", "onwh", "leen", "über", "ñado", "trans", "idiom"]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.25
        text = rng.choices(words, k=rng.randint(20, 120))
        if toxic:
            for _ in range(rng.randint(1, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["Idiot", "scum!", "grubby" + rng.choice("abcdefgh")]))
        out.append((i, " ".join(text) + ".\nlast line", int(toxic)))
    return out


def test_learns_words_and_inflections():
    train, test = corpus(400, 1), corpus(200, 2)
    model = t.fit_model([x.encode() for _, x, _ in train], [y for _, _, y in train])
    texts = [x.encode() for _, x, _ in test] + [b"the of grubbyzzz rely tion onwh ander", b""]
    got, _, _ = t.score_texts(model, texts, t.Emissions(model))
    right = [(s >= 0.5) == bool(y) for s, (_, _, y) in zip(got, test)]
    assert np.mean(right) > 0.97
    assert got[-2] >= 0.5 > got[-1]


def test_one_class_gives_a_constant():
    assert t.score_texts(m := t.fit_model([b"a"], [0]), [b"a", b""], t.Emissions(m))[0].max() < 0.5
    assert t.score_texts(m := t.fit_model([b"a"], [1]), [b"a", b""], t.Emissions(m))[0].min() >= 0.5
    assert t.score_texts(m := t.fit_model([], []), [b"a"], t.Emissions(m))[0].max() < 0.5


def test_hard_cases(spark, docs_frame):
    rows = [(i, x) for i, x, _ in corpus(300, 4)]
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in corpus(300, 4)] + [(None, 1, 1, "x"), (3, 1, None, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    extra = [(1000, None), (1001, ""), (None, "Ünd you idiot"), (1003, "the of " * 60_000 + "idiot scum"), (5, rows[5][1])]
    docs = docs_frame(rows + extra)
    model = t.fit(docs, labels)
    got = t.score(docs, model)
    assert got.count() == len(rows) + len(extra)
    by = {r.doc_id: r for r in got.collect()}
    assert 0 <= by[1000].score < 0.5 and by[1000].score == by[1001].score
    null = by[None]
    assert null.predicted == 1 and [(s.start, s.end) for s in null.spans] == [(8, 13)]
    assert len(by[1003].spans) == 2
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 0").count()
    assert t.score(docs.limit(0), model).count() == 0 and t.drop_toxic(docs.limit(0), model).count() == 0
    none = t.fit(docs, labels.limit(0))
    assert t.score(docs, none).where("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    from chainlake.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9

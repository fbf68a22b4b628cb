import random

import pytest
import xxhash

from chainlake.llm import simhash
from chainlake.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    words = ["Éa", "B", "c\x0b", "d e", "F", "x" * 300]
    texts = ["", " \t\n", "one", "One two", "a b c", " x y z w"] + [
        " ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 3) == brute_fingerprint(t)


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("bucket", [2, 32])
def test_links_equal_brute_force(spark, monkeypatch, max_bits, bucket):
    """Small buckets force the neighbour lookup; components are the same."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            flips = rng.sample(range(64), rng.choice((0, 1, 1, 2, 3)))
            fps.add(base ^ sum(1 << b for b in flips))
    want = brute_roots({signed(f) for f in fps}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(df, max_bits)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def below_broadcasts(plan):
    """Lines of a printed plan that stand below a broadcast."""
    found, inside = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if inside is not None and depth > inside:
            found.append(line)
        else:
            inside = depth if "BroadcastExchange" in line else None
    return found


@pytest.fixture
def plans(monkeypatch):
    """Final plans of what SimHash cuts off."""
    seen, cut = [], simhash.cut_lineage

    def spy(df):
        out = cut(df)
        seen.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return out
    monkeypatch.setattr(simhash, "cut_lineage", spy)
    return seen


@pytest.mark.parametrize("bucket", [2, 32])
def test_exploded_tables_are_not_broadcast(spark, monkeypatch, plans, bucket):
    """The size that Spark gives an exploded table is that of the rows before the explode."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = spark.createDataFrame([(f,) for f in range(200)], "fp long")
    simhash.cut_lineage(simhash.links(fps))
    exploded = [p for p in plans if "Generate explode" in p]
    assert len(exploded) == 2 and all("SortMergeJoin" in p for p in exploded)
    assert not any("Generate explode" in x for p in exploded for x in below_broadcasts(p))


def test_hard_cases_and_stage(spark, docs_frame):
    same = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, same), (3, same), (3, same), (None, same), (9, None), (8, ""), (7, " \n"), (None, "only null ids"),
            (None, "only null ids"), (1, "long " * 50_000 + "tail"), (2, "two words")]
    docs = docs_frame(rows)
    got = simhash.simhash_components(docs)
    assert got.count() == len(rows)
    by = {(r.doc_id, r.fp): r.component_id for r in got.collect()}
    fps = {signed(brute_fingerprint(t)) for _, t in rows}
    roots = brute_roots(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for i, t in rows:
        f = signed(brute_fingerprint(t))
        ids = [j for j, u in rows if roots[signed(brute_fingerprint(u))] == roots[f] and j is not None]
        assert by[i, f] == (min(ids) if ids else None)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert left == sorted([(3, same), (7, " \n"), (None, "only null ids"), (1, rows[9][1]), (2, "two words")], key=str)
    empty = docs.limit(0)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + k] == 1000 for k in range(60))
    assert len(got) == 41 + 60
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark, small_dir):
    from chainlake.llm.queries import QUERIES
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    roots = brute_roots(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = QUERIES["op9_simhash_near_dedup"](spark, small_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", roots[i]) for i, f in fps.items()}

"""Trigram search equals a regular expression over every url; ranks and parts; ranges of the block source."""

import random
import re

from pyspark.sql import functions as F

from chainlake.operators import registry as rg
from chainlake.operators import url_index as ui
from chainlake.operators.ranks import rank_in_groups
from chainlake.sources.block_source import BlockStreamReader, merge_ranges, register, subtract_ranges
from chainlake.sources.store_io import fresh_path
from chainlake.streaming import runners as sp

HOOK = "id string, customer_id string, url string, blockchain_id string, note string"
REQUEST = "request_id long, customer_id string, pattern string"


def _like(pattern):
    parts = (".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.compile(".*" + "".join(parts) + ".*", re.S)


def _brute(hooks, requests):
    out = set()
    for rid, customer, pattern in requests:
        for hid, owner, url, *_ in hooks:
            if customer is not None and owner == customer and hid is not None:
                if not pattern or (url is not None and _like(pattern).fullmatch(url.lower())):
                    out.add((rid, hid))
    return out


def _random_tables(seed):
    rnd = random.Random(seed)

    def text(n):
        return "".join(rnd.choice("abAB/\\é") for _ in range(rnd.randrange(n)))
    hooks = [(str(i), rnd.choice(["x", "y", None]), rnd.choice([text(12), text(40), None, ""]), "c", "n")
             for i in range(150)]
    requests = []
    for i in range(200):
        url = rnd.choice(hooks)[2] or "abAB"
        a = rnd.randrange(len(url) + 1)
        piece = url[a:a + rnd.randrange(1, 9)]
        if rnd.random() < .4:
            piece = "".join(rnd.choice("%_" + c) if rnd.random() < .3 else c for c in piece)
        requests.append((i, rnd.choice(["x", "y", "z", None]), rnd.choice([piece, piece.swapcase(), text(5), None])))
    return hooks, requests


def test_indexed_search_equals_every_row(spark):
    hooks, requests = _random_tables(3)
    w, r = spark.createDataFrame(hooks, HOOK), spark.createDataFrame(requests, REQUEST)
    index = ui.UrlIndex(spark, fresh_path(spark, "url-index"))
    index.add(w)
    index.add(w.where("id < '5'"))  # added twice: harmless
    stored = index.read()
    for rarest in (1, 3):
        got = [(x.request_id, x.id) for x in ui.search(stored, w, r, rarest).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(hooks, requests)
    assert ui.search(stored, w, r.where("false")).count() == 0


def test_stale_postings_and_one_search(spark):
    """A webhook that changed its url after indexing is found by its new pieces only; constants read few folders."""
    old = [("1", "x", "https://old.example", "c", ""), ("2", "x", "https://both.example", "c", "")]
    new = [("1", "x", "https://new.example", "c", ""), ("2", "x", "https://both.example", "c", "")]
    index = ui.UrlIndex(spark, fresh_path(spark, "url-index"))
    index.add(spark.createDataFrame(old, HOOK))
    w = spark.createDataFrame(new, HOOK)
    index.add(w)
    ask = [(1, "x", "OLD."), (2, "x", "new.ex"), (3, "x", "example"), (4, "y", "example")]
    got = {(x.request_id, x.id) for x in ui.search(index.read(), w, spark.createDataFrame(ask, REQUEST)).collect()}
    assert got == {(2, "1"), (3, "1"), (3, "2")}
    for rid, customer, pattern in [*ask, (5, "x", "w."), (6, "x", ""), (7, "x", "b%th.e_a")]:
        one = index.search_one(w, customer, pattern)
        assert {h.id for h in one.collect()} == {h for _, h in _brute(new, [(rid, customer, pattern)])}
    plan = index.search_one(w, "x", "new.")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_candidates_come_from_rare_pieces(spark):
    """'https' is in every url: a pattern with a rare piece meets the rows of that piece alone."""
    w = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("customer_id"),
                                 F.concat(F.lit("https://host/"), "id").alias("url"))
    index = ui.postings(w)
    ask = spark.createDataFrame([(1, "x", "https://host/1999")], REQUEST)
    assert [c.id for c in ui.candidates(index, ask, 2).collect()] == ["1999"]


def test_ranks_and_parts(spark):
    rows = [(g, f"{k:03x}") for g, n in (("big", 700), ("one", 1), (None, 60)) for k in range(n)]
    got = rank_in_groups(spark.createDataFrame(rows, "g string, k string"), ["g"], "k").collect()
    assert len(got) == len(rows) and all(r["rank"] == int(r["k"], 16) for r in got)
    jobs = spark.createDataFrame([("r", "C", 0, f"{k:04d}") for k in range(120)] + [("r", "C", 1, "9")],
                                 "request_id string, chain_id string, shard_id int, webhook_id string")
    chains = spark.createDataFrame([("C", "rpc://c")], "id string, url string")
    parts = {(p.shard_id, p.part): p.ids.split(",") for p in rg.grouped_ids(jobs, chains).collect()}
    assert [len(parts[0, k]) for k in range(3)] == [50, 50, 20] and parts[1, 0] == ["9"]
    assert parts[0, 0] + parts[0, 1] + parts[0, 2] == [f"{k:04d}" for k in range(120)]


def test_ranges_are_sets():
    rnd = random.Random(1)
    for _ in range(300):
        sets = [{rnd.randrange(30) for _ in range(rnd.randrange(15))} for _ in range(2)]
        a, b = (merge_ranges([(h, h) for h in rnd.sample(sorted(s), len(s))]) for s in sets)

        def heights(ranges):
            return [h for lo, hi in ranges for h in range(lo, hi + 1)]
        assert heights(a) == sorted(sets[0]) and all(x[1] + 1 < y[0] for x, y in zip(a, a[1:]))
        assert heights(merge_ranges(a, b)) == sorted(sets[0] | sets[1])
        assert heights(subtract_ranges(a, b)) == sorted(sets[0] - sets[1])


def test_earlier_offsets_and_vanished_heights():
    class Fetcher:
        have = {"C": [(5, 9)]}

        def ranges(self):
            return self.have
    reader = BlockStreamReader(Fetcher(), {"heights_per_partition": "3"})
    parts = reader.partitions({"C": 6}, {"C": [[0, 9], [12, 12]]})  # one last height: all up to it
    assert [(p.lo, p.hi) for p in parts] == [(7, 9), (12, 12)]
    assert reader.latestOffset() == {"C": [[0, 9]]}  # 0 to 6 were handed out, whatever the fetcher lists now


def test_late_holes_are_fetched_once(spark):
    """Heights that appear below the head, also over a restart, are fetched; no height is fetched twice."""
    base = fresh_path(spark, "holes")

    def make(have):
        class Fetcher:
            def ranges(self):
                return {"C": have}

            def fetch(self, chain_id, lo, hi):
                for h in range(lo, hi + 1):
                    yield chain_id, h, f"b{h}"
        return lambda options: Fetcher()

    for have in ([(0, 3), (6, 9)], [(0, 4), (6, 9), (11, 12)], [(0, 12)]):
        register(spark, make(have))
        stream = spark.readStream.format("chainlake_blocks").option("heights_per_partition", "3").load()
        sp.run_available_now(stream, lambda df, bid: df.write.mode("append").parquet(f"{base}/out"), f"{base}/ckpt")
    assert sorted(r.block_height for r in spark.read.parquet(f"{base}/out").collect()) == list(range(13))


def test_equal_searches_are_answered_once(spark, monkeypatch):
    """One search asked by many: their ids meet its answer in lists over several parts, and no pair is shuffled."""
    monkeypatch.setattr(ui, "IDS", 4)
    hooks = [(str(i), "x", f"https://shop.example/hooks/{i}", "c", "") for i in range(60)]
    hooks.append(hooks[7])  # a webhook that comes twice is found twice
    requests = [(i, "x", p) for i in range(90) for p in [["SHOP.ex", "s/1", "7", None, "hooks/33"][i % 5]]]
    requests += [(i, "x", "only" + str(i)) for i in range(90, 95)]
    w, r = spark.createDataFrame(hooks, HOOK), spark.createDataFrame([*requests, *requests[:9]], REQUEST)
    index = ui.UrlIndex(spark, fresh_path(spark, "url-index"))
    index.add(w)
    df = ui.search(index.read(), w, r)
    want = sorted((rid, h[0]) for rid, _, p in requests for h in hooks if _like(p or "").fullmatch(h[2].lower()))
    assert sorted((x.request_id, x.id) for x in df.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ui.search(index.read(), w, r)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Generate explode(_ids" in plan.split("Exchange")[0]

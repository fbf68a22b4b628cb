"""Payload normalisation and strict documents on inputs the fixtures lack."""

import json

from chainlake.sources import payloads as pl

BIG = 2 ** 255 + 1


def test_evm_document_is_whole_and_exact(spark):
    tx = [{"to": "0x1", "nonce": "0xff", "value": BIG}, {"to": None, "nonce": 7, "value": hex(BIG), "extra": [1]}]
    full = {"number": 5, "hash": "0xh", "nonce": 2 ** 64 - 1, "miner": "0xm", "transactions": tx,
            "header": {"deep": {"n": BIG}}, "uncles": "not a list"}
    raw = [(json.dumps(full),), ('{"number":6}',), ("no json",), ("",), (None,)]
    rows = pl.normalize_evm_blocks(spark.createDataFrame(raw, "raw string").selectExpr("'c' AS chain_id", "raw")).collect()
    doc = json.loads(rows[0].block)
    assert sorted(doc) == sorted([f.name for f in pl.EVM_KEYS.fields] + list(pl.EVM_RAW_KEYS)) and len(doc) == 25
    assert doc["nonce"] == 2 ** 64 - 1 and doc["coinbase"] == "0xm" == rows[0].coinbase
    assert doc["transactions"] == tx and doc["header"] == full["header"]
    assert doc["uncles"] is None and doc["withdrawals"] is None and doc["size"] is None
    assert rows[0].n_transactions == 2
    assert rows[1].block_height == 6 and json.loads(rows[1].block)["transactions"] is None
    assert [r.block_height for r in rows[2:]] == [None, None, None]
    got = pl.explode_transactions(
        spark.createDataFrame(raw, "raw string").selectExpr("'c' AS chain_id", "raw")).orderBy("tx_index").collect()
    assert [(r.nonce, r.value) for r in got] == [("0xff", str(BIG)), ("7", hex(BIG))]


def test_strict_documents(spark):
    docs = ['{"chain_id":"a","block_height":7,"block":""}', '{"chain_id":5,"block_height":"7","block":"x"}',
            '{"chain_id":"a","block_height":7.5,"block":null}', '{"chain_id":"a","block_height":1,"block":"x","y":1,"z":2}',
            "[1]", "", None, '{"chain_id":"a","block_height":99999999999999999999,"block":"x"}']
    got = pl.enforce_schema(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")).orderBy("i").collect()
    assert [r.reason for r in got[:4]] == [
        None, "bad type for chain_id; bad type for block_height", "bad type for block_height; bad type for block",
        "extra properties: y,z"]
    assert (got[0].chain_id, got[0].block_height, got[0].block) == ("a", 7, "")
    assert all(r.reason.startswith("not a JSON object") for r in got[4:7])
    assert got[7].reason == "bad type for block_height"

"""Chain payload and message formats: parse with explicit schemas (never
inference), keep the block document as a JSON string, read fields on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of the EVM block document with their types.  Header,
# transactions, uncles and withdrawals stay raw JSON text, so that unknown
# keys and numbers of any size survive.
_EVM_LONGS = ("blobGasUsed", "excessBlobGas", "gasLimit", "gasUsed", "number", "size", "time")
_EVM_TYPES = {**dict.fromkeys(_EVM_LONGS, T.LongType()), "nonce": T.DecimalType(20, 0)}  # all others are strings
EVM_KEYS = T.StructType([T.StructField(k, _EVM_TYPES.get(k, T.StringType())) for k in (
    "receivedAt", "baseFee", "blobGasUsed", "bloom", "coinbase", "difficulty", "excessBlobGas", "extra", "gasLimit",
    "gasUsed", "hash", "mixDigest", "nonce", "number", "parentHash", "receiptHash", "root", "size", "time", "txHash",
    "uncleHash")])
EVM_RAW_KEYS = {"header": "{", "transactions": "[", "uncles": "[", "withdrawals": "["}
EVM_SCHEMA = T.StructType([*[T.StructField(f.name, T.StringType() if f.name == "number" else f.dataType) for f in EVM_KEYS.fields], *[T.StructField(k, T.StringType()) for k in EVM_RAW_KEYS],
                           T.StructField("miner", T.StringType())])  # some nodes call the coinbase so

FLOW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("height", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("collection_ids", T.ArrayType(T.StructType([T.StructField("collection_id", T.StringType())]))),
    T.StructField("seals", T.ArrayType(T.StructType([T.StructField("block_id", T.StringType()),
                                                     T.StructField("execution_receipt_id", T.StringType())]))),
])

# Envelope of a block message on the ingest stream.
BLOCK_MESSAGE_SCHEMA = T.StructType([
    T.StructField("Height", T.LongType()),
    T.StructField("Block", T.StringType()),
])

BLOCK_SCHEMA = T.StructType([
    T.StructField("chain_id", T.StringType(), False),
    T.StructField("block_height", T.LongType(), False),
    T.StructField("block", T.StringType(), False),
])


def _raw_or_null(text: Column, opening: str) -> Column:
    """Raw JSON of the expected kind (object or array); JSON null otherwise."""
    return F.when(F.startswith(text, F.lit(opening)), text).otherwise(F.lit("null"))


def block_number(text: Column) -> Column:
    """A height in decimal or 0x form as BIGINT; null if it is neither or does not fit."""
    hexadecimal = F.conv(F.substr(text, F.lit(3)), 16, 10)  # 16 digits at most, so nothing is cut
    return (F.when(text.rlike(r"^0[xX][0-9a-fA-F]{1,16}$"), hexadecimal.try_cast("bigint"))
            .when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint")))


def flow_time(text: Column) -> Column:
    """Block time as TIMESTAMP: ISO form (any fraction, Z or offset) or ``date time[.fraction] +0000 UTC``.
    Microseconds are kept; the document keeps the text with all its digits."""
    iso = F.regexp_replace(text, r"^(\S+) (\S+) ([+-]\d\d):?(\d\d)( .*)?$", "$1T$2$3:$4")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), iso.try_cast("timestamp"))


def split_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(blocks, rejected)``: rows that a store can hold, and the others with a ``reason``."""
    reason = (F.when(F.col("chain_id").isNull(), "no chain").when(F.col("block_height").isNull(), "no height")
              .when(F.col("block").isNull(), "no document"))
    return rows.where(reason.isNull()), rows.where(reason.isNotNull()).withColumn("reason", reason)


def normalize_evm_blocks(raw: DataFrame, chain_id: Column | str = "chain_id", raw_col: str = "raw") -> DataFrame:
    """EVM payloads -> store rows: height = ``number``, decimal or 0x; ``block`` is the whole
    document with every key (null where the payload has none), transactions
    included.  A payload that is not JSON gives null fields (``split_blocks`` rejects it)."""
    chain = F.col(chain_id) if isinstance(chain_id, str) else chain_id
    p = raw.select(chain.alias("chain_id"), F.from_json(F.col(raw_col), EVM_SCHEMA).alias("p"))
    field = {f.name: F.col(f"p.{f.name}") for f in EVM_KEYS.fields}
    field["number"] = block_number(F.col("p.number"))
    field["coinbase"] = F.coalesce("p.coinbase", "p.miner")
    scalars = F.to_json(F.struct(*[c.alias(k) for k, c in field.items()]), {"ignoreNullFields": "false"})
    doc = F.concat(F.rtrim(scalars, F.lit("}")), *[
        F.concat(F.lit(f',"{k}":'), _raw_or_null(F.col(f"p.{k}"), opening)) for k, opening in EVM_RAW_KEYS.items()],
        F.lit("}"))
    return p.select(
        "chain_id", field["number"].alias("block_height"), F.col("p.hash").alias("hash"),
        F.col("p.parentHash").alias("parent_hash"), F.col("p.time").alias("time"),
        F.col("p.gasUsed").alias("gas_used"), F.col("p.gasLimit").alias("gas_limit"),
        field["coinbase"].alias("coinbase"),
        F.json_array_length("p.transactions").cast("bigint").alias("n_transactions"), doc.alias("block"))


def normalize_flow_blocks(raw: DataFrame, chain_id: Column | str = "chain_id", raw_col: str = "raw") -> DataFrame:
    """Flow payloads -> store rows with collection ids and seals kept."""
    chain = F.col(chain_id) if isinstance(chain_id, str) else chain_id
    p = raw.select(chain.alias("chain_id"), F.from_json(F.col(raw_col), FLOW_SCHEMA).alias("p"))
    return p.select(
        "chain_id", F.col("p.height").alias("block_height"), F.col("p.id").alias("id"),
        F.col("p.parent_id").alias("parent_id"),
        flow_time(F.col("p.timestamp")).cast("timestamp_ntz").alias("ts"),
        F.col("p.status").alias("status"),
        F.array_join(F.transform("p.collection_ids", lambda c: c["collection_id"]), ",").alias("collection_ids"),
        F.size("p.seals").cast("bigint").alias("n_seals"),
        F.to_json(F.col("p"), {"ignoreNullFields": "false"}).alias("block"))


TX_SCHEMA = T.StructType([
    T.StructField("number", T.StringType()),
    T.StructField("transactions", T.ArrayType(T.StructType([
        T.StructField("to", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("nonce", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])


def explode_transactions(raw: DataFrame, chain_id: Column | str = "chain_id", raw_col: str = "raw") -> DataFrame:
    """One row per transaction with its index.  The payload is parsed once
    into typed structs (no re-serialisation and re-parsing per field).  Nonce
    and value keep the payload's own text, so hexadecimal and 256-bit numbers
    are exact; they are null only where the payload has none."""
    chain = F.col(chain_id) if isinstance(chain_id, str) else chain_id
    p = raw.select(chain.alias("chain_id"), F.from_json(F.col(raw_col), TX_SCHEMA).alias("p"))
    t = p.select("chain_id", block_number(F.col("p.number")).alias("block_height"),
                 F.posexplode("p.transactions").alias("tx_index", "tx"))
    return t.select("chain_id", "block_height", F.col("tx_index").cast("bigint").alias("tx_index"),
                    F.col("tx.to").alias("to_address"), F.col("tx.from").alias("from_address"),
                    F.col("tx.nonce").alias("nonce"), F.col("tx.value").alias("value"))


def append_message(blocks: DataFrame) -> DataFrame:
    """Block rows -> stream messages ``(chain_id, msg_id, data)`` where
    ``data`` is the JSON envelope ``{"Height":..,"Block":".."}``."""
    return blocks.select("chain_id", F.col("seq").alias("msg_id"),
                         F.to_json(F.struct(F.col("block_height").alias("Height"),
                                            F.col("block").alias("Block"))).alias("data"))


def parse_message(messages: DataFrame, schema: T.StructType = BLOCK_MESSAGE_SCHEMA) -> DataFrame:
    """Decode envelopes; a malformed envelope or a missing field keeps the
    raw text in ``_corrupt`` instead of failing the batch."""
    p = messages.withColumn("_p", F.from_json("data", schema))
    missing = None
    for f in schema.fields:
        cond = F.col(f"_p.{f.name}").isNull()
        missing = cond if missing is None else (missing | cond)
    cols = [F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]
    keep = [c for c in messages.columns if c != "data"]
    return p.select(*keep, *cols, F.when(missing, F.col("data")).alias("_corrupt"))


# JSON types, as a parsed value reports them, that a column type accepts
JSON_TYPES = {"string": r"^STRING$", "bigint": r"^BIGINT$", "int": r"^BIGINT$", "smallint": r"^BIGINT$", "tinyint": r"^BIGINT$",
              "boolean": r"^BOOLEAN$", "double": r"^(BIGINT|DOUBLE|DECIMAL)", "float": r"^(BIGINT|DOUBLE|DECIMAL)",
              "decimal": r"^(BIGINT|DECIMAL)", "date": r"^STRING$", "timestamp": r"^STRING$", "timestamp_ntz": r"^STRING$",
              "array": r"^ARRAY<", "map": r"^OBJECT<", "struct": r"^OBJECT<", "variant": r"."}


def _json_type(f: T.StructField) -> str:
    kind = f.dataType.typeName()
    name = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}.get(kind, kind)
    if name not in JSON_TYPES:
        raise ValueError(f"no JSON value has the type {f.dataType.simpleString()} of field {f.name}")
    return JSON_TYPES[name]


def enforce_schema(docs: DataFrame, schema: T.StructType = BLOCK_SCHEMA, doc_col: str = "doc") -> DataFrame:
    """Strict document validation: required fields, fixed JSON types (a quoted
    number is a string, never an integer), no extra properties.  Adds
    ``reason`` (null when valid) and the typed fields."""
    m = F.from_json(F.col(doc_col), "map<string, variant>")
    d = docs.withColumn("_m", m)
    allowed = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.array_except(F.map_keys("_m"), allowed)
    checks = [F.when(F.col("_m").isNull(), F.lit("not a JSON object"))]
    typed = []
    for f in schema.fields:
        v, kind = F.col("_m")[f.name], f.dataType.simpleString()
        tv = F.when(F.schema_of_variant(v).rlike(_json_type(f)), F.try_variant_get(v, "$", kind))
        checks.append(F.when(v.isNull(), F.lit(f"missing field {f.name}")))
        checks.append(F.when(v.isNotNull() & tv.isNull(), F.lit(f"bad type for {f.name}")))
        typed.append(tv.alias(f.name))
    checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("extra properties: "), F.array_join(F.array_sort(extra), ","))))
    reasons = F.filter(F.array(*checks), lambda x: x.isNotNull())
    keep = [c for c in docs.columns if c != doc_col]
    return d.select(*keep, *typed, F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).alias("reason"))

"""Delivery rounds with idempotent cursors (no MERGE needed).

One round = up to ``window`` ordered requests of each job that is due (new
ones, or ``next_height < head``); they are written to the outbox with bodies
that are built once per distinct range, handed to the sender, and a prefix
scan over its answers decides how far each cursor moves.  Outbox, attempts and
cursor snapshots are folders keyed by ``round_id`` that a replay replaces.
The current cursor of a webhook is the snapshot row with the highest round id
(``max_by``); a null ``next_height`` says that the job has left.
``compact_rounds`` folds old snapshots into one base so reads stay small.

A cursor moves only on a reported success, on a skip, or past evicted blocks.
The first failed request of a job stays where it is and is counted under its
own ``(webhook_id, next_height, is_new)``, so a skip or a success starts at
zero; what lies behind it is asked again in a later round.

``webhooks``, ``blocks`` and ``heads`` are DataFrames or functions that
return one; a function is called in every round, so that a long-running relay
sees what arrived since (a Parquet DataFrame keeps its list of files).

A round is one distributed job over all webhooks; the loop only decides how
many rounds to run (a trigger), it never touches individual jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators import delivery as dv
from chainlake.operators.windows import advance, request_window
from chainlake.session import ensure_checkpoint_dir

CURSOR_SCHEMA = T.StructType([
    T.StructField("webhook_id", T.StringType()),
    T.StructField("chain_id", T.StringType()),
    T.StructField("next_height", T.LongType()),
    T.StructField("is_new", T.BooleanType()),
    T.StructField("round_id", T.LongType()),
])


ATTEMPT_SCHEMA = T.StructType([
    T.StructField("webhook_id", T.StringType()),
    T.StructField("next_height", T.LongType()),
    T.StructField("is_new", T.BooleanType()),
    T.StructField("failures", T.LongType()),
    T.StructField("round_id", T.LongType()),
])
JOB = ["webhook_id", "next_height", "is_new"]


def _now(source) -> DataFrame:
    return source() if callable(source) else source


def _write_round(df: DataFrame, path: str, round_id: int) -> None:
    """Replace the folder of one round, also by an empty one."""
    df.drop("round_id").write.mode("overwrite").parquet(f"{path}/round_id={round_id}")


def _fs(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def init_cursors(jobs: DataFrame, path: str) -> None:
    """Seed snapshot (round -1) from a jobs table."""
    _write_round(jobs.select("webhook_id", "chain_id", "next_height", "is_new"), path, -1)


def current_cursors(spark: SparkSession, path: str, before_round: int | None = None) -> DataFrame:
    """Newest snapshot row per webhook (only rounds before ``before_round``:
    a round never reads its own output, so re-running it is idempotent).
    Jobs that have left are not listed."""
    c = spark.read.schema(CURSOR_SCHEMA).parquet(path)
    if before_round is not None:
        c = c.where(F.col("round_id") < before_round)  # partition filter
    return (c.groupBy("webhook_id")
            .agg(F.max_by(F.struct("chain_id", "next_height", "is_new"), "round_id").alias("c"))
            .select("webhook_id", "c.*").where(F.col("next_height").isNotNull()))


def message_failures(spark: SparkSession, path: str, before_round: int) -> DataFrame:
    """Failed sends of each message ``(webhook_id, next_height, is_new, failures)``."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return spark.createDataFrame([], ATTEMPT_SCHEMA).drop("round_id")
    return (spark.read.schema(ATTEMPT_SCHEMA).parquet(path).where(F.col("round_id") < before_round)
            .groupBy(*JOB).agg(F.sum("failures").alias("failures")))


def _fold(spark: SparkSession, path: str, base_round: int, rows: DataFrame) -> None:
    ensure_checkpoint_dir(spark)
    _write_round(rows.checkpoint(eager=True), path, base_round)
    fs, root = _fs(spark, path)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("round_id=") and int(name.split("=", 1)[1]) < base_round:
            fs.delete(status.getPath(), True)


def compact_cursors(spark: SparkSession, path: str, base_round: int) -> None:
    """Fold every snapshot into the folder of ``base_round`` (the last
    completed round) and then drop the older ones.  Readers take the newest
    round per webhook, so every intermediate state reads the same cursors."""
    _fold(spark, path, base_round, current_cursors(spark, path, before_round=base_round + 1))


def compact_rounds(spark: SparkSession, cursor_path: str, attempts_path: str, base_round: int) -> None:
    """``compact_cursors``, and the attempts of messages that are still current.
    The attempts go first: they need the cursors of the same rounds."""
    fs, root = _fs(spark, attempts_path)
    if fs.exists(root):
        current = current_cursors(spark, cursor_path, before_round=base_round + 1).select(*JOB)
        _fold(spark, attempts_path, base_round,
              message_failures(spark, attempts_path, base_round + 1).join(current, JOB, "left_semi"))
    compact_cursors(spark, cursor_path, base_round)


def run_round(spark: SparkSession, round_id: int, cursor_path: str, outbox_path: str, webhooks, blocks, heads,
              send=None, attempts_path: str | None = None, mode: str = "reference", skip_evicted: bool = False,
              window: int = 1) -> bool:
    """One delivery round; tells whether it moved a cursor or counted a failure.

    ``send(outbox) -> DataFrame(webhook_id, seq, delivered)`` delivers the
    requests of the round, those of a webhook by ``seq`` (``runners.ordered_sender``
    does so); a request that it does not report counts as failed.  ``seq`` may
    be left out where ``window`` is 1.  Without ``send`` the outbox is the
    boundary and a request counts as delivered once it is written there.
    """
    attempts_path = attempts_path or f"{outbox_path}__attempts"
    ensure_checkpoint_dir(spark)
    w, b = _now(webhooks), _now(blocks)
    h = _bounds(_now(heads), b).checkpoint(eager=True)  # one row per chain, used many times
    jobs = current_cursors(spark, cursor_path, before_round=round_id)
    ready = (dv.due_jobs(jobs, h).where(F.col("is_new") | (F.col("state") == "ready"))
             .select("webhook_id", "chain_id", "next_height", "is_new"))
    ready = ready.checkpoint(eager=True)
    if ready.isEmpty():  # the folders of the round, without its plan
        for schema, path in ((_outbox_schema(w), outbox_path), (ATTEMPT_SCHEMA, attempts_path), (CURSOR_SCHEMA, cursor_path)):
            _write_round(spark.createDataFrame([], schema), path, round_id)
        return False
    failures = (message_failures(spark, attempts_path, round_id).join(jobs.select(*JOB), JOB)
                .select("webhook_id", F.col("failures").cast("int").alias("failures")))
    # what the round does not need is left out of its plan: the driver compiles every branch, empty or not
    new_jobs = not ready.where("is_new").isEmpty()
    gaps = not h.where("n_blocks is null or n_blocks <> head - low + 1").isEmpty()
    # a few columns per request; one evaluation feeds all writes
    steps = request_window(ready, w, b, h, failures, window, mode, skip_evicted, gaps).checkpoint(eager=True)
    _write_round(_outbox(steps, w, b, h, mode, new_jobs), outbox_path, round_id)
    answers = None
    if send is not None:
        answers = send(spark.read.parquet(f"{outbox_path}/round_id={round_id}"))
        if "seq" not in answers.columns:
            if window != 1:
                raise ValueError("the sender must report the seq of each request")
            answers = answers.withColumn("seq", F.lit(0))
        answers = answers.select("webhook_id", "seq", "delivered").checkpoint(eager=True)  # requests are sent once
    moves, failed = advance(steps, answers)
    _write_round(failed, attempts_path, round_id)
    _write_round(moves, cursor_path, round_id)
    written = spark.read.schema(CURSOR_SCHEMA).parquet(f"{cursor_path}/round_id={round_id}")
    # a job that left has a null cursor, which no earlier row equals
    return not (written.join(jobs, JOB, "left_anti").isEmpty()
                and spark.read.parquet(f"{attempts_path}/round_id={round_id}").isEmpty())


def _bounds(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """``heads`` with the number of stored blocks of each chain."""
    if "n_blocks" in heads.columns:
        return heads.select("chain_id", "head", "low", "n_blocks")
    counted = blocks.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return heads.select("chain_id", "head", "low").join(F.broadcast(counted), "chain_id", "left")


def _outbox_schema(webhooks: DataFrame) -> T.StructType:
    shard = [f.dataType.simpleString() for f in webhooks.schema.fields if f.name == "shard_id"]
    hook = {f.name: f.dataType.simpleString() for f in webhooks.schema.fields}
    return T.StructType.fromDDL(
        "webhook_id string, seq int, first_height bigint, last_height bigint, n_blocks bigint, "
        f"url {hook['url']}, timeout_ms {hook['timeout_ms']}, " + "".join(f"shard_id {t}, " for t in shard) + "body string")


def _outbox(steps: DataFrame, webhooks: DataFrame, blocks: DataFrame, heads: DataFrame, mode: str,
            new_jobs: bool) -> DataFrame:
    """``(webhook_id, seq, first_height, last_height, n_blocks, url, timeout_ms, body)`` of the requests of ``steps``."""
    asked = (steps.where(F.col("outcome") == "deliver")
             .withColumn("lo", F.when(F.col("is_new"), F.lit(0).cast("bigint")).otherwise(F.col("first_height")))
             .withColumn("hi", F.when(F.col("is_new"), F.col("batch")).otherwise(F.col("last_height")))
             .select("webhook_id", "seq", *dv.RANGE))
    shard = [c for c in ("shard_id",) if c in webhooks.columns]
    hooks = webhooks.select(F.col("id").alias("webhook_id"), "url", "timeout_ms", *shard)
    # the bodies come last: they meet their requests and are written, and are in no later shuffle
    return dv.join_bodies(asked.join(hooks, "webhook_id"), dv.range_bodies(asked, blocks, heads, mode, new_jobs)).select(
        "webhook_id", "seq", "first_height", "last_height", "n_blocks", "url", "timeout_ms", *shard, "body")


def run_rounds(spark: SparkSession, n_rounds: int, cursor_path: str, outbox_path: str, webhooks, blocks, heads,
               start_round: int = 0, **options) -> None:
    for r in range(start_round, start_round + n_rounds):
        run_round(spark, r, cursor_path, outbox_path, webhooks, blocks, heads, **options)


def run_until_idle(spark: SparkSession, cursor_path: str, outbox_path: str, webhooks, blocks, heads,
                   start_round: int = 0, compact_every: int | None = None, **options) -> int:
    """Rounds until one neither moves a cursor nor counts a failure; returns how many were run.
    Without failures that is the longest backlog in requests over ``window``, and one round that finds nothing.
    With ``compact_every``, snapshots are folded after so many rounds, so that a long run does not list them all."""
    attempts_path = options.get("attempts_path") or f"{outbox_path}__attempts"
    r = start_round
    while run_round(spark, r, cursor_path, outbox_path, webhooks, blocks, heads, **options):
        r += 1
        if compact_every and (r - start_round) % compact_every == 0:
            compact_rounds(spark, cursor_path, attempts_path, r - 1)
    return r + 1 - start_round


def relay_stream(spark: SparkSession, cursor_path: str, outbox_path: str, webhooks, blocks, heads,
                 checkpoint: str, interval: str = "1 second", compact_every: int = 100, **options):
    """The relay as a streaming query: every trigger runs one round whose id
    is the micro-batch id.  A batch replayed after a failure re-runs the
    same round, which replaces the same outbox and cursor folders.  Pass
    functions for ``webhooks``, ``blocks`` and ``heads`` to see new rows."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_df, batch_id: int) -> None:
        run_round(spark, batch_id, cursor_path, outbox_path, webhooks, blocks, heads, **options)
        if batch_id % compact_every == compact_every - 1:
            # up to the round before: this one may still be replayed
            compact_rounds(spark, cursor_path, options.get("attempts_path") or f"{outbox_path}__attempts", batch_id - 1)

    return (ticks.writeStream.trigger(processingTime=interval).foreachBatch(tick)
            .option("checkpointLocation", checkpoint).start())

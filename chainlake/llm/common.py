"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source files to the Python workers, once per application.

    They travel through Spark itself; nothing is read from a driver folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="chainlake-"), "chainlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id BIGINT, text BINARY): the two columns that the text operators read.

    Every other column, whatever its name, is left out; a null text becomes
    empty; a null id stays null.  Text travels as UTF-8 bytes, so the Python
    side never decodes it twice.
    """
    ship_package(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def text_key(col: Column) -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is planned as a sort-merge join, neither side broadcast.

    An exploded table is sized like the rows before the explode, so Spark (and
    adaptive execution, from the measured size of those rows) would send one
    that is many times its broadcast limit through the driver.
    """
    return side.hint("merge")


def until_stable(step: Callable[[DataFrame], DataFrame], state: DataFrame,
                 max_rounds: int = 100) -> DataFrame:
    """Repeat ``step`` until the rows of ``state`` no longer change.

    A round's rows are compared by their count and two sums of row hashes, one
    small aggregate each.  ``max_rounds`` only guards against a fault: passing
    it raises, it never returns an unfinished state.
    """
    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64(*df.columns)
        return tuple(df.agg(F.count(F.lit(1)), F.sum((h % 1000003).cast("decimal(38,0)")),
                            F.sum(F.shiftright(h, 20).cast("decimal(38,0)"))).first())

    seen = digest(state)
    for _ in range(max_rounds):
        state = cut_lineage(step(state))
        now = digest(state)
        if now == seen:
            return state
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

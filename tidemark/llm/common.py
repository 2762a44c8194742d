"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six white-space characters at which words end, as a Java and DuckDB character class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with as many underscores added as it needs to be new to the table."""
    taken = {c.lower() for c in df.columns}
    result = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        result.append(name)
    return result


def quoted(name: str) -> Column:
    """A column by its exact name, also one with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names]


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; repeats and order stay."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def bit_set(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap is set; false where there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int"))
    return F.coalesce(F.lit(1).bitwiseAND(bit) == 1, F.lit(False))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a short ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, i:
        CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def python_ready(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Limit what Spark hands to a Python worker at once, since texts can be long, and see that workers
    find this package: a cluster that does not have it installed or on its path gets it as a zip file."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = "spark.sql.execution.arrow." + key
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    package = Path(__file__).resolve().parents[1]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if package.parent in known or "site-packages" in package.parts:
        return
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        with tempfile.TemporaryDirectory() as folder:
            archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
            context.addPyFile(archive)


def join_with_large_keys(
    rows: DataFrame, table: DataFrame, key: str, count: str, total: int, share: int = 1000
) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` that has each key once and, in ``count``, how many
    rows have it. Keys with a ``1 / share`` of all ``total`` rows or more are at most ``share`` and are
    joined by broadcast, so that no task gets all rows of a frequent key; the others shuffle."""
    large = table.filter(F.col(count) * share >= total).drop(count)
    rest = table.filter(F.col(count) * share < total).drop(count)
    at_once = rows.join(F.broadcast(large), key)
    others = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(rest, key)
    return at_once.unionByName(others)

"""What the corpus operators share: reading, checkpoints, words and packed arrays."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import saved as saved
from sieveline.session import shared_dir as shared_dir

#: Upper to lower case, ASCII only; bytes of other letters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The same, and every character that no alphanumeric word holds becomes a space.
ALNUM = bytes(
    b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: The separators of plain words, as SQL regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, added: str) -> T.StructType:
    """The schema of the frame with more columns, given as DDL; the frame's own schema stays."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that a task holds the Python objects of one piece at a time.

    At the end free memory goes back to the system: a worker outlives its tasks, beside those of other stages.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def bucket_of(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII blanks 0x09-0x0D and 0x20."""
    # bytes.split() without argument splits at exactly these six bytes.
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, compressed byte plane by byte plane; sorted ones should come as differences."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as packed differences."""
    return pack(np.diff(values.astype("<u8"), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype="<u8")


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in this order (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype="<u8")
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

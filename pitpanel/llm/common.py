"""Helpers that the text operators share: reading tables, shared scratch tables, bounded membership bitmaps."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, local mode takes a temporary folder of this machine and a cluster takes the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="pitpanel-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/pitpanel"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the files of tables that materialize wrote and that nothing will read any more."""
    for path in {f._scratch for f in frames if f is not None and hasattr(f, "_scratch")}:
        spark = frames[0].sparkSession if frames[0] is not None else SparkSession.active()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows and bytes that a Python task works on at once.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 22


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept_for(operator: str | None) -> dict:
    """What this worker keeps for an operator; what it kept for others goes, as a worker serves one operator after another."""
    for name in [k for k in _KEPT if k != operator]:
        del _KEPT[name]
    return _KEPT.setdefault(operator, {}) if operator else {}


def sliced(batches, operator: str | None = None):
    """Record batches in slices of about SLICE_ROWS rows or SLICE_BYTES, so what a task holds besides is bounded by those and one text."""
    kept_for(operator)
    for batch in batches:
        step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names made from those wanted that are not taken, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Copies of a repeated row that one array holds.
COPIES = 1 << 16


def with_copies(rows: DataFrame, copies: str, name: str) -> DataFrame:
    """rows as often as the column `copies` says (1 or more), numbered from 0 in a new column; no array holds more than COPIES numbers."""
    (block,) = free_names([*rows.columns, name], "block")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES).cast("long")))
    first = F.col(block) * COPIES
    return rows.withColumn(block, blocks).withColumn(name, F.explode(F.sequence(first, F.least(first + COPIES, F.col(copies)) - 1))).drop(block)


def normalize_case(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The array of words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: inside a higher-order function a variable stands for it."""
    return F.transform(F.array(value), body)[0]


BITMAP_BITS = 1 << 24


def bitmap_of(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap (uint64 words) in which the bit key mod bits is set for every long in column key.

    Of fixed size whatever the input: at most bits / 64 rows reach the driver. Testing a key against it never
    gives a false no; a false yes only sends a row on to the exact join that follows.
    """
    bit = f"pmod(`{key}`, {bits}L)"
    rows = (
        keys.filter(F.col(key).isNotNull())
        .selectExpr(f"shiftright({bit}, 6) AS word", f"shiftleft(1L, CAST({bit} & 63 AS INT)) AS val")
        .groupBy("word")
        .agg(F.bit_or("val").alias("val"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["val"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be in the set."""
    bit = keys.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, from one running sum of a polynomial over the bytes."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_bytes(text: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(text, np.uint8)]

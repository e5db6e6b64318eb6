"""Shared pieces: reading tables, shared folders, and vectorized words over Arrow text columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master, whose one process is driver and executor, may do without: it takes a folder under /tmp.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or "/tmp/specloom-checkpoints")
    return context.getCheckpointDir()


BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold about so many bytes at most: texts are long, and a worker keeps what it once took.

    Rows of one batch are of no consequence to any result, so the setting may stay.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: later jobs survive lost executors and repeat nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut, as a table of Parquet files. Of these the planner knows the true size, while a checkpoint keeps the estimate of
    its plan, whose digits double with each join of a table with itself: a loop of such joins fills the driver with them."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def row_key() -> Column:
    """64 bits that tell rows of one doc_id apart by their text; rows without a doc_id too."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def few(df: DataFrame, width: int) -> DataFrame:
    """df, for all tasks if its rows of about width bytes are few."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def without(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """documents but those that rows (doc_id, row_key) names; a row of another text, or without a doc_id, is another row."""
    rows = cut(rows.select(F.col("doc_id").cast("long").alias("_id"), F.col("row_key").alias("_row")).distinct())
    own = F.xxhash64(F.col("d.doc_id").cast("long"), F.col("d.text")) == F.col("gone._row")
    return documents.alias("d").join(few(rows.alias("gone"), 24), own & F.col("d.doc_id").cast("long").eqNullSafe(F.col("gone._id")), "left_anti")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def crc_bucket(id_column: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names hold: dots, spaces, backticks."""
    return [named(c) for c in df.columns]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sampled(df: DataFrame, by: str, rows: int, *key: str) -> DataFrame:
    """About rows rows of df, chosen by a hash of key: of each value of by its share of rows, though a tenth of rows for a
    rare one if it has as many. The values of by are few, and none goes without rows."""
    sizes = df.groupBy(by).count()
    held = F.sum("count").over(Window.partitionBy())  # one row for each value of by
    share = F.least(F.lit(1.0), F.greatest(F.lit(rows) / held, F.lit(rows / 10) / F.col("count")))
    shares = sizes.select(F.col(by).alias("_by"), share.alias("_share"))
    drawn = F.xxhash64(*key) / F.lit(2.0**64) + 0.5
    return df.join(F.broadcast(shares), F.col(by) == F.col("_by")).filter(drawn < F.col("_share")).drop("_by", "_share")


def labelled_sample(labels: DataFrame, column: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """doc_id and label (0 or 1) of about rows labelled ids outside the held-out bucket; small enough to broadcast.

    Of an id with several labels the largest counts.
    """
    known = labels.filter(F.col(column).isNotNull() & (crc_bucket("doc_id", modulus) != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(column) > 0).cast("int")).cast("double").alias("label"))
    return sampled(known, "label", rows, "doc_id")


def one_text(sample: DataFrame, *others: str) -> DataFrame:
    """One row for each doc_id of a bounded sample (doc_id, text, others): the text of smallest hash, then in order of text."""
    return sample.groupBy("doc_id", *others).agg(F.min(F.struct(F.xxhash64("text"), F.col("text").alias("text"))).alias("t")).select("doc_id", *others, "t.text")


def held_out(modulus: int, bucket: int) -> Column:
    return F.coalesce(crc_bucket("doc_id", modulus) == bucket, F.lit(False))


def _byte_table(is_word) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        out[b] = low + 1 if is_word(low) else 0
    return out


#: Byte to 1 + lower-cased byte, or 0 for a separator. UTF-8 bytes of 0x80 and up belong to words in both.
SPACED = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _byte_table(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without making Python strings; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _piece(values: np.ndarray, breaks: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one piece; a word ends at a separator and at each of breaks. After each word's
    hash come those of its first bytes, one for each length of prefixes; 0 where the word isn't longer than that."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = values > 0
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    edge[0] = edge[n] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    start, end = np.flatnonzero(word & (before | edge[:-1])), np.flatnonzero(word & (after | edge[1:]))
    power, inverse = _power_tables(n)
    term = values * power[:n]
    total = np.cumsum(term)
    until = lambda last: mix((total[last] - total[start] + term[start]) * inverse[start])
    if not prefixes:
        return until(end), start
    beginnings = [np.where(start + k <= end, mix(until(np.minimum(start + k - 1, end)) + np.uint64(k)), np.uint64(0)) for k in prefixes]
    return np.stack([until(end), *beginnings], axis=1).ravel(), start


def word_hashes(data: np.ndarray, offsets: np.ndarray, bytes_to: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Yields (first row, row after the last, hashes of their words, bounds of each row's words).

    A hash is 64 bits of the lower-cased word (A-Z only); prefixes adds hashes to each word, as _piece states. Rows come in runs of about CHUNK_BYTES; a longer
    text is hashed in pieces that end at a separator, so scratch memory doesn't grow with it.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[last])
        if b - a <= 2 * CHUNK_BYTES:
            inner = offsets[row : last + 1] - a
            hashes, start = _piece(bytes_to[data[a:b]], inner, prefixes)
            yield row, last, hashes, np.searchsorted(start, inner) * (1 + len(prefixes))
        else:
            parts = []
            while a < b:
                stop = min(b, a + CHUNK_BYTES)
                while stop < b and bytes_to[data[stop]]:
                    stop += 1
                parts.append(_piece(bytes_to[data[a:stop]], np.zeros(0, np.int64), prefixes)[0])
                a = stop
            hashes = np.concatenate(parts)
            yield row, last, hashes, np.array([0, len(hashes)])
        row = last


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; with fewer words, one hash of all of them; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = hashes[: n - width + 1].copy()
    for j in range(1, width):
        out = mix(out * np.uint64(_BASE)) + hashes[j : n - width + 1 + j]
    return mix(out + np.uint64(width))


def hash_words_of(text: str | None, bytes_to: np.ndarray) -> np.ndarray:
    data, offsets = text_buffers(pa.array([text], pa.string()))
    return np.concatenate([h for _, _, h, _ in word_hashes(data, offsets, bytes_to)] or [np.zeros(0, np.uint64)])

"""Benchmark decontamination with an FM-index per training shard (operator 4).

A task cuts its documents into shards of SHARD_WORDS words or, as each shard is searched for the whole benchmark, a quarter
of the benchmark's, but at most MOST_SHARD_WORDS (an index takes about 100 bytes a word while it is built). Of each shard it builds an FM-index over word
symbols (suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions), searches all
benchmark windows backwards at once, locates the occurrences and merges them into spans to remove. A document lies in
one shard, so nothing is shuffled. The alphabet is the benchmark's words; each other word, and each end of a document,
is a break that no window crosses.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import kit
from specloom.llm.warc import store_of

SHARD_WORDS, MOST_SHARD_WORDS = 250_000, 2_000_000
PHRASE_BYTES = 2 << 20
SAMPLE_EVERY = 8


class WaveletMatrix:
    """Rank of a symbol in a sequence of small integers, for arrays of symbols and positions."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, current = bits, [], sequence
        for level in range(bits - 1, -1, -1):
            ones = (current >> level) & 1 == 1
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((level, words, before, len(ones) - int(before[-1])))
            current = np.concatenate((current[~ones], current[ones]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position at."""
        start = np.zeros_like(at)
        for level, words, before, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b = self._ones(words, before, start), self._ones(words, before, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Sorted starts of all suffixes. 0 is a break: any two differ and sort by position, before all words.

    The first key packs as many symbols as fit; ties then double their length by rank, unresolved ones only.
    """
    n, packed = len(symbols), max(1, 62 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(min(packed, n)):
        ahead = np.zeros(n, np.int64)
        ahead[: n - j] = symbols[j:]
        key = (key << bits) | np.where(open_, ahead, 0)
        open_ &= ahead > 0
    order = np.argsort(key, kind="stable")
    tie = np.zeros(n, bool)  # as the one before it in order; suffixes with a break are settled by position
    tie[1:] = (key[order[1:]] == key[order[:-1]]) & open_[order[1:]]
    group = np.arange(n)
    group[tie] = 0
    group = np.maximum.accumulate(group)
    rank = np.empty(n, np.int64)
    rank[order] = group
    width = packed
    while tie.any():
        rows = np.flatnonzero(tie | np.concatenate((tie[1:], [False])))
        at = order[rows]
        follow = rank[np.minimum(at + width, n - 1)]
        new = np.lexsort((follow, group[rows]))
        order[rows], follow = at[new], follow[new]
        still = np.zeros(n, bool)
        still[rows[1:]] = (group[rows][1:] == group[rows][:-1]) & (follow[1:] == follow[:-1])
        tie = still
        head = np.arange(n)
        head[tie] = 0
        group = np.where(np.isin(np.arange(n), rows, assume_unique=True), np.maximum.accumulate(head), group) if len(rows) < n else np.maximum.accumulate(head)
        rank[order[rows]] = group[rows]
        width *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int):
        """symbols: 0 for breaks, else 1 to size; it ends with a break."""
        bits = max(1, int(size).bit_length())
        order = suffix_order(symbols, bits)
        self.transform = symbols[order - 1].astype(np.int32)
        self.transform[order == 0] = 0
        self.tree = WaveletMatrix(self.transform, bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size + 1))))
        self.n = len(symbols)
        self.sampled = (order % SAMPLE_EVERY == 0) | (self.transform == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 suffix of each window (a row of symbols), from its last word to its first."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[live, j]
            low[live], high[live] = self.first[c] + self.tree.rank(c, low[live]), self.first[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: backwards to a sampled one. Those after a break are all sampled."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            c = self.transform[rows[live]].astype(np.int64)
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.positions[self.place[rows]] + steps


class Phrases:
    """The benchmark as two tables of the shared folder: its alphabet, which a task holds, and its items' symbols in blocks,
    which a task reads one after the other for each shard."""

    def __init__(self, alphabet: str, blocks: str, window: int):
        self.paths, self.window, self.known = (alphabet, blocks), window, None

    @property
    def alphabet(self) -> np.ndarray:
        """Hashes of all words of the benchmark, sorted; read once in a task."""
        if self.known is None:
            parts = [group.column("word").to_numpy().view(np.uint64) for group in _row_groups(self.paths[0])]
            self.known = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
        return self.known

    def windows(self):
        """Yields (width, items, windows), those of one block at a time."""
        for group in _row_groups(self.paths[1]):
            for row in group.to_pylist():
                items, bounds = (np.frombuffer(row[name], np.int64) for name in ("items", "bounds"))
                symbols, lengths = np.frombuffer(row["symbols"], np.int32), np.diff(bounds)
                widths = np.minimum(lengths, self.window)
                for width in np.unique(widths):
                    own = np.flatnonzero(widths == width)
                    count = lengths[own] - width + 1
                    start = np.repeat(bounds[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    yield width, np.repeat(items[own], count), symbols[start[:, None] + np.arange(width)]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)


def _row_groups(path: str):
    files, root = store_of(path)
    for name in sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with pq.ParquetFile(files.open_input_file(name)) as table:
            for group in range(table.num_row_groups):
                yield table.read_row_group(group)


def _words_of(batches):
    """item_id and word hashes of each row that has both."""
    for batch in batches:
        names = batch.column("item_id").to_pylist()
        data, offsets = kit.text_buffers(batch.column("text"))
        for first, last, hashes, bounds in kit.word_hashes(data, offsets, kit.ALNUM):
            for r in range(first, last):
                words = hashes[bounds[r - first] : bounds[r - first + 1]]
                if names[r] is not None and len(words):
                    yield names[r], words


def _phrases(benchmark: DataFrame, window: int) -> tuple[Phrases, int]:
    """The benchmark written to the shared folder, and its number of words. A block holds about PHRASE_BYTES of symbols;
    longer items come in pieces that overlap, so that each window lies in one."""
    spark, size = benchmark.sparkSession, max(window, PHRASE_BYTES // 4)

    def alphabet(batches):
        for batch in batches:
            own = [w for _, w in _words_of([batch])]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)).view(np.int64))], ["word"])

    words = f"{kit.shared_dir(spark)}/alphabet-{uuid.uuid4().hex}"
    benchmark.mapInArrow(alphabet, "word long").distinct().write.parquet(words)
    blocks = f"{kit.shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    held = Phrases(words, blocks, window)

    def block(items, pieces):
        bounds = np.cumsum([0, *(len(p) for p in pieces)])
        row = (np.array(items, np.int64).tobytes(), bounds.tobytes(), np.concatenate(pieces).astype(np.int32).tobytes(), int(bounds[-1]))
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["items", "bounds", "symbols", "n"])

    def packed(batches):
        items, pieces, amount = [], [], 0
        for item, hashes in _words_of(batches):
            symbols = held.symbols(hashes)
            for a in range(0, max(1, len(symbols) - window + 1), size - window + 1):
                items.append(item)
                pieces.append(symbols[a : a + size])
                amount += len(pieces[-1])
                if amount >= size:
                    yield block(items, pieces)
                    items, pieces, amount = [], [], 0
        if items:
            yield block(items, pieces)

    made = benchmark.mapInArrow(packed, "items binary, bounds binary, symbols binary, n long")
    made.write.option("parquet.block.row.count.limit", 1).parquet(blocks)  # a block to a row group, so a task reads one at a time
    return held, int(spark.read.parquet(blocks).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


def _scan(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, length and item of each occurrence in a shard."""
    out = [(np.zeros(0, np.int64),) * 3]
    if symbols.any():
        index = FMIndex(symbols, len(phrases.alphabet))
        for width, items, windows in phrases.windows():
            low, high = index.search(windows)
            count = high - low
            which = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            out.append((index.locate(rows), np.full(len(rows), width), items[which]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, sorted; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate(([True], start[1:] > end[:-1]))
    return start[head], end[np.concatenate((np.flatnonzero(head)[1:] - 1, [len(end) - 1]))]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _shard_rows(rows: list, words: list[np.ndarray], phrases: Phrases) -> pa.RecordBatch:
    counts = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(counts + 1)))  # a break after each document
    symbols = np.zeros(first[-1], np.int64)
    for a, w in zip(first, words, strict=False):
        symbols[a : a + len(w)] = w
    position, length, item = _scan(symbols, phrases)
    row = np.searchsorted(first, position, "right") - 1
    items, starts, ends = ([[] for _ in rows] for _ in range(3))
    order = np.argsort(row, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(row[order])) + 1, [len(order)]))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            own, r = order[a:b], row[order[a]]
            items[r] = np.unique(item[own])
            starts[r], ends[r] = merge_spans(position[own] - first[r], position[own] - first[r] + length[own])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([i for i, _ in rows], [k for _, k in rows], counts, items, starts, ends), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """A row for each row of documents: doc_id, row_key (of its text), n_words, items (sorted item_ids), spans (word starts and ends to remove).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts have no words. An item
    of fewer words than window is one window; an item without words or id has none. Repeated rows, and those
    without a doc_id, count each for themselves; an empty benchmark hits nothing. Other columns are ignored. Each shard is searched for
    the benchmark in blocks of PHRASE_BYTES: a task holds the benchmark's distinct words, 8 bytes each, and the windows of one
    block, and nothing of it goes through the driver.
    """
    spark = documents.sparkSession
    kit.small_batches(spark)
    documents, benchmark = documents.select(F.col("doc_id").cast("long").alias("doc_id"), kit.row_key().alias("row_key"), "text"), benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    phrases, known = _phrases(benchmark, window)
    shard = min(max(SHARD_WORDS, known // 4), MOST_SHARD_WORDS)

    def run(batches):
        rows, words, amount = [], [], 0
        for batch in batches:
            names = list(zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), strict=True))
            data, offsets = kit.text_buffers(batch.column("text"))
            for first, last, hashes, bounds in kit.word_hashes(data, offsets, kit.ALNUM):
                symbols = phrases.symbols(hashes).astype(np.int32)
                for r in range(first, last):
                    rows.append(names[r])
                    words.append(symbols[bounds[r - first] : bounds[r - first + 1]])
                    amount += len(words[-1]) + 1
                if amount >= shard:
                    yield _shard_rows(rows, words, phrases)
                    rows, words, amount = [], [], 0
        if rows:
            yield _shard_rows(rows, words, phrases)

    found = documents.mapInArrow(run, "doc_id long, row_key long, n_words long, items array<long>, starts array<long>, ends array<long>")
    return found.select("doc_id", "row_key", "n_words", "items", F.arrays_zip("starts", "ends").alias("spans"))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.ends - s.starts)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS win FROM d, widths, unnest(range(1, len(w) - width + 2)) AS r(i)),
hits AS (SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + width)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Packing documents into sequences of a fixed capacity (operator 12) by Karmarkar-Karp multiway differencing.

Documents are tokenized and packed in the task that reads them, so nothing is shuffled. Of each document, whole sequences
are cut off first; what is left over is pooled. When a pool holds about a million tokens, differencing deals its pieces to
near-equal windows: partial partitions, ordered by imbalance, merge two by two with the fullest window of one on the
emptiest of the other. The window count is what the pool's tokens fill, and rises whenever they exceed it. As documents
may be cut anywhere, the few tokens by which a window then exceeds the capacity move to windows with room; tokens that
fill no window go on to the next pool, and at a partition's end into sequences of powers of two, which need no padding.
A task holds one pool and one document's tokens; a task that is run again packs alike.
"""

from __future__ import annotations

import heapq
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specloom.llm import kit

CAPACITY = 2048
POOL_TOKENS = 1 << 20
END_ID = 1
RUN_BYTES = 1 << 20
CACHED_CHUNKS = 500_000
BATCH_TOKENS = 1 << 19

#: Bytes that start a character other than white space; C2, E1, E2 and E3 start some of both and don't count.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = _PLAIN & ~_LETTER
_MARK[0x30:0x3A] = False


def split_places(data: np.ndarray) -> np.ndarray:
    """Places at which a byte-level BPE text may be cut without a change of its ids: before the last blank ahead of a
    character that isn't white space, before a lone line end, and between a letter and a mark after it (ASCII). A token never
    runs across them."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    inner, before, after = data[1:-1], data[:-2], data[2:]
    return np.flatnonzero((inner == 0x20) & _SOLID[after] | (inner == 0x0A) & _PLAIN[before] & _PLAIN[after] | _LETTER[before] & _MARK[inner]) + 1


class Ids:
    """Token ids of texts, by chunks between split places: each distinct chunk is encoded once and its ids are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.start, self.size = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, chunks: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded), np.uint32, int(size.sum()))])
        self.size = np.concatenate([self.size, size])
        for c in chunks:
            self.known[c] = len(self.known)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 bytes, and the places in them of bounds, which split the bytes into texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[split_places(data)] = True
        edge[bounds] = True
        starts = np.flatnonzero(edge[:-1])
        edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(starts), edges, pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > CACHED_CHUNKS or len(self.flat) > 8 * CACHED_CHUNKS:
            self.clear()
        words = coded.dictionary.to_pylist()
        unknown = [w for w in words if w not in self.known]
        if unknown:
            self._add(unknown)
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[at]
        until = np.cumsum(size)
        places = np.concatenate([[0], until])[np.searchsorted(starts, bounds)]
        return self.flat[np.repeat(self.start[at] - until + size, size) + np.arange(until[-1])], places


_loaded: dict[str, Ids] = {}


def token_ids(column: pa.Array, path: str):
    """The ids of each text of a string column, in order; null counts as empty."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    ids = _loaded[path]
    data, offsets = kit.text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[last])
        if b - a <= 2 * RUN_BYTES:
            found, places = ids.of(data[a:b], offsets[row : last + 1] - a)
            yield from (found[places[k] : places[k + 1]] for k in range(last - row))
        else:  # one long text, in pieces that end where it may be cut
            parts = []
            while a < b:
                stop = min(b, a + RUN_BYTES)
                while stop < b:
                    cuts = split_places(data[stop - 1 : min(b, stop + RUN_BYTES) + 1])
                    stop = min(b, stop + RUN_BYTES) if not len(cuts) else stop - 1 + int(cuts[0])
                    if len(cuts):
                        break
                parts.append(ids.of(data[a:stop], np.array([0, stop - a]))[0])
                a = stop
            yield np.concatenate(parts)
        row = last


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window, 0 to windows - 1, of each of the lengths: Karmarkar-Karp for many windows.

    A partial partition is its sums, largest first, with a handle for each: the items it holds, as a tree.
    """
    n = len(lengths)
    heap = [(-int(lengths[i]), r, lengths[i : i + 1].astype(np.int64), np.array([i])) for r, i in enumerate(np.argsort(-lengths, kind="stable"))]
    heapq.heapify(heap)
    joined, free = [], n
    for turn in range(n, 2 * n - 1):
        _, _, sums, held = heapq.heappop(heap)
        _, _, other, other_held = heapq.heappop(heap)
        if windows == 1:
            joined.append((held, other_held))
            sums, held, free = sums + other, np.array([free]), free + 1
        else:
            a, b = len(sums), len(other)
            size, both = min(windows, a + b), max(0, a + b - windows)  # the emptiest `both` of one meet the emptiest of the other, reversed
            merged, handles = np.zeros(size, np.int64), np.empty(size, np.int64)
            merged[:a], handles[:a] = sums, held
            merged[size - b :] += other[::-1]
            handles[a:] = other_held[::-1][both:]
            if both:
                joined.append((held[a - both :], other_held[::-1][:both]))
                handles[a - both : a] = np.arange(free, free + both)
                free += both
            order = np.argsort(-merged, kind="stable")
            sums, held = merged[order], handles[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == windows else 0)), turn, sums, held))
    of = np.empty(free, np.int64)
    of[heap[0][3]] = np.arange(len(heap[0][3]))
    if joined:
        left, right = (np.concatenate(x) for x in zip(*joined, strict=True))
        for k in range(len(left) - 1, -1, -1):
            of[left[k]] = of[right[k]] = of[n + k]
    return of[:n]


def level(lengths: np.ndarray, window: np.ndarray, windows: int, capacity: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Places (item, start in it, length, window) that fill each window to its capacity at most, and the rest (item, start,
    length). What exceeds a window is cut from the end of its last items and moves to windows with room."""
    placed, over, used = [], [], np.zeros(windows, np.int64)
    for i in np.argsort(window, kind="stable").tolist():
        w, size = int(window[i]), int(lengths[i])
        fits = min(size, capacity - int(used[w]))
        if fits:
            placed.append((i, 0, fits, w))
            used[w] += fits
        if fits < size:
            over.append((i, fits, size - fits))
    rest, w = [], 0
    for i, start, size in over:
        while size:
            while w < windows and used[w] == capacity:
                w += 1
            if w == windows:
                rest.append((i, start, size))
                break
            fits = min(size, capacity - int(used[w]))
            placed.append((i, start, fits, w))
            used[w] += fits
            start, size = start + fits, size - fits
    return placed, rest


class Packer:
    """Collects pieces of documents and hands out packed ones, as (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, pool_tokens: int):
        self.capacity, self.pool_tokens, self.pool, self.pooled, self.sequences = capacity, pool_tokens, [], 0, 0

    def add(self, document, total: int):
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield document, start, self.capacity, self.sequences, 0
            self.sequences += 1
        if whole < total:
            self.pool.append((document, whole, total - whole))
            self.pooled += total - whole
        if self.pooled >= self.pool_tokens:
            yield from self.fill()

    def fill(self):
        """Full windows of the pool; what fills none stays in it."""
        windows = self.pooled // self.capacity
        if windows:
            lengths = np.array([p[2] for p in self.pool])
            placed, rest = level(lengths, differencing(lengths, windows), windows, self.capacity)
            yield from self._sequences(placed)
            self.pool = [(self.pool[i][0], self.pool[i][1] + start, size) for i, start, size in rest]
            self.pooled -= windows * self.capacity

    def _sequences(self, placed):
        offset, last = 0, None
        for i, start, size, w in sorted(placed, key=lambda p: p[3]):
            if w != last:
                self.sequences += last is not None
                offset, last = 0, w
            document, at, _ = self.pool[i]
            yield document, at + start, size, self.sequences, offset
            offset += size
        self.sequences += 1

    def end(self):
        """The last windows, and sequences of decreasing powers of two for what fills none."""
        yield from self.fill()
        left, sizes = self.pooled, []
        while left:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        offset = 0
        for document, start, size in self.pool:
            while size:
                fits = min(size, sizes[0] - offset)
                yield document, start, fits, self.sequences, offset
                start, size, offset = start + fits, size - fits, offset + fits
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.sequences += 1
                    offset = 0
        self.pool, self.pooled = [], 0


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pieces of documents(doc_id, text): doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id
    and offset. A document is the ids of its text by the tokenizer file (a byte-level BPE, no special tokens added), then
    end_id; each id lies in one piece, and pieces fill a sequence without gaps.

    A null or empty text is end_id alone. Rows are packed each on its own, so repeated and null doc_ids are no matter. Other
    columns are ignored. Sequences are numbered within each partition, above its number; an empty table gives no rows.
    """
    kit.small_batches(documents.sparkSession)
    given = documents.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([given.schema["doc_id"]])
    for name in names[1:]:
        schema = schema.add(name, "binary" if name == "ids" else "long")

    def run(batches):
        first, packer, out, held = pyspark.TaskContext.get().partitionId() << 33, Packer(capacity, pool_tokens), [], 0
        kind = None

        def batch():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names[1:], columns[1:], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def pieces():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                for doc_id, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1), tokenizer), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    yield from packer.add((doc_id, ids), len(ids))
            yield from packer.end()

        for (doc_id, ids), start, length, sequence, offset in pieces():
            out.append((doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), first + sequence, offset))
            held += length
            if held >= BATCH_TOKENS:
                yield batch()
                held = 0
        if out:
            yield batch()

    return given.mapInArrow(run, schema)


def op12_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    made = pack(kit.table(spark, sf_dir, "documents"), tokenizer)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Benchmark decontamination by suffix arrays over shards of the training text.

Texts become words: ASCII letters lower-cased, everything but digits, letters
and non-ASCII characters a break. A benchmark item is cut into suffixes, one
for each window of ``window`` words (all its words if it has fewer). A task
turns its documents, about a million words at a time, into one array of word
numbers, sorts all its suffixes and binary-searches every test suffix in that
array. Hits that follow each other in both texts are joined into longest
verbatim matches.

No document is shuffled. Tasks cut the benchmark into blocks of a fixed number
of words and store them in the shared folder; every shard is searched block by
block, so no task holds more than one block. A shard grows with the number of
blocks, up to ``MOST_SHARDS`` times, so that a block is read less often.

Defined cases: a null or empty text has no words and is never contaminated;
null or empty items have no windows; null item ids are left out of the lists;
repeated rows are judged each; empty tables give no rows, or no hits; the
input's other columns are ignored, or kept as they are with ``keep=True`` (a
column named as the result is a ValueError); a very long text is one shard.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, materialise, new_name, read_file, work_path, write_file

WINDOW = 10
SHARD_BYTES = 6_000_000
BLOCK_WORDS = 1_000_000
MOST_SHARDS = 4

_WORD = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The suffix array of ``ids``: all its positions, sorted by the whole suffixes that start there.

    Ranks by 1, 2, 4, ... words are refined until no two are equal. A 0 stands
    for a word of no item; each is unlike any other, as no match reaches over it.
    """
    n = len(ids)
    value = ids.astype(np.int64)
    none = np.flatnonzero(value == 0)
    value[none] = -1 - np.arange(len(none))
    _, rank = np.unique(value, return_inverse=True)
    order, size = np.argsort(rank), 1
    while n and rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        size *= 2
    return order


class Block:
    """Test suffixes of some items, ready to be searched for. Items of equal words are one text with several ids."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        owners: dict[tuple[bytes, ...], list] = {}
        for i, ws in items:
            owners.setdefault(tuple(ws), []).append(i)
        self.ids = [sorted({i for i in ids if i is not None}) for ids in owners.values()]
        self.vocab = {w: n for n, w in enumerate(sorted({w for ws in owners for w in ws}), 1)}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, ws in enumerate(owners):
            ids = [self.vocab[w] for w in ws]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[at: at + size]), []).append((item, at))
        self.lengths = np.array([len(w) for w in found], np.int64)
        pad = np.zeros((len(found), window), np.uint32)
        for n, w in enumerate(found):
            pad[n, : len(w)] = w
        self.low = self._keys(pad)
        high = pad.copy()
        for n, w in enumerate(found):
            high[n, len(w):] = 0xFFFFFFFF
        self.high = self._keys(high)
        self.first = np.cumsum([0, *(len(v) for v in found.values())])
        self.places = np.array([p for v in found.values() for p in v], np.int64).reshape(-1, 2)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and window numbers of all occurrences in ``ids``, where 0 never matches: every test suffix is
        binary-searched in the suffix array."""
        if not len(self.lengths) or not ids.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffixes = suffix_order(ids)
        suffixes = suffixes[np.searchsorted(ids[suffixes], 1):]  # those that start with a word of some item lie behind the others
        tail = np.concatenate([ids.astype(np.uint32), np.zeros(self.window, np.uint32)])
        keys = np.empty((len(suffixes), self.window), ">u4")
        for k in range(self.window):
            keys[:, k] = tail[suffixes + k]
            if k:
                keys[:, k] *= keys[:, k - 1] != 0  # words behind a 0 don't decide
        keys = keys.view(f"S{4 * self.window}").ravel()
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = hi - lo
        win = np.repeat(np.arange(len(count)), count)
        at = suffixes[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(win))]
        return at, win


def stored_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list[str]:
    """Write the benchmark as blocks in the shared folder; returns their paths."""
    root = work_path(benchmark.sparkSession, "benchmark")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .packing import text_bytes

        part, paths, held, size = TaskContext.get().partitionId(), [], [], 0

        def put():
            paths.append(f"{root}/block-{part:05d}-{len(paths):05d}")
            write_file(paths[-1], pickle.dumps(Block(held, window)))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                ws = words(text)
                if ws:
                    held.append((i, ws))
                    size += len(ws)
                if size >= block_words:
                    put()
                    held, size = [], 0
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    stored = rows.repartition(1 + size // (8 * block_words)).mapInArrow(run, "path string")
    return sorted(r["path"] for r in materialise(stored, "benchmark-blocks").collect())


_LOADED: dict[str, Block] = {}


def _block(path: str) -> Block:
    claim("decontamination", _LOADED.clear)
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = pickle.loads(read_file(path))
    return _LOADED[path]


def scan_shard(texts: list[bytes], blocks: list[str]) -> list[tuple]:
    """``(n_words, n_hit, item ids, longest match)`` of each text."""
    joined = b" \0 ".join(t.translate(TABLE) for t in texts).split()
    covered = bounds = None
    items: list[set] = [set() for _ in texts]
    longest: list[tuple] = [(0, None, None, None)] * len(texts)
    for path in blocks or [None]:
        block = _block(path) if path else Block([], 1)
        vocab = block.vocab
        ids = np.fromiter(map(vocab.get, joined, repeat(0)), np.int64, len(joined))
        if bounds is None:
            breaks = np.flatnonzero(np.fromiter(map(b"\0".__eq__, joined), bool, len(joined)))
            bounds = np.concatenate([[-1], breaks, [len(joined)]])
            covered = np.zeros(len(joined) + 1, np.int64)
        at, win = block.search(ids)
        if not len(at):
            continue
        np.add.at(covered, at, 1)
        np.add.at(covered, at + block.lengths[win], -1)
        many = block.first[win + 1] - block.first[win]
        where = np.repeat(at, many)
        place = block.places[np.repeat(block.first[win] - np.cumsum(many) + many, many) + np.arange(len(where))]
        size = np.repeat(block.lengths[win], many)
        order = np.lexsort((where, where - place[:, 1], place[:, 0]))
        where, item, begin, size = where[order], place[order, 0], place[order, 1], size[order]
        new = np.ones(len(where), bool)
        new[1:] = (item[1:] != item[:-1]) | (where[1:] - begin[1:] != where[:-1] - begin[:-1]) | (where[1:] - where[:-1] != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(where)) - 1
        length = where[last] - where[first] + size[last]
        doc = np.searchsorted(bounds, where[first], "right") - 1
        for d, i, n, p, q in zip(doc.tolist(), item[first].tolist(), length.tolist(), (where[first] - bounds[doc] - 1).tolist(), begin[first].tolist()):
            items[d].update(block.ids[i])
            owner = block.ids[i][0] if block.ids[i] else None
            if n > longest[d][0] or n == longest[d][0] and (p, str(owner), q) < (longest[d][1], str(longest[d][2]), longest[d][3]):
                longest[d] = (n, p, owner, q)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return [
        (int(b - a - 1), int(hit[b] - hit[a + 1]), sorted(items[n]), *longest[n])
        for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
    ]


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("longest", T.LongType(), False),
        T.StructField("longest_start", T.LongType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_item_start", T.LongType()),
    ]
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: bool = False,
    name: str = "match",
    shard_bytes: int = SHARD_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The input's id (or with ``keep`` all its columns) and a struct
    ``name(n_words, n_hit, items, longest, ...)`` for each document, where
    ``items`` are the ids of items with occurring windows, sorted as strings."""
    if keep:
        new_name(docs.columns, name)
    blocks = stored_blocks(benchmark, item_col, item_text_col, window, block_words)
    shard_bytes *= min(MOST_SHARDS, max(1, len(blocks)))
    slim = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = slim.columns.index(text_col if keep else "text")
    kept = [f for f in slim.schema if keep or f.name != "text"]
    schema = T.StructType([*kept, T.StructField(name, RESULT, False)])
    places = [n for n, f in enumerate(slim.schema) if keep or n != at]

    def run(batches):
        import pyarrow as pa

        from .packing import text_bytes

        out = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string()), ("longest_item_start", pa.int64())])
        names = [f.name for f in RESULT]

        def flush(parts, texts):
            table = pa.Table.from_batches(parts).combine_chunks()
            rows = [dict(zip(names, r)) for r in scan_shard(texts, blocks)]
            columns = [table.column(p) for p in places]
            yield from pa.Table.from_arrays([*columns, pa.array(rows, out)], names=[f.name for f in schema]).to_batches()

        parts, texts, size = [], [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                parts.append(part)
                got = text_bytes(part.column(at))
                texts += got
                size += sum(map(len, got))
                if size >= shard_bytes:
                    yield from flush(parts, texts)
                    parts, texts, size = [], [], 0
        if parts:
            yield from flush(parts, texts)

    return slim.mapInArrow(run, schema)

"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document longer than the window is first cut into full windows; each
remainder goes to the open window with the least room that still holds it,
found through a segment tree over remaining capacity. What is left over is
then filled: the emptiest windows are dissolved into the larger gaps of the
fuller ones, and the last partial window is cut into powers of two, which
need no padding.

Packing is local to a task, so nothing is shuffled. A task packs groups of at
most ``group_tokens`` tokens, which bounds its memory.

Defined cases: a null or empty text is the end token alone; a null id stays
null; repeated rows are packed each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim

WINDOW = 2048
END_ID = 1
GROUP_TOKENS = 16_000_000
#: Gaps of fewer tokens are padded, as filling them would shred documents.
MIN_FILL = 16
#: Entries a worker's chunk cache may hold before it is dropped.
CACHE_CHUNKS = 700_000


class CapacityTree:
    """Segment tree over capacities 0..size-1 that counts open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        self._shift(capacity, 1)

    def _shift(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity >= need."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        self._shift(capacity, -1)
        return capacity, window


def plan(lengths: list[int], window: int = WINDOW, min_fill: int = MIN_FILL) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document index, start, length)`` holding every token once."""
    full: list[list[tuple[int, int, int]]] = []
    rest = []
    for doc, length in enumerate(lengths):
        whole = length // window
        full.extend([(doc, k * window, window)] for k in range(whole))
        if length % window:
            rest.append((length % window, doc, whole * window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = CapacityTree(window + 1)
    bins: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    for need, doc, start in rest:
        found = tree.take(need)
        if found is None:
            bins.append([])
            room.append(window)
            found = (window, len(bins) - 1)
        capacity, at = found
        bins[at].append((doc, start, need))
        room[at] = capacity - need
        if room[at]:
            tree.add(room[at], at)

    order = sorted((b for b in range(len(bins)) if room[b] >= min_fill), key=lambda b: (room[b], b))
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        if room[to] < min_fill:
            i += 1
            continue
        doc, start, length = bins[source].pop()
        moved = min(length, room[to])
        bins[to].append((doc, start + length - moved, moved))
        room[to] -= moved
        if moved < length:
            bins[source].append((doc, start, length - moved))
        elif not bins[source]:
            j -= 1
    out = full
    tail: list[tuple[int, int, int]] = []
    if i == j and room[order[i]] >= min_fill:
        tail, bins[order[i]] = bins[order[i]], []
    out.extend(b for b in bins if b)
    left = sum(x[2] for x in tail)
    while left:
        size, sequence = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            doc, start, length = tail.pop()
            used = min(size, length)
            sequence.append((doc, start, used))
            if used < length:
                tail.append((doc, start + used, length - used))
            size -= used
        out.append(sequence)
    return out


class _Index(dict):
    """Numbers its keys in order of first use and remembers new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkEncoder:
    """Token ids of whole texts through a cache of white-space-free chunks.

    The word tokenizer never joins text across ASCII white space, lower-cases
    every character by itself and breaks between an ASCII letter and closing
    punctuation, so a text's ids are those of its chunks in order. Each
    distinct chunk is encoded by the tokenizer once per worker.
    """

    SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.start, self.length = array("i"), array("q"), array("q")
        self.cores: dict[bytes, bytes] = {}

    def _direct(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tok.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in got]

    def _encode_cores(self, cores: list[bytes]) -> None:
        words, other = [], []
        for c in cores:
            s = c.decode("utf-8", "replace")
            (words if s.isalpha() else other).append(c)
        if words:
            ids = np.array(self.tok.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * cuts).tolist()
                self.cores.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))
            else:
                other += words
        if other:
            self.cores.update(zip(other, (x.tobytes() for x in self._direct(other))))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        heads = [c.rstrip(b".,;:!?") for c in new]
        tails = [b""] * len(new)
        for n, (chunk, head) in enumerate(zip(new, heads)):
            if len(head) < len(chunk):
                if head and 97 <= head[-1] <= 122:
                    tails[n] = chunk[len(head):]
                else:
                    heads[n] = chunk
        self.cores.setdefault(b"", b"")
        self._encode_cores([c for c in {*heads, *tails} if c not in self.cores])
        core = self.cores.__getitem__
        ids = [a + b for a, b in zip(map(core, heads), map(core, tails))]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat.frombytes(b"".join(ids))
        self.start.frombytes(starts.tobytes())
        self.length.frombytes(lengths.tobytes())

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > CACHE_CHUNKS:
            self.reset()
        look = self.index.__getitem__
        places, odd = [], {}
        for n, text in enumerate(texts):
            low = text.lower()
            if b"<|" in low and any(s in low for s in self.SPECIAL):
                odd[n] = self._direct([text])[0]
                low = b""
            places.append(np.array(list(map(look, low.split())), np.int64))
        if self.index.new:
            self._learn()
        which = np.concatenate(places) if places else np.zeros(0, np.int64)
        lengths = np.frombuffer(self.length, np.int64)[which]
        begin = np.frombuffer(self.start, np.int64)[which]
        ends = np.cumsum(lengths)
        flat = np.frombuffer(self.flat, np.int32)
        ids = flat[np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, places)])]
        return [odd.get(n, ids[bounds[n]: bounds[n + 1]]) for n in range(len(texts))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    claim("packing", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    min_fill: int = MIN_FILL,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_tokens, ids`` where ``ids`` holds little-endian unsigned 32-bit token ids.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens")]
        + [T.StructField("ids", T.BinaryType(), False)]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        base, made = TaskContext.get().partitionId() << 33, 0
        names = [f.name for f in schema]
        kinds = [pa.int64()] * 7 + [pa.binary()]

        def flush(keys, docs_ids):
            nonlocal made
            rows: list[tuple] = []
            for pieces in plan([len(x) for x in docs_ids], window, min_fill):
                offset, total = 0, sum(p[2] for p in pieces)
                for doc, start, length in pieces:
                    ids = docs_ids[doc]
                    rows.append((keys[doc], start, length, len(ids), base + made, offset, total, ids[start: start + length].astype("<u4").tobytes()))
                    offset += length
                made += 1
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        keys, held, tokens = [], [], 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys += part.column(0).to_pylist()
                for ids in enc.encode(text_bytes(part.column(1))):
                    held.append(np.concatenate([ids, end]))
                    tokens += len(ids) + 1
                if tokens >= group_tokens:
                    yield from flush(keys, held)
                    keys, held, tokens = [], [], 0
        if keys:
            yield from flush(keys, held)

    return slim.mapInArrow(run, schema)

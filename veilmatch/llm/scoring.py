"""Language-model scores by context-tree weighting over bytes.

Texts are tokens: ASCII letters lower-cased, words between ASCII white space,
then one end. A word is coded as its bytes and a closing byte. Each byte is
decomposed into eight binary decisions; every decision node keeps zero and one
counts for each context of 0 to ``depth`` bytes before it (words before the
byte's own included; blanks stand before a text's start), and the
Krichevsky-Trofimov estimates of all depths are mixed with the weights of
context-tree weighting, taken from the counts of all training texts. A context
that training never reached takes no part.

How it scales: every task counts its texts' grams (context and next byte) and
hands on sorted runs of distinct ones, packed by bucket; a bucket holds whole
contexts of three bytes. Runs are merged by bucket, and the tree is never in
one place: a bucket weighs the nodes below its contexts, hands the top nodes on
to tasks that hold whole contexts of one byte, and only the nodes of one byte
of context, 65,280 at most, meet on the driver; what the upper nodes give to
the lower ones comes back the same way. The depth is the same for any input.
Scores of the ``head`` most frequent words and of ``GRAMS_A_WORD`` times as many
grams, fixed numbers, go to every task; rarer ones are joined. Both ways are
always in use and give the same sums.

Defined cases: a null or empty text is the end token alone; a null id counts
as training when its CRC rule says so; repeated rows are scored each; an empty
table gives no rows; a very long text is worked on in pieces that carry their
context; the input's other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, materialise, read_file, work_path, write_file

#: Bytes of context. A gram fills 56 bits; the other eight number a block's texts.
DEPTH = 6
HEAD = 262_144
GRAMS_A_WORD = 8
#: Distinct words and grams a task holds before it hands its counts on.
FLUSH_WORDS = 300_000
FLUSH_GRAMS = 1_000_000
#: Bytes and texts whose grams and texts whose words are worked on at once, grams of the tree that are weighed at once, grams in a packed row.
BLOCK_BYTES = 4_000_000
BLOCK_TEXTS = 256
WORD_TEXTS = 1_024
BLOCK_GRAMS = 200_000
ROW_GRAMS = 2_048
BUCKETS = 4_096
#: Bytes of context that a bucket holds whole.
LOW = 3
END = b"\n"
START, CLOSE = b" ", b" "


def normal(text: bytes) -> bytes:
    """The text as its coded bytes: lower-cased words, each before a closing byte, then the end."""
    return CLOSE.join([*text.lower().split(), END])


def words_of(column) -> tuple:
    """All words of an Arrow string column, and the place of each word's text."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, place = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), place.filter(full).to_numpy()


# ---------------------------------------------------------------- the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of values >= 0.5."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(12):
        shift += np.log(y)
        y = y + 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def windows(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``depth`` context bytes and next byte at each place of parts that open with their context, and each part's places."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = bytes(7) + b"".join(parts)
    eight = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))  # the eight bytes up to each place
    keep = np.ones(len(eight), bool)
    keep[((np.cumsum(lengths) - lengths)[:, None] + np.arange(depth)).ravel()] = False
    return eight[keep].astype(np.uint64) & np.uint64((1 << (8 * depth + 8)) - 1), lengths - depth


def grams_of(units: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``, for units that start after blanks: words, or words between closing bytes up to an end."""
    return windows([START * depth + (u if u.endswith(END) else u + CLOSE) for u in units], depth)


def split_bits(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each gram's node at its byte's ``k``-th bit (context, then the bits before it behind a one), and that bit."""
    byte = (codes & np.uint64(255)).astype(np.int64)
    prefix = ((1 << k) | (byte >> (8 - k))).astype(np.uint64)
    return ((codes >> np.uint64(8)) << np.uint64(8)) | prefix, (byte >> (7 - k)) & 1


def ladder(keys: np.ndarray, deep: int, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes at depth ``top`` above those at depth ``deep``, and each level's places in the next shallower one."""
    up = []
    for d in range(deep - 1, top - 1, -1):
        keys, parent = np.unique(keys & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        up.append(parent.astype(np.int32))
    return keys, up


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, up: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
    """``(zeros, ones, share of the node's own estimate)`` by level, deepest first (no share there), and the top's weighted ln probability."""
    levels = [(zeros, ones, None)]
    for parent in up:
        size = parent.max() + 1 if len(parent) else 0
        zeros, ones, below = (np.bincount(parent, x, size).astype(float) for x in (zeros, ones, weighted))
        block = kt_block(zeros, ones)
        weighted = np.logaddexp(block, below) - np.log(2)
        levels.append((zeros, ones, np.exp(block - np.log(2) - weighted)))
    return levels, weighted


def descend(levels: list[tuple], up: list[np.ndarray], alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the top to the deepest level: a node whose mixture is p makes the whole tree give ``alpha + beta * p``."""
    for k in range(len(up) - 1, -1, -1):
        a, b, share = levels[k + 1]
        own = (b + 0.5) / (a + b + 1)
        seen = levels[k][0] + levels[k][1] > 0
        alpha, beta = (
            np.where(seen, (alpha + beta * share * own)[up[k]], (alpha + beta * own)[up[k]]),
            np.where(seen, (beta * (1 - share))[up[k]], 0),
        )
    return alpha, beta


def decisions(codes: np.ndarray, counts: np.ndarray):
    """For each bit: the nodes below which grams lie, each gram's place in them and bit, and the nodes' zeros and ones."""
    for k in range(8):
        key, bit = split_bits(codes, k)
        keys, inverse = np.unique(key, return_inverse=True)
        yield keys, inverse, bit, np.bincount(inverse, counts * (1 - bit), len(keys)), np.bincount(inverse, counts * bit, len(keys))


def tree_log10(codes: np.ndarray, counts: np.ndarray, depth: int, top: int = 0, above=None) -> np.ndarray:
    """log10 probability of each gram's last byte in its context.

    ``counts`` are training counts; grams of count 0 are scored but not learned.
    With ``top``, the grams are all those below some contexts of that many bytes,
    and ``above`` tells the ``alpha`` and ``beta`` of given nodes at that depth.
    """
    total = np.zeros(len(codes))
    for keys, inverse, bit, zeros, ones in decisions(codes, counts):
        tops, up = ladder(keys, depth, top)
        levels, _ = weigh(zeros, ones, kt_block(zeros, ones), up)
        alpha, beta = descend(levels, up, *(above(tops) if above else (np.zeros(len(tops)), np.ones(len(tops)))))
        p = (alpha + beta * (ones + 0.5) / (zeros + ones + 1))[inverse]
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def top_nodes(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of the nodes at depth ``top``, and their zeros, ones and weighted ln probability."""
    found = []
    for keys, _, _, zeros, ones in decisions(codes, counts):
        tops, up = ladder(keys, depth, top)
        levels, weighted = weigh(zeros, ones, kt_block(zeros, ones), up)
        found.append((tops, *levels[-1][:2], weighted))
    keys, *values = map(np.concatenate, zip(*found))
    return keys, values


# ---------------------------------------------------------------- counting


class Tally:
    """Sorted distinct marked grams (gram, then a bit for training) and their counts, from sorted runs of them."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.runs, self.size, self.most = [], 0, 2 * FLUSH_GRAMS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            self.settled()
            self.most = max(2 * FLUSH_GRAMS, 2 * self.size)

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.runs) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.runs))
            order = np.argsort(keys, kind="stable")  # merges runs that are sorted
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.runs = [(keys[first], np.add.reduceat(counts[order], first))]
            self.size = len(first)
        return self.runs[0]


def unmarked(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, and their counts in all texts and in training texts, from a settled tally."""
    if not len(keys):
        return keys, counts, counts
    codes, marked = keys >> np.uint64(1), (keys & np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first), np.add.reduceat(counts * marked, first)


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    return (contexts * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)


def suffix(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of context of grams' or nodes' keys."""
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * length)) - 1)


#: Rows of packed arrays: grams with counts, nodes with zeros, ones and weights, or nodes with what lies above them.
GRAMS, NODES, LINKS = 0, 1, 2
PACKED = "bucket int, kind int, keys binary, values binary"


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: most planes hold like bytes, which the shuffle compresses."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(kind: int, bucket: np.ndarray, keys: np.ndarray, values: list[np.ndarray]):
    """Batches of packed rows, each of one bucket."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[order], keys[order], np.stack(values)[:, order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    cuts = [(a, min(a + ROW_GRAMS, e)) for s, e in zip(starts, [*starts[1:], len(keys)]) for a in range(s, e, ROW_GRAMS)]
    for at in range(0, len(cuts), 512):
        part = cuts[at: at + 512]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket[a] for a, _ in part], pa.int32()),
                pa.array([kind] * len(part), pa.int32()),
                pa.array([planes(keys[a:e]) for a, e in part], pa.binary()),
                pa.array([planes(values[:, a:e].ravel()) for a, e in part], pa.binary()),
            ],
            ["bucket", "kind", "keys", "values"],
        )


def rows_of(batches):
    """``bucket, kind, keys, values`` of packed rows."""
    for batch in batches:
        for bucket, kind, keys, values in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "keys", "values"))):
            keys = from_planes(keys, np.uint64)
            yield bucket, kind, keys, from_planes(values, np.int64 if kind == GRAMS else np.float64).reshape(-1, len(keys))


def whole_buckets(batches):
    """A tally of the grams and the list of other rows of some whole buckets, from rows that are sorted by bucket."""
    tally, others, size, last = Tally(), [], 0, None
    for bucket, kind, keys, values in rows_of(batches):
        if bucket != last and size >= BLOCK_GRAMS:
            yield tally, others
            tally, others, size = Tally(), [], 0
        last, size = bucket, size + len(keys)
        if kind == GRAMS:
            tally.add(keys, values[0])
        else:
            others.append((keys, values))
    if size:
        yield tally, others


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """``word, n, c``: a word's count in all texts, and in the training texts."""
    slim = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).cast("int").alias("train"))
    names = ["word", "n", "c"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed(tables):
            return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum"), ("c", "sum")]).rename_columns(names)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, WORD_TEXTS):
                part = batch.slice(at, WORD_TEXTS)
                marks = part.column(1).to_numpy()
                words, place = words_of(part.column(0))
                for mark in (0, 1):
                    found = pc.value_counts(words.filter(pa.array(marks[place] == mark)))
                    word = pa.concat_arrays([found.field(0).cast(pa.binary()), pa.array([END])])
                    n = np.append(found.field(1).to_numpy(), (marks == mark).sum())
                    held.append(pa.table([word, pa.array(n), pa.array(n * mark)], names))
                    size += len(n)
                if size > 2 * FLUSH_WORDS:
                    held = [summed(held)]
                    size = held[0].num_rows
                    pa.default_memory_pool().release_unused()
                    if size > FLUSH_WORDS:
                        yield from held[0].to_batches(50_000)
                        held, size = [], 0
        if held:
            yield from summed(held).combine_chunks().to_batches(50_000)
        del held
        pa.default_memory_pool().release_unused()

    parts = slim.mapInArrow(run, "word binary, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where("n > 0")


def blocks(texts: list[bytes], depth: int):
    """``(numbers of the texts, parts)`` of at most about ``BLOCK_BYTES``, for ``windows``; a long text is cut into parts that repeat their context."""
    numbers, held, size = [], [], 0
    for k, text in enumerate(texts):
        whole = START * depth + normal(text)
        for at in range(depth, len(whole), BLOCK_BYTES):
            part = whole[at - depth: at + BLOCK_BYTES]
            if held and size + len(part) > BLOCK_BYTES:
                yield np.array(numbers), held
                numbers, held, size = [], [], 0
            numbers.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(numbers), held


def gram_counts(docs: DataFrame, text_col: str, train: Column, depth: int) -> DataFrame:
    """Packed rows of grams, marked for training, with each task's counts."""
    low = min(LOW, depth)
    slim = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).cast("int").alias("train"))

    def run(batches):
        from .packing import text_bytes

        tally = Tally()

        def flush():
            keys, counts = tally.settled()
            yield from packed(GRAMS, bucket_of(suffix(keys >> np.uint64(1), low)), keys, [counts])
            tally.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(at, BLOCK_TEXTS)
                marks = part.column(1).to_numpy().astype(np.uint64)
                for numbers, held in blocks(text_bytes(part.column(0)), depth):
                    codes, lengths = windows(held, depth)
                    tally.add(*np.unique(codes << np.uint64(1) | np.repeat(marks[numbers], lengths), return_counts=True))
                if tally.size > FLUSH_GRAMS:
                    tally.settled()
                    if tally.size > FLUSH_GRAMS:
                        yield from flush()
        yield from flush()

    return slim.mapInArrow(run, PACKED)


# ---------------------------------------------------------------- the tree as tables


def gram_scores(parts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Merged packed rows of the grams, and ``gram, n, s``: each gram's count in all texts and log10 probability."""
    spark, low = parts.sparkSession, min(LOW, depth)

    def merge(batches):
        for tally, _ in whole_buckets(batches):
            keys, counts = tally.settled()
            yield from packed(GRAMS, bucket_of(suffix(keys >> np.uint64(1), low)), keys, [counts])
            codes, _, c = unmarked(keys, counts)
            tops, values = top_nodes(codes, c.astype(float), depth, low)
            yield from packed(NODES, suffix(tops, 1).astype(np.int64), tops, values)

    def climb(rows, deep, top):
        """Node keys, those at the top, the ladder between and the levels with the top's weighted ln probability."""
        keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows], 1)
        order = np.argsort(keys)
        keys = keys[order]
        tops, up = ladder(keys, deep, top)
        return keys, tops, up, weigh(*values[:, order], up)

    def lift_nodes(batches):
        for _, rows in whole_buckets(batches):
            _, tops, _, (levels, weighted) = climb(rows, low, 1)
            yield from packed(NODES, np.zeros(len(tops), np.int64), tops, [*levels[-1][:2], weighted])

    merged = materialise(together(parts).mapInArrow(merge, PACKED), "lm-grams")
    grams, nodes = merged.where(F.col("kind") == GRAMS), merged.where(F.col("kind") == NODES)
    upper = together(nodes).mapInArrow(lift_nodes, PACKED)
    rows = [(k, v) for _, _, k, v in rows_of(upper.toArrow().to_batches())]
    given = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if rows:
        keys, tops, up, (levels, _) = climb(rows, 1, 0)
        given = (keys, *descend(levels, up, np.zeros(len(tops)), np.ones(len(tops))))
    path = work_path(spark, "lm-top")
    write_file(path, pickle.dumps(given))

    def lower_nodes(batches):
        known, alpha, beta = pickle.loads(read_file(path))
        for _, rows in whole_buckets(batches):
            keys, tops, up, (levels, _) = climb(rows, low, 1)
            at = np.searchsorted(known, tops)
            yield from packed(LINKS, bucket_of(suffix(keys, low)), keys, list(descend(levels, up, alpha[at], beta[at])))

    def score_grams(batches):
        import pyarrow as pa

        for tally, rows in whole_buckets(batches):
            known, links = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows], 1)
            order = np.argsort(known)
            known, links = known[order], links[:, order]
            codes, n, c = unmarked(*tally.settled())
            scores = tree_log10(codes, c.astype(float), depth, low, lambda tops: links[:, np.searchsorted(known, tops)])
            for at in range(0, len(codes), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[cut].astype(np.int64)), pa.array(n[cut]), pa.array(scores[cut])], ["gram", "n", "s"])

    links = together(nodes).mapInArrow(lower_nodes, PACKED)
    scored = together(grams.unionByName(links)).mapInArrow(score_grams, "gram long, n long, s double")
    return grams, materialise(scored, "lm-scored-grams")


def most_frequent(table: DataFrame, head: int) -> DataFrame:
    """The rows of the least count such that no more than ``head`` rows reach it, by powers of 2^(1/8)."""
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least = head, None
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return table.where(level >= least) if least is not None else table.limit(0)


@dataclass(frozen=True)
class Model:
    """A fitted model: where its tables lie, and its totals."""

    words: DataFrame  # word, c, n, base
    counts: DataFrame  # packed rows of all grams
    grams: DataFrame  # gram, n, s
    head_path: str
    depth: int
    train_tokens: int
    train_types: int

    @property
    def unseen(self) -> float:
        """The base's log10 for a word that training doesn't hold."""
        return -float(np.log10(self.train_tokens + self.train_types + 1))


def fit(docs: DataFrame, train: Column, text_col: str = "text", depth: int = DEPTH, head: int = HEAD) -> Model:
    """Learn from the rows where ``train`` holds; the words and grams of other rows are looked up in the same pass."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, text_col, train), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    words = counts.withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))))
    grams, scored = gram_scores(gram_counts(docs, text_col, train, depth), depth)

    head_path = work_path(spark, "lm-head")
    end = words.where(F.col("word") == F.lit(END)).select("c", "base").first() or (0, 0.0)
    top = most_frequent(words.where(F.col("word") != F.lit(END)), head).select("word", "c", "base").toArrow()
    parts = [tuple(end), top.column("word").to_pylist(), *(np.append(top.column(x).to_numpy(), 0) for x in ("c", "base"))]
    top = most_frequent(scored, GRAMS_A_WORD * head).select("gram", "s").toArrow()
    codes = top.column("gram").to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    write_file(head_path, pickle.dumps((*parts, codes[order], top.column("s").to_numpy()[order])))
    return Model(words, grams, scored, head_path, depth, n, v)


def new_grams(model: Model, grams: DataFrame) -> DataFrame:
    """``gram, s`` of grams that ``fit`` did not meet: the tree is run again with them, at count zero."""
    low = min(LOW, model.depth)

    def run(batches):
        for batch in batches:
            keys = np.sort(batch.column(0).to_numpy().astype(np.uint64)) << np.uint64(1)
            yield from packed(GRAMS, bucket_of(suffix(keys >> np.uint64(1), low)), keys, [np.zeros(len(keys), np.int64)])

    _, scored = gram_scores(model.counts.unionByName(grams.mapInArrow(run, PACKED)), model.depth)
    return scored.join(grams, "gram", "left_semi").select("gram", "s")


_LOADED: dict[str, tuple] = {}


def _load(path: str) -> tuple:
    claim("scoring", _LOADED.clear)
    if path not in _LOADED:
        import pyarrow as pa

        _LOADED.clear()
        end, words, c, base, grams, scores = pickle.loads(read_file(path))
        _LOADED[path] = (end, pa.array(words, pa.binary()), (c > 0).astype(np.int64), base, grams, scores)
    return _LOADED[path]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_bytes, n_known, base_score, score`` of each row; scores are log10.

    Rows that ``fit`` did not meet may be scored too; if they hold grams that are
    new to the model, the tree is run again to tell those grams' chances.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    head_path, depth = model.head_path, model.depth

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from .packing import text_bytes

        (end_c, end_base), head, known, base, known_grams, values = _load(head_path)
        uid, last = TaskContext.get().partitionId() << 33, max(0, len(known_grams) - 1)

        def lists(places, n, values):
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, np.arange(n + 1)).astype(np.int32)), values)

        def by_words(column):
            n, (words, place) = len(column), words_of(column)
            words = words.cast(pa.binary())
            spot = pc.index_in(words, value_set=head)
            rare, spot = spot.is_null(), pc.fill_null(spot, len(head)).to_numpy()
            return [
                np.bincount(place, minlength=n) + 1,
                np.bincount(place, known[spot], n).astype(np.int64) + int(end_c > 0),
                np.bincount(place, base[spot], n) + end_base,
                lists(place[rare.to_numpy(zero_copy_only=False)], n, words.filter(rare)),
            ]

        def by_grams(texts):
            sums, lost = np.zeros(len(texts)), []
            for numbers, held in blocks(texts, depth):
                codes, lengths = windows(held, depth)
                pairs, k = np.unique(codes << np.uint64(8) | np.repeat(numbers.astype(np.uint64), lengths), return_counts=True)
                codes, text = pairs >> np.uint64(8), (pairs & np.uint64(255)).astype(np.int64)
                new = np.append(True, codes[1:] != codes[:-1])
                distinct = codes[new]
                spot = np.minimum(np.searchsorted(known_grams, distinct), last)
                hit = known_grams[spot] == distinct if len(known_grams) else np.zeros(len(distinct), bool)
                value = np.where(hit, values[spot], 0.0) if len(known_grams) else np.zeros(len(distinct))
                at = np.cumsum(new) - 1
                sums += np.bincount(text, k * value[at], len(texts))
                rest = ~hit[at]
                lost.append((text[rest], codes[rest], k[rest]))
            text, codes, k = (np.concatenate(x) for x in zip(*lost))
            order = np.argsort(text, kind="stable")
            gram = pa.StructArray.from_arrays([pa.array(codes[order].astype(np.int64)), pa.array(k[order].astype(np.int32))], ["gram", "k"])
            return sums, lists(text[order], len(texts), gram)

        for batch in batches:
            for at in range(0, batch.num_rows, WORD_TEXTS):
                part = batch.slice(at, WORD_TEXTS)
                counted, texts = by_words(part.column(1)), text_bytes(part.column(1))
                found = [by_grams(texts[k: k + BLOCK_TEXTS]) for k in range(0, len(texts), BLOCK_TEXTS)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.arange(uid, uid + len(texts))), pa.array(list(map(len, texts)), pa.int64()),
                        *(pa.array(x) for x in counted[:3]), counted[3], pa.array(np.concatenate([x for x, _ in found])), pa.concat_arrays([x for _, x in found]),
                    ],
                    ["doc_id", "uid", "n_bytes", "n_tokens", "n_known", "base_score", "rare", "score", "rare_grams"],
                )
                uid += len(texts)

    ddl = "uid long, n_bytes long, n_tokens long, n_known long, base_score double, rare array<binary>, score double, rare_grams array<struct<gram: long, k: int>>"
    first = materialise(slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL(ddl)])), "lm-head-scores")
    words = first.select("uid", F.explode("rare").alias("word")).join(model.words.select("word", "c", "base"), "word", "left").groupBy("uid").agg(
        F.count_if(F.col("c") > 0).alias("known"), F.sum(F.coalesce("base", F.lit(model.unseen))).alias("b")
    )
    lost = first.select("uid", F.inline("rare_grams"))
    scored = model.grams.select("gram", "s")
    new = materialise(lost.select("gram").distinct().join(scored, "gram", "left_anti"), "lm-new-grams")
    if not new.isEmpty():
        scored = scored.unionByName(new_grams(model, new))
    grams = lost.join(scored, "gram").groupBy("uid").agg(F.sum(F.col("k") * F.col("s")).alias("w"))
    zero = F.lit(0)
    return first.drop("rare", "rare_grams").join(words, "uid", "left").join(grams, "uid", "left").select(
        "doc_id",
        "n_tokens",
        "n_bytes",
        (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("w", zero)).alias("score"),
    )

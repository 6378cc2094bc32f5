"""Near-duplicate documents by one-permutation MinHash.

A document is its set of distinct word shingles, as 64-bit hashes. Documents
with equal sets are one class from the start. A class's sorted hashes fall
into bins by their leading bits; the least hash of each bin is its signature,
and empty bins borrow from bins that a fixed random sequence points to
(optimal densification). Signatures are cut into bands, a band is a bucket,
and each bucket gives star edges only: from its most central class (the one
that meets most others over all buckets) to every other one. Edges are
confirmed on the full sets, and components follow by label propagation.

A star can miss a link between two outer classes. Buckets that still hold
several components are therefore taken up again, exactly and without comparing
all their pairs. Each class is written as its difference from the star's
centre. Two classes are linked only if their differences share as many hashes
as their sizes tell, so an index over the rarest hashes of each difference
(prefix filtering, with bounds for each pair) finds all pairs that can be
linked; these are confirmed on the full sets like any other.

Bands are chosen so that a pair at the threshold shares no bucket with a chance
below ``MISS``. Only hashes are shuffled, but for the texts of classes that
some edge names. A hot bucket is pre-aggregated and its join is one that
adaptive execution can split.

Defined cases: a null or empty text, or one without words, has the empty set,
links with nothing and is its own component; a text of fewer words than a
shingle is one shingle; a null id links like any other, and its component is
the smallest id reachable, or null; repeated rows are copies; an empty table
gives no rows; the input's other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, free_name, materialise

MISS = 1e-7
#: Bands that a signature has at most, unless one row a band asks for more.
MAX_BANDS = 56
SHINGLE_WORDS = 5
PERCENT = 80
#: Slices of a component's classes when they meet its smallest id.
LABEL_SALTS = 16
CACHE_WORDS = 300_000
CACHE_SETS = 256
#: Hashes after which a batch of differences is handed on, however long the texts are.
BATCH_HASHES = 100_000

_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int, miss: float = MISS, most: int = MAX_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most selective bands that miss a pair at the threshold with chance <= ``miss``.

    The chance is that of independent rows. Bins of one signature agree or
    differ together a little, which makes it up to some 50 times as large for
    a pair exactly at the threshold (5e-6); pairs above it gain quickly.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if best and bands > most:
            break
        best = (bands, rows)
    return best


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if not _WORDS:
        claim("near duplicates", _WORDS.clear)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        out = out * _P + h[j: j + n]
    out = np.sort(_finish(out))
    return out[np.append(True, out[1:] != out[:-1])]


class Signer:
    """Band hashes of shingle sets."""

    STEPS = 64

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.walk = np.random.default_rng(20240229).integers(0, self.bins, (self.bins, 64 * self.STEPS), np.int64)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin, densified; ``hashes`` sorted and not empty."""
        bin_of = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
        out = np.zeros(self.bins, np.uint64)
        held = np.zeros(self.bins, bool)
        held[bin_of[first]] = True
        out[bin_of[first]] = hashes[first]
        empty = np.flatnonzero(~held)
        at, step = 0, 4
        while len(empty) and at < self.walk.shape[1]:
            to = self.walk[empty, at: at + step]
            hit = held[to]
            found = hit.any(1)
            out[empty[found]] = out[to[found, hit[found].argmax(1)]]
            empty, at, step = empty[~found], at + step, min(4 * step, self.STEPS * 4)
        out[empty] = hashes[0]
        return out

    def band_hashes(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).reshape(self.bands, self.rows)
        h = self.salt.copy()
        for j in range(self.rows):
            h = (h ^ _finish(sig[:, j])) * _P
        return _finish(h).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """``uid, doc_id, n_shingles, set_key, bands`` of each row; no key or bands for empty sets."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        from .packing import text_bytes

        signer, uid = Signer(bands, rows), TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                sizes, keys, found = [], [], []
                for text in text_bytes(part.column(1)):
                    s = shingles(text, k)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    found.append(signer.band_hashes(s) if len(s) else np.zeros(0, np.int64))
                n = len(sizes)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists],
                    ["uid", "doc_id", "n_shingles", "set_key", "bands"],
                )
                uid += n

    return slim.mapInArrow(run, "uid long, doc_id long, n_shingles long, set_key binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``cid, label`` of the nodes of undirected edges ``a, b``: the least node reachable."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("cid").alias("a"), "label"), "a").groupBy(F.col("b").alias("cid")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialise(step, "labels")
        jump = step.select(F.col("cid").alias("label"), F.col("label").alias("far"))
        labels = materialise(step.join(jump, "label", "left").select("cid", "old", F.least("label", "far").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("cid", "label")
        labels = labels.select("cid", "label")


def confirm(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``a, b, shared, total``: sizes of the intersection and union of both full sets."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}

        def set_of(cid, text):
            if cid not in held:
                if len(held) >= CACHE_SETS:
                    held.clear()
                held[cid] = shingles(text, k)
            return held[cid]

        from .packing import text_bytes

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                shared, total = [], []
                for x, y, tx, ty in zip(a, b, text_bytes(part.column(2)), text_bytes(part.column(3))):
                    p, q = set_of(x, tx), set_of(y, ty)
                    both = np.sort(np.concatenate([p, q]), kind="stable")
                    n = int((both[1:] == both[:-1]).sum())
                    shared.append(n)
                    total.append(len(both) - n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    return rows.mapInArrow(run, "a long, b long, shared long, total long")


def class_texts(docs: DataFrame, classes: DataFrame, named: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``cid, text`` of the classes in ``named`` (``cid``)."""
    wanted = classes.join(named, "cid").select("cid", "set_key", F.col("any_id").alias("__id"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = source.join(wanted.hint("shuffle_hash"), source["doc_id"].eqNullSafe(F.col("__id"))).select("cid", "set_key", "text")

    def run(batches):
        import pyarrow as pa
        import xxhash

        from .packing import text_bytes

        for batch in batches:
            keys = batch.column(1).to_pylist()
            same = [key == xxhash.xxh3_128_digest(shingles(t, k).tobytes()) for key, t in zip(keys, text_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in (batch.column(0), batch.column(2))], ["cid", "text"])

    # rows that share an id may hold several texts, and a text several rows
    return found.mapInArrow(run, "cid long, text string").groupBy("cid").agg(F.first("text").alias("text"))


def follow_up(stars: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` that share a bucket, not a component, and may still be linked.

    With c the centre's set, x and y linked means that the symmetric difference
    of x and y is at most ``slack * (|x| + |y|)``. It is that of X = x ^ c and
    Y = y ^ c, so X and Y share at least ``need = (|X| + |Y| - slack * (|x| +
    |y|)) / 2`` hashes, and one of them is among the ``|X| - need + 1`` rarest of
    X and the ``|Y| - need + 1`` rarest of Y. One class of such a pair is not
    linked with the centre; that bounds ``need`` for the other one alone.

    Of the classes that share a hash, those of its commonest component meet only
    classes of other components, so a group of copies that is linked already is
    never paired within itself, however large.
    """
    slack = (100 - percent) / (100 + percent)
    labelled = stars.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    members = labelled.join(several, "bucket").where("cid <> hub").select("hub", "cid", "label").distinct()
    hub_label = labels.select(F.col("cid").alias("hub"), F.col("label").alias("hub_label"))
    members = members.join(hub_label, "hub", "left").withColumn("rest", F.col("label") != F.coalesce("hub_label", "hub")).drop("hub_label")
    members = members.join(texts.select("cid", F.col("text").alias("t")), "cid").join(texts.select(F.col("cid").alias("hub"), F.col("text").alias("th")), "hub")

    def run(batches):
        import pyarrow as pa

        from .packing import text_bytes

        name, centre = None, None

        def rows_of(part, hashes, sizes, centres):
            each = np.array([len(h) for h in hashes])
            rows = np.repeat(np.arange(len(each)), each)
            taken = [part.column(n).take(pa.array(rows)) for n in range(4)]
            numbers = [np.array(x)[rows] for x in (sizes, centres, each)]
            return pa.RecordBatch.from_arrays(
                [*taken, *(pa.array(x, pa.int64()) for x in numbers), pa.array(np.concatenate(hashes).view(np.int64))], ["hub", "cid", "label", "rest", "n", "nh", "d", "hash"]
            )

        for batch in batches:
            for part in (batch.slice(n, 64) for n in range(0, batch.num_rows, 64)):
                begin, held, hashes, sizes, centres = 0, 0, [], [], []
                for at, (hub, t, th) in enumerate(zip(part.column(0).to_pylist(), text_bytes(part.column(4)), text_bytes(part.column(5)))):
                    if hub != name:
                        name, centre = hub, shingles(th, k)
                    own = shingles(t, k)
                    hashes.append(np.setxor1d(own, centre, assume_unique=True))
                    sizes.append(len(own))
                    centres.append(len(centre))
                    held += len(hashes[-1])
                    if held >= BATCH_HASHES:
                        yield rows_of(part.slice(begin, at + 1 - begin), hashes, sizes, centres)
                        begin, held, hashes, sizes, centres = at + 1, 0, [], [], []
                if hashes:
                    yield rows_of(part.slice(begin), hashes, sizes, centres)

    split = members.select("hub", "cid", "label", "rest", "t", "th").mapInArrow(run, "hub long, cid long, label long, rest boolean, n long, nh long, d long, hash long")
    split = materialise(split, "minhash-differences")
    often = split.groupBy("hub", "hash").agg(F.count("*").alias("often"))
    order = Window.partitionBy("hub", "cid").orderBy("often", "hash")
    ranked = split.join(often, ["hub", "hash"]).withColumn("rank", F.row_number().over(order))

    def need(total):
        return F.greatest(F.lit(1), F.ceil(total / 2 - 1e-9))

    alone = need(F.col("d") + slack * (F.col("nh") - F.col("n")))
    ranked = materialise(ranked.withColumn("early", F.col("rank") <= F.col("d") - alone + 1).where("rest OR early"), "minhash-prefixes")
    # rows of a hash that carry its commonest label never meet each other: large groups that are linked already cost nothing
    held = ranked.groupBy("hub", "hash", "label").agg(F.count("*").alias("c"))
    major = held.groupBy("hub", "hash").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("major")).where("labels > 1").drop("labels")
    ranked = ranked.join(major, ["hub", "hash"]).withColumn("common", F.col("label") == F.col("major"))
    x = ranked.where("rest").select(F.col("common").cast("int").alias("side"), "hub", "hash", F.col("cid").alias("x"), F.col("label").alias("xl"), F.col("n").alias("xn"), F.col("d").alias("xd"), F.col("rank").alias("xr"))
    sides = F.when(F.col("common"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    y = ranked.where("early").select(F.explode(sides).alias("side"), "hub", "hash", F.col("cid").alias("y"), F.col("label").alias("yl"), F.col("n").alias("yn"), F.col("d").alias("yd"), F.col("rank").alias("yr"))
    both = need(F.col("xd") + F.col("yd") - slack * (F.col("xn") + F.col("yn")))
    found = x.join(y, ["hub", "hash", "side"]).where((F.col("xl") != F.col("yl")) & (F.col("xr") <= F.col("xd") - both + 1) & (F.col("yr") <= F.col("yd") - both + 1))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and ``set_key, component_id, least_id, first`` of each
    class, where ``first`` marks the class that stands for its component."""
    bands, rows = bands_for(percent)
    signed = materialise(signatures(docs, id_col, text_col, k, bands, rows), "minhash-signatures")
    classes = materialise(
        signed.where("n_shingles > 0").groupBy("set_key").agg(
            F.min("uid").alias("cid"), F.min("doc_id").alias("least_id"), F.min_by("doc_id", "uid").alias("any_id"), F.min_by("bands", "uid").alias("bands")
        ),
        "minhash-classes",
    )
    members = classes.select("cid", F.explode("bands").alias("bucket"))
    sized = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(members.join(sized, "bucket"), "minhash-buckets")
    central = shared.groupBy("cid").agg(F.sum("n").alias("c"))
    hubs = shared.join(central, "cid").groupBy("bucket").agg(F.max(F.struct("c", (-F.col("cid")).alias("m"))).alias("h")).select("bucket", (-F.col("h.m")).alias("hub"))
    stars = materialise(shared.select("bucket", "cid").join(hubs, "bucket"), "minhash-stars")

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    pairs = materialise(stars.where("cid <> hub").select(*ordered("hub", "cid")).distinct(), "minhash-pairs")
    named = stars.select("cid").distinct()
    texts = materialise(class_texts(docs, classes, named, id_col, text_col, k), "minhash-texts")
    compared = materialise(confirm(pairs, texts, k), "minhash-compared")
    linked = F.col("shared") * 100 >= F.col("total") * percent
    labels = components(compared.where(linked))
    missed = materialise(follow_up(stars, labels, texts, k, percent), "minhash-pairs")
    if not missed.isEmpty():
        compared = compared.unionByName(materialise(confirm(missed, texts, k), "minhash-compared"))
        labels = components(compared.where(linked))
    place = F.struct(F.col("least_id").isNull().alias("missing"), "least_id", "cid")
    lowest = labels.join(classes.select("cid", "least_id"), "cid").groupBy("label").agg(F.min(place).alias("low"))
    # a component may hold a large share of all classes, so its label is salted
    salted = labels.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(LABEL_SALTS)).cast("int"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    named = classes.select("set_key", "cid", "least_id").join(salted.join(lowest, ["label", "salt"]).select("cid", "low"), "cid", "left")
    return signed, named.select(
        "set_key", F.coalesce("low.least_id", "least_id").alias("component_id"), "least_id", F.coalesce(F.col("low.cid") == F.col("cid"), F.lit(True)).alias("first")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row: documents with
    ``100 * shared >= percent * total`` are linked."""
    signed, named = linked_classes(docs, id_col, text_col, shingle_words, percent)
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The input without all but one row of each component: a row with its
    smallest id. Rows without words all stay."""
    k = shingle_words
    _, named = linked_classes(docs, id_col, text_col, k, percent)
    key, winner, least, row_name = (free_name(docs.columns, x) for x in ("__key", "__winner", "__least", "__row"))
    winners = named.where("first").select(F.col("set_key").alias(winner), F.col("least_id").alias(least))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField(key, T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import xxhash

        from .packing import text_bytes

        for batch in batches:
            sets = (shingles(t, k) for t in text_bytes(batch.column(at)))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[f.name for f in schema])

    keyed = docs.mapInArrow(run, schema)
    match = (F.col(key) == F.col(winner)) & F.col(id_col).cast("long").eqNullSafe(F.col(least))
    found = keyed.join(winners, match, "left").where(F.col(key).isNull() | F.col(winner).isNotNull())
    row = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return found.withColumn(row_name, row).dropDuplicates([key, id_col, row_name]).select(*docs.columns)

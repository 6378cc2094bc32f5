"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

The features of a text are lexicon densities, how close lexicon words stand to
a second person, capitals, punctuation and obfuscation rates. The lexicon
(words and word beginnings) is learned from the labelled sample by the
likelihood-ratio statistic of document counts; a term must be far beyond
chance. Trees are fitted to three quarters of the sample and calibrated by
isotonic regression on the rest, both weighted back to the classes' shares.

Sample bound: at most ``positives`` and ``negatives`` labelled documents,
chosen by a hash of the id. All that depends on the sample (term counts after
the threshold, features, trees) is bounded by it; every text is scored whole,
in one pass without a shuffle.

Defined cases: a null or empty text has all features 0 and the score they get;
labels other than 0 and 1, or of null ids, are not learned from; a document
with several labels counts as toxic if one says so; without any labels of both
kinds every score is 0; repeated rows are scored each; an empty table gives no
rows; the input's other columns are ignored, or kept with ``keep=True``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, materialise, new_name

POSITIVES, NEGATIVES = 3000, 6000
MAX_TERMS = 256
MIN_DOCS = 4
MIN_RATIO = 30.0
NEAR = 5
CACHE_CHUNKS = 250_000
PREFIXES = (4, 5)

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú usted ustedes tus".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": "", "|": "l"})

NAMES = (
    "hit_rate", "log_hits", "distinct_hits", "weight_rate", "hit_near_second", "second_rate", "capital_rate", "shout_rate",
    "punctuation_rate", "exclamation_rate", "question_rate", "digit_rate", "obfuscation_rate", "hidden_hits", "repeat_rate", "log_words",
)

_REPEAT = re.compile(r"(.)\1\1")
_EDGE = ".,;:!?\"'()[]{}<>*_-|/\\#%&$~`+="


def terms(word: str) -> list[str]:
    """A word and its beginnings, as lexicon terms."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def core(chunk: str) -> str:
    return chunk.strip(_EDGE).lower()


class Chunks(dict):
    """Numbers distinct chunks and keeps a row of facts for each."""

    WIDTH = 11

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows, self.hit = lexicon, [], {}
        self.table, self.filled = np.zeros((1024, self.WIDTH)), 0
        self.begin = {k: {t[:-1]: w for t, w in lexicon.items() if t.endswith("*") and len(t) == k + 1} for k in PREFIXES}

    def facts(self) -> np.ndarray:
        """All rows so far; only new ones are copied into the growing table."""
        total = self.filled + len(self.rows)
        if total > len(self.table):
            self.table = np.concatenate([self.table[: self.filled], np.zeros((2 * total - self.filled, self.WIDTH))])
        if self.rows:
            self.table[self.filled: total] = self.rows
            self.filled = total
            self.rows.clear()
        return self.table[:total]

    def forget(self) -> None:
        self.clear()
        self.rows.clear()
        self.hit.clear()
        self.filled = 0

    def weight(self, word: str) -> tuple[float, str]:
        """The greatest weight among a word's terms, and that term."""
        best, term = self.lexicon.get(word, 0.0), word
        for k, table in self.begin.items():
            w = table.get(word[:k], 0.0)
            if w > best or w == best and w and f"{word[:k]}*" > term:
                best, term = w, f"{word[:k]}*"
        return best, term

    def __missing__(self, raw: bytes) -> int:
        chunk = raw.decode("utf-8", "replace")
        size = len(chunk)
        if chunk.isalpha():
            word = chunk.lower()
            letters, digits, upper = size, 0, 0 if word == chunk else sum(map(str.isupper, chunk))
        else:
            word = core(chunk)
            letters, digits = sum(map(str.isalpha, chunk)), sum(map(str.isdigit, chunk))
            upper = 0 if chunk.islower() else sum(map(str.isupper, chunk))
        weight, term = self.weight(word) if word else (0.0, "")
        hidden = 0
        mixed = 0 < letters < len(word) - word.count("-") - word.count("'")
        if mixed and not weight:
            weight, term = self.weight(word.translate(LEET))
            hidden = weight > 0
        self[raw] = n = self.filled + len(self.rows)
        if weight:
            self.hit[n] = term
        self.rows.append(
            (weight > 0, weight, word in SECOND_PERSON, letters, upper, letters > 1 and upper == letters, size - letters - digits, chunk.count("!"), chunk.count("?"), digits, mixed + 2 * hidden + 4 * bool(_REPEAT.search(word)))
        )
        return n


def features(texts: list[bytes], chunks: Chunks) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    if len(chunks) > CACHE_CHUNKS:
        chunks.forget()
    look = chunks.__getitem__
    places = [np.array(list(map(look, t.split())), np.int64) for t in texts]
    out = np.zeros((len(texts), len(NAMES)))
    n = np.array([len(p) for p in places])
    if not n.sum():
        return out
    facts = chunks.facts()
    which = np.concatenate(places)
    doc = np.repeat(np.arange(len(texts)), n)
    spot = np.arange(len(which)) + doc * 2 * (NEAR + 1)
    hit = np.flatnonzero(facts[which, 0])
    second = np.flatnonzero(facts[which, 2])

    def total(column):
        return np.bincount(doc, facts[which, column] if isinstance(column, int) else column, len(texts))

    hits = np.bincount(doc[hit], minlength=len(texts)).astype(float)
    kinds = {}
    for d, k in zip(doc[hit].tolist(), which[hit].tolist()):
        kinds.setdefault(d, set()).add(chunks.hit[k])
    near = np.zeros(len(texts))
    if len(hit) and len(second):
        at = np.searchsorted(spot[second], spot[hit])
        left = np.abs(spot[hit] - spot[second][np.maximum(at - 1, 0)])
        right = np.abs(spot[hit] - spot[second][np.minimum(at, len(second) - 1)])
        near = np.bincount(doc[hit][np.minimum(left, right) <= NEAR], minlength=len(texts)).astype(float)
    letters, flags = np.maximum(total(3), 1), facts[which, 10].astype(int)
    size = np.maximum(n, 1)
    chars = np.maximum(total(3) + total(6) + total(9), 1)
    out[:, 0] = hits / size
    out[:, 1] = np.log1p(hits)
    out[:, 2] = [len(kinds.get(d, ())) for d in range(len(texts))]
    out[:, 3] = total(1) / size
    out[:, 4] = near / size
    out[:, 5] = total(2) / size
    out[:, 6] = total(4) / letters
    out[:, 7] = total(5) / size
    for k, column in ((8, 6), (9, 7), (10, 8), (11, 9)):
        out[:, k] = total(column) / chars
    out[:, 12] = total((flags & 1).astype(float)) / size
    out[:, 13] = total((flags >> 1 & 1).astype(float))
    out[:, 14] = total((flags >> 2 & 1).astype(float)) / size
    out[:, 15] = np.log1p(n)
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Boosted:
    """Additive regression trees on logistic loss, over quantile bins."""

    start: float
    trees: list  # arrays (feature, threshold, left, right, value) of a tree's nodes
    x: np.ndarray  # of the isotonic fit: raw scores
    y: np.ndarray  # and probabilities

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, part: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48) -> Boosted:
        """``part``: True for rows that calibrate, False for rows that grow trees."""
        grow = ~part if 0 < part.sum() < len(part) and 0 < y[~part].sum() < (~part).sum() else np.ones(len(y), bool)
        gx, gy, gw = x[grow], y[grow], w[grow]
        cuts = [np.unique(np.quantile(gx[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        cuts = [np.unique(np.append(c, gx[gx[:, f] > 0, f].min() / 2)) if (gx[:, f] > 0).any() else c for f, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, gx[:, f], "left") for f, c in enumerate(cuts)], 1)
        mean = float(np.clip((gw * gy).sum() / gw.sum(), 1e-6, 1 - 1e-6))
        model = cls(np.log(mean / (1 - mean)), [], np.zeros(0), np.zeros(0))
        raw = np.full(len(gy), model.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree = _grow(binned, cuts, gw * (gy - p), gw * np.maximum(p * (1 - p), 1e-6), depth, rate, gw.sum())
            model.trees.append(tree)
            raw += _walk(tree, gx)
        own = part if 0 < y[part].sum() < part.sum() else np.ones(len(y), bool)
        model.x, model.y = isotonic(model.raw(x[own]), y[own], w[own])
        return model

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_walk(t, x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a small share of the raw one keeps the order inside steps."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.x, self.y) + 0.01 / (1 + np.exp(-raw))


def _grow(binned, cuts, grad, hess, depth, rate, mass):
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows, level):
        at = len(feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, rate * g / (h + 1e-3 * mass / len(grad) * 10))):
            a.append(v)
        best = (1e-6 * mass, None)
        if level < depth and len(rows) >= 8:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.bincount(binned[rows, f], grad[rows], len(c) + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, f], hess[rows], len(c) + 1).cumsum()[:-1]
                ns = np.bincount(binned[rows, f], minlength=len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1e-9) + (g - gs) ** 2 / (h - hs + 1e-9) - g**2 / (h + 1e-9)
                gain[(ns < 4) | (len(rows) - ns < 4)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1]:
            f, k = best[1]
            go = binned[rows, f] <= k
            feature[at], threshold[at] = f, cuts[f][k]
            left[at] = node(rows[go], level + 1)
            right[at] = node(rows[~go], level + 1)
        return at

    node(np.arange(len(grad)), 0)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def _walk(tree, x):
    feature, threshold, left, right, value = tree
    at = np.zeros(len(x), int)
    for _ in range(len(feature)):
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            break
        go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return value[at]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted least-squares fit (pool adjacent violators)."""
    keys, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w)
    mean = np.bincount(inverse, w * y) / weight
    blocks: list[list[float]] = []
    for k, m, n in zip(keys.tolist(), mean.tolist(), weight.tolist()):
        blocks.append([m, n, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, n2, _, hi = blocks.pop()
            m1, n1, lo, _ = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    xs, ys = [], []
    for m, _, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [m, m] if hi > lo else [m]
    return np.array(xs), np.array(ys)


# ---------------------------------------------------------------- on Spark


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    boosted: Boosted | None


def _lexicon(sample: DataFrame, max_terms: int) -> dict[str, float]:
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return {}

    def count(batches):
        import pyarrow as pa

        from .packing import text_bytes

        found = ({}, {})

        def flush():
            keys = list({*found[0], *found[1]})
            for at in range(0, len(keys), 50_000):
                ks = keys[at: at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(ks), *(pa.array([found[y].get(k, 0) for k in ks], pa.int64()) for y in (1, 0))], ["term", "p", "n"])
            found[0].clear()
            found[1].clear()

        for batch in batches:
            for text, y in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = {core(c.decode("utf-8", "replace")) for c in set(text.split())}
                counts = found[y]
                for t in {t for w in words if w for t in terms(w)}:
                    counts[t] = counts.get(t, 0) + 1
                if len(found[0]) + len(found[1]) > 1_000_000:
                    yield from flush()
        yield from flush()

    df = sample.select("text", "toxic").mapInArrow(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both = (F.col("p") + F.col("n")) / F.lit(float(p + n))
    ratio = 2 * (part(F.col("p"), both * p) + part(F.col("n"), both * n) + part(p - F.col("p"), (1 - both) * p) + part(n - F.col("n"), (1 - both) * n))
    odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    best = df.where((F.col("p") >= MIN_DOCS) & (F.col("p") * n > F.col("n") * p * 4)).select("term", ratio.alias("g"), odds.alias("w"))
    rows = best.where(F.col("g") >= MIN_RATIO).orderBy(F.desc("g"), "term").limit(max_terms).collect()
    return {r["term"]: float(r["w"]) for r in rows}


def _kept(docs: DataFrame, text_col: str, fn, name: str, kind: T.DataType, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and one more, which ``fn(texts)`` gives for each row."""
    slim = docs.select(*columns, F.col(text_col).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField(name, kind, False)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from .packing import text_bytes

        claim("toxicity", int)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = fn(text_bytes(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, to_arrow_type(kind))], names=[f.name for f in schema])

    return slim.mapInArrow(run, schema)


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positives: int = POSITIVES, negatives: int = NEGATIVES, max_terms: int = MAX_TERMS,
) -> Model:
    """Learn from labelled documents for which ``allowed`` (over ``labels``) holds."""
    known = labels.where(allowed & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for y, most in ((1, positives), (0, negatives)):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(materialise(chosen, "toxicity-ids")), "__id")
    sample = materialise(texts.groupBy("__id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity-sample")
    lexicon = _lexicon(sample, max_terms)
    chunks = []

    def rows(texts):
        if not chunks:
            chunks.append(Chunks(lexicon))
        return features(texts, chunks[0]).tolist()

    measured = _kept(sample, "text", rows, "x", T.ArrayType(T.DoubleType(), False), ["__id", "toxic"])
    got = measured.groupBy("__id").agg(F.max("toxic").alias("toxic"), F.min("x").alias("x")).orderBy("__id").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, None)
    x = np.array(got.column("x").to_pylist())
    share = {k: size.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    part = np.array([hash_part(i) for i in got.column("__id").to_pylist()])
    return Model(lexicon, Boosted.fit(x, y, w, part))


def hash_part(value) -> bool:
    """Whether a sample row calibrates rather than grows trees (a quarter do)."""
    import zlib

    return zlib.crc32(f"calibrate {value}".encode()) % 4 == 0


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """The input's id (or with ``keep`` all its columns, none of them called ``name``) and its score from 0 to 1."""
    chunks = []

    def rows(texts):
        if model.boosted is None:
            return [0.0] * len(texts)
        if not chunks:
            chunks.append(Chunks(model.lexicon))
        return model.boosted.score(features(texts, chunks[0])).tolist()

    if keep:
        new_name(docs.columns, name)
    source = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _kept(source, text_col if keep else "text", rows, name, T.DoubleType(), source.columns if keep else ["doc_id"])

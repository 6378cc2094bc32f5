"""One object for a schema and a key, and the evaluation runs built on it."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import auprc, auroc, calibrate, confusion, latency_summary, pick_at, pick_best, sample_pairs, score_pairs, sweep, throughput
from ..operators.link import equal, link_equal, link_similar
from ..operators.tokenize import Tokenizer, annotate, comparable
from ..operators.validate import record_errors
from .schema import FieldPath, FieldSet


class Session:
    """The field set is validated before the secret is touched."""

    def __init__(self, secret: bytes, field_set: FieldSet, key_id: str = ""):
        self.field_set = field_set.validate()
        self.tokenizer = Tokenizer(secret, key_id)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.destroy()

    def destroy(self) -> None:
        self.tokenizer.destroy()

    def deterministic(self, df: DataFrame, **options) -> DataFrame:
        return self.tokenizer.deterministic(df, self.field_set, **options)

    def probabilistic(self, df: DataFrame, **options) -> DataFrame:
        return self.tokenizer.probabilistic(df, self.field_set, **options)

    def field(self, value: Column, path: FieldPath) -> Column:
        return self.tokenizer.field(value, path)

    def equal(self, a: Column, b: Column) -> Column:
        return equal(a, b)

    def link_equal(self, left: DataFrame, right: DataFrame, **options) -> DataFrame:
        return link_equal(left, right, **options)

    def match(self, left: DataFrame, right: DataFrame, threshold: float, **options) -> DataFrame:
        return link_similar(left, right, self.field_set, threshold, **options)

    def validate(self, record: str = "record") -> Column:
        return record_errors(record, self.field_set)

    def annotate(self, token: Column, bloom: bool = False) -> Column:
        return annotate(token, self.field_set, bloom)


def _tokenized(session: Session, records: DataFrame, timed: bool = False) -> DataFrame:
    done = session.probabilistic(records.select("id", "record"), policy="sanitize", keep_errors=True, timed=timed)
    return comparable(done).select("id", "token", "words", "pops", "errors", *(["ns"] if timed else []))


def _drops(done: DataFrame) -> DataFrame:
    return done.select(F.explode("errors").alias("e")).groupBy(F.col("e.path").alias("path")).agg(F.count("*").alias("drops"))


def tokenize_all(session: Session, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparable tokens of sanitised records (``id``, ``record``), and counts of dropped fields."""
    done = _tokenized(session, records)
    return done.select("id", "token", "words", "pops"), _drops(done)


def scored(session: Session, records: DataFrame, positives: int, negatives: int, seed: int, threshold: float = 0.5) -> DataFrame:
    """``a, b, label, score, result`` of sampled pairs of ``id, canonical_id, record``."""
    pairs = sample_pairs(records, positives, negatives, seed)
    tokens, _ = tokenize_all(session, records)
    return score_pairs(pairs, tokens, session.field_set, threshold)


def calibrate_on(session: Session, records: DataFrame, positives: int, negatives: int, seed: int) -> dict:
    """The best threshold on a sample of labelled pairs."""
    return calibrate(scored(session, records, positives, negatives, seed)).first().asDict()


def run(session: Session, records: DataFrame, positives: int, negatives: int, seed: int, threshold: float) -> dict:
    """A full evaluation: sizes, areas, the best operating points, and times.

    Records are tokenised once; latencies are those of single records and
    pairs, taken where they are encoded and compared. An action runs each part,
    as what returns is numbers.
    """
    began = time.time()
    done = _tokenized(session, records, timed=True).persist()
    n = done.count()
    tokenized = time.time()
    rows = score_pairs(sample_pairs(records, positives, negatives, seed), done, session.field_set, threshold, timed=True).select("label", "score", "ns").persist()
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    matched = time.time()
    points = sweep(rows).persist()

    def one(df: DataFrame) -> dict | None:
        row = df.first()
        return row.asDict() if row else None

    def times(df: DataFrame, seconds: float, items: int) -> dict:
        return {**latency_summary(df, "ns", integral=True).first().asDict(), "throughput": throughput(items, seconds)}

    out = {
        "field_set_version": session.field_set.version,
        "field_set_fingerprint": session.field_set.fingerprint(),
        "counts": {"records": n, "positives": count.get(True, 0), "negatives": count.get(False, 0), "dropped_fields": {r["path"]: r["drops"] for r in _drops(done).collect()}},
        "auroc": auroc(rows).first()["auroc"],
        "auprc": auprc(rows).first()["auprc"],
        "best_f1": one(pick_best(points, "f1")),
        "best_accuracy": one(pick_best(points, "accuracy")),
        "best_mcc": one(pick_best(points, "mcc")),
        "precision_at_recall_95": one(pick_at(points, "recall", 0.95, "precision")),
        "recall_at_precision_99": one(pick_at(points, "precision", 0.99, "recall")),
        "at_threshold": one(confusion(rows, threshold)),
        "roc": [r.asDict() for r in points.orderBy("threshold").collect()],
        "tokenize": times(done, tokenized - began, n),
        "match": times(rows, matched - tokenized, sum(count.values())),
    }
    for df in (done, rows, points):
        df.unpersist()
    return out


def block_on(df: DataFrame, session: Session, value: str, path: FieldPath, name: str = "block") -> DataFrame:
    """``df`` with a blocking column: the field token of ``value`` under ``path``, in hex."""
    return df.withColumn(name, F.hex(session.field(F.col(value), path)))

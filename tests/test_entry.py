import re
from pathlib import Path

import __spark_entry__ as entry
from veilmatch.plans import queries


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "id_r", "score", "comparable_fields"]


def test_linkage_does_not_need_the_training_data_part():
    root = Path(entry.__file__).parent
    for file in (root / "veilmatch").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", file.read_text()), file


def test_workers_find_the_package(spark):
    entry.queries()["fieldset_fingerprint"](spark, "")
    assert entry.ROOT in spark.sparkContext.environment["PYTHONPATH"].split(":")

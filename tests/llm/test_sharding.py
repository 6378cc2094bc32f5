import random
import zlib

from veilmatch.llm.sharding import SlotMap, shard


def test_build_is_near_equal_and_growth_moves_little():
    rng = random.Random(1)
    size = [rng.randint(0, 1000) for _ in range(4096)]
    m = SlotMap.build(size, 40)
    loads = m.loads(size)
    assert max(loads) - min(loads) <= 1000
    grown = m.rebalance(size, 41)
    assert grown.version == 2 and grown.shards == 41
    moved = [s for s in range(4096) if grown.assignment[s] != m.assignment[s]]
    assert all(grown.assignment[s] == 40 for s in moved)
    new = grown.loads(size)
    assert max(new) - min(new) <= 2100
    assert sum(size[s] for s in moved) <= sum(size) / 40


def test_placement(spark):
    rows = [(i, "é" * (i % 50)) for i in range(300)] + [(None, None), (5, "x" * 5000), (5, "y"), (5, "y")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, shard int, virtual_slot string").repartition(3)
    placed, slot_map, path = shard(df, 7, slots=256)
    got = placed.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert SlotMap.load(spark.read.parquet(path)) == slot_map
    regrown, m2, _ = shard(df, 8, slots=256, previous=slot_map)
    assert m2.version == 2
    old = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in got}
    assert all(r["shard"] in (7, old[r["doc_id"], r["text_crc32"]]) for r in regrown.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    placed, slot_map, path = shard(df, 4, slots=16)
    assert placed.count() == 0 and sorted(slot_map.assignment) == sorted([0, 1, 2, 3] * 4)
    assert SlotMap.load(spark.read.parquet(path)) == slot_map


def test_the_stored_map_knows_its_shards(spark):
    """Even those that hold no slot."""
    m = SlotMap(7, (0, 1, 0, 1), 3)
    assert SlotMap.load(m.table(spark)) == m

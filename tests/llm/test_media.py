import glob
import hashlib
import zlib

import pytest

from veilmatch.llm import media
from veilmatch.llm.media import decode, feature, from_png, padded, plan_ranges, read_archives, to_png, write_archives


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_image_round_trip(n):
    payload = bytes(k * 7 % 256 for k in range(n))
    samples = padded(payload)
    assert len(samples) % 192 == 0 and len(samples) > 0 and len(samples) - n < 193
    image = to_png(samples, n)
    assert from_png(image) == (samples, n) and to_png(samples, n) == image
    assert feature(samples).startswith("mean=")
    with pytest.raises((ValueError, zlib.error)):
        from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_ranges_cover_every_byte():
    sizes = [("a", 5), ("b", 100), ("c", 0), ("d", 31), ("e", 7)]
    for target in (1, 7, 30, 1000):
        tasks = plan_ranges(sizes, target)
        assert all(sum(e - s for _, s, e in t) <= target for t in tasks)
        for path, size in sizes:
            mine = sorted((s, e) for t in tasks for p, s, e in t if p == path)
            assert [x for s, e in mine for x in range(s, e)] == list(range(size))


def rows(found):
    return sorted((r["member"].split("/")[0], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in decode(found).collect())


def test_archives_by_ranges(spark):
    docs = [(1, "a"), (2, None), (3, ""), (1, "a"), (None, "é" * 100), (4, "x y " * 5000), (5, " " * 192)]
    df = spark.createDataFrame([(*d, b"c") for d in docs], "doc_id long, text string, content binary").repartition(2)
    path = write_archives(df, archive_bytes=600)
    assert len(glob.glob(f"{path}/*.zip")) > 1
    want = []
    for i, t in docs:
        raw = (t or "").encode()
        full = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        want.append(("" if i is None else str(i), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    for target in (100, 10**9):
        assert rows(read_archives(spark, path, partitionBytes=str(target), batchBytes="300")) == sorted(want)
    assert rows(read_archives(spark, write_archives(df.limit(0)))) == []


def test_a_damaged_member_leaves_the_others(spark):
    df = spark.createDataFrame([(k, "text " * (50 + k)) for k in range(6)], "doc_id long, text string").coalesce(1)
    path = write_archives(df)
    (name,) = glob.glob(f"{path}/*.zip")
    data = bytearray(open(name, "rb").read())
    at = data.index(b"IDAT", data.index(b"3/3.png")) + 8
    data[at] ^= 255
    open(name, "wb").write(data)
    got = {r["member"]: r for r in read_archives(spark, path).collect()}
    assert len(got) == 6 and got["3/3.png"]["content"] is None and "damaged" in got["3/3.png"]["error"]
    assert sum(r["content"] is not None for r in got.values()) == 5
    assert [r["member"] for r in decode(read_archives(spark, path)).where("error IS NOT NULL").collect()] == ["3/3.png"]


def test_reads_are_tried_again(spark, tmp_path, monkeypatch):
    """A member and a directory that fail once are read; an archive that can't be read gives an error and not the query's end."""
    df = spark.createDataFrame([(k, "text " * 50) for k in range(3)], "doc_id long, text string").coalesce(1)
    path = write_archives(df)
    calls = {"members": 0, "read_member": 0}

    def flaky(name, real):
        def fn(*args):
            calls[name] += 1
            if calls[name] == 1:
                raise OSError("once")
            return real(*args)

        return fn

    for name in calls:
        monkeypatch.setattr(media, name, flaky(name, getattr(media, name)))
    reader = media.MediaReader({"path": path})
    (part,) = reader.partitions()
    got = [r for b in reader.read(part) for r in b.to_pylist()]
    assert len(got) == 3 and all(r["content"] and r["error"] is None for r in got) and calls == {"members": 2, "read_member": 4}
    monkeypatch.undo()
    (tmp_path / "bad.zip").write_bytes(b"PK no directory")
    (r,) = read_archives(spark, str(tmp_path)).collect()
    assert r["content"] is None and r["error"] and decode(read_archives(spark, str(tmp_path))).first()["error"] == r["error"]


def test_features_by_hand():
    """Mean, deviation, entropy and step of the samples, written out."""
    x = padded(bytes([0, 10, 10, 30]) * 48)
    p = [0.25, 0.5, 0.25]
    mean = sum(v * q for v, q in zip((0, 10, 30), p))
    spread = sum((v - mean) ** 2 * q for v, q in zip((0, 10, 30), p)) ** 0.5
    steps = [abs(a - b) for a, b in zip(x, x[1:])]
    assert feature(x) == f"mean={mean:.3f};deviation={spread:.3f};entropy=1.5000;step={sum(steps) / len(steps):.3f}"

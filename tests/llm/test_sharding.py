"""Sharding against a plain k-d tree, its law, and edge cases."""
import hashlib
import zlib

import pytest

from labelforge.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, size string, shard string, rid long, tie long, k int, d0 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


def plain(rows, shards):
    """The tree by sorting: sorted (doc_id, size, crc, shard)."""
    def code(x, n):
        return -1 if x is None else int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    points = []
    for i, t, lang, source in rows:
        data = (t or "").encode()
        crc, size = zlib.crc32(data), len(data) + 1
        tie = code(f"{'null' if i is None else i}|{crc}|{size}", 15)
        points.append(((code(source, 8), code(lang, 8), size, i or 0), tie, i, size, crc))
    spread = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in range(4)] if points else [0] * 4
    out = []

    def split(held, first, k):
        if k == 1 or not held:
            out.extend((p[2], p[3], p[4], first) for p in held)
            return
        widths = [(max(p[0][d] for p in held) - min(p[0][d] for p in held)) / spread[d] if spread[d] else 0.0 for d in range(4)]
        d = widths.index(max(widths))
        target, before, left, right = sum(p[3] for p in held) * (k // 2) // k, 0, [], []
        for p in sorted(held, key=lambda p: (p[0][d], p[1])):
            (left if 2 * before + p[3] <= 2 * target else right).append(p)
            before += p[3]
        split(left, first, k // 2)
        split(right, first + k // 2, k - k // 2)

    split(points, 0, shards)
    return sorted(out, key=str)


def placed(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard) for r in df.collect()), key=str)


ROWS = ([(i, "x" * (i * 37 % 101), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
        + [(7, "the same row", "en", "hot")] * 60 + [(1000 + i, "a copy", "fr", "hot") for i in range(60)]
        + [(None, None, None, None), (None, "", None, "s1"), (-(1 << 63), "é" * 5, "", ""), ((1 << 63) - 1, "long " * 400, "en", None)])


@pytest.mark.parametrize("shards", [16, 5])
def test_equals_a_plain_tree(spark, shards):
    out = sharding.shard(frame(spark, ROWS), shards=shards).cache()
    assert placed(out) == plain(ROWS, shards)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    slots = {}
    for r in out.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_hold_near_equal_bytes_despite_hot_values(spark):
    rows = [(i, "word " * 10, "en", "hot") for i in range(300)] + [(5, "again " * 8, "en", "hot")] * 300 + [(i, "w", "de", f"s{i}") for i in range(900, 930)]
    sizes = [r["sum(size)"] for r in sharding.shard(frame(spark, rows)).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 4 * 51


def test_target_bytes_and_few_rows(spark):
    rows = [(i, "y" * 99, "en", "s") for i in range(50)]
    out = sharding.shard(frame(spark, rows), shards=None, target_bytes=1000)
    assert {r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()} == {1000}
    assert sorted(r.slot for r in sharding.shard(frame(spark, ROWS[:3])).collect()) == [0, 0, 0]
    assert sharding.shard(frame(spark, [])).count() == 0
    assert sharding.shard(frame(spark, rows), shards=1).where("shard = 0").count() == 50
    for bad in ({"shards": 0}, {"shards": 4, "target_bytes": 5}, {"shards": None}):
        with pytest.raises(ValueError):
            sharding.shard(frame(spark, rows), **bad)

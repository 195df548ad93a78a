"""Plain versions of what the other tests hold by properties: the k-d tree, small packings; and the fit's bound."""

import random
from functools import lru_cache

import pytest
from corvane.llm import pack_gga, quality_gam, shard_kd


def plain_tree(rows, shards):
    """shard by doc_id: rows are (doc_id, size, source, lang, n_chars), doc_ids differ."""
    rank = [{v: k for k, v in enumerate(sorted({r[c] for r in rows if r[c] is not None}, key=lambda v: v.encode()))} for c in (2, 3)]
    lowest = shard_kd.LOWEST
    number = lambda v: (v >> 2, v & 3) if v is not None else (lowest, 0)
    code = {r[0]: [(rank[0].get(r[2], -1), 0), (rank[1].get(r[3], -1), 0), number(r[4]), number(r[0])] for r in rows}
    span = [max(1, max(c[d][0] for c in code.values()) - min(c[d][0] for c in code.values())) for d in range(4)]
    out = []

    def split(own, leaves):
        if leaves == 1 or not own:
            out.extend([own] if own else [])
            return
        wide = [(max(code[r[0]][d][0] for r in own) - min(code[r[0]][d][0] for r in own)) / span[d] for d in range(4)]
        d = max(range(4), key=lambda i: (wide[i], -i))
        own = sorted(own, key=lambda r: (code[r[0]][d], number(r[0])))
        goal, before, k = sum(r[1] for r in own) * (leaves // 2) / leaves, 0, 0
        while k < len(own) and before + own[k][1] / 2 < goal:
            before += own[k][1]
            k += 1
        split(own[:k], leaves // 2)
        split(own[k:], leaves - leaves // 2)

    split(rows, shards)
    return {frozenset(r[0] for r in own) for own in out}


@pytest.mark.parametrize("shards", [2, 7, 16])
def test_kd_shards_are_those_of_a_plain_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(k * 3, "x" * rng.randrange(200), rng.choice(["hot", "hot", "hot", "b", "ü", None]), rng.choice(["en", "fr", None]), rng.choice([None, *range(0, 2000, 37)])) for k in range(150)]
    df = spark.createDataFrame([(i, t, la, s, n) for i, t, s, la, n in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = {}
    for r in shard_kd.kd_shards(df, shards=shards, tolerance=0.0).collect():
        found.setdefault(r.shard, set()).add(r.doc_id)
    assert {frozenset(x) for x in found.values()} == plain_tree([(i, len(t) + 1, s, la, n) for i, t, s, la, n in rows], shards)


def test_slots_of_very_many_shards_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(k, "x" * k, "en", "s", k) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    sent = sorted(map(tuple, shard_kd.kd_shards(df, shards=5).select("doc_id", "shard", "slot").collect()))
    monkeypatch.setattr(shard_kd, "SLOTS_SENT", 1)
    assert sorted(map(tuple, shard_kd.kd_shards(df, shards=5).select("doc_id", "shard", "slot").collect())) == sent


def fewest(sizes, capacity):
    """Bins of an optimal packing, by subsets."""
    n = len(sizes)

    @lru_cache(None)
    def best(mask):
        """(bins, room used in the last one) for the pieces of a mask, least first."""
        if not mask:
            return 1, 0
        found = []
        for k in range(n):
            if mask >> k & 1:
                bins, used = best(mask & ~(1 << k))
                found.append((bins, used + sizes[k]) if used + sizes[k] <= capacity else (bins + 1, sizes[k]))
        return min(found)

    return best((1 << n) - 1)[0] if n else 0


def test_small_packings_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        capacity = rng.choice([10, 30, 100])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        bins = pack_gga.evolve(sizes, capacity, [], 1)
        loads = {}
        for b, s in zip(bins, sizes):
            loads[b] = loads.get(b, 0) + s
        assert max(loads.values()) <= capacity and len(loads) == fewest(tuple(sizes), capacity), (sizes, capacity)


def test_the_fit_gets_one_row_per_document_at_most(spark, monkeypatch):
    rows = [(k % 3, f"text {k} of words {'z' * (k % 7)}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5][:3]
    docs = docs.replace({0: ids[0], 1: ids[1], 2: ids[2]}, subset=["doc_id"])
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_gam.AdditiveModel, "fit", classmethod(lambda cls, x, y, **more: seen.append((x.shape, len(y)))))
    quality_gam.trained(docs, labels, most_rows=3)
    quality_gam.trained(docs.repartition(5), labels, most_rows=2)
    assert [n for _, n in seen] == [3, 2] and seen[0][0][0] == 3

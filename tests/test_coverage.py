"""The completeness gate: late, double and stray answers, time limits, a restart."""

from datetime import datetime, timedelta

from corvane.streaming.coverage import run_gate

START = datetime(2024, 1, 1)
SCHEMA = "pack string, pid string, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_one_verdict_for_each_pack(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    expected = spark.createDataFrame([(p, f"{p}{k}", at(60)) for p in ("whole", "holes", "late", "silent") for k in range(3)] + [("soon", "soon0", at(10))], "pack string, pid string, limit timestamp")

    def add(name, rows):
        spark.createDataFrame([(p, i, at(m)) for p, i, m in rows], SCHEMA).coalesce(1).write.parquet(f"{src}/{name}")

    def verdicts():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(src)
        return {r.pack: tuple(r)[1:] for r in run_gate(spark, stream, expected, out, mark).collect()}

    add("a", [("whole", "whole0", 1), ("whole", "whole1", 2), ("whole", "whole0", 3), ("whole", "other", 3), ("holes", "holes0", 4), ("late", "late0", 5), ("unknown", "x", 5), ("soon", "stray", 6)])
    assert verdicts() == {}
    add("b", [("whole", "whole2", 20), ("holes", "holes0", 21), ("late", "late1", 22)])
    # the second run goes on from the first one's checkpoint; `soon` has passed its limit
    assert verdicts() == {"whole": (True, 3, 3, 0, 1, 1, 0), "soon": (False, 1, 0, 1, 0, 1, 0)}
    add("c", [("late", "late2", 61), ("whole", "whole1", 62), ("holes", "holes2", 30)])
    got = verdicts()
    assert got["whole"] == (True, 3, 3, 0, 1, 1, 0) and len(got) == 5
    assert got["late"] == (False, 3, 2, 1, 0, 0, 1)
    assert got["silent"] == (False, 3, 0, 3, 0, 0, 0)
    assert got["holes"][0] is False and got["holes"][2] in (1, 2)  # holes2 came before its limit but after the watermark's


def test_chunks_of_a_pack_and_calls_to_its_state(spark, tmp_path, monkeypatch):
    """A pack of several chunks over two batches; each answer used to cost several calls to the state."""
    from corvane.streaming import coverage

    monkeypatch.setattr(coverage, "CHUNK", 4)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    pids = [f"p{k}" for k in range(50)]
    expected = spark.createDataFrame([("big", p, at(60)) for p in pids + pids[:5]] + [("part", p, at(60)) for p in pids], "pack string, pid string, limit timestamp")
    rows = [("big", p, 1) for p in pids[:30] + pids[:3] + ["odd"]] + [("part", p, 1) for p in pids[:20]]
    spark.createDataFrame([(p, i, at(m)) for p, i, m in rows], SCHEMA).coalesce(1).write.parquet(f"{src}/a")
    verdicts = lambda: {r.pack: tuple(r)[1:] for r in run_gate(spark, spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(src), expected, out, mark).collect()}
    assert verdicts() == {}
    rows = [("big", p, 2) for p in pids[28:]] + [("part", p, 61) for p in pids[20:]]
    spark.createDataFrame([(p, i, at(m)) for p, i, m in rows], SCHEMA).coalesce(1).write.parquet(f"{src}/b")
    assert verdicts() == {"big": (True, 50, 50, 0, 5, 1, 0), "part": (False, 50, 20, 30, 0, 0, 30)}


class Kept:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def _called(self, give):
        self.calls += 1
        return give

    def get(self):
        return self._called(self.values.get(None))

    def update(self, value):
        self._called(self.values.__setitem__(None, value))

    def exists(self):
        return self._called(None in self.values)

    def getValue(self, key):
        return self._called(self.values.get(key))

    def containsKey(self, key):
        return self._called(key in self.values)

    def updateValue(self, key, value):
        self._called(self.values.__setitem__(key, value))

    def clear(self):
        self._called(self.values.clear())


def test_calls_to_a_state_grow_neither_with_answers_nor_with_packs():
    from types import SimpleNamespace
    from zlib import crc32

    import pandas as pd

    from corvane.streaming.coverage import CoverageGate

    calls = []
    for users, n in ((1, 10), (1, 800), (40, 20)):
        gate, packs, wanted = CoverageGate(), Kept(), Kept()
        gate.init(SimpleNamespace(getMapState=lambda *a: wanted, getValueState=lambda *a: packs, registerTimer=lambda t: None, deleteTimer=lambda t: None))
        both = [(f"u{u}", f"u{u}|{k}") for u in range(users) for k in range(n)]
        wanted_ = both + [(f"u{u}", f"u{u}|never") for u in range(users)]
        gate.handleInitialState((0,), pd.DataFrame({"chunk": [0], "chunks": [1], "packs": [[p for p, _ in wanted_]], "limits": [[100] * len(wanted_)], "tokens": [[t for _, t in wanted_]]}), None)
        frame = pd.DataFrame({"pack": [p for p, _ in both], "token": [t for _, t in both], "at": 5, "mark": [crc32(t.encode()) for _, t in both]})
        assert list(gate.handleInputRows((0,), iter([frame]), None)) == []
        (told,) = gate.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 200), SimpleNamespace(getExpiryTimeInMs=lambda: 100))
        assert sorted(told.values.tolist()) == sorted([f"u{u}", False, n + 1, n, 1, 0, 0, 0] for u in range(users))
        calls.append(packs.calls + wanted.calls)
    assert len(set(calls)) == 1 and calls[0] <= 12


def test_packs_of_one_group(spark, tmp_path, monkeypatch):
    """Limits that pass one after the other, a pack that is told before others, an answer to a told pack."""
    from corvane.streaming import coverage

    monkeypatch.setattr(coverage, "GROUPS", 1)
    monkeypatch.setattr(coverage, "CHUNK", 3)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    expected = spark.createDataFrame([(f"p{k}", str(i), at(10 * k)) for k in range(1, 6) for i in range(3)], "pack string, pid string, limit timestamp")
    found, seen = [], {}
    for name, rows in (("a", [("p1", "0", 1), ("p5", "0", 2), ("p5", "1", 3), ("p5", "2", 12)]), ("b", [("p5", "0", 13), ("p3", "1", 14), ("p4", "x", 15), ("p9", "0", 25)]), ("c", [("p4", "0", 35), ("p9", "0", 70)])):
        spark.createDataFrame(rows, "pack string, pid string, m int").selectExpr("pack", "pid", f"timestamp'{START}' + make_interval(0, 0, 0, 0, 0, m) AS ts").coalesce(1).write.parquet(f"{src}/{name}")
        rows = run_gate(spark, spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(src), expected, out, mark).collect()
        assert len(rows) == len({r.pack for r in rows})
        seen = {r.pack: tuple(r)[1:] for r in rows}
        found.append(set(seen))
    assert found == [{"p1", "p5"}, {"p1", "p2", "p5"}, {"p1", "p2", "p3", "p4", "p5"}]
    assert seen["p5"] == (True, 3, 3, 0, 0, 0, 0) and seen["p1"] == (False, 3, 1, 2, 0, 0, 0) and seen["p2"] == (False, 3, 0, 3, 0, 0, 0)
    assert seen["p3"] == (False, 3, 1, 2, 0, 0, 0) and seen["p4"] == (False, 3, 1, 2, 0, 1, 0)

"""Knock-out rounds go on until each bracket has one winner."""

import hashlib

from corvane.catalog import sequences as S


def test_large_brackets_have_one_winner(spark, tmp_path, monkeypatch):
    rows = [(u, "big") for u in range(4100)] + [(u, "small") for u in range(9)]
    spark.createDataFrame(rows, "user_id long, event_type string").selectExpr("monotonically_increasing_id() AS event_id", "current_timestamp() AS ts", "user_id", "event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    key = lambda u: int(hashlib.sha1(f"pref|{u}".encode()).hexdigest()[:8], 16)
    want = {"big": max(range(4100), key=lambda u: (key(u), u)), "small": max(range(9), key=lambda u: (key(u), u))}
    for wide in (20_000, 100):
        monkeypatch.setattr(S.Q, "WIDE", wide)
        got = S.e11_knockout(spark, str(tmp_path)).collect()
        assert len(got) == 2 and {r.bid: r.winner for r in got} == want

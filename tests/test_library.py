"""Known vectors, properties and edge cases of the library's operators."""

import io
import random
import tarfile

import pytest
from corvane.functions import scrub as S
from corvane.functions import text as T
from corvane.functions.numeric import choose, normal_cdf, wilson
from corvane.operators import estimators as E
from corvane.operators import overlap as O
from corvane.operators import pairing as P
from corvane.operators import resampling as B
from corvane.operators import selection as G
from corvane.operators import sequencing as Q
from corvane.plans import sanitize
from corvane.sources import readers as R
from pyspark.sql import functions as F


def column(spark, value, *expressions):
    df = spark.createDataFrame([(value,)], "x string")
    return tuple(df.select(*[e(F.col("x")).alias(f"c{i}") for i, e in enumerate(expressions)]).first())


def test_holm_and_bh(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.5)], "i int, p double").withColumn("g", F.lit(0))
    got = {r.i: (r.holm, r.bh) for r in E.adjusted(df, ["g"]).collect()}
    assert [got[i][0] for i in range(4)] == [0.04, 0.09, 0.09, 0.5]
    assert [got[i][1] for i in range(4)] == [0.04, 0.0533, 0.0533, 0.5]


def test_words_and_shingles(spark):
    w, u, s, short = column(spark, "It's 3 naïve cats, one two three four", T.words, T.uwords, lambda c: T.shingles(c, 6), lambda c: T.shingles(c, 20))
    assert w == ["it's", "na", "ve", "cats", "one", "two", "three", "four"]
    assert u == ["it", "s", "3", "naïve", "cats", "one", "two", "three", "four"]
    assert s == ["it's na ve cats one two", "na ve cats one two three", "ve cats one two three four"] and short == []
    assert column(spark, None, T.words, lambda c: T.shingles(c, 6)) == ([], [])


def test_lines_and_prefixes(spark):
    assert column(spark, "a\r\nb\n\nc\n", T.lines) == (["a", "b", "", "c"],)
    assert column(spark, "- **bold** x", T.line_prefix, T.line_body) == ("- ", "**bold** x")
    assert column(spark, "**bold** x", T.line_prefix, T.line_body) == ("", "**bold** x")
    assert column(spark, "SIX WORDS THAT ARE ALL SHOUTED", T.is_content) == (False,)


def test_answers(spark):
    assert column(spark, "pick c 200", T.letter_anywhere, T.letter_first, T.letter_only, T.confidence) == ("C", None, None, 100.0)
    assert column(spark, "??", T.letter_anywhere, T.confidence) == (None, 50.0)
    assert column(spark, "```json\n[\"a\", \"b\"]\n```", T.json_strings) == (["a", "b"],)


def test_scrub(spark):
    mail = "Call Jane Doe at 713-853-1234 or j.d@x.com, see http://a.b/c\nThanks,\nBob Smith\n> quoted\nFrom: x\nthe LJM deal on Payment Date\n-----Original Message-----\nlost"
    df = spark.createDataFrame([(mail,)], "t string")
    out = S.scrub(df, "t", entities=S.ENTITIES).first().scrubbed
    assert "lost" not in out and "quoted" not in out and "Payment Date" in out
    for tag in ("[PHONE]", "[EMAIL]", "[URL]", "[PERSON]", "[ENTITY]"):
        assert tag in out
    assert column(spark, "jeff.dasovich@x.com", S.address_names)[0] == ["jeff", "dasovich", "jeff dasovich"]
    assert column(spark, "bob and BOB smith", lambda c: S.mask_own(c, F.array(F.lit("bob"), F.lit("bob smith"))))[0] == "[PERSON] and [PERSON]"


def test_statistics(spark):
    df = spark.range(1)
    r = df.select(normal_cdf(F.lit(1.96)).alias("a"), normal_cdf(F.lit(-1.0)).alias("b"), choose(F.lit(5), F.lit(2)).alias("c"), choose(F.lit(2), F.lit(5)).alias("d"), *[c.alias(n) for c, n in zip(wilson(F.lit(8), F.lit(10)), ("lo", "hi"))]).first()
    assert abs(r.a - 0.9750021) < 1e-6 and abs(r.b - 0.1586553) < 1e-6 and (r.c, r.d) == (10.0, 0.0)
    assert round(r.lo, 3) == 0.490 and round(r.hi, 3) == 0.943


def test_auc_of_ties_and_one_class(spark):
    rng = random.Random(0)
    rows = [("a", float(rng.randrange(6)), rng.randrange(2)) for _ in range(60)] + [("tied", 1.0, k % 2) for k in range(8)] + [("one", 1.0, 1), ("one", 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    up = {r.g: r.auc for r in E.auc(df, ["g"]).collect()}
    down = {r.g: r.auc for r in E.auc(df.withColumn("score", -F.col("score")), ["g"]).collect()}
    assert abs(up["a"] + down["a"] - 1) < 1e-12 and up["tied"] == 0.5 and up["one"] is None
    top = {r.g: (r.hit, r.precision) for r in E.rank_at_k(df, ["g"], 2).collect()}
    assert abs(top["tied"][0] - (1 - (4 * 3) / (8 * 7))) < 1e-12 and top["tied"][1] == 0.5 and top["one"] == (1.0, 1.0)


def test_cluster_interval_is_wider(spark):
    rng = random.Random(3)
    rows = [(g, 10 * g + k, base + rng.gauss(0, 0.05)) for g in range(20) for base in [rng.random()] for k in range(6)]
    df = spark.createDataFrame(rows, "g int, id int, v double")
    by_group, by_row = B.cluster_ci(df, [], "g", "v", 400).first(), B.cluster_ci(df, [], "id", "v", 400).first()
    assert by_group.hi - by_group.lo > 1.5 * (by_row.hi - by_row.lo) and abs(by_group["mean"] - by_row["mean"]) < 1e-12


def test_null_of_perfect_and_silent_guessers(spark):
    rows = [(u, f"a{u % 6}", f"a{u % 6}") for u in range(36)]
    perfect = B.block_null(spark.createDataFrame(rows, "u int, author string, guess string"), "u", "author", "guess", 200).first()
    assert perfect.observed == 1.0 and not perfect.reached_chance and perfect.p < 0.05
    silent = B.block_null(spark.createDataFrame([(u, a, None) for u, a, _ in rows], "u int, author string, guess string"), "u", "author", "guess", 50).first()
    assert silent.observed == 0.0 and silent.reached_chance


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 23])
def test_groups(spark, n):
    df = spark.createDataFrame([("b", k) for k in range(n)], "g string, k int")
    sizes = sorted(r["count"] for r in Q.even_groups(Q.shuffled(df, ["g"], "k", 1), ["g"]).groupBy("gidx").count().collect())
    assert sum(sizes) == n and len(sizes) == -(-n // 8) and sizes[-1] - sizes[0] <= 1
    clusters = [r["count"] for r in Q.random_groups(df, "k", 8, 1).groupBy("cluster").count().collect()]
    assert sum(clusters) == n and all(c >= 8 for c in clusters) or n < 8
    dealt = [r["count"] for r in Q.round_robin(df, [F.col("k")], 3).groupBy("batch").count().collect()]
    assert sum(dealt) == n and max(dealt) - min(dealt) <= 1


def test_runs_and_blocks(spark):
    hits = spark.createDataFrame([(1, p) for p in (0, 3, 9, 16, 40)], "k int, pos int")
    got = sorted((r["first"], r["last"]) for r in O.merged_runs(hits, ["k"], 6).collect())
    assert got == [(0, 14), (16, 21), (40, 45)]
    pairs = spark.createDataFrame([(1, list("xabcdy"), list("abcdzz")), (2, ["q"], ["r"])], "k int, a array<string>, b array<string>")
    assert {r.k: r.block for r in O.longest_token_block(pairs, ["k"], "a", "b").collect()} == {1: 4, 2: 0}
    assert pairs.select(G.similarity_ratio("a", "b").alias("r")).collect()[0].r == pytest.approx(8 / 12)


def test_sanitized_lines_share_no_run(spark):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = prose(12)
    lines = [(0, prose(20)), (1, prose(30) + " " + shared), (2, shared), (3, prose(60) + " " + shared[:40]), (4, "Need more information about 5 " + shared)]
    df = spark.createDataFrame(lines, "line_no int, line string")
    pool = O.exploded_grams(spark.createDataFrame([(shared,)], "text string"), [], "text", 6)
    out = sanitize.sanitized(df, ["line_no"], pool).cache()
    got = {r.line_no: r for r in out.collect()}
    assert len(got) == 5 and got[0].tier == "verbatim" and got[0].text == lines[0][1]
    kept = out.filter("text IS NOT NULL").select("line_no", F.col("text").alias("line"))
    assert O.lines_hit(kept, ["line_no"], pool).count() == 0
    assert all(r.text is None or r.tier == "verbatim" or bool(set("5") & set(r.text)) == bool(set("5") & set(lines[r.line_no][1])) for r in got.values())


def test_greedy_selectors(spark):
    docs = spark.createDataFrame([("a", 0, "one two three four"), ("a", 1, "one two three five"), ("a", 2, "six seven"), ("a", 3, "one two three five six seven eight"), ("b", 4, "")], "g string, i int, t string")
    kept = sorted(r.i for r in P.drop_near_sets(docs, "g", "i", T.uwords(F.col("t"))).collect())
    assert kept == [0, 2, 3]
    v = spark.createDataFrame([("a", k, [1.0, 0.01 * k]) for k in range(5)] + [("a", 9, [0.0, 1.0])], "g string, i int, vec array<double>")
    assert sorted(r.i for r in P.drop_near_vectors(v, "g", "i", [F.col("i")]).collect()) == [0, 9]
    batches = P.disjoint_batches(spark.createDataFrame([("g", i, i % 3, 10 + i % 2) for i in range(12)], "g string, i int, x int, y int"), "g", "i", "x", "y", 4).collect()
    for b in {r.batch for r in batches}:
        cards = [c for r in batches if r.batch == b for c in (r.i % 3, 10 + r.i % 2)]
        assert len(cards) == len(set(cards))


def test_sources(spark, tmp_path):
    with tarfile.open(tmp_path / "mail.tar.gz", "w:gz") as archive:
        for name in ("a/sent/1", "a/inbox/2"):
            data = f"From: me@x.org\nSubject: {name}\n\nbody".encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    mail = R.parsed_mail(R.tar_members(spark, str(tmp_path / "mail.tar.gz"), "/sent/"), ["member"], "text").collect()
    assert [(m.member, m.frm, m.subject, m.body) for m in mail] == [("a/sent/1", "me@x.org", "a/sent/1", "body")]
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "ans_1.json").write_text('﻿[{"pid": "p1", "choice": "it is b", "conf": 70}, {"pid": "p2", "choice": "?"}]', encoding="utf-8")
    (folder / "ans_2.json").write_text('[{"pid": "p1", "choice": "C"}, {"choice": "A"}]')
    (folder / "ans_3_part.json").write_text('[{"pid": "p9", "choice": "A"}]')
    (folder / "ans_4.json").write_text("not json")
    rows = R.answer_files(spark, str(folder))
    assert sorted((r.pid, r.choice, r.conf) for r in rows.collect()) == [("p1", "B", 70.0), ("p1", "C", 50.0), ("p2", None, 50.0)]
    last = P.last_record(rows, "pid", ["file", "place"])
    assert {r.pid: r.choice for r in last.collect()} == {"p1": "C", "p2": None}
    assert {r.file: r.good for r in R.malformed_files(spark, str(folder)).collect()} == {"ans_1.json": True, "ans_2.json": False, "ans_3_part.json": True, "ans_4.json": False}


def test_near_sets_by_prefixes_lose_no_pair(spark):
    """Against all pairs, with subjects, near both thresholds."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(160):
        own = rng.sample(words, rng.randrange(1, 12)) if i % 3 == 0 or not docs else [w for w in docs[rng.randrange(len(docs))][2].split() if rng.random() < 0.85] + rng.sample(words, 2)
        docs.append((f"g{i % 2}", i, " ".join(own), rng.choice(["", "s1", "s2"])))
    kept: dict = {}
    for g, i, t, s in docs:
        a = set(t.split())
        near = lambda j: len(a & kept[g][j][0]) / len(a | kept[g][j][0]) > (0.3 if s and s == kept[g][j][1] else 0.5)
        if not any(near(j) for j in kept.setdefault(g, {})):
            kept[g][i] = (a, s)
    df = spark.createDataFrame(docs, "g string, i int, t string, s string")
    got = sorted(r.i for r in P.drop_near_sets(df, "g", "i", F.split("t", " "), "s").collect())
    assert got == sorted(i for own in kept.values() for i in own) and 20 < len(got) < 140


def test_signatures(spark):
    texts = {
        "see you\nBest,\nJane Doe\n": "see you\nBest,\n[PERSON]",
        "see you\nBest\n\nJane Doe\nPS: more": "see you\nBest\n\n[PERSON]\nPS: more",
        "see you\nRegards, Margaret Hill\nmore lines follow here today": "see you\nRegards, [PERSON]\nmore lines follow here today",
        "a text of some words\nMargaret": "a text of some words\n[PERSON]",
        "a text of some words\nThanks": "a text of some words\nThanks",
        "Best\n\n\nJane Doe\nmore lines follow here today": "Best\n\n\nJane Doe\nmore lines follow here today",
        "Cheers\nthe next line is lower\nJane and more of it": "Cheers\nthe next line is lower\nJane and more of it",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", F.col("t"))
    got = {r.t: r.m.rstrip("\n") for r in S.mask_signed(df, "m").collect()}
    assert got == texts


def test_rebuild_check_finds_planted_faults(spark):
    routed = spark.createDataFrame([(1, k, f"line {k} with 5 items of many words in it", r) for k, r in enumerate(["verbatim", "edit", "rewrite", "edit"])], "card int, k int, line string, route string")
    good = [(0, routed.collect()[0].line, "verbatim"), (1, "line 1 with 5 items of many words in there", "edited"), (2, "line 2 with 5 items of many words on it", "rewritten"), (3, None, "dropped")]
    build = lambda rows: spark.createDataFrame(rows, "k int, text string, tier string")
    r = sanitize.rebuild_check(routed, build(good), build(good), ["k"], "card").first()
    assert (r.n, r.bad_route, r.bad_number, r.bad_clean, r.veto, r.same_cards) == (4, 0, 0, 0, False, 1) and r.drop_second == 0.25 and r.hard_failures == 1
    bad = [(0, "another line", "verbatim"), (1, "line 1 with 6 items of many words in there", "edited"), (2, "line 2 with 5 items", "edited"), (3, "line 3 with 5 items of many words in there", "rewritten")]
    r = sanitize.rebuild_check(routed, build(good), build(bad), ["k"], "card").first()
    assert (r.bad_route, r.bad_clean, r.bad_number, r.bad_length, r.bad_fidelity) == (1, 1, 1, 1, 1) and r.veto and r.hard_failures == 5


def test_pooled_waves_refuse_to_blend(spark):
    from corvane.plans.instruments import pooled_waves

    rows = [(f"w{t}", x, "base", u, u % 5, float((u + t) % 2)) for t in range(2) for x in ("a", "b") for u in range(20)]
    df = spark.createDataFrame(rows, "tag string, x string, y string, unit int, cluster int, value double")
    out = {r.x: r.n_units for r in pooled_waves(df, [("w0", "a", "base")], [("w1", "b", "base", "c", "base")], "cluster", 20).collect()}
    assert out == {"a": 20, "b": 20, "c": 20}
    with pytest.raises(ValueError, match="already"):
        pooled_waves(df, [], [("w0", "a", "base", "b", "base")], "cluster", 20)


def test_adjusted_in_parts(spark, monkeypatch):
    import math
    import random

    from corvane.operators import prefix

    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "b"]), i, rng.choice([None, *[round(rng.random() ** 2, 2)] * 20])) for i in range(400)]
    monkeypatch.setattr(prefix, "CUTS", 7)
    got = E.adjusted(spark.createDataFrame(rows, "g string, i int, p double"), ["g"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    have = {r.i: (r.holm, r.bh) for r in got.collect()}
    want = {}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0))
        m = len(own)
        for r, (_, i, p) in enumerate(own):
            holm = max([(m - k) * q for k, (_, _, q) in enumerate(own[: r + 1]) if q is not None], default=1.0)
            bh = min([q * m / (k + 1) for k, (_, _, q) in enumerate(own) if q is not None and (k >= r or q == p)])
            want[i] = (min(1.0, holm), min(1.0, bh))
    assert have.keys() == want.keys()
    assert all(math.isclose(x, y, abs_tol=6e-5) for i in want for x, y in zip(have[i], want[i]))

"""Sharding, quality, urls, vectors, packing, mixing and the pipeline."""

import math
import random
import zlib

import brute
import numpy as np
import pytest
from corvane.llm import embed_hyperplane, exact_bloom, mix_poisson, near_jaccard, pack_gga, quality_gam, shard_kd, simhash_anchor, url_trie
from corvane.llm.registry import OP4_SQL, URL_RULES, tokenizer_path
from pyspark.sql import functions as F


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_kd_shards(docs, rows, shards):
    out = shard_kd.kd_shards(docs, shards=shards).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in out)
    sizes = {}
    for r in out:
        assert 0 <= r.shard < shards
        sizes.setdefault(r.shard, []).append(r)
    for own in sizes.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    assert all(abs(sum(r.size for r in own) - total / shards) <= 2 * largest for own in sizes.values())


def test_kd_shards_are_even_under_ties(spark):
    df = spark.createDataFrame([(k, "x" * 9, "en", "one", 9) for k in range(4096)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = [r["n"] for r in shard_kd.kd_shards(df, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 80
    assert shard_kd.kd_shards(df, target_bytes=5000).select("shard").distinct().count() == 9


def test_kd_shards_of_odd_rows(odd, nothing):
    assert shard_kd.kd_shards(odd, shards=16).count() == 6
    assert shard_kd.kd_shards(nothing, shards=16).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/7", "https://x.com/en/8?q", "https://com/en/", "http://com/en", "http://n.net/de/81", "http://example.net/de/80#a", "http://x.org/es/?", "http://xorg/es/", None, "no url", "://", "http:///en/7", "a://b://c/en/", "http://example.com:80/en/1", "http://ünï.com/en/ü", "http://x.com\n/en/"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_trie.judged(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u is not None and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_trie.judged(df.limit(0), URL_RULES).count() == 0
    columns = ["page_id", "host", "path", "rule", "verdict"]
    joined = url_trie.judged(df, URL_RULES, most_rules=0).select(columns)
    assert sorted(map(tuple, joined.collect())) == sorted(tuple(r[c] for c in columns) for r in got.values())
    assert url_trie.judged(df.limit(0), URL_RULES, most_rules=0).count() == 0
    assert "RULES" in OP4_SQL.upper()


@pytest.mark.parametrize("block", [20, 20_000])
def test_vectors(spark, block):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.11 * rng.standard_normal(16)).tolist(), int(i % 12) % 4) for i in range(150)]
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, rows[0][1], None), (203, None, 1), (204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [None] + [1.0] * 15, 1), (207, [], 1), (208, rows[0][1][:8], rows[0][2]), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embed_hyperplane.near_vectors(df, tables=40, bits=6, block=block).collect())
    usable = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93 - 1e-15:
                    links.append((i, j))
    n = [sum(k in p for p in links) for k in range(len(rows))]
    reach = brute.smallest_reachable([r[0] for r in rows], links)
    want = sorted(((r[0] is None, r[0] or 0), n[k], reach[k], r[0] == reach[k]) for k, r in enumerate(rows))
    assert got == want and len(links) > 300
    assert embed_hyperplane.near_vectors(df.limit(0)).count() == 0


def test_vectors_at_the_registered_settings(spark):
    """Planted links at and above the threshold: nearly all are found, none below it, by the query's own defaults."""
    rng = np.random.default_rng(3)
    d, rows, links = 64, [], 0
    for k in range(600):
        x, y = rng.standard_normal((2, d))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cosine = (0.9301, 0.94, 0.96, 0.9299)[k % 4]
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (cosine * x + math.sqrt(1 - cosine**2) * y).tolist(), 1)]
        links += cosine > 0.93
    rows += [(5_000 + k, rng.standard_normal(d).tolist(), 1) for k in range(3_000)]
    got = {r.vec_id: r for r in embed_hyperplane.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = [got[2 * k + 1].component_id == 2 * k and got[2 * k].n_links == 1 for k in range(600) if k % 4 < 3]
    assert np.mean(found) >= 0.99 and len(found) == links
    assert all(got[2 * k].n_links == got[2 * k + 1].n_links == 0 for k in range(3, 600, 4))
    for n in (1, 2_000, 10**6, 10**12):
        tables, bits = embed_hyperplane.settings(n, 0.93)
        assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= embed_hyperplane.RECALL


def check_packing(out, texts, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[d])
        assert all(r.length == capacity for r in own[:-1])
        for r in own:
            part = ids[d][r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    least = -(-sum(map(len, ids.values())) // capacity)
    assert len(by_sequence) <= least * 1.05 + 2


def test_packing(docs, rows):
    rng = random.Random(2)
    odd = [(10_000 + k, t) for k, t in enumerate(["a\x1cb", "x\u00a0y\u2028z", "naïve café ÉTÉ İstanbul ΣΑΣ", "e\u0301 o\u0308", "<|endoftext|> x<|startoftext|>y", "don't DON'T 3.14%!!", "日本語テキスト", "word...)]} 12a34", "\u0301start", "ǅ ﬁ"])]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    out = pack_gga.packed(more, tokenizer_path(), per_problem=40).collect()
    check_packing(out, [*[(r[0], r[1]) for r in rows], *odd])
    sizes = [rng.randrange(1, 2000) for _ in range(300)]
    best = pack_gga.evolve(sizes, 2048, [], 1)
    assert max(np.bincount(best, sizes)) <= 2048 and len(set(best)) <= -(-sum(sizes) // 2048) * 1.05 + 1
    child = pack_gga.crossover([[i] for i in range(300)], [list(np.flatnonzero(np.array(best) == b)) for b in set(best)], sizes, 2048, rng)
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 2048 for b in child)


def test_packing_of_odd_rows(odd, nothing):
    out = pack_gga.packed(odd, tokenizer_path(), with_ids=True).collect()
    assert len(out) == 6 and {len(r.ids) for r in out if r.length == 1} == {1}
    assert pack_gga.packed(nothing, tokenizer_path()).count() == 0


def test_mixing(docs, rows):
    out = mix_poisson.mixed_copies(docs, power=0.5, seed=7)
    assert out.columns == [*docs.columns, "copy", "rate", "shuffle_key"]
    got = out.collect()
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    import hashlib

    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode()) + 1
    weight = {s: math.sqrt(b) for s, b in size.items()}
    want = {}
    for i, t, _, s in rows:
        mean = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        if n:
            want[i] = n
    counts = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == want
    only = mix_poisson.mixed_copies(docs, weights={"cold": 1.0})
    assert {r.source for r in only.select("source").collect()} == {"cold"}


def test_mixing_of_odd_rows(odd, nothing):
    got = mix_poisson.mixed_copies(odd, epochs=1000.0).collect()
    many = {}
    for r in got:
        many[r.doc_id, r.text] = many.get((r.doc_id, r.text), 0) + 1
    # 6 rows of one source at rate 1000: rows that repeat (twice each) get equal counts
    assert len(many) == 4 and sum(many.values()) == len(got) and all(many[k] % 2 == 0 and 1600 < many[k] < 2400 for k in [(None, "a b c d e"), (5, "a b c d e")])
    assert 800 < many[7, "q w"] < 1200 and 800 < many[None, None] < 1200
    assert many[None, None] != many[None, "a b c d e"] / 2
    assert mix_poisson.mixed_copies(nothing).count() == 0


def test_clashing_names_keep_their_values(spark):
    """Whole rows come back from the operators that keep documents, whatever the other columns are called."""
    names = ["_sha", "_rest", "_id", "_key", "_maybe", "_stays", "_n", "_hot", "_row", "_order", "_source", "_u", "_copies", "copy", "rate", "shuffle_key", "_bucket0", "_bitmap0", "_set0", "key", "n", "stays"]
    rows = [(i, f"words of text number {i // 2} and some more of them", "s", *[f"{c}{i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in names]]))
    for keep in (exact_bloom.drop_exact_copies, simhash_anchor.drop_near_copies, near_jaccard.drop_similar):
        out = keep(df)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [r for r in rows if r[0] % 2 == 0], keep.__name__
    out = mix_poisson.mixed_copies(df, epochs=3.0)
    assert out.columns == [*df.columns, "_copy", "_rate", "_shuffle_key"] and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert {tuple(r)[: len(df.columns)] for r in out.collect()} <= set(rows)


def test_rows_that_share_an_id_are_judged_each(spark):
    texts = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "ABCDE"}
    df = spark.createDataFrame([(None, texts["A"]), (None, texts["B"]), (5, texts["C"]), (5, texts["D"]), (7, texts["E"]), (7, texts["A"])], "doc_id long, text string")
    want = sorted([("None", texts["B"]), ("5", texts["C"]), ("5", texts["D"]), ("7", texts["E"]), ("7", texts["A"])])
    for keep in (simhash_anchor.drop_near_copies, near_jaccard.drop_similar):
        assert sorted((str(r.doc_id), r.text) for r in keep(df).collect()) == want, keep.__name__
    # of exact copies the row with the null doc_id stays
    assert sorted((str(r.doc_id), r.text) for r in exact_bloom.drop_exact_copies(df).collect()) == sorted([("None", texts["A"]), *[w for w in want if w != ("7", texts["A"])]])


def test_values_with_a_long_common_prefix_are_told_apart(spark):
    df = spark.createDataFrame([(k, "x" * 9, "en", f"https://common.example.org/{k % 8}", 9) for k in range(800)], "doc_id long, text string, lang string, source string, n_chars long")
    ranks = {r.value: r["rank"] for r in shard_kd.ranks(df, "source").collect()}
    assert ranks == {f"https://common.example.org/{k}": k for k in range(8)}
    shards = {(r.doc_id % 8, r.shard) for r in shard_kd.kd_shards(df, shards=8, numbers=()).collect()}
    assert shards == {(k, k) for k in range(8)}


def test_packing_beats_best_fit_decreasing_on_hard_sets():
    rng = random.Random(5)
    triples = [x for _ in range(200) for a in [rng.randrange(780, 1000)] for b in [rng.randrange(500, (2048 - a) // 2 + 1)] for x in (a, b, 2048 - a - b)]
    for sizes, gain in [(triples, 20), ([rng.randrange(270, 1370) for _ in range(1500)], 2), ([rng.randrange(520, 1030) for _ in range(1500)], 10), ([rng.randrange(1, 2048) for _ in range(400)], 0)]:
        first = len(pack_gga.best_fit_packing(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, 2048))
        islands = [pack_gga.evolve(sizes, 2048, [], seed) for seed in (1, 2)]
        best = pack_gga.evolve(sizes, 2048, islands, 3)
        assert max(np.bincount(best, sizes)) <= 2048 and len(best) == len(sizes)
        assert pack_gga.least_bins(sizes, 2048) <= len(set(best)) <= min(len(set(x)) for x in islands) <= first - gain
    one, two = pack_gga.subset_fill(list(range(90)), sizes[:90], 2048, rng), pack_gga.best_fit_packing(list(range(90)), sizes[:90], 2048)
    better = pack_gga.crossover(two, one, sizes[:90], 2048, rng)
    assert sorted(i for b in better for i in b) == list(range(90))


def test_encoder_of_any_tokenizer():
    """Chunk by chunk where the tokenizer allows it, and whole texts otherwise, ids are the tokenizer's."""
    import json

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a.b,c's DON'T <|endoftext|> x", "A<|ENDOFTEXT|>b  \u0301x E\u0301. .\u0301e", "\x1ca\x1db \u2028c", None, "", "12ab34 naïve ÉTÉ İ ΣΑΣ (so)..!", "日本語 テキスト。"]
    for name, by_chunk in [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]:
        spec = open(public_tokenizers.path(name), encoding="utf-8").read()
        assert pack_gga.splits_at_spaces(json.loads(spec)) is by_chunk
        own, t = pack_gga.Encoder(spec), Tokenizer.from_str(spec)
        for some in (texts, [x.lower() if x else x for x in texts], texts[::-1], texts[2:5]):
            ids, offsets = own.texts(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_encoder_forgets(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(pack_gga, "KEPT", 5)
    spec = open(tokenizer_path(), encoding="utf-8").read()
    own, t = pack_gga.Encoder(spec), Tokenizer.from_str(spec)
    for k in range(6):
        text = " ".join(f"word{chr(97 + (j + k) % 9)} again" for j in range(7))
        assert own.texts(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(own.keys) < 40


def plain_features(text: str) -> list[float]:
    """The classifier's inputs, one text and one word at a time."""
    raw = (text or "").encode()
    words, word = [], bytearray()
    for b in raw + b" ":
        if b == 32 or 9 <= b <= 13:
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    n, m = max(1, len(raw)), max(1, len(words))
    upper = lambda w: sum(65 <= b <= 90 for b in w)
    lower = lambda w: sum(97 <= b <= 122 for b in w)
    stops = b".,;:?'\"-()"
    marks = lambda w: sum(32 < b < 127 and not chr(b).isalnum() and b not in stops and b not in b"!|" for b in w)
    count = lambda c: raw.count(c) / n
    return [
        math.log1p(len(words)), sum(map(len, words)) / m, upper(raw) / n, sum(48 <= b <= 57 for b in raw) / n, marks(raw) / n, sum(b in stops for b in raw) / n,
        count(b"!"), count(b"|"), sum(b >= 128 for b in raw) / n, count(b"\n"), sum(upper(w) > 1 and not lower(w) for w in words) / m, sum(marks(w) > 0 for w in words) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, len(set(words)) / m,
    ]


def test_quality_scores_are_sums_of_table_entries(rows):
    """Features and scores of every text, row by row in plain Python."""
    import bisect

    import pyarrow as pa

    texts = [r[1] for r in rows] + ["A!B|C", "x\x0by z", "AB AB ab ab", "日本 日本"]
    x = quality_gam.text_features(pa.array(texts))
    assert np.allclose(x, [plain_features(t) for t in texts], atol=1e-12)
    rng = np.random.default_rng(1)
    y = (x[:, 0] + x[:, 4] + 0.1 * rng.standard_normal(len(x)) > np.median(x[:, 0] + x[:, 4])).astype(float)
    model = quality_gam.AdditiveModel.fit(x, y, bins=8, grid=4, rounds=10, pair_rounds=5)
    assert model.pairs and any(t.any() for t in model.tables)
    for row, score in zip(x, model.scores(x)):
        bins = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, row)]
        z = model.bias + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-12
    assert np.mean((model.scores(x) >= 0.5) == (y == 1)) > 0.9


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 0), (None, 1)], "doc_id long, quality int")
    model = quality_gam.trained(odd, labels)
    scores = sorted((str(r.doc_id), round(r.score, 9)) for r in quality_gam.scored(odd, model).collect())
    assert len(scores) == 6 and len({s for d, s in scores if d == "5"}) == 1
    text = {(r.doc_id, r.text): None for r in odd.collect()}
    assert len(text) == 4 and quality_gam.good_documents(odd, model, 0.0).count() == 6


def test_quality(spark, docs, nothing):
    rng = random.Random(1)
    good = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(20, 200))), 1) for k in range(600)]
    bad = [(k, " ".join(rng.choice(["ALPHA!!", "x***", "y$$$"]) for _ in range(rng.randrange(20, 200))), 0) for k in range(600, 900)]
    text = spark.createDataFrame([(a, b) for a, b, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_gam.trained(text, labels)
    scored = {r.doc_id: r.score for r in quality_gam.scored(text, model).collect()}
    held = [r.doc_id for r in text.filter(quality_gam.held_out(F.col("doc_id"))).collect()]
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in held) and len(held) > 100
    assert np.mean([(scored[d] >= 0.3) == (d < 600) for d in held]) > 0.98
    kept = quality_gam.good_documents(docs, model)
    assert kept.columns == docs.columns
    everything = {r.doc_id: r.score for r in quality_gam.scored(docs, model).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, s in everything.items() if s >= 0.3)
    assert all(0 <= s <= 1 for s in everything.values())
    assert quality_gam.scored(nothing, model).count() == 0
    empty = quality_gam.trained(text, labels.limit(0))
    assert {round(r.score, 6) for r in quality_gam.scored(text, empty).collect()} == {0.5}


def test_pipeline(spark, tmp_path, docs, rows):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 0 if r[1] and "same same" in r[1] else 1) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = kept.columns
    before = {r.doc_id for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
        now = {r.doc_id for r in kept.collect()}
        assert now <= before, name
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in kept.collect()]
            assert all(d == c for d, _, c in brute.near_copies(texts))
        before = now
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} == before
    assert set(corpus_pipeline.queries()) == {"pipeline"} and corpus_pipeline.oracle_sql() == {}


def test_pipeline_end_to_end(spark, tmp_path, docs, rows):
    """Every stage's documents by brute force, and the packed pieces of what they leave."""
    import hashlib

    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    quality = [(r[0], 0 if r[1] and "same same" in r[1] else 1) for r in rows]
    spark.createDataFrame(quality, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality_gam.trained(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    z = {d: model.scores(np.array([plain_features(t)]))[0] for d, t, *_ in rows}
    left = [r for r in rows if z[r[0]] >= 0.3]
    groups = {}
    for r in left:
        groups.setdefault("".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(r[1] or ""), r[0]))
    keep = {min(g)[1] for g in groups.values()}
    left = [r for r in left if r[0] in keep]
    left = [r for r, first in zip(left, brute.similar_first([r[:2] for r in left])) if r[0] == first]
    size = {}
    for _, t, _, s in left:
        size[s] = size.get(s, 0) + len((t or "").encode()) + 1
    weight = {s: math.sqrt(b) for s, b in size.items()}
    copies = []
    for i, t, _, s in left:
        mean = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            n, p = n + 1, p * mean / (n + 1)
            c += p
        copies += [(i, t)] * n
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in copies:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want) and len(want) > 20
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and all(o == sum(n for _, n in sorted(x)[:k]) for k, (o, _) in enumerate(sorted(x))) for x in fill.values())
    assert len(fill) <= -(-sum(w[3] for w in want) // 2048) * 1.05 + 2

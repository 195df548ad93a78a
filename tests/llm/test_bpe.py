"""Byte-level BPE against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest
from corvane.llm.bpe_verify import Encoder, Vocabulary, decoded, encoded, unlike_characters
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SPEC = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def coder():
    return Encoder(SPEC, unlike_characters(SPEC))


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    marks = ["'", "'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "a", "B", "ing", "the", "1", "22", "½", "é", "日本", "!", "...", "--", "<|endoftext|>", "<|", "\x00", "😀", "é", "‍", "ſ", "\U0001e6c0", "࢏", "\x1c", "\x85", " "]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(600)]


def test_ids_and_texts_are_the_librarys(coder):
    library = Tokenizer.from_file(PATH)
    some = texts(1) + ["", " ", "a" * 5000, " " * 3000, "é" * 3001, "=" * 700, "ab" * 999, "".join(map(chr, range(1, 0x3000)))]
    ids, ends = coder.texts(some)
    for k, text in enumerate(some):
        own = ids[ends[k] : ends[k + 1]].tolist()
        assert own == library.encode(text, add_special_tokens=False).ids, text
    assert 0 < coder.failed < coder.seen


def test_random_letters_need_exact_merging_at_times(coder):
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    some = [" " * rng.randrange(2) + "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 15))) for _ in range(4000)]
    before = coder.failed
    ids, ends = coder.texts(some)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert coder.failed > before


def test_pairs_stand_side_by_side_exactly_if_they_encode_to_themselves(coder):
    v, rng = coder.vocabulary, random.Random(3)
    assert v.sound[list(v.known.values())].all() and all(v.exact(v.text[i]) == [i] for i in rng.sample(sorted(v.known.values()), 2000))
    import numpy as np

    low = [rng.choice(sorted(v.known.values())[:900]) for _ in range(6000)]
    a, b = np.array(low[:3000]), np.array(low[3000:])
    want = [v.exact(v.text[x] + v.text[y]) != [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.crossed(a, b).tolist() == want and 20 < sum(want) < 2900


def test_long_texts_go_in_runs_of_words(coder, monkeypatch):
    import corvane.llm.bpe_verify as m

    some = ["one two three four " * 9, "", "x", "five " * 30]
    whole = [x.tolist() for x in coder.texts(some)]
    monkeypatch.setattr(m, "WORDS", 7)
    monkeypatch.setattr(m, "KEPT", 3)
    assert [x.tolist() for x in Encoder(SPEC, "").texts(some)] == whole


def test_tables(spark, docs, rows, odd, nothing):
    library = Tokenizer.from_file(PATH)
    out = decoded(encoded(docs, PATH), PATH).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.decoded == text[r.doc_id] and r.source in ("hot", "cold", None)
    clash = encoded(docs.withColumnRenamed("row", "ids").withColumnRenamed("at", "Decoded"), PATH)
    assert "_ids" in clash.columns and "_decoded" in decoded(clash, PATH, ids="_ids").columns
    assert encoded(odd, PATH).count() == 6 and encoded(nothing, PATH).count() == 0
    bad = spark.createDataFrame([(1, [0xE9, 127, 50256, 99999, -4]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decoded(bad, PATH).collect()}
    assert got == {1: library.decode([0xE9, 127, 50256], skip_special_tokens=False), 2: "", 3: ""}


def test_other_tokenizers_are_refused():
    spec = json.loads(SPEC)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"truncation": {"max_length": 4}}):
        with pytest.raises(ValueError):
            Vocabulary(spec | change)

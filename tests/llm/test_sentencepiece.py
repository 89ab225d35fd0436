import random

import pytest
import sentencepiece

from factorlake.llm.sentencepiece_sa import MODEL, Encoder, decode, encode, load, merge

from .fixtures import AWKWARD, SCHEMA, rows


@pytest.fixture(scope="module")
def vocabulary():
    return load()


def texts(v):
    rnd = random.Random(2)
    plain = [p for p, k in zip(v.pieces, v.kinds) if k == 1]
    out = ["".join(rnd.choice(plain) for _ in range(rnd.randint(1, 14))).replace("▁", " ") for _ in range(1500)]
    out += ["日本語 テキスト 🎉 naïve\n\n  x\t", "aab" * 400, "ababab" * 90 + " b", "\x00\x01 z", "def foo(self, x):\n    return x  # é" * 30]
    return [*out, *AWKWARD]


def test_equals_the_library(vocabulary):
    t = texts(vocabulary)
    ids, offs = Encoder(vocabulary).encode(t)
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode([x or "" for x in t])
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want


def test_equals_plain_merging(vocabulary):
    known = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k in (1, 4)}
    for t in ["hello world", "the internationalisation of it", "aaaaaaaaaaaaaaa"]:
        ids, _ = Encoder(vocabulary).encode([t])
        assert [vocabulary.pieces[i] for i in ids] == [s for s, _, _ in merge(vocabulary, known, "▁" + t.replace(" ", "▁"))]


def test_spark_round_trip(spark):
    df = spark.createDataFrame(rows(70), SCHEMA).selectExpr("*", "1 as n_tokens", "2 as start").repartition(3)
    got = decode(encode(df)).collect()
    assert len(got) == 70 and all(r.round_trip and r.decoded == (r.text or "") for r in got)
    assert encode(df.limit(0)).count() == 0

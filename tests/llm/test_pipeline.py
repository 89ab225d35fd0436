import random
import zlib

import pytest
import sentencepiece

import corpus_pipeline
from factorlake.llm.sentencepiece_sa import MODEL

from .test_decontaminate import brute as brute_hits
from .test_exact_dedup import brute as brute_exact
from .test_jaccard_join import brute as brute_jaccard
from .test_jaccard_join import corpus
from .test_toxicity import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(6)
    docs, labels = table(400)
    data = [d[:5] for d in docs] + [(20_000 + r[0], *r[1:]) for r in corpus(4, 60)]
    bench = [(i, " ".join(data[450 + i][1].split()[:30]) if i < 4 else "never seen %d" % i) for i in range(6)]
    data += [(9000 + i, rnd.choice(data)[1], "en", "s", 1) for i in range(40)] + [(9100, None, None, None, None), (9101, "", "en", "s", 0), (9102, bench[0][1] + " more", "en", "s", 1)]
    at = str(tmp_path_factory.mktemp("sf"))
    for name, rows, schema in (("documents", data, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    truth = {d[0]: d[5] for d in docs}
    return at, data, bench, truth


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark, folder):
    at, data, bench, truth = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = rows_of(kept)
        kept = stage(spark, kept, at)
        assert kept.columns == docs.columns
        kept.write.parquet(f"{at}/stage{k}")
        kept = spark.read.parquet(f"{at}/stage{k}")
        after = rows_of(kept)
        if k == 0:
            gone = {r[0] for r in before} - {r[0] for r in after}
            held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
            assert sum((i in gone) == truth[i] for i in held) / len(held) > 0.9
            assert all(r in before for r in after)
        else:
            want = {1: lambda: {x[0] for x in brute_exact(before) if x[3]}, 2: lambda: {x[0] for x in brute_jaccard(before, 5, 80) if x[0] == x[2]}, 3: lambda: {x[0] for x in brute_hits(before, bench) if not x[5]}}[k]()
            assert after == [r for r in before if r[0] in want]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, at).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(last) == kept.count() and all(r.ids == sp.encode(r.text or "") and r.round_trip for r in last)


def test_run_is_the_stages(spark, folder):
    at, *_ = folder
    out = corpus_pipeline.run(spark, at)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{at}/stage3").collect())


def test_empty_and_repeated(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0, name
    twice = docs.where("doc_id < 3").unionAll(docs.where("doc_id < 3"))
    assert corpus_pipeline.exact_dedup_stage(spark, twice, at).count() == 3

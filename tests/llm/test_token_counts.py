from collections import defaultdict

import tiktoken  # noqa: F401  the encoder below needs it
from pyspark.sql import functions as F

from factorlake.llm.token_counts import PATTERN, VOCABULARY, Rollup, _encoder, changes, revised

from .fixtures import SCHEMA, rows


def brute(data, sign=1, into=None):
    enc = _encoder(VOCABULARY, PATTERN)
    out = into if into is not None else defaultdict(lambda: [0, 0, 0])
    for _, t, lang, source, _ in data:
        for k, x in enumerate((1, len(enc.encode_ordinary(t or "")), len(t or ""))):
            out[source, lang, "v1"][k] += sign * x
    return out


def totals(r, **kw):
    return {(x.source, x.lang, x.tokenizer): [x.n_docs, x.n_tokens, x.n_chars] for x in r.totals(**kw).collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    data = rows(90) + [(500, "no source", None, None, 9)] * 2
    df = spark.createDataFrame(data, SCHEMA).withColumn("n_tokens", F.lit("clash"))
    r = Rollup(spark, f"file://{tmp_path}/rollup")
    assert totals(r) == {}
    assert r.commit("load", changes(df, 1, "v1")) and not r.commit("load", changes(df, 1, "v1"))
    want = brute(data)
    assert totals(r) == want
    gone = [x for x in data if x[3] == "s1"]
    r.commit("delete/1", changes(spark.createDataFrame(gone, SCHEMA), -1, "v1"))
    want = brute(gone, -1, want)
    assert totals(r) == want
    r.commit("revise", revised(spark.createDataFrame([("s2", "en", 10, 12, 30, None)], "source string, lang string, old_tokens long, new_tokens long, old_chars long, new_chars long"), "v1"))
    want["s2", "en", "v1"][1] += 2
    want["s2", "en", "v1"][2] -= 30
    assert totals(r) == want
    assert r.commit("empty", changes(df.limit(0), 1, "v1")) and not r.commit("empty", changes(df, 1, "v1"))
    r.compact()
    assert totals(r) == want and not r.commit("load", changes(df, 1, "v1"))
    r.commit("late", changes(df.limit(0), 1, "v2"))
    r.compact()
    again = Rollup(spark, f"file://{tmp_path}/rollup")
    assert totals(again) == want and again.committed("delete/1")
    assert totals(again, drop_zero=True) == {k: v for k, v in want.items() if any(v)}


def test_unfinished_stage_is_not_seen(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame(rows(20), SCHEMA)
    changes(df, 1, "v1").write.parquet(f"file://{tmp_path}/r/staging/dead/data")
    assert totals(r) == {}


def test_query_commits_deletes_and_revisions_of_the_whole_table(spark, tmp_path, monkeypatch):
    from factorlake.llm.queries import op9_token_counts

    data = rows(90) + [(500, "no source", None, None, 9)] * 2 + [(None, "no id é𝄞", "en", "s0", 8)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    seen, compacted = [], []
    commit, compact = Rollup.commit, Rollup.compact

    def spy(self, name, signed):
        done = commit(self, name, signed)
        seen.append((name, done, *signed.agg(F.sum("n_docs"), F.sum("n_tokens")).first()))
        return done

    monkeypatch.setattr(Rollup, "commit", spy)
    monkeypatch.setattr(Rollup, "compact", lambda self: compacted.append(1) or compact(self))
    got = {(x.source, x.lang): [x.n_docs, x.n_tokens, x.n_chars] for x in op9_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k[:2]: v for k, v in brute(data).items()}
    assert [done for _, done, *_ in seen] == [True, False] * 4 and compacted
    n = {name: (docs, tokens) for name, _, docs, tokens in seen}
    assert n["load"][0] == len(data) and 0 < -n["delete"][0] < len(data) and n["delete"][1] < 0
    assert n["put back"] == tuple(-x for x in n["delete"]) and n["revise"][0] == 0 < n["revise"][1]

import hashlib
import re

from factorlake.llm.exact_dedup import exact_dedup

from .fixtures import SCHEMA, rows


def brute(data):
    norm = {}
    for i, t, *_ in data:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in norm.items():
        for i in ids:
            out.append((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    data = rows(120) + [(1000 + i, "hot copy", "en", "s", 8) for i in range(300)]
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()))
    assert got == brute(data)


def test_null_id_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "z")], "doc_id long, text string")
    df = df.selectExpr("*", "1 as keep_id", "2 as size", "3 as sha", "4 as __id")
    got = sorted(map(tuple, exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, None, 1, True)], key=str)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0

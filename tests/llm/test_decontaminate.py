import hashlib
import re

from factorlake.llm.decontaminate import contamination, decontaminate

from .fixtures import SCHEMA, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, bench, n=10):
    win = {}
    for i, t in bench:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            win.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = []
    for i, t, *_ in docs:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in win}:
            for p in range(len(w) - k + 1):
                if (key := tuple(w[p : p + k])) in win:
                    hit |= set(range(p, p + k))
                    items |= win[key]
        s = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((i, len(w), len(hit), len([x for x in items if x is not None]), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_matches_brute_force_both_joins(spark):
    docs = rows(80)
    docs += [(500, "zz " + docs[30][1] + " zz", "en", "s", 1), (501, "ONE, two; x", "en", "s", 1)]
    bench = [(1, docs[30][1]), (2, "one TWO"), (10, docs[31][1]), (3, None), (4, "..."), (5, docs[30][1]), (6, "the same words the same words the same words the same words")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert sorted(map(tuple, contamination(d, b).collect())) == want
    assert sorted(map(tuple, contamination(d, b, broadcast_limit=0).collect())) == want
    kept = decontaminate(d.selectExpr("*", "7 as key", "8 as item"), b)
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if not x[5]]
    assert kept.columns == [*d.columns, "key", "item"]


def test_empty_tables_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(d, none).collect()] == [0, 0, 0]
    b = spark.createDataFrame([(None, "b")], "item_id long, text string")
    assert sorted(tuple(r)[1:4] for r in contamination(d, b).collect()) == [(0, 0, 0), (2, 1, 0), (2, 1, 0)]
    assert contamination(d.limit(0), b).count() == 0

"""Secret scan: three fixed patterns, and strings that character Markov models find random.

Native: DataFrame and SQL functions only. A pattern's matches come from regexp_extract_all, and their places from the
lengths of the pieces that split() leaves between them, summed in two levels. Two first-order character models, one of
random strings and one of ordinary identifiers, are counted from labelled samples; a part of a run of 12 or more key
characters whose log-likelihood ratio is above the threshold is a span of kind "markov", unless it meets a span of the fixed
patterns.

Defined results: null text counts as empty; a row without spans has zero counts, an empty spans string and the digest of
the empty string; repeated rows are scanned each on its own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run of 18 or more, as shorter ones fail
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
BLOCK = 256
SAMPLE_DOCS = 2000  # documented bound: documents whose words train the model of ordinary identifiers
SAMPLE_RANDOM = 4000  # random strings that train the other
THRESHOLD = 10.0  # nats that a part of a run has to gain, after PER_CHAR is taken off for each of its characters
PER_CHAR = 0.7
CLIP = 4.0  # nats that one character can add or take

_NONE = "array<struct<start:int,kind:int,stop:int,text:string>>"


def matches(text: Column, pattern: str, kind: int, group_check: int | None = None) -> Column:
    """Array of (start, kind, stop, text) of the leftmost non-overlapping matches, in code points."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    g = F.regexp_extract_all(text, F.lit(pattern), F.lit(group_check)) if group_check else m
    gaps = F.split(text, pattern, -1)
    lens = F.zip_with(F.transform(gaps, lambda x: F.char_length(x)), F.concat(F.array(F.lit(0)), F.transform(m, lambda x: F.char_length(x))), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    state = F.struct(m.alias("m"), g.alias("g"), lens.alias("lens"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def with_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(s["lens"]), F.lit(BLOCK)), lambda b: total(F.slice(s["lens"], b + 1, BLOCK)))
        return F.struct(s["m"].alias("m"), s["g"].alias("g"), s["lens"].alias("lens"), blocks.alias("blocks"))

    def place(s: Column) -> Column:
        def one(k: Column) -> Column:
            b = F.floor(k / BLOCK).cast("int")
            start = total(F.slice(s["blocks"], 1, b)) + total(F.slice(s["lens"], b * BLOCK + 1, k - b * BLOCK + 1))
            t = F.get(s["m"], k)
            ok = F.char_length(F.get(s["g"], k)) >= 12 if group_check else F.lit(True)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(t)).alias("stop"), F.when(ok, t).alias("text"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(s["m"]) - 1), one), lambda x: x["text"].isNotNull())

    # a one-element array binds each step's value to a lambda variable, so that it is computed once
    placed = F.transform(F.transform(F.array(state), with_blocks), place)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.get(placed, 0)).otherwise(F.array().cast(_NONE))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", n_docs: int = SAMPLE_DOCS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """(sample, secret): random base-64 strings, and the words of a bounded sample of documents."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(n_docs)
    words = docs.join(F.broadcast(ids), docs[id_col] == ids["__id"], "left_semi").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("sample"))
    words = words.where(~F.col("sample").rlike("[A-Z0-9][^A-Z]*[0-9]|[0-9]{4}")).select("sample", F.lit(0).alias("secret"))
    n = spark.range(n_random).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("x"))
    rand = n.select(F.base64(F.unhex("x")).alias("sample"), F.lit(1).alias("secret"))
    return rand.unionByName(words)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the next character, by (code of a character, code of the next)."""
    k = len(ALPHABET) + 1
    pairs = samples.select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("sample") - 1, F.lit(1))), lambda i: F.substring(F.col("sample"), i, F.lit(2)))).alias("p")).where(F.char_length("p") == 2)
    counts = pairs.groupBy("secret", _code(F.substring("p", 1, 1)).alias("a"), _code(F.substring("p", 2, 1)).alias("b")).count().collect()  # k*k*2 rows at most
    c = [[[0.0] * k for _ in range(k)] for _ in range(2)]
    for r in counts:
        c[int(r["secret"] == 1)][r["a"]][r["b"]] += r["count"]

    def model(rows: list[list[float]]) -> list[list[float]]:
        """Witten-Bell style: each row backs off to the add-one frequencies of the characters."""
        total = sum(map(sum, rows))
        freq = [(sum(r[b] for r in rows) + 1) / (total + k) for b in range(k)]
        return [[(r[b] + k * freq[b]) / (sum(r) + k) for b in range(k)] for r in rows]

    ordinary, rand = model(c[0]), model(c[1])
    return [max(-CLIP, min(CLIP, math.log(rand[a][b]) - math.log(ordinary[a][b]))) for a in range(k) for b in range(k)]


def _code(ch: Column) -> Column:
    return F.call_function("locate", ch, F.lit(ALPHABET)).cast("int")


def random_parts(run: Column, table: Column, threshold: float, per_char: float) -> Column:
    """Spans like `run` for its random parts: where the ratios, less per_char each, sum to the threshold or more.

    One pass: a part ends where its sum falls to nothing, or by the threshold below its highest value, and reaches as far as that
    value. Its ends move out to the ends of the alphanumeric pieces that they lie in, so parts of one piece may overlap."""
    k = len(ALPHABET) + 1
    codes = F.transform(F.split(run["text"], ""), lambda ch: F.when(ch == "", F.lit(0)).otherwise(_code(ch)))
    gain = F.get(F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.coalesce(F.get(table, F.get(c, i) * k + F.get(c, i + 1)), F.lit(0.0)) - per_char)), 0)
    none = F.array().cast("array<struct<a:int,b:int>>")

    def state(at: Column, total: Column, a: Column, best: Column, b: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), total.alias("total"), a.alias("a"), best.alias("best"), b.alias("b"), out.alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["best"] >= threshold, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"])

    def step(s: Column, v: Column) -> Column:
        total, at = s["total"] + v, s["at"] + 1
        ends = (total <= 0) | ((s["best"] >= threshold) & (s["best"] - total >= threshold))
        on = state(at, total, s["a"], F.greatest(s["best"], total), F.when(total > s["best"], at + 1).otherwise(s["b"]), s["out"])
        return F.when(ends, state(at, F.lit(0.0), at, F.lit(0.0), at, closed(s))).otherwise(on)

    zero = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), none)

    def whole(p: Column) -> Column:
        t = run["text"]
        a = p["a"] + F.char_length(F.regexp_extract(F.substring(t, p["a"] + 1, p["b"] - p["a"]), "^[+/_=-]*", 0))
        b = p["b"] - F.char_length(F.regexp_extract(F.substring(t, p["a"] + 1, p["b"] - p["a"]), "[+/_=-]*$", 0))
        a = a - F.char_length(F.regexp_extract(F.substring(t, F.lit(1), a), "[A-Za-z0-9]*$", 0))
        b = b + F.char_length(F.regexp_extract(F.substring(t, b + 1, F.char_length(t)), "^[A-Za-z0-9]*", 0))
        return F.struct((run["start"] + a).alias("start"), run["kind"].alias("kind"), (run["start"] + b).alias("stop"), F.substring(t, a + 1, b - a).alias("text"))

    return F.array_distinct(F.transform(F.aggregate(gain, zero, step, closed), whole))


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD, per_char: float = PER_CHAR) -> DataFrame:
    """docs with __base and __all: arrays of (start, kind, stop, text), ordered by start and then kind."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    t = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    t = t.withColumn("__base", F.array_sort(F.concat(matches(F.col("__t"), ASSIGN, 0, 2), matches(F.col("__t"), ACCESS, 1), matches(F.col("__t"), HEX, 2))))
    t = t.withColumn("__runs", matches(F.col("__t"), TOKEN, 3)).drop("__t")

    def free(x: Column) -> Column:
        return ~F.exists("__base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))

    parts = F.flatten(F.transform("__runs", lambda run: random_parts(run, table, threshold, per_char)))
    t = t.withColumn("__more", F.when(F.size("__runs") > 0, F.filter(parts, free)).otherwise(F.array().cast(_NONE)))
    return t.withColumn("__all", F.when(F.size("__more") > 0, F.array_sort(F.concat("__base", "__more"))).otherwise(F.col("__base"))).drop("__runs", "__more")


def joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id") -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), "text")
    s = scan(d, ratios if ratios is not None else train(labelled_samples(d)))

    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")

    return s.select(F.col("doc_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("__base").cast("binary"), 256).alias("base_sha256"), joined("__all").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by the mark; overlapping spans become one."""
    s = scan(docs, ratios)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate("__all", start, lambda acc, x: F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out")))
    clean = F.when(F.size("__all") > 0, F.concat(folded["out"], F.substring(F.col("text"), folded["at"] + 1, F.char_length("text")))).otherwise(F.col("text"))
    return s.withColumn("text", clean).select(*docs.columns)


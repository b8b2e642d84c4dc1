import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from mnemos.llm import resampling
from mnemos.llm.registry import QUERIES, SQL
from tests.llm.util import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, orders):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, orders=2, buckets=10_000, least=20, percent=25):
    """rows: (key, text), keys distinct."""
    own = {k: grams(t, orders) for k, t in rows}
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(map(bucket, x)) for x in ((g for _, gs in own.values() for g in gs), (g for x in target for g in grams(x, orders)[1])))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets))))
    out = {}
    for k, (_, gs) in own.items():
        weight = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        h = int(sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        out[k] = [k, len(gs), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((k for k, (n, _) in own.items() if n >= least), key=lambda k: (k is None, -(out[k][3] or 0), k))
    for r, k in enumerate(able[: len(able) * percent // 100], 1):
        out[k][4] = r
    return sorted(out.values(), key=repr)


def mine(df):
    return sorted([[r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in df.collect()], key=repr)


def test_query_equals_sql_and_brute_force(spark):
    got = QUERIES["op12_importance_resampling"](spark, SF)
    assert spark_rows(got) == sql_rows(SQL["op12_importance_resampling"], SF)
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert mine(got) == brute([(r.doc_id, r.text) for r in docs], [r.text for r in target])


def test_odd_tables(spark):
    """Null keys and texts, words beyond ASCII, upper-case letters that stay, a very long text, few buckets, three orders."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Ab", "ÄB", "c3", "d-e", "ß", "x y", "İ"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, " ,\n"), (None, "a b " * 20), (103, "Wort über " * 30_000)]
    target = ["ab ÄB c3", None, "d e"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "key", "word", "bucket", "rank", "score")})
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for orders in (1, 3):
        got = resampling.resample(df, aims, orders=orders, buckets=50, percent=40)
        assert mine(got) == brute(rows, target, orders, 50, percent=40)


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b " * 15), (1, "a b " * 15), (2, "c " * 30), (3, "zz")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = mine(resampling.resample(docs, none, percent=100))
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3] and got[0][:4] == got[1][:4]
    assert resampling.resample(docs.limit(0), none).count() == 0

import math
from collections import Counter, defaultdict

from mnemos.llm import kneser_ney as k


def fold(text, order):
    z = [0] * (order - 1)
    return [*z, *[ord(c) if ord(c) < 128 else 128 + (ord(c) & 127) for c in text], 0]


def brute(docs, trusted, order):
    """key -> log perplexity; docs: (key, text)."""
    levels = {order: Counter()}
    for key, text in docs:
        if key in trusted:
            s = fold(text or "", order)
            levels[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    stats, discount = {}, {}
    for n, counts in levels.items():
        by = Counter(counts.values())
        n1, n2, n3, n4 = (by[i] for i in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            discount[n] = [0, *[min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]]
        else:
            discount[n] = [0, 0.5, 0.75, 0.9]
        stats[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts.items():
            stats[n][g[:-1]][0] += c
            stats[n][g[:-1]][min(c, 3)] += 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        total, *kinds = stats[n][g[:-1]] if g[:-1] in stats[n] else [0]
        if not total:
            return p(g[1:])
        c = levels[n][g]
        return (c - discount[n][min(c, 3)]) / total + sum(a * b for a, b in zip(discount[n][1:], kinds)) / total * p(g[1:])

    out = {}
    for key, text in docs:
        s = fold(text or "", order)
        out[key] = -sum(math.log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)) / (len(text) + 1) if text else None
    return out


def test_scores_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 1500")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for order in (2, 4):
        want = brute(rows, {r.doc_id for r in labels.collect()}, order)
        found = k.score(docs, labels, order=order).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.log_perplexity is None) == (want[r.doc_id] is None) and (want[r.doc_id] is None or abs(r.log_perplexity - want[r.doc_id]) < 1e-9)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = k.classify(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = found["quality"] == 1
    assert found["kept"][good].mean() > 0.99 and found["kept"][~good].mean() < 0.2, (found["kept"][good].mean(), found["kept"][~good].mean())


def test_odd_tables(spark):
    rows = [(1, "ab ab", "en"), (1, "ab ab", "en"), (2, None, "en"), (3, "", None), (None, "zz", None), (4, "日本é", "xx"), (5, "ab " * 50_000, "en")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, most int, key int")
    trusted = spark.createDataFrame([(1,), (5,), (None,), (77,)], "doc_id long")
    found = k.classify(df, trusted).collect()
    assert len(found) == 7 and {r.kept for r in found if r.n_symbols == 0} == {False}
    want = brute([(i, t) for i, (_, t, _) in enumerate(rows)], {0, 1, 6}, k.ORDER)
    got = sorted(r.log_perplexity for r in found if r.log_perplexity is not None)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, sorted(x for x in want.values() if x is not None), strict=True))
    none = k.classify(df, trusted.limit(0)).collect()
    assert len(none) == 7 and all(r.kept == bool(r.n_symbols) and r.most is None for r in none)
    assert k.classify(df.limit(0), trusted).count() == 0


def test_limit_is_the_quantile_of_held_out_scores(spark):
    words = "the cat sat on a mat and the dog ran to a tree".split()
    docs = spark.createDataFrame([(i, " ".join(words[i * j % len(words)] for j in range(3, 40)), "en") for i in range(80)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id")
    held = sorted(r.log_perplexity for r in k.held_out(docs, trusted, "doc_id", "text", "lang", k.ORDER).collect())
    most = {r.most for r in k.classify(docs, trusted).collect()}
    assert len(held) == 80 and len(most) == 1
    want = held[math.ceil(0.995 * 80) - 1]
    assert want <= most.pop() < want + 2 * k.BIN


def test_variety_and_whole_characters(spark):
    words = "der Hund läuft schnell über die große Straße und 日本語 спасибо тебе".split()
    rows = [(i, " ".join(words[(i * j + j // 7) % len(words)] for j in range(4, 30 + 9 * i))) for i in range(1, 50)] + [(90, "ja " * 3000), (91, None), (92, "语")]
    df = spark.createDataFrame([(a, b, "de") for a, b in rows], "doc_id long, text string, lang string")
    trusted = {k for k, _ in rows[:40]}
    grams = Counter()
    for key, text in rows:
        if key in trusted:
            s = "\0\0\0" + text + "\0"
            grams.update(s[i : i + 4] for i in range(len(s) - 3))
    total = sum(grams.values())

    def would(n):
        low = min(int(math.log2(n)), k.PIECE - 1)
        a, b = (sum(-math.expm1(-c * 2.0**e / total) for c in grams.values()) for e in (low, low + 1))
        return a + (b - a) * (n / 2**low - 1)

    got = {r.doc_id: r for r in k.score(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), bits=k.WIDE).collect()}
    assert got[91].variety is None and got[92].log_perplexity > got[1].log_perplexity
    for key, text in rows:
        if text:
            s = "\0\0\0" + text + "\0"
            own = [s[i : i + 4] for i in range(len(s) - 3)]
            pieces = [own[i : i + (1 << k.PIECE)] for i in range(0, len(own), 1 << k.PIECE)]
            assert abs(got[key].variety - sum(len(set(x)) for x in pieces) / sum(would(len(x)) for x in pieces)) < 1e-9
    assert got[90].variety < 0.1


def test_query_judges_by_the_limits(spark):
    sf = "/root/testdata/sf0.001"
    found = k.op9_kneser_ney_quality(spark, sf).collect()
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(rows)
    for r in found:
        assert r.n_symbols == len(rows[r.doc_id].text or "")
        assert r.kept == (r.log_perplexity is not None and r.log_perplexity <= r.most and r.variety >= r.least)

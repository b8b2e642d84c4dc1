import hashlib
import random

import pytest

from mnemos.llm import suffix_dedup as s


def brute(rows):
    """rows: (key, text) in order of the keys."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - s.LENGTH + 1):
            w = data[i : i + s.LENGTH]
            if w in seen:
                gone[i : i + s.LENGTH] = b"\1" * s.LENGTH
            seen.add(w)
        spans = sum(b and not a for a, b in zip([0, *gone], gone))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return out


def test_loser_tree_sorts_and_knows_prefixes():
    random.seed(2)
    runs = [sorted(bytes(random.choices(b"ab", k=random.randint(0, 9))) for _ in range(random.randint(0, 30))) for _ in range(7)]
    coded = [(s.front_code(r)[0], r) for r in runs]
    got = list(s.merged(coded))
    strings = [runs[r][i] for r, i, _ in got]
    assert strings == sorted(sum(runs, []))
    assert [k for _, _, k in got[1:]] == [s.common(a, b) for a, b in zip(strings, strings[1:])]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = sorted(map(tuple, s.op6_suffix_dedup(spark, sf).collect()))
    assert found == brute(rows) and any(r[2] for r in found)


def rows_of(spark, rows, **how):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, block long")
    found = s.remove_repeats(df.repartition(3), **how).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in found)


@pytest.mark.parametrize("hot,few,block", [(20_000, 24, 1 << 22), (2, 24, 700), (5, 1, 2000), (20_000, 1, 700)])
def test_random_repeats(spark, hot, few, block):
    random.seed(hot + few)
    word = lambda: "".join(random.choices("abcdé", k=random.randint(2, 6)))
    passages = [" ".join(word() for _ in range(random.randint(15, 60))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [random.choice(passages)[random.randint(0, 40) :] if random.random() < 0.5 else " ".join(word() for _ in range(8)) for _ in range(random.randint(1, 6))]
        rows.append((k, "|".join(parts)))
    rows += [(60, "ab" * 300), (61, "x" * 150), (62, "x" * 99), (63, None), (64, ""), (65, rows[3][1])]
    assert rows_of(spark, rows, hot=hot, few=few, block=block) == brute(rows)


def test_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    found = rows_of(spark, [(1, text), (1, text)])
    assert [r[2] for r in found] in ([0, len(text)], [len(text), 0])
    df = spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")
    assert {r.doc_id: len(r.starts) for r in s.remove_repeats(df).collect()} == {None: 1, 5: 0}
    assert s.remove_repeats(df.limit(0)).count() == 0

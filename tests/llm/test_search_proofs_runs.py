"""Exact top-k search, Merkle manifest and periodic runs, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, periods, topk
from tidemark.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# --- top-k ------------------------------------------------------------------------------------


def plain_top(rows, k=5):
    usable = [(n, key, [int(np.floor(256 * np.float64(x))) for x in v]) for n, (key, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, key, v in usable:
        if key is not None and key % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), other is None, other or 0) for m, other, w in usable if m != n)[:k]  # noqa: B905
            out += [(key, at + 1, None if unnamed else other, -loss) for at, (loss, unnamed, other) in enumerate(scored)]
    return sorted(out, key=str)


def found_top(spark, rows, k=5, kind="float"):
    df = spark.createDataFrame([(key, v, "x", 1) for key, v in rows], f"vec_id long, embedding array<{kind}>, label string, strip int").repartition(3)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect()), key=str)


def test_top_k_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    rng = random.Random(4)
    v = lambda n=8: [np.float32(rng.choice([-0.5, -0.25, 0.0, 0.25, 0.3, 0.7])).item() for _ in range(n)]
    rows = [(k, v()) for k in range(400)]
    hot = v()
    rows += [(1000 + k, hot) for k in range(150)] + [(50, hot), (50, hot), (None, hot), (None, v())]
    rows += [(2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, v(3)), (7, v(20))]
    assert found_top(spark, rows) == plain_top(rows)
    monkeypatch.setattr(topk, "CANDIDATES", 20)  # many strips: lists are merged in a tree
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SHARD_COMPONENTS", 64)
    assert found_top(spark, rows, 3) == plain_top(rows, 3)


def test_top_k_of_few_rows_and_of_large_numbers(spark):
    assert found_top(spark, []) == [] and found_top(spark, [(1, [1.0])]) == [] and found_top(spark, [(50, [1.0])]) == []
    assert found_top(spark, [(50, [1.0]), (3, [2.0])]) == [(50, 1, 3, 131072)]
    big = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 5.0])]
    assert found_top(spark, big, kind="double") == plain_top(big)
    huge = found_top(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1e200])], kind="double")
    assert [r[2] for r in huge] == [1, 3, 2] and huge[0][3] == 2**63 - 1 and huge[2][3] == -(2**63 - 1)


def test_a_kept_list_never_loses_an_equal_score_of_a_smaller_id():
    block = lambda ids, numbers: _block(ids, np.array(numbers, np.int16))
    queries = block([50], [[1, 0]])
    queries.spots = np.array([-1])
    blocks = [block(range(100, 300), [[1, 5]] * 200), block(range(0, 90), [[1]] * 90)]
    (rows, scores, _, ids), = topk.best_of(queries, blocks, 5)
    assert sorted(ids.tolist()) == [0, 1, 2, 3, 4] and set(scores.tolist()) == {1}


def _block(ids, numbers):
    ids = np.array(ids, np.int64)
    return topk._Block([{"n": len(ids), "width": numbers.shape[1], "ids": ids.tobytes(), "unnamed": np.zeros(len(ids), bool).tobytes(), "spots": (ids * 2).tobytes(), "numbers": numbers.tobytes(), "wide": numbers.itemsize}])


# --- Merkle manifest --------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_record(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(tree, at, folded):
    """Root of ``tree`` folded from ``folded`` at place ``at``, and the siblings passed."""
    proof = ""
    while len(tree) > 1:
        run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(tree)))
        proof += "".join(tree[k] for k in run if k != at)
        folded = sha("".join(folded if k == at else tree[k] for k in run))
        tree, at = [sha("".join(tree[k : k + 3])) for k in range(0, len(tree), 3)], at // 3
    return folded, proof


def plain_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        doc_id, source, lang, n, text = row
        damaged = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        start = plain_record((doc_id, source, lang, n, text.replace("\n", "") if damaged else text))
        by_source[source].append((doc_id, plain_record(row), start))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [climb([x[1] for x in by_source[s]], 0, by_source[s][0][1])[0] for s in names]
    root = climb(subroots, 0, subroots[0])[0] if subroots else None
    out = []
    for j, s in enumerate(names):
        leaves = [x[1] for x in by_source[s]]
        for k, (doc_id, leaf, start) in enumerate(by_source[s]):
            sub, below = climb(leaves, k, start)
            folded, above = climb(subroots, j, sub)
            out.append((doc_id, leaf, subroots[j], root, sha(below + above), folded, folded == root))
    return sorted(out, key=str)


def found_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int")
    return sorted(map(tuple, merkle.manifest(df.repartition(3)).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "a", "ü\nb\n", "line\nline", "x" * 3000])
    rows = [(k, rng.choice(["hot", "hot", "hot", "é", "", "z"]), rng.choice(["en", None]), k, text()) for k in range(900)]
    rows += [(None, None, None, None, None), (None, "hot", None, 3, "a\nb"), (5, None, "en", None, "t\n"), rows[0], rows[0], rows[3], (7, "lone", "de", 1, "q\n")]
    rows += [(2000 + k, f"s{k}", "en", 1, "a\nb") for k in range(120)]  # a tree over sources of several heights
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_few_rows_and_many_sources(spark, monkeypatch):
    assert found_manifest(spark, []) == []
    for rows in ([(1, "a", "en", 1, "t\n")], [(k, "a", "en", 1, "b\n") for k in range(28)], [(k, "ab"[k % 2], "en", 1, "b\n") for k in range(2)]):
        assert found_manifest(spark, rows) == plain_manifest(rows)
    monkeypatch.setattr(merkle, "FEW_SOURCES", 3)
    monkeypatch.setattr(merkle, "BLOCK", 27)
    rows = [(k, f"s{k % 40}", "en", 1, "b\n") for k in range(100)] + [(k, "hot", "en", 1, "b\n") for k in range(200)]
    assert found_manifest(spark, rows) == plain_manifest(rows)


# --- periodic runs ----------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, x = j - i + q, w[i : j + q]
            if length >= max(6, 4 * q) and not any(all(x[t] == x[t + r] for t in range(length - r)) for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        documents = []
        for _ in range(rng.randint(1, 5)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 100))]
            for _ in range(rng.randint(0, 3)):
                u, at = [b"%d" % rng.randrange(4) for _ in range(rng.randint(1, 20))], rng.randint(0, len(w))
                w[at:at] = (u * 7)[: rng.randint(1, 6 * len(u))]
            documents.append(w)
        assert [sorted(x) for x in periods.runs_of_group(documents)] == [plain_runs(w) for w in documents]


def test_words_whose_hashes_meet_make_no_run(monkeypatch):
    monkeypatch.setattr(periods, "_scrambled", lambda x: np.zeros(len(x), np.uint64))
    rng = random.Random(7)
    documents = [[b"%d" % rng.randrange(3) for _ in range(60)] + [b"a", b"b"] * 6 for _ in range(20)]
    assert [sorted(x) for x in periods.runs_of_group(documents)] == [plain_runs(w) for w in documents]


def test_long_texts_take_little_more_than_linear_work():
    assert periods.runs_of_group([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    fibonacci = [[b"a"], [b"b"]]
    while len(fibonacci[-1]) < 50_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periods.runs_of_group([fibonacci[-1], [], [b"x"]]) == [[], [], []]  # its powers stay below 3.7


def plain_row(doc_id, text, alter):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if alter and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    of = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), of(listed), of(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_rows_of_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periods, "GROUP", 500)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90)))) for k in range(250)]
    rows += [(None, None), (None, "x " * 50), (300, ""), (301, " \t\n\x0b\x0c\r "), (302, "é   é   é   é  "), (303, "ab " * 3000), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, "mine", 3) for r in rows], "doc_id long, text string, runs string, __i int")
    for alter in (False, True):
        found = periods.periodic_runs(df.repartition(3), alter)
        assert found.columns == ["doc_id", "text", "__i", "runs"]
        assert sorted(map(tuple, found.select("doc_id", "runs.*").collect()), key=str) == sorted((plain_row(k, t, alter) for k, t in rows), key=str)
    assert periods.periodic_runs(df.limit(0)).count() == 0

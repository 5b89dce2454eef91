"""Operators over groups: SimHash components, mixing, chat formatting."""

import heapq
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, components, mixing, queries, simhash
from tidemark.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    roots = list(range(len(fps)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            roots[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    base = "the quick brown fox jumps over a lazy dog while many other animals look on from behind the old garden wall in spring " * 6
    words = base.split()
    texts = [None, "", " \n", "one", "one", "ONE", "one two three four", "One two three four"]
    texts += [" ".join(words[:k] + [f"z{k}"] + words[k + 1 :]) for k in range(0, 60, 3)] + [f"entirely different text number {k} with words of its own {k * 7}" for k in range(15)] + [base, base]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    want = brute_components(fps)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == len(texts)
    for k in range(len(texts)):
        assert found[k]["fp"] & (2**64 - 1) == int(fps[k]) and found[k]["component_id"] == want[k]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def dense_fingerprints():
    rng = np.random.default_rng(5)
    fps = [np.uint64(x) for x in rng.integers(0, 2**63, 60)]
    for weak in (rng.choice(64, 9, replace=False), rng.choice(64, 5, replace=False)):
        for mask in range(1 << len(weak)):
            fps.append(np.uint64(int(fps[0]) ^ sum(1 << int(b) for k, b in enumerate(weak) if mask >> k & 1)))
    return np.unique(np.array(fps, np.uint64))


def test_links_of_dense_groups(spark):
    fps = dense_fingerprints()
    rows = spark.createDataFrame([(k, int(x)) for k, x in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    want = brute_components(fps)
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert all(want[place[r["fp"]]] == r["component_id"] for r in simhash.near_duplicate_classes(rows).collect())


@pytest.mark.parametrize(("long_run", "chunk", "batch"), [(16_384, 8_192, 10_000), (30, 24, 60)])
def test_long_runs_are_dealt_out(monkeypatch, long_run, chunk, batch):
    """Cells read in this process, with runs that count as long: members go out and meet again in pairs of chunks."""
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    fps = dense_fingerprints()
    masks = sum(simhash.cell_masks(), [])
    rows = sorted((hash((m, int(e) & m)), int(f)) for m in masks for e, f in zip(simhash._embedding(fps), fps.view(np.int64), strict=True))
    columns = [np.array(c, np.int64) for c in zip(*((c, f, f) for c, f in rows), strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + batch]) for c in columns], ["cell", "fp", "label"]) for k in range(0, len(rows), batch)]
    found = pa.Table.from_batches(list(simhash._read_cells(iter(batches))))
    pairs = found.filter(pc.is_null(found["at"])).select(["a", "b"]).to_pandas()
    members = found.filter(pc.is_valid(found["at"])).to_pandas()
    assert bool(len(members)) == (long_run < 16_384)
    for _, run in members.groupby("a"):
        assert sorted(run["at"]) == list(range(len(run)))
        of = (run["at"] // chunk).astype(int)
        for low in range(of.max() + 1):
            for high in range(low, of.max() + 1):
                pairs = pd.concat([pairs, simhash._pair_links(run[of.isin([low, high])].rename(columns={"b": "fp"})[["fp", "label"]].reset_index(drop=True))])
    roots = list(range(len(fps)))
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in pairs.drop_duplicates().itertuples(index=False):
        x, y = root(place[int(a)]), root(place[int(b)])
        roots[max(x, y)] = min(x, y)
    assert [root(k) for k in range(len(fps))] == brute_components(fps)


def test_manhattan_bound_and_cells():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(5) << rng.integers(0, 60, 500, dtype=np.uint64))
    bound = np.bitwise_count(simhash._embedding(a) ^ simhash._embedding(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()
    first, rest = simhash.cell_masks()
    assert len(first) == 6 and len(first) + len(rest) == 70
    ea, eb = simhash._embedding(a), simhash._embedding(b)
    near = np.bitwise_count(a ^ b) <= 4
    assert all(any((int(x) ^ int(y)) & m == 0 for m in first + rest) for x, y in zip(ea[near], eb[near], strict=True))


def test_components_of_a_chain_and_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same text of a nameless row"), (None, "same text of a nameless row"), (5, "other words entirely"), (None, "other words entirely"), (5, "other words entirely")], "doc_id long, text string")
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "same text of a nameless row"), (5, "other words entirely")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_one_row_of_each_component(spark, seed):
    """Shared ids, nameless rows, ties in everything but one column, repeated rows, clashing names: against brute force."""
    rng = np.random.default_rng(seed)
    texts = [None, "", "T t t t t", "T t t t t", *(" ".join(f"w{k}{j}" for j in range(12)) for k in range(6))]
    texts += [texts[4] + " ", texts[5].upper()]
    rows = [(int(i) if (i := rng.integers(-1, 6)) >= 0 else None, texts[rng.integers(0, len(texts))], [None, "a", "b"][rng.integers(0, 3)], [None, "a", "b"][rng.integers(0, 3)]) for _ in range(80)]
    rows += [(4, "T unique words", "x", None), (5, "T unique words", None, "x"), (5, "U other words", None, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, key string")
    roots = brute_components(np.array([brute_fingerprint(r[1]) for r in rows], np.uint64))
    kept = [tuple(r) for r in simhash.one_of_each(docs.repartition(3)).collect()]
    assert len(kept) == len(set(roots))
    by_root = defaultdict(list)
    for root, row in zip(roots, rows, strict=True):
        by_root[root].append(row)
    for own in by_root.values():
        mine = [r for r in kept if r in own]
        ids = [r[0] for r in own if r[0] is not None]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    assert sorted(map(str, kept)) == sorted(str(tuple(r)) for r in simhash.one_of_each(docs.repartition(5)).collect())


def test_rows_of_a_hot_value_look_it_up_in_many_tasks(spark):
    rows = spark.createDataFrame([(k, 7 if k % 3 else k) for k in range(3000)], "node long, low long")
    table = spark.createDataFrame([(7, 70), *((k, 10 * k) for k in range(0, 3000, 6) if k != 7)], "low long, root long")
    found = components.looked_up(rows, "low", "node", table, "left").collect()
    want = {(k, 7 if k % 3 else k): 70 if k % 3 else 10 * k if k % 6 == 0 else None for k in range(3000)}
    assert len(found) == 3000 and {(r["node"], r["low"]): r["root"] for r in found} == want
    assert components.looked_up(rows, "low", "node", table).count() == sum(v is not None for v in want.values())


def test_fingerprint_of_a_long_text_is_read_in_pieces(monkeypatch):
    words = [f"W{k * k % 977}" for k in range(4000)]
    text = " ".join(words[:2000]) + "\n\t " + "\x0b".join(words[2000:]) + " " + "x" * 3000
    want = brute_fingerprint(text)
    for piece in (1, 10, 997, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == want
        assert [simhash.fingerprint(t) for t in ("", " \n", "One", "a b c", "a b c d", "a b c d e")] == [brute_fingerprint(t) for t in ("", " \n", "One", "a b c", "a b c d", "a b c d e")]


def brute_targets(sizes, weights=(3, 1, 2)):
    own, left, found = [weights[k % 3] for k in range(len(sizes))], set(range(len(sizes))), {}
    rest = 1.5 * sum(sizes)
    while left:
        share = rest / sum(own[k] for k in left)
        over = {k for k in left if own[k] * share > 2 * sizes[k]}
        if not over:
            found |= {k: own[k] * share for k in left}
            break
        found |= {k: 2.0 * sizes[k] for k in over}
        rest -= sum(2.0 * sizes[k] for k in over)
        left -= over
    return [found[k] for k in range(len(sizes))]


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(0, 400)), ["b", "a", "c", None, "é", "Z"][int(rng.choice(6, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]))], "clash") for k in range(3000)]
    rows += [(3000, None, "a", "clash"), (3001, "", None, "clash"), (None, "x y z", "a", "clash"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mixed string")
    found = mixing.mix(docs).select("doc_id", "source", "mixed.*") if "mixed" not in docs.columns else mixing.mix(docs, columns=["doc_id", "source"]).select("doc_id", "source", "mixed.*")
    found = found.collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names]), strict=True))
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK
    key = lambda r: tuple(str(x) for x in r)
    again = mixing.mix(docs.repartition(7), columns=["doc_id", "source"]).select("doc_id", "source", "mixed.*").collect()
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0), columns=["doc_id"]).count() == 0


def test_mixing_through_bundles_of_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(rng.integers(1, 200)), "hot" if rng.random() < 0.6 else "other") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, columns=["doc_id", "source"], shard_rows=20, bundle=4).select("doc_id", "source", "mixed.*").collect()
    assert len(found) == len(rows) and len({r["doc_id"] for r in found}) == len(rows)
    for source in ("hot", "other"):
        own = [r for r in found if r["source"] == source]
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_quotas_of_shards_add_up_to_those_of_sources(spark):
    shards = [(0, k, 16 * (k % 7) + k % 3, 500) for k in range(50)] + [(1, k, 160, 3) for k in range(3)] + [(2, 0, 0, 0)]
    table = spark.createDataFrame(shards, "rank int, shard long, words long, seats long")
    one, several = ({(r["rank"], r["shard"]): r for r in mixing._shard_quotas(table, bundle).collect()} for bundle in (1000, 8))
    for found in (one, several):
        assert set(found) == {(rank, shard) for rank, shard, _, _ in shards}
        for rank, seats in ((0, min(500, 2 * sum(-(-w // 16) for r, _, w, _ in shards if r == 0))), (1, 3), (2, 0)):
            assert sum(r["quota"] for (k, _), r in found.items() if k == rank) == seats
        assert all(r["quota"] <= 2 * r["blocks"] for r in found.values())
    direct = mixing.sainte_lague([w for r, _, w, _ in shards if r == 0], 500, [2 * -(-w // 16) for r, _, w, _ in shards if r == 0])
    assert [one[0, k]["quota"] for k in range(50)] == direct


def highest_quotients(weights, seats, most):
    given = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0 and most[k]]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        given[k] += 1
        seats -= 1
        if given[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * given[k] + 1), k))
    return given


def test_sainte_lague_gives_the_highest_quotients():
    rng = np.random.default_rng(9)
    for t in range(400):
        n = int(rng.integers(1, 500 if t % 4 == 0 else 9))
        weights = rng.integers(0, 1000, n).tolist() if t % 3 else (rng.random(n) * rng.choice([0.1, 1, 100], n)).tolist()
        seats, most = int(rng.integers(0, 60 + 2 * n)), rng.integers(0, 50, n).tolist() if t % 2 else [10**9] * n
        assert mixing.sainte_lague(weights, seats, most) == highest_quotients(weights, seats, most)
    assert mixing.sainte_lague([40] + [0.6] * 100, 100, [10**9] * 101)[0] == 33
    assert mixing.sainte_lague([400] + [0.6] * 1000, 1000, [10**9] * 1001)[0] == 333


def test_null_and_repeated_ids_are_dealt_to_all_shards(spark):
    rows = [(None if k % 2 else 7, f"w{k} " * (k % 60 + 1), "one") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, columns=["doc_id", "text"], shard_rows=20)
    taken = sum(r["taken"] for r in found.select("mixed.taken").collect())
    assert taken == pytest.approx(1.5 * sum(k % 60 + 1 for k in range(4000)), rel=0.02)  # shards end in blocks that aren't full
    copies = [r["mixed"]["taken"] / r["mixed"]["size"] for r in found.where(F.length("text") > 150).collect()]
    assert min(copies) > 0.5 and max(copies) <= 2


def brute_maximal(rows):
    own = defaultdict(set)
    for conv, turn, role, text in rows:
        own[conv].add((turn, role, text))
    order = {c: sorted(t, key=lambda x: tuple((v is not None, v) for v in x)) for c, t in own.items()}
    kept = [c for c in order if not any(len(o) > len(order[c]) and o[: len(order[c])] == order[c] for o in order.values())]
    return {c for c in kept if not any(order[o] == order[c] and o < c for o in kept if o is not None and c is not None)}


def test_chat(spark):
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 700)):
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + ("!" if conv == 4 and k == 2 else "")) for k in range(n)]
    rows += [(6, None, None, None), (7, 0, "user", "a <|im_end|> b"), (7, 0, "user", "a <|im_end|> b"), (8, 0, "user", None), (8, 1, None, "x"), (9, 0, "user", None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = chat.render(table).collect()
    assert {r["conv_id"] for r in found} == brute_maximal(rows)
    whole = defaultdict(str)
    for r in sorted(found, key=lambda r: (r["conv_id"], r["part"])):
        assert r["n_turns"] <= chat.PART
        whole[r["conv_id"]] += r["text"]
    assert whole[5] == "".join(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\nturn {k}<|im_end|>\n" for k in range(700))
    assert whole[7] == "<|im_start|>user\na < |im_end|> b<|im_end|>\n" and whole[6] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(table.limit(0)).count() == 0


def test_chat_of_turns_with_the_same_number(spark):
    rows = []
    for k in range(12):  # the snapshot of one row is a prefix if that row comes first by role and text
        a, b = (1, "assistant", f"answer {k}"), (1, "user", f"question {k}")
        rows += [(10 * k + 1, *a), (10 * k + 2, *a), (10 * k + 2, *b), (10 * k + 3, *b)]
        rows += [(10 * k + 4, 0, None, f"x {k}"), (10 * k + 5, 0, "user", f"x {k}"), (10 * k + 5, 0, None, f"x {k}")]
        rows += [(10 * k + 6, 2, "user", None), (10 * k + 6, 2, "user", f"z {k}"), (10 * k + 7, 2, "user", f"z {k}")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in chat.render(table).collect()]
    assert {r[0] for r in found} == brute_maximal(rows)
    assert_sql(rows, found)


def test_chat_of_one_large_conversation(spark):
    """Null or shared turn numbers: parts of 64 turns all the same, dealt to many blocks."""
    rows = [(None, None, "user", f"nameless {k}") for k in range(500)] + [(1, 3, None, f"other {k}") for k in range(300)] + [(2, 3, None, f"other {k}") for k in range(100, 300)]
    rows += [(3, None, "user", f"text {k}") for k in range(500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = [tuple(r) for r in chat.render(table.repartition(5)).collect()]
    n_blocks = chat._blocks(table).select("block").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n_blocks > 1
    assert {r[0] for r in found} == brute_maximal(rows) == {None, 1, 2, 3} and all(r[2] <= chat.PART for r in found)
    assert_sql(rows, found)


def assert_sql(rows, found):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(queries.OP4_SQL).fetchall(), key=str) == sorted(found, key=str)


def test_rows_without_id_meet_in_many_tasks(spark):
    """A third of all rows has neither id nor text: what answers them comes from many tasks."""
    rows = [(None, None)] * 1_000 + [(k, f"text number {k} of its own with words {k * k} and {k % 7}") for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = simhash.near_duplicates(docs)
        sizes = [r["count"] for r in found.where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert sum(sizes) == 1_000 and len(sizes) > 8 and max(sizes) < 250

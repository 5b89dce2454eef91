"""Row-wise operators: token counts, licences, quality rules, decontamination."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, quality_rules, queries, token_counts
from tidemark.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ledger string, hits string"
LONG = "word " * 30_000
TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h i j k l m n", "a<|endoftext|>b  <|endoftext|>\n\n x", "Don't 's LL I'll  \t\n z", "ſ ª º ʰ é x​f 漢字 ۱۲ \x1c\x1d",
    "x " * 40, "Er Er Er Er Er der der der der der ist ist ist ist ist im im", "SHOUT " * 3 + "a quick line of calm words here\nline\nline\nother words follow", "| a | b | c | d | e | f | g | h", LONG,
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(k, t, None, None, None, "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "null id here", *rows[0][2:])], DOCS)


def test_token_counts_equal_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_counts.tokenizer(path)
    found = token_counts.token_counts(docs, path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(found) == docs.count()
    for r in found:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids), text
        assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_long_texts_are_counted_in_groups(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts._Counter(path, token_counts.prove_whole_tokens(path)), token_counts.tokenizer(path)
    monkeypatch.setattr(token_counts, "LONG", 10)
    for group in (1, 7, 1 << 16):
        monkeypatch.setattr(token_counts, "GROUP", group)
        for text in [t for t in TEXTS if t and t is not LONG] + ["  tail   \n\n of  spaces  <|endoftext|> é unheardofword" * 40]:
            assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_token_counts_of_all_documents(spark):
    ship(spark)
    library = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op1_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found} == {
        k: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for k, t in texts.items()
    }


def test_whole_tokens_are_proved(spark):
    whole = token_counts.prove_whole_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    library = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(whole) > 40_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::500])


def brute_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_quality_rules_equal_brute_force(spark, docs):
    for r in quality_rules.rule_ledger(docs).collect():
        want = brute_rules(r["text"])
        assert {k: r["ledger"][k] for k in want} == want, r["text"]
        base = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert (r["ledger"]["fail_bits"] & quality_rules.BASE != 0) == base
    assert quality_rules.rule_ledger(docs.limit(0)).count() == 0


def test_ablations_count_bits(spark, docs):
    ledger = quality_rules.rule_ledger(docs)
    bits = [r["ledger"]["fail_bits"] for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(b & bit != 0 for b in bits)
        assert r["n_only"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_quality_rules_plan_is_native(spark, docs):
    plan = quality_rules.rule_ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_licences(spark):
    mit = next(text for name, text in licenses.KNOWN if name == "MIT" and len(text) > 500)
    spelt = "/* Copyright (c) 2019 Somebody */\n" + mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").lower()
    rows = [(1, spelt), (2, "words\nLicenced under the APACHE  license; version 2.0\nmore"), (3, None), (4, ""), (5, "...\n---"), (6, "about a license"), (2, "x\nLicensed under CC BY-NC 4.0.")]
    found = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["scope"], r["line_no"], r["license_id"]) for r in found} == {(1, "text", 0, "MIT"), (1, "line", 2, "MIT"), (2, "line", 2, "Apache-2.0"), (2, "line", 2, "CC-BY-NC-4.0")}
    plan = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_of_whole_files(spark):
    gpl = next(text for name, text in licenses.KNOWN if name == "GPL-3.0-only" and len(text) > 30_000)
    standard = {name: text for name, text in licenses._standard() if len(text) > 300}
    owner = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    body = {name: text for name, text in licenses.LISTED if len(text) > 500}
    apache = standard["Apache-2.0"]
    rows = [
        (gpl, {"GPL-3.0-only", "GPL-3.0-or-later"}), (apache, {"Apache-2.0"}), (apache[: apache.index("APPENDIX")].strip(), {"Apache-2.0"}),
        (apache.replace("[yyyy] [name of copyright owner]", "2020 Some Body"), {"Apache-2.0"}),
        ("BSD 3-Clause License\n\n" + owner + body["BSD-3-Clause"], {"BSD-3-Clause"}), ("BSD 2-Clause License\n\n" + owner + body["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "), {"BSD-2-Clause"}),
        ("ISC License\n\n" + owner + body["ISC"], {"ISC"}), ("The MIT License (MIT)\n\n" + owner + body["MIT"].removeprefix("MIT License "), {"MIT"}),
        ("zlib License\n\n(C) 2020 Some Body\n\n" + standard["Zlib"].partition("\n")[2], {"Zlib"}),
        *((standard[n], {n}) for n in ("Unlicense", "BSL-1.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0")), (standard["LGPL-2.1-only"], {"LGPL-2.1-only", "LGPL-2.1-or-later"}),
        ("/*\n * " + next(t for n, t in licenses._standard() if n == "GPL-3.0-or-later" and t.lstrip().startswith("This program")).replace("\n", "\n * ") + "/", {"GPL-3.0-or-later"}),
    ]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "doc_id long, text string")
    found = [tuple(r) for r in licenses.licenses(docs).collect()]
    for k, (text, want) in enumerate(rows):
        assert {r[3] for r in found if r[:2] == (k, "text")} == want, text[:60]
    con = duckdb.connect()
    con.register("given", docs.toPandas())
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    assert sorted(con.execute(queries.OP2_SQL).fetchall()) == sorted(found)


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(text, items):
    words, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
    for item, whole in items:
        own = ITEM_WORD.findall(lower(whole))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("shard_windows", [250_000, 3])
def test_decontamination_equals_brute_force(spark, shard_windows):
    ship(spark)
    passage = " ".join(f"w{k}" for k in range(20))
    items = [(1, passage.upper()), (2, "short Item"), (10, "w5, w6; w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 tail"), (3, None), (4, "!?"), (None, "é ü words"), (2, "short item")]
    texts = [None, "", "...", passage, "x " * 100 + passage, "x " * 3000 + passage, "a SHORT-item, here é Ü É ü words", "É ü words", "short itemised", passage + " y " + passage, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, hits string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(docs, table, shard_windows=shard_windows).collect():
        h, want = r["hits"], brute_hits(r["text"], items)
        assert (h["n_words"], h["n_hit"], h["n_items"], h["items_sha256"]) == want, r["text"]
        assert h["contaminated"] == (want[1] > 0 and 20 * want[1] >= want[0])
        inside = [w for a, b in h["spans"] for w in ITEM_WORD.findall(lower(r["text"])[a:b])]
        assert len(inside) == want[1]
    clean = decontaminate.contamination(docs, table.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r["hits"]["contaminated"] for r in clean)
    assert decontaminate.contamination(docs.limit(0), table).count() == 0


def test_scanner_reads_long_texts_in_pieces(monkeypatch):
    """Random words over a small alphabet, so that windows overlap, touch and cross the pieces' edges; offsets as well."""
    rng = random.Random(4)
    names = ["a", "B", "é", "ü2", "x9", "Long-Word"]
    of = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(names) for _ in range(n))
    items = [(str(k), of(rng.choice((1, 3, 13, 14, 30)) if k else 14)) for k in range(12)]
    cut = lambda t: [w for w in ITEM_WORD.findall(lower(t))]
    rows = set()
    for item, text in items:
        own = cut(text)
        size = min(13, len(own))
        rows |= {(" ".join(own[i : i + size]), item) for i in range(len(own) - size + 1)}
    scanner = decontaminate.Scanner(decontaminate.Shard(sorted(rows)))
    texts = [of(rng.choice((0, 5, 60, 400))) + " zz " + rng.choice(items)[1] + "; " + of(20) for _ in range(40)]
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        for text in texts:
            found = decontaminate._verdict(text, *scanner.scan(text))
            want = brute_hits(text, items)
            assert (found["n_words"], found["n_hit"], found["n_items"], found["items_sha256"]) == want
            assert [w for a, b in found["spans"] for w in cut(text[a:b])] and sum(len(cut(text[a:b])) for a, b in found["spans"]) == want[1]
    nothing = decontaminate.Scanner(decontaminate.Shard([]))
    assert nothing.scan("a b c") == (3, [], set()) and nothing.scan(None) == (0, [], set())


def test_shards_hold_a_bounded_number_of_rows(spark):
    """A window that all items share is dealt to all shards; every document keeps all its items."""
    ship(spark)
    items = [(k, "one shared window") for k in range(40)]
    docs = spark.createDataFrame([(1, "here is one shared window"), (1, "here is one shared window"), (2, "nothing")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), shard_windows=9).collect()
    assert sorted((r["doc_id"], r["hits"]["n_items"]) for r in found) == [(1, 40), (1, 40), (2, 0)]


def _docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, digest string, line_no int").repartition(4)


def test_known_licences_are_found_however_they_are_wrapped(spark):
    import textwrap

    given = [(name, text) for name, text in licenses.KNOWN if 300 < len(text) < 2_500] + [(n, t) for n, t in licenses._standard() if len(t) > 10_000][:3]
    rows = []
    for at, (name, text) in enumerate(given):
        widths = range(40, 121) if at < 6 else (44, 61, 72, 97, 120)
        for width in widths if len(text) < 2_500 else (50, 76):
            wrapped = "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False)) for p in text.split("\n\n"))
            rows += [(name, wrapped), (name, "\n".join(f" * {line}" for line in wrapped.split("\n")))]
    found = licenses.licenses(_docs(spark, [t for _, t in rows])).where("scope = 'text'").groupBy("doc_id").agg(F.collect_set("license_id").alias("ids")).collect()
    by_row = {r["doc_id"]: r["ids"] for r in found}
    assert [k for k, (name, _) in enumerate(rows) if name not in by_row.get(k, ())] == []


def test_terms_behind_a_copyright_statement_on_its_line(spark):
    mit = next(text for name, text in licenses.LISTED if name == "MIT" and len(text) > 500)
    body = mit[mit.index("Permission") :].replace("\n", " ")
    heads = ("Copyright (c) 2020 Jane Doe. ", "Copyright 2019 Foo Inc. All rights reserved. ", "© 2001 A. Owner & Co. ", "(c) 2011-2013 The X Authors.  ")
    found = licenses.licenses(_docs(spark, [h + body for h in heads] + ["Copyright 2019 Foo Inc. and others\n" + body, "Copyright (c) 2020 Jane Doe permission " + body])).where("scope = 'text'").collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in found) == [(k, "MIT") for k in range(5)]


def test_licence_scan_of_empty_and_repeated_rows(spark):
    mit = next(text for name, text in licenses.LISTED if name == "MIT" and len(text) > 500)
    assert licenses.licenses(_docs(spark, ["x"]).limit(0)).count() == 0
    twice = licenses.licenses(spark.createDataFrame([(1, mit, "e"), (1, mit, "e"), (2, None, "e")], "doc_id long, text string, e string")).where("scope = 'text'").collect()
    assert [(r["doc_id"], r["line_no"], r["license_id"]) for r in twice] == [(1, 0, "MIT")] * 2

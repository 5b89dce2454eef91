"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, language_id, licenses, merkle, mixing, periods, quality_model, quality_rules, simhash, token_counts, topk
from .common import remainder, spread, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced_sql(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return text


def _words_sql(text: str, stated: bool = False) -> str:
    signed = f"replace({text}, '©', '(c)')"
    kept = signed if stated else f"regexp_replace({signed}, {_quoted(licenses.COPYRIGHT)}, '\\1', 'g')"
    return _replaced_sql(f"regexp_replace(lower({kept}), {_quoted(licenses.NOT_WORD_OR_BREAK)}, ' ', 'g')", licenses.WORDS)


def _canonical_sql(words: str) -> str:
    spelt = _replaced_sql(f"regexp_replace({words}, '[ \\n]+', ' ', 'g')", licenses.PHRASES)
    return f"trim(regexp_replace({spelt}, ' +', ' ', 'g'))"


OP2_SQL = f"""
WITH known AS (SELECT DISTINCT license_id, sha256(unnest([{_canonical_sql(_words_sql("entire"))}, {_canonical_sql(_words_sql("entire", True))}])) AS digest
               FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}) AS v(license_id, entire)),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_words_sql("text")} AS words, {_words_sql("text", True)} AS stated FROM documents WHERE text IS NOT NULL),
entire AS (SELECT row, doc_id, 'text' AS scope, 0::BIGINT AS line_no, words FROM d UNION ALL SELECT row, doc_id, 'text', 0, stated FROM d
           UNION ALL SELECT row, doc_id, 'line', unnest(range(1, len(string_split(words, chr(10))) + 1)), unnest(string_split(words, chr(10))) FROM d)
SELECT doc_id, scope, line_no::BIGINT AS line_no, license_id FROM (
  SELECT DISTINCT row, doc_id, scope, line_no, license_id FROM (SELECT *, sha256({_canonical_sql("words")}) AS digest FROM entire) JOIN known USING (digest))
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    net = language_id.fit(docs.where(~held_out).select("doc_id", "lang", "text"))
    found = language_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, count(*) OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(concat_ws(chr(1), coalesce(turn::VARCHAR, chr(2)), coalesce(role, chr(2)), coalesce(text, chr(2))), chr(3)) OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT min(conv_id) AS conv_id FROM p WHERE k = n AND prefix NOT IN (SELECT prefix FROM p WHERE k < n) GROUP BY prefix),
shown AS (SELECT conv_id, k, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t)
          WHERE conv_id IN (SELECT conv_id FROM kept) OR conv_id IS NULL AND EXISTS (SELECT 1 FROM kept WHERE conv_id IS NULL))
SELECT conv_id, ((k - 1) // 64)::BIGINT AS part, count(*)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM shown GROUP BY conv_id, part
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    bits = F.col("ledger.fail_bits")
    return ledger.select(
        "doc_id",
        *(f"ledger.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~quality_rules.passes(bits, "base")).alias("base_failed"),
        quality_rules.passes(bits, "v1").alias("kept"),
        bits.alias("fail_bits"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT row, i, array_to_string(words[i:i+4], ' ') AS gram
      FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1),
hit AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS s(k) GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(hit.n, 0) AS n_repeat_words,
             len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter,
             length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN hit USING (row)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_stutter > 30 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::INTEGER AS fail_bits
FROM b
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), columns=["doc_id"])
    return mixed.select("doc_id", "mixed.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", "hits.items_sha256", "hits.contaminated")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS gram
       FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT row, i, size, array_to_string(words[i:i + size - 1], ' ') AS gram
       FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes)),
found AS (SELECT row, i, size, item FROM dw JOIN bw USING (size, gram)),
hits AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM found)) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS names FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""

def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = html_extract.main_text(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    found = quality_model.score(docs, quality_model.fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
                        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CASE WHEN len(c.ints) > 0 THEN list_inner_product(q.ints, c.ints) ELSE 0 END::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each character is mixed in, then shifted out bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, s: {step}), 4294967295)"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")))


def _record_sql(fields: tuple[str, ...]) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in fields) + "))"


OP12_SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, source, {_record_sql(("doc_id", "source", "lang", "n_chars", "text"))} AS leaf,
         {_record_sql(("doc_id", "source", "lang", "n_chars", f"(CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)"))} AS start
  FROM documents),
i AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS no, count(*) OVER (PARTITION BY source) AS n FROM l),
low(tree, level, no, digest, n) AS (
  SELECT tree, 0, no, leaf, n FROM i UNION ALL
  SELECT tree, level + 1, no // 3, sha256(string_agg(digest, '' ORDER BY no)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, no // 3, n),
sub AS (SELECT tree, digest FROM low WHERE n = 1),
high(level, no, digest, n) AS (
  SELECT 0, tree, digest, (SELECT count(*) FROM sub) FROM sub UNION ALL
  SELECT level + 1, no // 3, sha256(string_agg(digest, '' ORDER BY no)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, no // 3, n),
climb(row, tree, level, no, folded, proof) AS (
  SELECT row, tree, 0, no, start, '' FROM i UNION ALL
  SELECT c.row, c.tree, c.level + 1, c.no // 3, sha256(string_agg(CASE WHEN u.no = c.no THEN c.folded ELSE u.digest END, '' ORDER BY u.no)),
         c.proof || coalesce(string_agg(u.digest, '' ORDER BY u.no) FILTER (u.no <> c.no), '')
  FROM climb c JOIN low u ON u.tree = c.tree AND u.level = c.level AND u.no // 3 = c.no // 3 WHERE u.n > 1 GROUP BY c.row, c.tree, c.level, c.no, c.folded, c.proof),
up AS (SELECT row, tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climb GROUP BY row, tree),
rise(row, level, no, folded, proof) AS (
  SELECT row, 0, tree, folded, proof FROM up UNION ALL
  SELECT c.row, c.level + 1, c.no // 3, sha256(string_agg(CASE WHEN u.no = c.no THEN c.folded ELSE u.digest END, '' ORDER BY u.no)),
         c.proof || coalesce(string_agg(u.digest, '' ORDER BY u.no) FILTER (u.no <> c.no), '')
  FROM rise c JOIN high u ON u.level = c.level AND u.no // 3 = c.no // 3 WHERE u.n > 1 GROUP BY c.row, c.level, c.no, c.folded, c.proof),
done AS (SELECT row, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM rise GROUP BY row)
SELECT doc_id, leaf, sub.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM i JOIN done USING (row) JOIN sub USING (tree), (SELECT digest FROM high WHERE n = 1) r
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periods.periodic_runs(docs, alter=True).select("doc_id", "runs.*")


# stretches of equal words q places apart; a longer period over the same words is a multiple of a smaller run's
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_crc32_sql("doc_id::VARCHAR")}, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a FROM d),
t AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM s),
w AS MATERIALIZED (SELECT row, n, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM t)),
eq AS (SELECT x.row, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM eq) GROUP BY row, q, island),
long AS MATERIALIZED (SELECT * FROM stretch WHERE length >= greatest(6, 4 * q)),
deep AS (SELECT * FROM stretch WHERE length >= 4 * q),
runs AS MATERIALIZED (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM deep s WHERE s.row = l.row AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)),
best AS (SELECT DISTINCT ON (row) * FROM runs ORDER BY row, length DESC, start, q),
listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, i FROM (SELECT row, unnest(range(start + q, start + length)) AS i FROM runs)),
left_ AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN left_ USING (row)
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_topk": op11_topk,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op2_license_scan": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_topk": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}

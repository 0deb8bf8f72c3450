"""The registered queries of the subpackage, each over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brasstide.llm import chat_repair, decontaminate, jaccard, merkle, mixing, page_text, ranker, repeats, rules, simhash, tokens, warc, whitening

_WS = "[\\x20\\x09-\\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    store = tokens.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read(*store)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ranker.fit(*ranker.training_rows(docs, _table(spark, sf_dir, "labels")))
    return ranker.scored(docs, model)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(_table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix_copy", "mix_copies", "mix_key",
                                   F.md5("text").alias("text_md5"))


def op8_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired(_table(spark, sf_dir, "conversations")).drop("at")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(_table(spark, sf_dir, "pages"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, where every third by its id's checksum claims a text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.proofs(merkle.manifest(docs, claims={"text": F.when(tampered, lowered).otherwise(F.col("text"))}))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_simhash, op3_quality_rules, op4_quality_ranker, op5_warc, op6_decontamination, op7_mixing, op8_chat_repair, op9_repeats, op10_page_text, op11_ngram_join, op12_whitening, op13_merkle)}

#: Unsigned CRC-32 of a doc_id's decimal digits: a byte is XORed in, then eight shifts (-1) follow.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda b: -1::BIGINT))))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END))"""


def _merkle_leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                                        for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _merkle_tree(name: str, levels: int) -> str:
    """CTEs from {name}0 (t, pos, node, total): nodes of each level above, and each level's runs of eight."""
    return ",\n".join(f"""{name}r{k} AS (SELECT t, pos // 8 AS run, list(node ORDER BY pos) AS ns, any_value(total) AS total FROM {name}{k} GROUP BY t, pos // 8),
{name}{k + 1} AS (SELECT t, run AS pos, CASE WHEN total > 1 THEN sha256(array_to_string(ns, '')) ELSE ns[1] END AS node, (total + 7) // 8 AS total FROM {name}r{k})"""
                      for k in range(levels))


def _merkle_fold(name: str, tree: str, levels: int) -> str:
    """CTEs from {name}0 (doc_id, leaf, t, pos, claim, proof): the siblings of each level joined on."""
    left, right = "array_to_string(ns[1:pos % 8], '')", "array_to_string(ns[pos % 8 + 2:], '')"
    return ",\n".join(f"""{name}{k + 1} AS (SELECT doc_id, leaf, tree, f.t, run AS pos,
  CASE WHEN r.total > 1 THEN sha256({left} || claim || {right}) ELSE claim END AS claim, proof || {left} || {right} AS proof
  FROM {name}{k} f JOIN {tree}r{k} r ON f.t = r.t AND f.pos // 8 = r.run)""" for k in range(levels))


#: Levels of the SQL form: trees of up to 8 ** 7 leaves, up to 64 of them.
_DEEP, _WIDE = 7, 2
_STOP = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)

SQL = {
    "op3_quality_rules": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         len(list_filter(w, lambda x: x = '|')) AS n_bars,
         len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
         length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters
  FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(0)) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
j AS (SELECT m.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(word_chars / n_words BETWEEN 1.5 AND 20.0, true)
       AND coalesce(n_symbols / n_words <= 0.1, true)
       AND coalesce(n_upper / nullif(n_letters, 0) <= 0.5, true)
       AND (n_words < 50 OR n_stop / n_words >= 0.02)
       AND coalesce(n_stutter / n_words <= 0.2, true)
       AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true)
       AND coalesce(n_bars / n_words <= 0.05, true)
       AND coalesce(n_bangs / n_words <= 0.3, true) AS kept
FROM f""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_WS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_WS}'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, s, w, least(5, len(w)) AS k FROM (SELECT item_id, w, least(5, len(w)) AS s FROM b WHERE len(w) > 0)),
bi AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g
       FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
n AS (SELECT item_id, k, count(*)::INT AS n_shingles FROM bi GROUP BY ALL),
di AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS g
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
             FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, count(*)::INT AS n_found FROM di JOIN bi USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM h JOIN n USING (item_id) WHERE 10 * n_found >= 8 * n_shingles""",
    "op7_mixing": """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
s AS (SELECT source, rate, greatest(ceil(rate / 16.0), 1)::INT AS draws FROM r),
p AS (SELECT source, draws, rate / draws AS mean, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM s
      UNION ALL
      SELECT source, draws, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM p WHERE k < 80),
cdf AS (SELECT source, draws, list(c ORDER BY k) AS cs FROM p GROUP BY ALL),
u AS (SELECT doc_id, source, text, cs,
             ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || draw), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM (SELECT doc_id, d.source, text, cs, unnest(range(draws)) AS draw
            FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)),
n AS (SELECT doc_id, source, text, sum(len(list_filter(cs, lambda x: x <= u)))::INT AS copies FROM u GROUP BY ALL)
SELECT doc_id, source, mix_copy, copies AS mix_copies,
       md5('order17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mix_copy) AS mix_key, md5(text) AS text_md5
FROM (SELECT *, unnest(range(copies))::INT AS mix_copy FROM n)""",
    "op11_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'),
    lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op13_merkle": f"""
WITH d AS (SELECT *, CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed
  FROM documents),
l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_merkle_leaf('text')} AS leaf, {_merkle_leaf('claimed')} AS claim FROM d),
f0 AS (SELECT doc_id, leaf, tree, tree AS t, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, claim, '' AS proof,
  count(*) OVER (PARTITION BY tree) AS total FROM l),
n0 AS (SELECT t, pos, leaf AS node, total FROM f0),
{_merkle_tree('n', _DEEP)},
{_merkle_fold('f', 'n', _DEEP)},
u0 AS (SELECT '' AS t, t AS tree, row_number() OVER (ORDER BY t) - 1 AS pos, node, count(*) OVER () AS total FROM n{_DEEP}),
{_merkle_tree('u', _WIDE)},
g0 AS (SELECT doc_id, leaf, f.tree, u.t, u.pos, claim, proof FROM f{_DEEP} f JOIN u0 u ON f.tree = u.tree),
{_merkle_fold('g', 'u', _WIDE)}
SELECT doc_id, leaf, u0.node AS subroot, u{_WIDE}.node AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = u{_WIDE}.node AS verified
FROM g{_WIDE} JOIN u0 USING (tree), u{_WIDE}""",
}

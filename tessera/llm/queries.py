"""The registered queries of the corpus operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_features

    d = audio_features(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    feature = F.concat_ws(":", F.col("n_frames"), F.size("spans"), F.sha2(F.col("tensors"), 256), F.sha2(F.to_json("spans"), 256))
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2(F.col("media"), 256).alias("media_sha256"), feature.alias("feature"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing_lm import learn, scores

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs.where(fold("doc_id", 7) != 2))
    d = scores(docs, model, keep=["doc_id"])
    return d.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_quality_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .convnet import fitted, quality_scores

    docs = documents(spark, sf_dir)
    net = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = quality_scores(docs.select("doc_id", "text"), net, keep=["doc_id"])
    return d.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weakrules import rule_report

    return rule_report(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import dictionaries, identify

    docs = documents(spark, sf_dir)
    content = dictionaries(docs.where(fold("doc_id", 5) != 0))
    d = identify(docs.select("doc_id", "text"), content, keep=["doc_id"])
    return d.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sourcemix import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, fitted, personal_data

    docs = documents(spark, sf_dir).select("doc_id", "text")
    d = personal_data(docs, fitted(docs), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["pattern"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return d.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_table, vocabulary_file

    return token_table(documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"), end_id=1, spaces="dropped")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binpack import pack_documents
    from .tokens import vocabulary_file

    return pack_documents(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"), 1024, 2, "leading")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repaired

    d = repaired(damaged(conversations(spark, sf_dir)), with_turns=False)
    return d.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, toxicity_scores

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = toxicity_scores(docs, model, keep=["doc_id"])
    return d.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import chained, prefix_trie, rebuilt

    d = prefix_trie(chained(rebuilt(conversations(spark, sf_dir))))
    return d.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sql_crc32(text: str) -> str:
    """CRC-32 of ASCII text in SQL: bit by bit over its characters."""
    bit = "lambda c, i: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1))"
    byte = f"lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), CAST(4294967295 AS BIGINT))"


def sql_least(*paths: str) -> str:
    """The least (cost, audit) of those that exist."""
    return f"list_min(list_filter([{', '.join(paths)}], lambda p: p IS NOT NULL))"


def sql_put(letter: str, cost: str, path: str) -> str:
    """An edit before a path."""
    return f"{{'c': {path}.c + {cost}, 'a': '{letter}' || {path}.a}}"


QUERIES = {f.__name__: f for f in (op1_audio_features, op2_context_mixing, op3_quality_convnet, op4_quality_rules, op5_superminhash, op6_language_id, op7_source_mix, op8_personal_data, op9_token_files, op10_best_fit_packing, op11_structure_repair, op12_toxicity, op13_prefix_trie)}
INK = r"[^\x20\x09-\x0D]"
_CHOICE = lambda first: sql_least(sql_put("D", "2", "q"), f"CASE WHEN free THEN {sql_put('R', '1 + more', 'x')} END", f"CASE WHEN free AND ({first}) THEN {sql_put('K', 'more', 'y')} END")
_ROWS = f"""rs AS (SELECT conv_id, turn, {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
  dm AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM rs WHERE how <> 0),
  od AS (SELECT *, row_number() OVER c AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, lag(role[1]) OVER c || role[1] AS pair FROM dm WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  fl AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{INK}') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM od)"""
ORACLE = {
    "op11_structure_repair": f"""
WITH RECURSIVE {_ROWS},
  al AS (SELECT conv_id, max(n) AS n FROM fl GROUP BY 1),
  dp AS (SELECT conv_id, n, {{'c': 0, 'a': ''}} AS e, {{'c': 10, 'a': 'II'}} AS s, {{'c': 5, 'a': 'I'}} AS u, {{'c': 0, 'a': ''}} AS a FROM al
    UNION ALL SELECT conv_id, n, {sql_least('e', sql_put('I', '5', 'u2'))}, {sql_least('s', sql_put('I', '5', 'u2'))}, u2, a2 FROM (
      SELECT *, {sql_least('u', sql_put('I', '5', 'a'))} AS u2, {sql_least('a', sql_put('I', '5', 'u'))} AS a2 FROM (
        SELECT d.conv_id, d.n - 1 AS n, {_CHOICE("role[1] IN ('s', 'u')").replace('q.', 'd.e.').replace('x.', 'd.u.').replace('y.', "(CASE role[1] WHEN 's' THEN d.s ELSE d.u END).")} AS e,
          {_CHOICE("role[1] = 'u'").replace('q.', 'd.s.').replace('x.', 'd.u.').replace('y.', 'd.u.')} AS s,
          {_CHOICE("role[1] = 'a'").replace('q.', 'd.u.').replace('x.', 'd.a.').replace('y.', 'd.a.')} AS u,
          {_CHOICE("role[1] = 'u'").replace('q.', 'd.a.').replace('x.', 'd.u.').replace('y.', 'd.u.')} AS a
        FROM dp d JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM fl) f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n))),
  bs AS (SELECT conv_id, e.c AS cost, e.a AS audit FROM dp WHERE n = 0),
  ed AS (SELECT conv_id, audit[i] AS letter, i, length(replace(audit[:i], 'I', '')) AS n FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM bs)),
  kp AS (SELECT e.conv_id, i, letter, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS k, max(CASE WHEN letter = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
    FROM ed e LEFT JOIN fl f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n AND letter <> 'I' WHERE letter <> 'D'),
  rp AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS h FROM kp GROUP BY 1),
  st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN bs ON bs.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_prefix_trie": f"""
WITH ow AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  hs AS (SELECT *, {sql_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM ow),
  rb AS (SELECT o.conv_id, list_concat(coalesce(b.s[:o.h], []), o.s[o.h + 1:]) AS s FROM hs o LEFT JOIN ow b ON b.conv_id = o.conv_id - o.conv_id % 5),
  px AS (SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM rb),
  nd AS (SELECT depth, md5(CAST(s[:depth] AS VARCHAR) || depth) AS node, CASE WHEN depth > 0 THEN md5(CAST(s[:depth - 1] AS VARCHAR) || (depth - 1)) END AS parent, CASE WHEN depth > 0 THEN octet_length(encode(s[depth].t)) ELSE 0 END AS b, conv_id, n, s FROM px),
  ag AS (SELECT node, parent, depth, b, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256, any_value(list_slice(s, 1, depth)) AS s FROM nd GROUP BY ALL),
  ch AS (SELECT parent, count(*) AS n_children FROM ag GROUP BY 1),
  an AS (SELECT a.node, a.n_convs, a.b, coalesce(c.n_children, 0) = 0 AS leaf, unnest(list_transform(range(a.depth + 1), lambda d: md5(CAST(a.s[:d] AS VARCHAR) || d))) AS above FROM ag a LEFT JOIN ch c ON c.parent = a.node),
  sb AS (SELECT above, count_if(leaf) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM an GROUP BY 1)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM ag a JOIN sb ON sb.above = a.node LEFT JOIN ch ON ch.parent = a.node LEFT JOIN ag p ON p.node = a.parent""",
    "op7_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN length(text) > 0 THEN CAST(0.5 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(10 AS DOUBLE) * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text)) ELSE CAST(0.5 AS DOUBLE) END AS quality,
    (CAST(CAST('0x' || substr(md5('mix' || doc_id), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
  w AS (SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 AS DOUBLE) * source_size AS most FROM s),
  l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT arg_min(level, (most / w, place)) FILTER (most / w > level) AS common FROM l),
  t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN most ELSE least(most, common * w) END AS target FROM l, c),
  e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t),
  r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r""",
}
__all__ = ["ORACLE", "QUERIES", "fold"]

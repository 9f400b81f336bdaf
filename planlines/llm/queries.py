"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlines.llm import anchors, chat, forest, hmm, host_rules, latent, merkle, mixing, nra, site_quality, token_counts, toxicity, warc
from planlines.llm.registry import QUERIES, SQL, query  # noqa: F401  (read by the driver entry)
from planlines.llm.texts import read

_ESCAPE = chat.ESCAPE.replace("'", "''")

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(role, '{_ESCAPE}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_ESCAPE}', '\1\\\2\3', 'g'))
           + {len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), prefixed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM numbered
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM prefixed GROUP BY conv_id
"""


@query("op1_chat_prefix_targets", CHAT_SQL)
def chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], table.schema)
    return chat.digests(chat.prefix_examples(table.unionByName(extra)))


@query("op2_site_quality")
def site_quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return site_quality.judge(docs, read(spark, sf_dir, "labels"))


@query("op3_latent_decontamination")
def latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


@query("op4_nonnegative_pu")
def nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op5_hidden_markov")
def hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


HOST_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), tri AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3
), dup AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p+1], w[p+2]) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p + o) AS n FROM dup, (VALUES (0), (1), (2)) AS x(o) GROUP BY r
), c AS (
  SELECT d.doc_id, d.source, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), g AS (
  SELECT *, base_failed OR n_symbols > {host_rules.SYMBOL_SHARE} * word_chars
            OR n_dup_lines > {host_rules.DUP_LINE_SHARE} * n_lines AS failed FROM f
), h AS (
  SELECT source, count(*) AS host_docs, count(*) FILTER (failed) AS host_failures FROM g GROUP BY source
), s AS (
  SELECT CAST(sum(host_docs) AS DOUBLE) AS n, CAST(sum(host_failures) AS DOUBLE) / sum(host_docs) AS m, count(*) AS k,
         sum(CAST(host_failures AS DOUBLE) * host_failures / host_docs) / sum(host_docs) AS q FROM h
), a AS (
  SELECT n, m, q - m * m - (k - 1) * m * (1 - m) / n AS v FROM s
), b AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE n END, 1), greatest(n, 1)) AS strength FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host_failures + m * strength) / (host_docs + strength) <= {host_rules.MAX_RATE} AS kept,
       host_docs, host_failures
FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source, b
"""


@query("op6_host_rules", HOST_SQL)
def host_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs",
        "host_failures",
    )


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM hit, range(0, 50) AS x(o)
), word AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d
), left_over AS (
  SELECT word.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed,
         sha256(coalesce(string_agg(w, ' ' ORDER BY word.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


@query("op7_fixed_block_anchors", REPEATS_SQL)
def fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.removals(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_minhash_forest")
def minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@query("op10_warc_dictionary")
def warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t
  FROM documents
), s AS (
  SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0
), i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t
  FROM benchmark
), iq AS (
  SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM i) GROUP BY q, term
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM iq) GROUP BY r, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), m AS (
  SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(t) AS BIGINT) * n) // l) AS m FROM d, s WHERE len(t) > 0
), x AS (
  SELECT q, m.r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM iq JOIN p USING (term) JOIN f USING (term) JOIN m ON m.r = p.r GROUP BY q, m.r
), o AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i USING (q) WHERE rank <= 20
"""


@query("op11_nra_search", SEARCH_SQL)
def nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


MERKLE_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS scope,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS cut
  FROM documents
), g AS (
  SELECT doc_id, scope, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS altered
  FROM f
), crc(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) AS x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), t AS (
  SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), l AS (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 2 = 0 AS even
  FROM g, t
), up(scope, level, i, h, n) AS (
  SELECT scope, 0, rank, leaf, count(*) OVER (PARTITION BY scope) FROM l
  UNION ALL
  SELECT scope, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY scope, level, i // 3
), sub AS (
  SELECT scope, level AS height, h AS subroot, row_number() OVER (ORDER BY scope) - 1 AS s FROM up WHERE n = 1
), top(level, i, h, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3
), nodes AS (
  SELECT scope, level, i, h FROM up WHERE n > 1 UNION ALL SELECT NULL, level, i, h FROM top WHERE n > 1
), fam AS (
  SELECT scope, level, i // 3 AS p, max(h) FILTER (i % 3 = 0) AS a, max(h) FILTER (i % 3 = 1) AS b, max(h) FILTER (i % 3 = 2) AS c
  FROM nodes GROUP BY scope, level, i // 3
), root AS (
  SELECT h AS root FROM top WHERE n = 1
), walk(doc_id, leaf, scope, home, level, i, cur, proof, height, s) AS (
  SELECT doc_id, leaf, scope, scope, 0, rank, CASE WHEN even THEN altered ELSE leaf END, '', height, s FROM l JOIN sub USING (scope)
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN w.scope IS NULL OR height = w.level THEN NULL ELSE w.scope END, home,
         CASE WHEN w.scope IS NOT NULL AND height = w.level THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.scope IS NOT NULL AND height = w.level THEN s ELSE w.i // 3 END,
         CASE WHEN w.scope IS NOT NULL AND height = w.level THEN cur
              WHEN w.i % 3 = 0 THEN sha256(cur || coalesce(b, '') || coalesce(c, ''))
              WHEN w.i % 3 = 1 THEN sha256(a || cur || coalesce(c, '')) ELSE sha256(a || b || cur) END,
         CASE WHEN w.scope IS NOT NULL AND height = w.level THEN proof
              ELSE proof || CASE WHEN w.i % 3 = 0 THEN coalesce(b, '') || coalesce(c, '')
                                 WHEN w.i % 3 = 1 THEN a || coalesce(c, '') ELSE a || b END END,
         height, s
  FROM walk w LEFT JOIN fam ON fam.scope IS NOT DISTINCT FROM w.scope AND fam.level = w.level AND fam.p = w.i // 3
  WHERE (w.scope IS NOT NULL AND height = w.level) OR fam.p IS NOT NULL
), ended AS (
  SELECT * FROM walk w WHERE scope IS NULL AND level = (SELECT max(level) FROM top)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM ended JOIN sub ON sub.scope = ended.home, root
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.verify(merkle.manifest(docs))


@query("op13_token_counts")
def token_counts_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.budget(token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.json")))

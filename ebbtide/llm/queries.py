"""Registered queries of the operators over the synthetic tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    chat,
    fingerprints,
    jaccard_join,
    lexical_search,
    licenses,
    mixing,
    packing,
    quality,
    quality_rules,
    slack_packing,
    token_counts,
    toxicity,
    word_runs,
)
from ebbtide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"),
    )


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.counted_documents(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


#: Exact for words of any length: shingles are joined with a separator that no word holds.
_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), keyed AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM sets
), nodes AS (
  SELECT k, min(doc_id) AS node, min(n) AS n FROM keyed WHERE n > 0 GROUP BY k
), tokens AS (
  SELECT node, nodes.n, unnest(s) AS t FROM nodes JOIN keyed ON keyed.doc_id = node
), common AS (
  SELECT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY ALL
), links AS (
  SELECT u, v FROM common WHERE 100 * c >= 90 * (nu + nv - c)
), both_ways AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT node AS u, node AS v FROM nodes
  UNION
  SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u
), named AS (
  SELECT u AS node, min(v) AS component_id FROM reach GROUP BY u
)
"""
_LINKS_SQL = """, sizes AS (
  SELECT k, count(*) AS held FROM keyed WHERE n > 0 GROUP BY k
), linked AS (
  SELECT x.node, sum(held) AS linked
  FROM (SELECT u AS node, v AS other FROM links UNION ALL SELECT v, u FROM links) x
  JOIN nodes ON nodes.node = x.other JOIN sizes USING (k) GROUP BY x.node
)
"""
ORACLES["op4_ngram_jaccard_join"] = _JACCARD_SQL + _LINKS_SQL + """
SELECT keyed.doc_id, keyed.n::BIGINT AS n_shingles, coalesce(named.component_id, keyed.doc_id) AS component_id,
  (coalesce(held - 1, 0) + coalesce(linked, 0))::BIGINT AS n_links
FROM keyed LEFT JOIN nodes ON keyed.k = nodes.k AND keyed.n > 0 LEFT JOIN sizes ON sizes.k = nodes.k
  LEFT JOIN linked USING (node) LEFT JOIN named USING (node)
"""


@query("op4_ngram_jaccard_links")
def op4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.counted_documents(table(spark, sf_dir, "documents"), width=3, num=9, den=10).select("doc_id", "n_links")


#: The pairs of op4_ngram_jaccard_join, counted for each document instead of followed.
ORACLES["op4_ngram_jaccard_links"] = _JACCARD_SQL.split(", both_ways AS")[0] + _LINKS_SQL + """
SELECT keyed.doc_id, (coalesce(held - 1, 0) + coalesce(linked, 0))::BIGINT AS n_links
FROM keyed LEFT JOIN nodes ON keyed.k = nodes.k AND keyed.n > 0 LEFT JOIN sizes ON sizes.k = nodes.k LEFT JOIN linked USING (node)
"""


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op2_tool_call_linking")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(*chat.calls_of_turns(table(spark, sf_dir, "conversations")))


ORACLES["op2_tool_call_linking"] = r"""
WITH RECURSIVE one AS (
  SELECT conv_id, turn, min(role) AS role, min_by(text, (role, text)) AS text FROM conversations GROUP BY conv_id, turn
), asked AS (
  SELECT conv_id, turn + 1 AS turn, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM one WHERE role = 'user'
), raw AS (
  SELECT a.conv_id, a.turn, length(a.text) AS size, len(w) AS n, array_to_string(w, ' ') AS query
  FROM one a LEFT JOIN asked USING (conv_id, turn) WHERE a.role = 'assistant'
), calls AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id,
    ['search', 'lookup', 'calculate', 'translate'][CASE WHEN size % 13 = 0 THEN 4 ELSE 1 + size % 3 END] AS name,
    CASE WHEN turn > 1 AND n % 2 = 0 THEN 'call-' || conv_id || '-' || (turn - 2) END AS after, n, query
  FROM raw
), chain AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c LEFT JOIN calls d ON c.conv_id = d.conv_id AND c.after = d.call_id
  WHERE d.call_id IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, chain.level + 1 FROM calls c JOIN chain ON c.conv_id = chain.conv_id AND c.after = chain.call_id
), results AS (
  SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text AS result FROM one WHERE role = 'user' AND turn > 0
), joined AS (
  SELECT c.*, chain.level, r.result, r.call_id IS NOT NULL AS linked,
    list_filter([
      CASE WHEN name = 'calculate' AND n IS NULL THEN 'missing limit' END,
      CASE WHEN name = 'calculate' AND n % 11 = 0 THEN 'type of limit' END,
      CASE WHEN name = 'calculate' AND query <> '' THEN 'unknown argument' END,
      CASE WHEN name = 'lookup' AND n % 11 = 0 THEN 'type of limit' END,
      CASE WHEN name = 'lookup' AND coalesce(query, '') = '' THEN 'missing query' END,
      CASE WHEN name = 'search' AND n IS NULL THEN 'missing limit' END,
      CASE WHEN name = 'search' AND n % 11 = 0 THEN 'type of limit' END,
      CASE WHEN name = 'search' AND coalesce(query, '') = '' THEN 'missing query' END,
      CASE WHEN name = 'translate' THEN 'unknown tool' END
    ], lambda x: x IS NOT NULL) AS errors
  FROM calls c JOIN chain USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)
)
SELECT conv_id, turn, call_id, name, level::BIGINT AS level, linked, len(errors) = 0 AS valid, array_to_string(errors, ',') AS errors,
  '{"arguments":{"after":' || to_json(coalesce(after, ''))
    || CASE WHEN n IS NULL THEN '' WHEN n % 11 = 0 THEN ',"limit":"' || n || '"' ELSE ',"limit":' || n END
    || CASE WHEN coalesce(query, '') = '' THEN '' ELSE ',"query":' || to_json(query) END
    || '},"call_id":' || to_json(call_id) || ',"errors":' || to_json(errors) || ',"level":' || level
    || ',"name":' || to_json(name) || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS message
FROM joined
"""


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents placed in a tree by source, language and hundreds of ids, at three depths; some are licence files."""
    top, block = F.col("source"), F.floor(F.col("doc_id") / 100).cast("string")
    id_ = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("LICENSE-"), id_)).otherwise(F.concat(id_, F.lit(".txt")))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", top, name)).when(
        F.col("doc_id") % 3 == 1, F.concat_ws("/", top, F.col("lang"), name)
    ).otherwise(F.concat_ws("/", top, F.col("lang"), block, name))
    return docs.select("doc_id", "text", path.alias("path"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(with_paths(table(spark, sf_dir, "documents")))


def _licence_sql() -> str:
    rows = [
        f"({x.k}, '{x.license}', {x.body}, '{term}', {j}, {len(x.terms)})"
        for x in licenses.numbered(licenses.TEMPLATES, licenses.BODIES) for j, term in enumerate(x.terms)
    ]
    return f"""
WITH places(k, license, body, term, j, len) AS (VALUES {", ".join(rows)}), notices AS (
  SELECT k, license, body, term, count(*) AS c FROM places GROUP BY ALL
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source,
    CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 = 2 THEN (doc_id // 100)::VARCHAR END,
    CASE WHEN doc_id % 7 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs
), split AS (
  SELECT doc_id, line, regexp_extract_all(lower(l), '[a-z0-9]+') AS t FROM lines
), words AS MATERIALIZED (
  SELECT doc_id, line, term, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS i
  FROM (SELECT doc_id, line, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM split)
), held AS MATERIALIZED (
  SELECT term, count(DISTINCT doc_id) AS h FROM words GROUP BY term
), size AS (
  SELECT count(*)::DOUBLE AS n FROM docs
), idf AS MATERIALIZED (
  SELECT term, coalesce(h, 0) AS h, ln((n + 1) / (coalesce(h, 0) + 1)) + 1 AS idf
  FROM held FULL JOIN (SELECT DISTINCT term FROM notices) USING (term), size
), weights AS MATERIALIZED (
  SELECT k, license, body, term, h, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY k)) AS w FROM notices JOIN idf USING (term)
), distinctive AS (
  SELECT k, term, h FROM weights
  QUALIFY sqrt(sum(w * w) OVER (PARTITION BY k ORDER BY w, term ROWS UNBOUNDED PRECEDING)) >= {licenses.LEAST}
), seeds AS (
  SELECT k, term FROM distinctive JOIN (SELECT DISTINCT k FROM notices WHERE NOT body) USING (k) WHERE h > 0
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY h, term) <= {licenses.SEEDS}
), starts AS (
  SELECT DISTINCT doc_id, k AS versus, i - j AS begin_at, len FROM words JOIN seeds USING (term) JOIN places USING (k, term)
), candidates AS (
  SELECT doc_id, {licenses.LINE} AS versus, line AS begin_at, line, term FROM words
  UNION ALL SELECT doc_id, {licenses.FILE}, 0, 0, term FROM words JOIN docs USING (doc_id) WHERE regexp_matches(path, '{licenses.FILE_NAME}')
  UNION ALL SELECT doc_id, versus, begin_at, min(line) OVER (PARTITION BY doc_id, versus, begin_at), term
  FROM starts JOIN words USING (doc_id) WHERE i >= begin_at AND i < begin_at + len
), vectors AS MATERIALIZED (
  SELECT doc_id, versus, begin_at, line, term, count(*) * any_value(idf) AS weight
  FROM candidates JOIN idf USING (term) GROUP BY doc_id, versus, begin_at, line, term
), norms AS (
  SELECT doc_id, versus, begin_at, sqrt(sum(weight * weight)) AS norm FROM vectors GROUP BY doc_id, versus, begin_at
), likeness AS (
  SELECT doc_id, line, license, round(sum(weight * w) / any_value(norm), 9) AS similarity
  FROM vectors JOIN weights USING (term) JOIN norms USING (doc_id, versus, begin_at)
  WHERE versus = k OR versus = {licenses.FILE} OR versus = {licenses.LINE} AND NOT body GROUP BY doc_id, versus, begin_at, line, k, license
), own AS (
  SELECT * FROM likeness WHERE similarity >= {licenses.LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, line, license) = 1
), placed AS (
  SELECT docs.doc_id, path, license, similarity, line,
    regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') AS dir
  FROM docs LEFT JOIN own USING (doc_id)
), stated AS (
  SELECT dir AS above, license AS stated FROM placed
  WHERE license IS NOT NULL AND regexp_matches(path, '{licenses.FILE_NAME}') GROUP BY dir, license
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, license) = 1
), resolved AS (
  SELECT dir, above, stated FROM (
    SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1),
      lambda d: array_to_string(string_split(dir, '/')[1:d], '/'))) AS above
    FROM (SELECT DISTINCT dir FROM placed)
  ) JOIN stated USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
)
SELECT doc_id, path, coalesce(license, stated) AS license,
  CASE WHEN license IS NOT NULL THEN 'header' WHEN stated IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN license IS NULL THEN above END AS from_dir, round(similarity, 6) AS similarity, line::BIGINT AS line
FROM placed LEFT JOIN resolved USING (dir)
"""


ORACLES["op8_license_scan"] = _licence_sql()


@query("op11_lexical_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)
  ) GROUP BY ALL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), frequencies AS (
  SELECT doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM frequencies, totals GROUP BY term
), parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS part
  FROM frequencies JOIN weights USING (term) JOIN sizes USING (doc_id), totals
), scores AS (
  SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM parts JOIN asked USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op12_word_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = word_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return word_runs.digests(word_runs.periodic_runs(docs))


@query("op13_slack_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.digests(slack_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")))

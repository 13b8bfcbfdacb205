"""The queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.llm import chat_format, decontaminate, lexical_search, license_scan, line_dedup, merkle, near_dedup, packing, quality_rules, site_quality, token_counts, token_files, toxicity
from quantsieve.llm._shared import with_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = with_code(f)
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\\### Assistant: </turn> ok"
    planted = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digest(chat_format.format_conversations(turns))


ORACLES["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n') AS e_role, replace(replace(text, '\', '\b'), '<', '\l') AS e_text FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn>') + length(e_role) + 1 + length(e_text) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS goes FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read(spark, sf_dir, "documents"), keep=["doc_id"], **quality_rules.PRODUCTION)
    return judged.drop("char_distance", "word_distance")


_MARKS = quality_rules.PUNCTUATION.replace("'", "''")
ORACLES["op9_quality_rules"] = (
    r"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), split AS (
  SELECT *, list_transform(ws, lambda w: trim(lower(w), '"""
    + _MARKS
    + r"""')) AS folded FROM texts
), holding AS (
  SELECT lang, w, count(*) AS n FROM (
    SELECT lang, trim(lower(form), '"""
    + _MARKS
    + r"""') AS w FROM (SELECT lang, unnest(list_distinct(ws)) AS form FROM texts WHERE len(ws) >= 50)
  ) WHERE w <> '' GROUP BY ALL
), commonest AS (
  SELECT lang, list(w ORDER BY r) AS common FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM holding) WHERE r <= 16 GROUP BY lang
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), stripped AS (
  SELECT s.*, coalesce(c.common, []) AS common, array_to_string(ws, '') AS c0 FROM split s LEFT JOIN commonest c ON s.lang IS NOT DISTINCT FROM c.lang
), stripped1 AS (SELECT *, regexp_replace(c0, '\p{Ll}+', '', 'g') AS c1 FROM stripped
), stripped2 AS (SELECT *, regexp_replace(c1, '\p{Lu}+', '', 'g') AS c2 FROM stripped1
), stripped3 AS (SELECT *, regexp_replace(c2, '[0-9]+', '', 'g') AS c3 FROM stripped2
), stripped4 AS (SELECT *, regexp_replace(c3, '[.,;:!?''"()\-]+', '', 'g') AS c4 FROM stripped3
), stripped5 AS (SELECT *, regexp_replace(c4, '[#*$%&|<>]+', '', 'g') AS c5 FROM stripped4
), counted AS (
  SELECT *, [length(c0) - length(c1), length(c1) - length(c2), length(c2) - length(c3), length(c3) - length(c4), length(c4) - length(c5), length(c5)] AS chars,
         list_transform(common, lambda c: len(list_filter(folded, lambda x: x = c))) AS found
  FROM stripped5
), based AS (
  SELECT c.doc_id, c.lang, len(ws) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(ws) AS failed FROM counted c LEFT JOIN again USING (doc_id)
), measured AS (
  SELECT lang FROM based WHERE NOT failed GROUP BY lang HAVING count(*) >= 20
), histograms AS (
  SELECT doc_id, lang, 'chars' AS kind, unnest(range(1, 7)) AS pos, unnest(chars) AS v FROM counted
  UNION ALL
  SELECT doc_id, lang, 'words', unnest(range(0, len(found) + 1)), unnest(list_prepend((len(ws) - coalesce(list_sum(found), 0))::BIGINT, found)) FROM counted
), refs AS (
  SELECT h.lang, kind, pos, sum(v) AS v FROM histograms h JOIN based b USING (doc_id) JOIN measured m ON h.lang IS NOT DISTINCT FROM m.lang WHERE NOT b.failed GROUP BY ALL
), shares AS (
  SELECT h.doc_id, h.lang, h.kind, h.v / nullif(sum(h.v) OVER (PARTITION BY h.doc_id, h.kind), 0) AS p, r.v / nullif(sum(r.v) OVER (PARTITION BY h.doc_id, h.kind), 0) AS q
  FROM histograms h JOIN refs r ON h.lang IS NOT DISTINCT FROM r.lang AND h.kind = r.kind AND h.pos = r.pos
), distances AS (
  SELECT doc_id, lang, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS far FROM shares GROUP BY ALL
), empty AS (
  SELECT lang, (pos = 0)::INT::DOUBLE AS p, v / nullif(sum(v) OVER (PARTITION BY lang), 0) AS q FROM refs WHERE kind = 'words'
), word_limits AS (
  SELECT lang, 0.75 * sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS most FROM empty GROUP BY lang
), far_off AS (
  SELECT doc_id, coalesce(bool_or(far > CASE kind WHEN 'chars' THEN 0.3 ELSE most END), FALSE) AS far
  FROM distances d LEFT JOIN word_limits w ON d.lang IS NOT DISTINCT FROM w.lang GROUP BY doc_id
), rules AS (
  SELECT doc_id, failed, len(ws) AS n_words, length(c0) AS word_chars, length(c4) - length(c5) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM counted JOIN based USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT coalesce(far, FALSE) AS kept
FROM rules LEFT JOIN far_off USING (doc_id)
"""
)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_groups(read(spark, sf_dir, "documents"), k=3, percent=85)


ORACLES["op4_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM split
), sizes AS (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x
)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.site_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short_items=True)


@query
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digest(token_files.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("spans")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), threshold=0.3)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), k=20)


def _terms(name: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({name}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES["op11_lexical_search"] = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_terms("documents")} AS ts FROM documents
), asked AS (SELECT item_id, unnest({_terms("benchmark")}) AS term FROM benchmark
), tfs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) GROUP BY ALL
), whole AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM docs
), weighted AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole
), factors AS (SELECT doc_id, 100 - 25 + (25 * len(ts)::BIGINT * n) // l AS m FROM docs, whole
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM asked JOIN tfs USING (term) JOIN weighted USING (term) JOIN factors USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered={"text": found})


def _hashed(text: str) -> str:
    fields = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": text}
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in fields.values()) + ")"


_LATE = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
# DuckDB has no crc32: the reflected polynomial, bit by bit, over the digits of the id.
_CRC = "(SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))"


def _nodes(leaves: str, key: str) -> str:
    return f"""SELECT {key}, 0 AS level, pos, digest, n FROM {leaves}
  UNION ALL
  SELECT {key}, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {leaves}_nodes WHERE n > 1 GROUP BY {key}, level, pos // 3, n"""


def _fold(start: str, nodes: str, key: str) -> str:
    return f"""SELECT doc_id, {key}, 0 AS level, pos, n, digest, proof FROM {start}
  UNION ALL
  SELECT f.doc_id, f.{key}, f.level + 1, f.pos // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN m.pos = f.pos THEN f.digest ELSE m.digest END, '' ORDER BY m.pos)), f.proof || coalesce(string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos <> f.pos), '')
  FROM {start}_fold f JOIN {nodes} m ON m.{key} IS NOT DISTINCT FROM f.{key} AND m.level = f.level AND m.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.{key}, f.level, f.pos, f.n, f.proof"""


ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (SELECT *, xor({_CRC}, 4294967295::BIGINT) AS crc FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, source, {_hashed("text")} AS digest, {_hashed(_LATE)} AS late, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs
), leaves_nodes AS ({_nodes("leaves", "source")}
), tops AS MATERIALIZED (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, 0 AS one FROM leaves_nodes WHERE n = 1
), tops_nodes AS ({_nodes("tops", "one")}
), start AS (SELECT doc_id, source, pos, n, late AS digest, '' AS proof FROM leaves
), start_fold AS ({_fold("start", "leaves_nodes", "source")}
), mid AS (SELECT f.doc_id, t.one, t.pos, t.n, f.digest, f.proof FROM start_fold f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source WHERE f.n = 1
), mid_fold AS ({_fold("mid", "tops_nodes", "one")}
)
SELECT doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(m.proof) AS proof_sha256, m.digest AS folded_root, m.digest = r.digest AS verified
FROM leaves l JOIN mid_fold m USING (doc_id) JOIN tops t ON l.source IS NOT DISTINCT FROM t.source, tops_nodes r WHERE m.n = 1 AND r.n = 1
"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)

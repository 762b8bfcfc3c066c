"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import bpe_codec, chat_format, collocations, exact_dedup, language_id, lexical_search, license_scan, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, source_mixing

#: Vocabulary files, the same path on every machine.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_ok"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op2_license_scan``, which SQL can state."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearRule(words=2))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_deleted", sha.alias("text_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), PIECES)
    told = language_id.predict(docs, model, PIECES)
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), n_shards=24)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.predict(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "license_base_phrases": license_base_phrases,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_source_mixing": op6_source_mixing,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": """
WITH base AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, host, text,
         list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM base),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM again) GROUP BY doc_id),
counts AS (
  SELECT words.doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
fails AS (
  SELECT host, unnest([{'rule': 'short', 'bad': (n_words < 10)::INT},
                       {'rule': 'repeats', 'bad': (100 * n_repeat_words > 20 * n_words)::INT},
                       {'rule': 'symbols', 'bad': (100 * n_symbols > 25 * word_chars)::INT},
                       {'rule': 'lines', 'bad': (2 * n_dup_lines > n_lines)::INT}], recursive := true) FROM counts),
rates AS (SELECT host, rule, count(*) AS n, sum(bad) AS bad FROM fails GROUP BY host, rule),
prior AS (SELECT rule, avg(bad / n) AS m, var_samp(bad / n) AS v FROM rates GROUP BY rule),
strength AS (SELECT rule, m, greatest(2.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS k FROM prior),
verdict AS (SELECT host, max((bad + m * k) / (n + k)) <= 0.5 AS host_ok FROM rates JOIN strength USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host_ok) AS kept, counts.host, host_ok
FROM counts JOIN verdict ON counts.host IS NOT DISTINCT FROM verdict.host
""",
    "license_base_phrases": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
      FROM documents),
h AS (SELECT doc_id, len(w) AS n,
             list_filter(range(1, len(w)), lambda k: w[k] = 'mit' AND w[k + 1] = 'license') AS mit,
             list_filter(range(1, len(w)), lambda k: w[k] = 'apache' AND w[k + 1] = 'license') AS apache,
             list_filter(range(1, len(w) - 1), lambda k: w[k] = 'general' AND w[k + 1] = 'public' AND w[k + 2] = 'license') AS gpl FROM w)
SELECT doc_id, n AS n_words, len(mit) + len(apache) + len(gpl) AS n_base, list_min(mit || apache || gpl) - 1 AS first_word, list_max(mit || apache || gpl) - 1 AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM h
""",
    "op3_near_dedup": """
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT edges.b, reach.c FROM reach JOIN edges ON reach.a = edges.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) m ON s.doc_id = m.a
""",
    "op4_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op5_chat_formatting": """
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id, turn, min(text) AS prompt, count(*) AS n FROM m WHERE role = 'user' GROUP BY conv_id, turn),
i AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM i),
r AS (SELECT conv_id, turn, min(text) AS said, count(*) AS n FROM m WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn,
       coalesce(c.turn, r.turn - 1)::VARCHAR AS call_id,
       CASE WHEN c.turn IS NOT NULL AND r.turn IS NOT NULL THEN 'linked' WHEN c.turn IS NOT NULL THEN 'unanswered' ELSE 'orphan' END AS status,
       coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results,
       level::INT AS level, CASE WHEN c.turn IS NOT NULL THEN length(prompt) BETWEEN 1 AND 300 END AS args_valid,
       CASE WHEN c.turn IS NOT NULL AND r.turn IS NOT NULL
              THEN to_json({'arguments': {'prompt': prompt}, 'call_id': c.turn::VARCHAR, 'name': 'reply', 'result': said})::VARCHAR
            WHEN c.turn IS NOT NULL THEN to_json({'arguments': {'prompt': prompt}, 'call_id': c.turn::VARCHAR, 'name': 'reply'})::VARCHAR
            ELSE to_json({'call_id': (r.turn - 1)::VARCHAR, 'result': said})::VARCHAR END AS message
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1
UNION ALL
SELECT conv_id, turn, '', 'context', count(*), 0, NULL, NULL, to_json({'content': text, 'role': role})::VARCHAR
FROM m WHERE role NOT IN ('user', 'assistant') GROUP BY conv_id, turn, role, text
""",
    "op8_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, i, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
n AS (SELECT doc_id, i, line, len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM t WHERE line <> ''),
g AS (SELECT doc_id, list(line ORDER BY p) AS lines, list(words ORDER BY p) AS words, list(i ORDER BY p) AS places FROM n GROUP BY doc_id),
s AS (SELECT doc_id, lines, words, places, a, unnest(range(a, least(a + 9, len(lines)) + 1)) AS b FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS a FROM g)),
r AS (SELECT doc_id, a, b, places, lines[a:b] AS run FROM s WHERE list_sum(words[a:b]) >= 10 AND (b > a OR words[a] >= 25)),
f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(a) OVER w AS fa FROM r WINDOW w AS (PARTITION BY run ORDER BY doc_id, a)),
dead AS (SELECT DISTINCT doc_id, unnest(places[CASE WHEN doc_id = fd THEN greatest(a, fa + b - a + 1) ELSE a END:b]) AS i FROM f WHERE doc_id <> fd OR a <> fa),
done AS (SELECT l.doc_id, count(*) AS n_lines, count(dead.i) AS n_deleted,
                coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE dead.i IS NULL), '') AS body
         FROM l LEFT JOIN dead ON l.doc_id = dead.doc_id AND l.i = dead.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_deleted, sha256(body) AS text_sha256 FROM done
""",
    "op11_collocations": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM s)),
f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
inside AS (SELECT lang, g[i:i + k - 1] AS g, max(f) AS f FROM
             (SELECT lang, g, f, i, unnest(range(2, least(len(g) - 1, len(g) - i + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, len(g))) AS i FROM f WHERE len(g) > 2))
           GROUP BY 1, 2),
c AS (SELECT f.lang, f.g, f.f AS a, unnest(range(1, len(f.g))) AS k FROM f LEFT JOIN inside ON f.lang = inside.lang AND f.g = inside.g
      WHERE len(f.g) >= 2 AND (inside.f IS NULL OR inside.f < f.f)),
x AS (SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:] JOIN totals ON totals.lang = c.lang),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
""",
    "op12_lexical_search": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, unnest(list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*) AS often FROM q GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, big_n),
x AS (SELECT item_id, doc_id, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
""",
}

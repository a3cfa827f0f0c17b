"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bpe import encode_texts
from veilframe.llm.chat import formatted_conversations
from veilframe.llm.chat_repair import digests, merged, repair
from veilframe.llm.common import read
from veilframe.llm.fingerprints import document_fingerprints
from veilframe.llm.hard_negatives import hard_negatives
from veilframe.llm.langid import languages
from veilframe.llm.license_scan import license_report
from veilframe.llm.line_dedup import dedup_lines
from veilframe.llm.mixing import mixture
from veilframe.llm.simhash_dedup import hex_word, simhash_components
from veilframe.llm.topk import top_k
from veilframe.llm.toxicity import toxicity
from veilframe.llm.url_lists import dated_pages, evaluate, listed_hosts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked within two bits."""
    found = simhash_components(read(spark, sf_dir, "documents"), "doc_id", "text", 3)
    return found.select(
        F.col("id").alias("doc_id"), hex_word("fp").alias("fingerprint"), "component_id"
    )


@query
def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_texts(read(spark, sf_dir, "documents"), "doc_id", "text", path, digest=True)
    return coded.withColumnRenamed("id", "doc_id")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text."""
    return languages(read(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products for every hundredth vector."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


SQL["op2_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""


@query
def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order of the corpus: every use of every document."""
    return mixture(read(spark, sf_dir, "documents"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    held = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(i AS BIGINT) turn, IF(i = 0, 'user', 'assistant') role,"
        " '</s>[INST] ok [/INST]' text FROM range(2) t(i)"
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return formatted_conversations(rows.unionByName(held))


SQL["op9_chat_formatting"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]))', '\1\\\2\3', 'g') AS escaped FROM c
), g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum(length(url_encode(role)) + length(escaped) + 9) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
    sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query
def op8_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries active on its fetch day."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(dated_pages(pages), listed_hosts(pages)).withColumnRenamed("id", "page_id")
    return found.withColumns({c: F.col(c).cast("string") for c in ("day", "since", "until")})


SQL["op8_url_list_asof"] = r"""
WITH p AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day,
        regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
        regexp_extract(url, '^(?i:https?)://[^/?#]*/([^/?#]+)', 1) AS segment
    FROM pages
), l AS (
    SELECT *, string_split(host, '.') AS labels FROM p
), k AS (
    SELECT page_id, url, day, n AS specificity, array_to_string(labels[len(labels) - n + 1:], '.') AS key
    FROM l, unnest(range(least(2, len(labels)), len(labels) + 1)) AS t(n) WHERE host <> ''
    UNION ALL
    SELECT page_id, url, day, len(labels) + 1, host || '/' || segment FROM l WHERE host <> '' AND segment <> ''
), e0 AS (
    SELECT DISTINCT key, md5(key) AS m FROM k
), e1 AS (
    SELECT key, CAST('0x' || substr(m, 1 + 4 * i, 4) AS INTEGER) AS d FROM e0, unnest([1, 2, 3]) AS t(i)
    WHERE CAST('0x' || substr(m, 1, 4) AS INTEGER) % 3 = 0
), e AS (
    SELECT key, DATE '2023-12-01' + d % 400 AS since, max(CASE d % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'allow' ELSE 'block' END) AS action
    FROM e1 GROUP BY ALL
), v AS (
    SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e
), j AS (
    SELECT k.page_id, k.specificity, k.key, v.action, v.since, v.until
    FROM k ASOF JOIN v ON k.key = v.key AND k.day >= v.since
), b AS (
    SELECT * FROM j WHERE action <> 'remove'
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY specificity DESC) = 1
)
SELECT p.page_id, p.url, CAST(p.day AS VARCHAR) AS day, coalesce(b.action, 'none') AS verdict, b.key AS rule,
    CAST(b.since AS VARCHAR) AS since, CAST(b.until AS VARCHAR) AS until
FROM p LEFT JOIN b USING (page_id)
"""


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return document_fingerprints(read(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    return license_report(read(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh has a wrong label."""
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


SQL["op13_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
    positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the long lines that an earlier document has."""
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_line_dedup"] = """
WITH d AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
    SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > keeper) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, drawn from the crc32 of ``conv_id:turn``: rows that are lost
    (0), emptied (1), without ends of sentences (2), repeated (3) or of the user (4)."""
    names = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    fault = F.crc32(F.concat_ws(":", *names)) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    ).filter("times > 0").withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


@query
def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest edits, and what they give."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows))
    audit = done.blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "letters"))).alias("held"))
    told = digests(done.rows.filter("edit <> 'D'"), "conv", ["start", "place"], F.concat("role", F.lit(":"), "text"), "\n",
                   "repaired_sha256")
    whole = merged([
        rows.select(F.col("conv_id").alias("conv")).distinct(), done.report, told,
        audit.select("conv", F.array_join("held.letters", "").alias("audit"))])
    counts = (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return whole.select(
        F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL["op11_chat_repair"] = r"""
WITH RECURSIVE tab AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) r(i)
), c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS k
    FROM conversations, tab
), d AS (
    SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM c, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i FROM d
), f AS (
    SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM o
), ins(p, q, letters, cost) AS (
    VALUES (0, 0, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 1, '', 0), (1, 2, 'I', 2), (1, 3, 'II', 4),
        (2, 2, '', 0), (2, 3, 'I', 2), (3, 3, '', 0), (3, 2, 'I', 2)
), step(q, i, edit, z, cost) AS (
    SELECT q, i, 'D', q, 3 FROM range(4) a(q), (VALUES ('s'), ('u'), ('a'), ('x')) b(i)
    UNION ALL SELECT q, i, 'R', CASE q WHEN 2 THEN 3 ELSE 2 END, 2 FROM range(4) a(q), (VALUES ('s'), ('u'), ('a'), ('x')) b(i)
    UNION ALL VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0)
), w AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM o)
    UNION ALL
    SELECT w.conv_id, w.n + 1, CAST(step.z AS INTEGER), min({
        'cost': w.best.cost + ins.cost + step.cost + CASE WHEN f.fault = 'truncated' AND step.edit <> 'D' THEN 1 ELSE 0 END,
        'audit': w.best.audit || ins.letters || step.edit})
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1 JOIN ins ON ins.p = w.state
        JOIN step ON step.q = ins.q AND step.i = CASE WHEN f.i IN ('s', 'u', 'a') THEN f.i ELSE 'x' END
            AND (step.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    GROUP BY w.conv_id, w.n + 1, step.z
), e AS (
    SELECT w.conv_id, min({'cost': w.best.cost + ins.cost, 'audit': w.best.audit || ins.letters}) AS best
    FROM w JOIN (SELECT conv_id, max(n) AS n FROM o GROUP BY conv_id) m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.n = m.n
        JOIN ins ON ins.p = w.state AND ins.q IN (0, 3)
    GROUP BY w.conv_id
), x AS (
    SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS place
    FROM e WHERE best.audit <> ''
), y AS (
    SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS n FROM x
), z AS (
    SELECT y.conv_id, place, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
        CASE WHEN edit IN ('D', 'K') THEN role END AS kept, edit = 'K' AND f.i = 's' AS system
    FROM y LEFT JOIN f ON y.conv_id IS NOT DISTINCT FROM f.conv_id AND y.n = f.n
), r AS (
    SELECT *, coalesce(kept, CASE WHEN count(*) FILTER (WHERE edit <> 'D' AND NOT coalesce(system, false))
        OVER (PARTITION BY conv_id ORDER BY place) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS role FROM z
), told AS (
    SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY place) FILTER (WHERE edit <> 'D') AS text FROM r GROUP BY conv_id
), faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(told.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN faults ON i.conv_id IS NOT DISTINCT FROM faults.conv_id LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN told ON i.conv_id IS NOT DISTINCT FROM told.conv_id
"""

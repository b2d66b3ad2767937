"""The operators of this subpackage on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.chat import branched_pairs, format_preferences
from tidemark.llm.common import ORACLES, QUERIES, query, table
from tidemark.llm.embeddings import link_embeddings
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.filter_audit import audit_filters
from tidemark.llm.importance import resample
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_classes
from tidemark.llm.packing import pack
from tidemark.llm.quality import bucket_of, score_quality, train_quality
from tidemark.llm.sharding import shard
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import score_toxicity, train_toxicity
from tidemark.llm.window_dedup import remove_repeated_windows

__all__ = ["QUERIES", "ORACLES"]


@query(
    "op10_exact_dedup",
    r"""
    WITH flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM flat WINDOW g AS (PARTITION BY t)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query(
    "op3_mixing",
    r"""
    WITH rows_ AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               (('0x' || substr(md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
                   / 4503599627370496.0 AS u
        FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM rows_ GROUP BY source),
    placed AS (SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM sizes),
    weighed AS (SELECT *, CAST([5, 2, 1][p % 3 + 1] AS BIGINT) AS w FROM placed),
    ratios AS (SELECT *, CAST(3 * s AS DOUBLE) / w AS ratio FROM weighed),
    leveled AS (
        SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER r, 0) AS DOUBLE)
                  / CAST(sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS DOUBLE) AS lvl
        FROM ratios WINDOW r AS (ORDER BY ratio, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    free AS (SELECT lvl AS c FROM leveled WHERE ratio > lvl ORDER BY ratio, p LIMIT 1),
    targets AS (
        SELECT source, s, coalesce(least(CAST(3 * s AS DOUBLE), w * (SELECT c FROM free)), CAST(3 * s AS DOUBLE)) AS target
        FROM leveled),
    plans AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS k FROM targets),
    rests AS (SELECT *, greatest(0.0, target - k * s) AS rest FROM plans),
    drawn AS (
        SELECT r.doc_id, r.source, r.size, t.s, t.target, t.k, t.rest,
               CASE WHEN t.rest > 0 AND r.size < t.rest AND t.s > 0 THEN
                   r.u / (1 - r.u) / ((t.rest / t.s * (1 - r.size / t.rest)) / (1 - (t.rest / t.s * (1 - r.size / t.rest)))) END AS q
        FROM rows_ r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source),
    summed AS (
        SELECT *, CASE WHEN q IS NOT NULL THEN
            sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS FIRST) END AS words FROM drawn),
    sampled AS (SELECT *, coalesce(words <= rest, false) AS taken_once FROM summed),
    gaps AS (SELECT source, max(rest) - coalesce(max(words) FILTER (taken_once), 0) AS gap FROM sampled GROUP BY source),
    closing AS (
        SELECT source, doc_id, size FROM (
            SELECT s.source, s.doc_id, s.size,
                   row_number() OVER (PARTITION BY s.source ORDER BY abs(s.size - g.gap), s.doc_id, s.size) AS n
            FROM sampled s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source
            WHERE NOT taken_once AND abs(s.size - g.gap) < g.gap) WHERE n = 1)
    SELECT a.doc_id, a.size, a.s AS source_size, a.target,
           CAST(a.size * (a.k + CASE WHEN a.taken_once OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM sampled a LEFT JOIN closing c
      ON a.source IS NOT DISTINCT FROM c.source AND a.doc_id = c.doc_id AND a.size = c.size
    """,
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced by bytes; tokens and rows are balanced along with them."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bucket = table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 4)
    detector = train_toxicity(docs, table(spark, sf_dir, "labels"), bucket != 2)
    return score_toxicity(docs, detector).select(
        "doc_id", (bucket == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bucket = table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 5)
    model = train_quality(docs, table(spark, sf_dir, "labels"), bucket != 0)
    return score_quality(docs, model).select(
        "doc_id", (bucket == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


@query(
    "op2_chat_preferences",
    r"""
    WITH counts AS (SELECT conv_id, count(*) AS n, lead(conv_id) OVER (ORDER BY conv_id) AS other
                    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    pairs AS (SELECT conv_id AS pair_id, other, conv_id % n AS branch FROM counts WHERE other IS NOT NULL),
    turns AS (
        SELECT p.pair_id, 'chosen' AS side, c.turn, c.role, c.text FROM conversations c JOIN pairs p ON c.conv_id = p.pair_id
        UNION ALL
        SELECT p.pair_id, 'rejected', c.turn, c.role, c.text FROM conversations c JOIN pairs p ON c.conv_id = p.pair_id WHERE c.turn < p.branch
        UNION ALL
        SELECT p.pair_id, 'rejected', c.turn, c.role, c.text FROM conversations c JOIN pairs p ON c.conv_id = p.other WHERE c.turn >= p.branch),
    placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos FROM turns),
    compared AS (
        SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
               a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
        FROM (SELECT * FROM placed WHERE side = 'chosen') a
        FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.pos = b.pos),
    shared AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS shared_turns FROM compared GROUP BY pair_id),
    written AS (
        SELECT p.pair_id, side, pos, shared_turns, pos <= shared_turns AS in_prompt, coalesce(role = 'assistant', false) AS trained,
               '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
        FROM placed p JOIN shared USING (pair_id)),
    spans AS (
        SELECT *, coalesce(sum(CASE WHEN NOT in_prompt THEN length(head || body) END)
                    OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
        FROM written)
    SELECT pair_id, max(shared_turns) AS shared_turns,
           coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (in_prompt AND side = 'chosen'), '') AS prompt,
           coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT in_prompt AND side = 'chosen'), '') AS chosen,
           coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY pos)
                    FILTER (NOT in_prompt AND trained AND side = 'chosen'), '') AS chosen_spans,
           coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT in_prompt AND side = 'rejected'), '') AS rejected,
           coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY pos)
                    FILTER (NOT in_prompt AND trained AND side = 'rejected'), '') AS rejected_spans
    FROM spans GROUP BY pair_id
    """,
)
def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against a branch of it that ends like the next one."""
    return format_preferences(branched_pairs(table(spark, sf_dir, "conversations")))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op12_filter_audit",
    r"""
    WITH marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
    failed AS (
        SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
               len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
               regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e
        FROM worded d LEFT JOIN marks m ON d.doc_id = m.doc_id),
    masks AS (
        SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS many,
               CAST(count(*) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic
        FROM failed GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE length(replace(replace(replace(replace(replace(a.l || b.l || c.l || d.l || e.l, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0
          AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    placed AS (
        SELECT part, o, step, m.fails, many, n, good, toxic, fails[substr(o, step, 1)] AS hit,
               len(list_filter(range(1, step), lambda k: fails[substr(o, k, 1)])) > 0 AS earlier
        FROM masks m, orders, (SELECT unnest(range(1, 6)) AS step)),
    counted AS (
        SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (hit AND earlier), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (hit AND many = 1), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS toxic_lost
        FROM placed GROUP BY part, o, step)
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM counted
    """,
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_importance",
    r"""
    WITH worded AS (
        SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT 'b', 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    runs AS (
        SELECT side, doc_id, unnest(w) AS f FROM worded
        UNION ALL
        SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
    counted AS (SELECT side, doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
    tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, x)) AS t),
    crcs AS (
        SELECT f, xor(4294967295, list_reduce(
            list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295)) % 10000 AS bucket
        FROM (SELECT DISTINCT f FROM counted), tab),
    placed AS (SELECT side, doc_id, bucket, sum(n) AS n FROM counted JOIN crcs USING (f) GROUP BY ALL),
    sums AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
    totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM sums),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g
        FROM sums, totals),
    weighed AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
        FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    scored AS (
        SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM worded w LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
    drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n_words >= 20)
    SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * fit // 100 THEN rank END AS rank
    FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id
    """,
)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op11_window_dedup",
    r"""
    WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM worded WHERE len(w) >= 35),
    windows AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS win FROM starts),
    repeated AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded),
    marked AS (
        SELECT a.doc_id, a.p, a.word,
               coalesce(max(CAST(r.p IS NOT NULL AS INT)) OVER (PARTITION BY a.doc_id ORDER BY a.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
        FROM words a LEFT JOIN repeated r ON a.doc_id = r.doc_id AND a.p = r.p),
    cut AS (
        SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
        FROM marked GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
    """,
)
def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

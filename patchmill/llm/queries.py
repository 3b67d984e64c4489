"""Queries of the training-data operators, named by problem, and their SQL where SQL can tell the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.llm import cutoffs, leaks, mixing, sketches, spans, splits, subsets, vectors
from patchmill.runtime import table, written


SHARES = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]


def _clean(name: str):
    return F.lower(F.trim(name)).alias(name)


COLLECTION = ["category", "layer"]


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prototype_embeddings").select(_clean("category"), "layer", "proto_id", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.similar(_bank(spark, sf_dir), COLLECTION, vec_id="proto_id", vector="embedding", dim=32, k=5, max_distance=0.8)
    return vectors.similar_pairs(near, COLLECTION).select(F.col("id_a").alias("proto_id_a"), F.col("id_b").alias("proto_id_b"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 100, however far, against all vectors."""
    return vectors.similar(_bank(spark, sf_dir), COLLECTION, vec_id="proto_id", vector="embedding", dim=32, k=5, queries=lambda i: i % 100 == 0)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs that a search of all cells finds for the same queries, whether p1_neighbours gives nine tenths."""
    exact = vectors.similar(_bank(spark, sf_dir), COLLECTION, vec_id="proto_id", vector="embedding", dim=32, k=5, recall=1, queries=lambda i: i % 100 == 0)
    got = p1_neighbours(spark, sf_dir).select(*COLLECTION, "id", "neighbour", F.lit(1).alias("hit"))
    return exact.join(got, [*COLLECTION, "id", "neighbour"], "left").agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = splits.Overlaps(table(spark, sf_dir, "industrial_samples")).pairs()
    return pairs.select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "industrial_samples")
    return splits.counts(splits.Overlaps(samples).records(), samples)


def p3_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of each category and day, as it would be stored to be combined later."""
    pixels = table(spark, sf_dir, "pixel_scores").select(_clean("category"), "scored_on", "intensity", "score")
    measures = {"intensity": "intensity", "score": F.when(F.col("score") != -1, F.col("score"))}
    return sketches.sketch(pixels, ["category", "scored_on"], measures)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each category, from the sketches of its days."""
    return sketches.percentiles(sketches.merge(p3_daily_sketches(spark, sf_dir), ["category"], few=True), ["category"], SHARES)


def p3_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each answer of p3_percentiles whether its true rank lies within the bound it carries."""
    answers = written(p3_percentiles(spark, sf_dir))
    pixels = table(spark, sf_dir, "pixel_scores").select(_clean("category"), F.explode(F.array(F.struct(F.lit("intensity").alias("measure"), F.col("intensity").alias("v")), F.struct(F.lit("score").alias("measure"), F.when(F.col("score") != -1, F.col("score")).alias("v")))).alias("m"))
    pixels = pixels.select("category", "m.*").where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    each = pixels.join(answers, ["category", "measure"])  # a dozen answers for each value, counted before any shuffle
    ranks = each.groupBy("category", "measure", "percentile", "n", "rank_error").agg(F.count("*").alias("true_n"), F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    share = F.col("percentile") / 100
    off = F.greatest(F.col("below") / F.col("true_n") - share, share - F.col("upto") / F.col("true_n"), F.lit(0.0))
    return ranks.select("category", "measure", F.round("percentile").cast("int").alias("percentile"), "n", (off <= F.col("rank_error") + 1 / F.col("n")).alias("within"))


def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    latest = cutoffs.latest_scores(table(spark, sf_dir, "image_scores"), table(spark, sf_dir, "industrial_samples"))
    targets = table(spark, sf_dir, "keep_targets").select(_clean("category"), "label", "keep_permille")
    scores = written(latest)
    return scores, cutoffs.cutoffs(scores, targets, ["category", "label"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, cuts = _cutoffs(spark, sf_dir)
    return cutoffs.kept(scores, cuts, ["category", "label"]).select("category", "label", "sample_id")


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoffs(spark, sf_dir)[1]


def p5_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "subset_targets").select(_clean("category"), "layer", "subset_permille")
    return subsets.varied_subset(_bank(spark, sf_dir), targets, COLLECTION, vec_id="proto_id", vector="embedding", dim=32)


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_subset(spark, sf_dir).groupBy("category", "layer").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leaks.without_leaks(docs.select("doc_id", "source", "n_chars"), leaks.leaked_pairs(docs, table(spark, sf_dir, "eval_items")))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    tokenizer = mixing.RankTokenizer(os.environ.get("PATCHMILL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken"))
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: a row for each slot of the output, with the pieces of records in its block."""
    return _mix(spark, sf_dir).mixed()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source whether its share lies within 6 deviations of the draw and no record is used too often."""
    mix = _mix(spark, sf_dir)
    near = F.abs(F.col("share") - F.col("target_share")) <= 6 * F.sqrt(F.col("target_share") * (1 - F.col("target_share")) / max(1, mix.slots)) + 2 / max(1, mix.slots)
    return mix.shares().select("source", "target_share", "max_repeats", near.alias("near"), (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).record_uses()


def p7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).token_blocks()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Spans(table(spark, sf_dir, "documents")).pairs()


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Spans(table(spark, sf_dir, "documents")).shares()


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record that shares a span its class of equal texts and the number of records it shares one with."""
    return spans.Spans(table(spark, sf_dir, "documents")).links()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Spans(table(spark, sf_dir, "documents")).spans()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_counts, p3_percentiles, p3_daily_sketches, p3_rank_errors, p4_found, p4_cutoffs, p5_subset, p5_sizes, p6_found, p6_longest, p6_clean, p7_mix, p7_shares, p7_limits, p7_records, p7_tokens, p8_found, p8_shared, p8_links, p8_spans)}


_P4_SQL = """
    WITH last AS (
        SELECT sample_id, arg_max(score, {'s': scored_at, 'a': arrived_at, 'v': score}) AS score FROM image_scores
        WHERE sample_id IS NOT NULL AND isfinite(score) GROUP BY 1
    ), known AS (
        SELECT sample_id, s.c AS category, s.l AS label FROM (
            SELECT sample_id, max({'a': arrived_at, 'c': lower(trim(category)), 'l': label}) AS s FROM industrial_samples GROUP BY 1)
    ), scored AS (
        SELECT k.category, k.label, sample_id, score, keep_permille FROM last JOIN known k USING (sample_id)
        JOIN keep_targets t ON t.category = k.category AND t.label = k.label
    ), ranked AS (
        SELECT *, count(*) OVER (PARTITION BY category, label) AS n,
               count(*) OVER (PARTITION BY category, label ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS above FROM scored
    ), cut AS (
        SELECT category, label, keep_permille, n, max(score) FILTER (above * 1000 >= keep_permille * n) AS cutoff FROM ranked GROUP BY ALL
    )
"""


_P1_SQL = """
    WITH v AS (SELECT DISTINCT ON (c, layer, proto_id) lower(trim(category)) AS c, layer, proto_id, embedding::DOUBLE[] AS e FROM prototype_embeddings
               WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT a.proto_id AS a, b.proto_id AS b, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.c = b.c AND a.layer = b.layer AND a.proto_id <> b.proto_id),
    r AS (SELECT a, b FROM d WHERE d <= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
    SELECT DISTINCT least(a, b) AS proto_id_a, greatest(a, b) AS proto_id_b FROM r
"""
_P1_RECALL = """
    g AS (SELECT c, layer, count(DISTINCT proto_id) AS n FROM v GROUP BY ALL)
    SELECT sum(least(5, n - 1))::BIGINT AS n, true AS enough FROM (SELECT DISTINCT c, layer, proto_id FROM v WHERE proto_id % 100 = 0) JOIN g USING (c, layer)
"""
_P6_LONGEST = """
    dg AS (SELECT doc_id, p AS q, array_to_string(w[p : p + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) t(p)),
    m AS (SELECT doc_id, item_id, n, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM dg JOIN ig USING (g)),
    r AS (SELECT doc_id, item_id, n, min(p) - 1 AS start, count(*) + 7 AS length FROM m GROUP BY doc_id, item_id, n, p - q, run)
    SELECT item_id, n::BIGINT AS item_words, start::BIGINT AS start, length::BIGINT AS length, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length DESC, start, doc_id) = 1
"""
_P6_SQL = r"""
    WITH i AS (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '\\+.?', ' ', 'gs'), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
    ig AS (SELECT item_id, len(w) AS n, p, array_to_string(w[p : p + 7], ' ') AS g FROM i, unnest(range(1, len(w) - 6)) t(p)),
    d AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '\\+.?', ' ', 'gs'), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) t(p)),
    hit AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(p, p + 8)) AS word FROM dg JOIN ig USING (g))
    SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, n HAVING 2 * count(*) >= n
"""
_P8_SQL = """
    WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 400),
    h AS (SELECT DISTINCT doc_id, md5_number(substring(text, i::INT, 400)) AS h FROM t, unnest(range(1, n - 398)) u(i)),
    s AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1), m AS (SELECT h, list(doc_id ORDER BY doc_id) AS ids FROM h SEMI JOIN s USING (h) GROUP BY 1),
    g AS (SELECT DISTINCT ids FROM m)
    SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM g, unnest(ids) x(a), unnest(ids) y(b) WHERE a < b
"""
_P3_SQL = """
    WITH m AS (SELECT lower(trim(category)) AS category, 'intensity' AS measure, intensity AS v FROM pixel_scores UNION ALL SELECT lower(trim(category)), 'score', score FROM pixel_scores WHERE score <> -1),
    n AS (SELECT category, measure, count(*) AS n FROM m WHERE isfinite(v) GROUP BY ALL)
    SELECT category, measure, p::INT AS percentile, n, true AS within FROM n, (VALUES (1), (25), (50), (75), (95), (99)) t(p)
"""
_P5_SQL = """
    WITH v AS (SELECT DISTINCT lower(trim(category)) AS category, layer, embedding FROM prototype_embeddings
               WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT v.category, v.layer, greatest(1, (count(*) * any_value(subset_permille) + 500) // 1000)::BIGINT AS n FROM v JOIN subset_targets t ON t.category = v.category AND t.layer = v.layer GROUP BY ALL)
    SELECT category, layer, n, n AS ids FROM s
"""
_P8_SHARED = """
    WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 400),
    h AS (SELECT doc_id, n, i, md5_number(substring(text, i::INT, 400)) AS h FROM t, unnest(range(1, n - 398)) u(i)),
    s AS (SELECT h FROM h GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
    c AS (SELECT doc_id, n, least(400, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 400)) AS k FROM h SEMI JOIN s USING (h))
    SELECT doc_id, n::BIGINT AS n_chars, sum(k)::BIGINT AS shared_chars, sum(k) / n AS shared_share FROM c GROUP BY doc_id, n
"""
_P8_LINKS = """),
    e AS (SELECT doc_id_a AS d, doc_id_b AS o FROM p UNION ALL SELECT doc_id_b, doc_id_a FROM p),
    c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM t)
    SELECT doc_id, rep, count(*) AS links FROM e JOIN c ON c.doc_id = e.d GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_SQL,
        "p6_found": _P6_SQL,
        "p8_found": _P8_SQL,
        "p1_recall": _P1_SQL.split("d AS (")[0] + _P1_RECALL,
        "p6_longest": _P6_SQL.split("dg AS (")[0] + _P6_LONGEST,
        "p3_rank_errors": _P3_SQL,
        "p5_sizes": _P5_SQL,
        "p6_clean": _P6_SQL.rsplit("SELECT doc_id, item_id", 1)[0] + ", f AS (SELECT doc_id FROM hit GROUP BY doc_id, item_id, n HAVING 2 * count(*) >= n) SELECT doc_id, source, n_chars FROM documents ANTI JOIN f USING (doc_id)",
        "p7_limits": "SELECT source, target_share, max_repeats::BIGINT AS max_repeats, true AS near, true AS within FROM mix_targets",
        "p8_shared": _P8_SHARED,
        "p8_links": _P8_SQL.replace("SELECT DISTINCT a AS", ", p AS (SELECT DISTINCT a AS") + _P8_LINKS,
        "p4_found": _P4_SQL + "SELECT s.category, s.label, s.sample_id FROM scored s JOIN cut USING (category, label) WHERE score >= cutoff",
        "p4_cutoffs": _P4_SQL + "SELECT category, label, c.keep_permille, c.n, c.cutoff, count(*) AS n_kept FROM scored s JOIN cut c USING (category, label) WHERE score >= cutoff GROUP BY ALL",
    }

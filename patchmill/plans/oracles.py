"""SQL for the queries of registry.py."""

_BANK = """
    b AS (SELECT vec_id AS bid, embedding::DOUBLE[] AS e FROM embeddings WHERE label <= 6 AND vec_id % 8 <> 0),
    q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE NOT (label <= 6 AND vec_id % 8 <> 0)),
    d AS (SELECT vec_id, label, bid, list_distance(q.e, b.e) AS dist FROM q, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, bid) AS rank FROM d),
    top AS (SELECT vec_id, label, dist / 64 AS score FROM r WHERE rank = 1),
    lim AS (SELECT count(*) AS n, quantile_cont(score, 0.95) * 1.421 AS threshold FROM top WHERE label <= 6)
"""
_SAMPLES = """
    s AS (SELECT sample_id, min(lower(trim(category))) AS category, min(lower(trim(split))) AS split, min(image_path) AS image_path,
                 min(label) AS label, min(mask_path) AS mask_path FROM industrial_samples GROUP BY 1),
    names AS (SELECT sample_id, category, split, regexp_replace(regexp_extract(replace(trim(image_path), '\\', '/'), '([^/]*)$', 1), '\\.[^.]*$', '') AS name FROM s),
    parsed AS (SELECT *, CASE WHEN regexp_matches(name, '^(\\d{3})_(regular|mixed)$') THEN regexp_extract(name, '^(\\d{3})_', 1)::INT END AS "index",
                      CASE WHEN regexp_matches(name, '^(\\d{3})_(regular|mixed)$') THEN regexp_extract(name, '_(regular|mixed)$', 1) END AS suffix FROM names)
"""
_EVENTS = """
    e AS (SELECT 'c' || (user_id % 8) AS category, user_id AS image, value AS score, event_type = 'error' AS truth FROM events WHERE value IS NOT NULL AND NOT isnan(value))
"""
_AUC = """
    g AS (SELECT category, score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM e GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n
          FROM g WINDOW w AS (PARTITION BY category ORDER BY score DESC)),
    x AS (SELECT category, p, n, (fp - neg) / n AS x0, fp / n AS x1, (tp - pos) / p AS y0, tp / p AS y1 FROM c),
    auc AS (SELECT category, p::BIGINT AS positives, n::BIGINT AS negatives, 0.5 * (1 + (sum(CASE WHEN x1 <= 0.05 THEN (x1 - x0) * (y0 + y1) / 2
                   WHEN x0 < 0.05 THEN (0.05 - x0) * (2 * y0 + (y1 - y0) * (0.05 - x0) / (x1 - x0)) / 2 ELSE 0 END) - 0.00125) / 0.04875) AS auc FROM x GROUP BY ALL),
    f AS (SELECT category, count(*) FILTER (score > 20 AND truth) AS tp, count(*) FILTER (score > 20 AND NOT truth) AS fp, count(*) FILTER (NOT score > 20 AND truth) AS fn FROM e GROUP BY 1),
    fixed AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)
"""
_BEST = """
    g AS (SELECT category, image, score, count(*) FILTER (truth) AS pos, count(*) AS k FROM e GROUP BY ALL),
    c AS (SELECT category, image, sum(pos) OVER w AS tp, sum(k) OVER w AS flagged, sum(pos) OVER (PARTITION BY category, image) AS p
          FROM g WINDOW w AS (PARTITION BY category, image ORDER BY score DESC)),
    best AS (SELECT category, image, max(2 * tp::DOUBLE / (flagged + p)) AS best_f1 FROM c GROUP BY ALL)
"""
_MAPS = """
    m AS (SELECT vec_id, (p // 8)::INT AS y, (p % 8)::INT AS x, embedding[p + 1]::DOUBLE AS score FROM embeddings, range(64) t(p)),
    front AS (SELECT vec_id, y, x FROM m WHERE score > 0.08),
    cross5 AS (SELECT * FROM (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) t(dy, dx)),
    line3 AS (SELECT * FROM (VALUES (0, -1), (0, 0), (0, 1)) t(dy, dx))
"""
#: x as the nearest half-precision number, ties to even.
_HALF = "CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / pow(2, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({x}))), -14) - 10) END"
_IMAGES = """
    im AS (SELECT DISTINCT ON (sample_id) sample_id, height, width, hex(image) AS hx FROM industrial_samples
           WHERE image IS NOT NULL AND sample_id IS NOT NULL AND height > 0 AND width > 0 AND octet_length(image) = 3 * height * width),
    px AS (SELECT sample_id, height, width, (p // 3) // width AS y, (p // 3) % width AS x, p % 3 AS channel, ('0x' || substring(hx, (2 * p + 1)::INT, 2))::INT AS v FROM im, unnest(range(3 * height * width)) t(p))
"""
#: Taps of one axis, (n, o, i, w): {sizes} gives n and out, {kind} the weights.
_LINEAR = """
    la AS (SELECT n, m, o, greatest(0, (o + 0.5::DOUBLE) * n / m - 0.5) AS c FROM (VALUES {sizes}) s(n, m), unnest(range(m)) t(o)),
    lb AS (SELECT n, m, o, least(floor(c)::INT, n - 1) AS low, c - least(floor(c)::INT, n - 1) AS f FROM la),
    lw AS (SELECT n, m, o, low AS i, 1 - f AS w FROM lb UNION ALL SELECT n, m, o, least(low + 1, n - 1), f FROM lb)
"""
_CUBIC = """
    sz AS (SELECT DISTINCT height AS n FROM im UNION SELECT DISTINCT width FROM im),
    ca AS (SELECT n, o, n / floor(n * 0.625) AS sc, (o + 0.5::DOUBLE) * n / floor(n * 0.625) AS c FROM sz, unnest(range(floor(n * 0.625)::INT)) t(o)),
    cb AS (SELECT n, o, sc, c, unnest(range(greatest(0, trunc(c - 2 * sc + 0.5)::INT), least(n, trunc(c + 2 * sc + 0.5)::INT))) AS i FROM ca),
    cc AS (SELECT n, o, i, abs((i + 0.5::DOUBLE - c) / sc) AS d FROM cb),
    cd AS (SELECT n, o, i, CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1 WHEN d < 2 THEN -0.5 * (((d - 5) * d + 8) * d - 4) ELSE 0 END AS w FROM cc),
    cw AS (SELECT n, o, i, w / sum(w) OVER (PARTITION BY n, o) AS w FROM cd)
"""
#: Distances to the k nearest in the same subset (w), and from them the rows that stay (kept).
_NEAR = """        x AS (SELECT q.category, q.layer, q.part, q.share, q.id, q.u, q.late, len(list_filter(range({k} + 1), lambda c: q.u < 1.0::DOUBLE / (c + 1))) AS need, list_distance(q.e, b.e) AS dist,
                     row_number() OVER (PARTITION BY q.category, q.layer, q.id ORDER BY list_distance(q.e, b.e), b.id) AS k
              FROM v q JOIN v b ON q.category = b.category AND q.layer = b.layer AND q.part = b.part),
        w AS (SELECT category, layer, part, share, id, u, late, sum(dist) AS total, count(*) AS seen, max(dist) FILTER (k = need) AS d
              FROM x WHERE k <= {k} GROUP BY ALL),"""
_THIN = """        s AS (SELECT category, layer, part, share, count(*) AS m, sum(total) / sum(seen) / 10 AS r0 FROM w GROUP BY ALL),
        g AS (SELECT w.*, m, CASE WHEN r0 > 0 AND d = 0 THEN 0 WHEN r0 > 0 THEN list_min(list_filter(range(greatest(0, floor(ln(d / r0) / ln(1.1))::INT - 1), 400), lambda j: d < r0 * pow(1.1, j))) END AS j FROM w JOIN s USING (category, layer, part)),
        h AS (SELECT category, layer, part, m, share, j, count(*) OVER (PARTITION BY category, layer, part ORDER BY j) AS gone FROM g WHERE j IS NOT NULL),
        e AS (SELECT category, layer, part, min(j) AS stop FROM h WHERE m - gone <= share GROUP BY ALL),
        f AS (SELECT g.*, CASE WHEN m <= share THEN 0 ELSE stop END AS stop, row_number() OVER (PARTITION BY category, layer, part ORDER BY u, id) AS least FROM g LEFT JOIN e USING (category, layer, part)),
        kept AS (SELECT category, layer, id, late, CASE WHEN stop IS NULL THEN least <= share ELSE j IS NULL OR j > stop END AS stays FROM f)"""
_CATEGORIES = "can|fabric|fruit_jelly|rice|sheet_metal|vial|wallplugs|walnuts"
_WHERE = f"'^(.*?/)?({_CATEGORIES})/(train|validation|test_public|test_private|test_private_mixed)/(.*)$'"

SQL: dict[str, str] = {
    "flagship": f"WITH {_BANK} SELECT vec_id, label, round(score, 9) AS score, score > threshold AS flag FROM top, lim",
    "knn_top1_score": f"WITH {_BANK} SELECT vec_id, bid AS neighbour, round(dist / 64, 9) AS score FROM r WHERE rank = 1",
    "knn_topk_mean": f"WITH {_BANK} SELECT vec_id, round(avg(dist) / 64, 9) AS score FROM r WHERE rank <= 5 GROUP BY 1",
    "knn_normalized": """
        WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
        d AS (SELECT q.vec_id, b.vec_id AS neighbour, list_distance(q.e, b.e) AS dist FROM v q JOIN v b ON b.label <= 6 AND b.vec_id % 8 <> 0 WHERE NOT (q.label <= 6 AND q.vec_id % 8 <> 0)),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour)::INT AS rank FROM d)
        SELECT vec_id, neighbour, rank, round(dist, 7) AS distance FROM r WHERE rank <= 3""",
    "knn_self_join": """
        WITH d AS (SELECT q.label, q.vec_id, b.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour)::INT AS rank FROM d)
        SELECT label, vec_id, rank, round(dist, 9) AS distance FROM r WHERE rank <= 3""",
    "layer_scores": """
        WITH v AS (SELECT DISTINCT ON (proto_id) proto_id, lower(trim(category)) AS category, layer, sample_id, embedding::DOUBLE[] AS e FROM prototype_embeddings
                   WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        h AS (SELECT *, (dense_rank() OVER (PARTITION BY category ORDER BY sample_id) - 1) % 8 = 0 AS held FROM v)
        SELECT q.category, q.layer, q.proto_id, round(min(list_distance(q.e, b.e)) / 32, 6) AS score FROM h q JOIN h b ON q.category = b.category AND q.layer = b.layer
        WHERE q.held AND NOT b.held GROUP BY ALL""",
    "anomaly_threshold": f"WITH {_BANK} SELECT n, round(threshold, 9) AS threshold FROM lim",
    "pixel_threshold": """
        SELECT lower(trim(category)) AS category, count(*) AS n, round(quantile_cont(score, 0.95) * 1.421, 9) AS threshold FROM pixel_scores
        WHERE score <> -1 AND isfinite(score) GROUP BY 1""",
    "train_stride": f"""
        WITH {_SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sample_id) - 1 AS i FROM s WHERE split = 'train')
        SELECT category, sample_id, (i // 3)::INT AS position FROM p WHERE i % 3 = 0""",
    "holdout_split": f"""
        WITH {_SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sample_id) - 1 AS i FROM s WHERE split = 'train')
        SELECT category, sample_id, CASE WHEN (i // 2) % 8 = 0 THEN 'threshold' ELSE 'bank' END AS part FROM p WHERE i % 2 = 0""",
    "scored_labels": f"WITH {_SAMPLES} SELECT category, split, label, count(*) AS n, count(mask_path) AS masks FROM s WHERE label <> 0 GROUP BY ALL",
    "catalog_build": f"""
        WITH p AS (SELECT image_path AS path FROM industrial_samples UNION SELECT mask_path FROM industrial_samples),
        t AS (SELECT path, regexp_extract(path, {_WHERE}, 1) AS root, regexp_extract(path, {_WHERE}, 2) AS category, regexp_extract(path, {_WHERE}, 3) AS split, regexp_extract(path, {_WHERE}, 4) AS rest
              FROM p WHERE path IS NOT NULL AND regexp_matches(path, {_WHERE}) AND path LIKE '%.png'),
        i AS (SELECT *, regexp_replace(regexp_extract(rest, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
              CASE WHEN split IN ('train', 'validation', 'test_public') AND regexp_matches(rest, '^good/[^/]*$') THEN 0
                   WHEN split = 'test_public' AND regexp_matches(rest, '^bad/[^/]*$') THEN 1
                   WHEN split IN ('test_private', 'test_private_mixed') AND regexp_matches(rest, '^[^/]*$') THEN -1 END AS label FROM t)
        SELECT i.category, i.split, i.path AS image_path, i.label::INT AS label, k.path AS mask_path FROM i
        LEFT JOIN t k ON i.label = 1 AND k.root = i.root AND k.category = i.category AND k.split = i.split AND k.rest = 'ground_truth/bad/' || i.stem || '_mask.png'
        WHERE i.label IS NOT NULL""",
    "prediction_paths": f"""
        WITH {_SAMPLES} SELECT category, sample_id::VARCHAR AS stem, CASE sample_id % 6
            WHEN 0 THEN category || '/test_public/' || sample_id || '.tiff' WHEN 1 THEN 'anomaly_images/' || category || '/test_public/' || sample_id || '.tiff'
            WHEN 2 THEN 'anomaly_images/' || category || '/test_public/bad/' || sample_id || '.tiff' WHEN 3 THEN 'anomaly_images/' || category || '/test_public/bad/' || sample_id || '.tiff'
            WHEN 4 THEN category || '/test_public/bad/' || sample_id || '.tiff' END AS path FROM s WHERE split = 'test_public' AND label = 1""",
    "partial_auc": f"WITH {_EVENTS}, {_AUC} SELECT category, positives, negatives, round(auc, 9) AS auc FROM auc",
    "full_auc": f"""
        WITH {_EVENTS}, g AS (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM e GROUP BY 1),
        c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
        SELECT any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives, round(sum(neg / n * (2 * tp - pos) / p / 2), 9) AS auc FROM c""",
    "best_f1": f"WITH {_EVENTS}, {_BEST} SELECT category, image, round(best_f1, 9) AS best_f1 FROM best",
    "f1_fixed_threshold": f"WITH {_EVENTS}, {_AUC} SELECT category, tp, fp, fn, round(f1, 9) AS f1 FROM fixed",
    "mean_of_category_means": f"""
        WITH {_EVENTS}, {_BEST}, a AS (SELECT category, avg(best_f1) AS best_f1 FROM best GROUP BY 1)
        SELECT category, round(best_f1, 9) AS best_f1 FROM a UNION ALL SELECT 'mean', round(avg(best_f1), 9) FROM a""",
    "score_table": f"""
        WITH {_EVENTS}, {_AUC}, a AS (SELECT category AS "Category", auc AS "AU", f1 AS "F1" FROM auc JOIN fixed USING (category))
        SELECT "Category", round("AU", 9) AS "AU", round("F1", 9) AS "F1" FROM a UNION ALL SELECT 'mean', round(avg("AU"), 9), round(avg("F1"), 9) FROM a""",
    "density_subsample": f"""
        WITH v AS (SELECT 0 AS category, 0 AS layer, 0 AS part, 100 AS share, vec_id AS id, 0 AS late, embedding::DOUBLE[] AS e, ((vec_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u FROM embeddings),
        {_NEAR.format(k=100)}{_THIN}
        SELECT id AS vec_id FROM kept WHERE stays""",
    "density_subsample_filled": f"""
        WITH p AS (SELECT DISTINCT ON (proto_id) lower(trim(category)) AS category, layer, proto_id AS id, embedding::DOUBLE[] AS e FROM prototype_embeddings WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32),
        c AS (SELECT category, layer, count(*) AS n, least(4, ceil(count(*) / 5))::BIGINT AS parts FROM p GROUP BY ALL),
        v AS (SELECT p.*, id % parts AS part, 40 // parts AS share, ((id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u, (((id * 31 + 7) * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS late
              FROM p JOIN c USING (category, layer) WHERE n > 40),
        {_NEAR.format(k=5)}{_THIN},
        more AS (SELECT *, row_number() OVER (PARTITION BY category, layer ORDER BY late, id) AS r FROM kept WHERE NOT stays), have AS (SELECT category, layer, count(*) FILTER (stays) AS n FROM kept GROUP BY ALL)
        SELECT category, layer, id AS proto_id FROM kept WHERE stays UNION ALL SELECT category, layer, id FROM more JOIN have USING (category, layer) WHERE r <= 40 - n
        UNION ALL SELECT category, layer, id FROM p JOIN c USING (category, layer) WHERE c.n <= 40""",
    "tile_plan": """
        WITH s AS (SELECT DISTINCT p_size * 48 + 560 AS size FROM part), d AS (SELECT size, size // 16 AS d FROM s WHERE size >= 640),
        n AS (SELECT *, ceil((d - 40) / 24)::BIGINT + 1 AS n_tiles FROM d),
        t AS (SELECT size, d, n_tiles, unnest(range(n_tiles)) AS tile FROM n),
        p AS (SELECT *, (tile * (d - 40)) // greatest(1, n_tiles - 1) AS start FROM t),
        o AS (SELECT *, lag(start) OVER w + 40 - start AS before, start + 40 - lead(start) OVER w AS after FROM p WINDOW w AS (PARTITION BY size ORDER BY tile)),
        k AS (SELECT *, CASE WHEN tile = 0 THEN 0 ELSE (before + 1) // 2 END AS keep_from, CASE WHEN tile = n_tiles - 1 THEN 40 ELSE 40 - after // 2 END AS keep_to FROM o)
        SELECT size, tile, n_tiles, start, start + 40 AS stop, keep_from::BIGINT AS keep_from, keep_to::BIGINT AS keep_to, start + keep_from AS out_from, start + keep_to AS out_to FROM k""",
    "tile_cut_stitch": f"WITH {_MAPS} SELECT vec_id, y, x, round(score * 2, 7) AS score FROM m",
    "bilinear_resize": f"""
        WITH {_MAPS}, a AS (SELECT 16 AS n, o, greatest(0, (o + 0.5::DOUBLE) * 8 / 16 - 0.5) AS centre FROM range(16) t(o) UNION ALL SELECT 12, o, greatest(0, (o + 0.5::DOUBLE) * 8 / 12 - 0.5) FROM range(12) t(o)),
        b AS (SELECT n, o, least(floor(centre)::INT, 7) AS low, centre - least(floor(centre)::INT, 7) AS f FROM a),
        w AS (SELECT n, o, low AS i, 1 - f AS w FROM b UNION ALL SELECT n, o, least(low + 1, 7), f FROM b)
        SELECT vec_id, wy.o::INT AS y, wx.o::INT AS x, round(sum(score * wy.w * wx.w), 7) AS score FROM m JOIN w wy ON wy.n = 16 AND wy.i = y JOIN w wx ON wx.n = 12 AND wx.i = x GROUP BY ALL""",
    "layer_mean": f"""
        WITH {_MAPS}, {_LINEAR.format(sizes="(4, 8), (8, 16)")},
        r AS (SELECT vec_id, y // 4 AS layer, wy.o AS y, wx.o AS x, sum(score * wy.w * wx.w) AS score FROM m JOIN lw wy ON wy.n = 4 AND wy.i = y % 4 JOIN lw wx ON wx.n = 8 AND wx.i = x GROUP BY ALL)
        SELECT vec_id, y::INT AS y, x::INT AS x, round(avg(score)::FLOAT::DOUBLE, 7) + 0 AS score FROM r GROUP BY ALL""",
    "half_scores": f"WITH {_MAPS} SELECT vec_id, (y * 8 + x)::INT AS place, {_HALF.format(x='score')} AS value FROM m",
    "truth_resize": f"""
        WITH {_MAPS}, {_LINEAR.format(sizes="(8, 5), (8, 3)")}
        SELECT vec_id, (wy.o * 3 + wx.o)::INT AS place, (sum((score > 0.08)::INT * wy.w * wx.w) > 0.5)::INT AS value FROM m JOIN lw wy ON wy.m = 5 AND wy.i = y JOIN lw wx ON wx.m = 3 AND wx.i = x GROUP BY ALL""",
    "mask_decode": f"WITH {_MAPS} SELECT vec_id, (a * 20 + b)::INT AS place, (score > 0)::INT AS value FROM range(12) s(a), range(20) t(b), m WHERE y = a * 8 // 12 AND x = b * 8 // 20",
    "channel_means": f"WITH {_IMAGES} SELECT sample_id, channel::INT AS channel, sum(v)::BIGINT AS total, count(*) AS n FROM px GROUP BY ALL",
    "image_files": f"WITH {_IMAGES} SELECT sample_id, height, width, sum(v)::BIGINT AS total, max(v) FILTER (channel = 0 AND y = 0 AND x = 0) AS red FROM px GROUP BY ALL",
    "patch_tokens": f"WITH {_IMAGES} SELECT sample_id, 7 AS layer, (y // 4)::INT AS ty, (x // 4)::INT AS tx, sum(v)::BIGINT AS red FROM px WHERE height = 16 AND width = 16 AND channel = 0 GROUP BY ALL",
    "bicubic_resize": f"""
        WITH {_IMAGES}, {_CUBIC}, r AS (SELECT sample_id, height, width, channel, wy.o AS y, wx.o AS x, sum((v / 255.0::DOUBLE)::FLOAT::DOUBLE * wy.w * wx.w)::FLOAT::DOUBLE AS v
            FROM px JOIN cw wy ON wy.n = height AND wy.i = y JOIN cw wx ON wx.n = width AND wx.i = x GROUP BY ALL),
        s AS (SELECT *, floor(height * 0.625)::INT AS h, floor(width * 0.625)::INT AS w FROM r)
        SELECT sample_id, h AS height, w AS width, channel::INT AS channel, round(sum(v * ((channel * h * w + y * w + x) % 7 + 1)), 3) AS total FROM s GROUP BY ALL""",
    "batch_sizes": f"WITH {_SAMPLES} SELECT count(*) AS n, true AS bounded FROM s WHERE image_path IS NOT NULL",
    "map_files": f"""
        WITH {_MAPS} SELECT vec_id, 'tiff' AS kind, 'float16' AS dtype, (y * 8 + x)::INT AS place, {_HALF.format(x='score')} AS value FROM m
        UNION ALL SELECT vec_id, 'png', 'uint8', (y * 8 + x)::INT, CASE WHEN score > 0.1 THEN 255 ELSE 0 END FROM m""",
    "scores_csv": f"""
        WITH {_EVENTS}, {_AUC}, a AS (SELECT category AS "Category", auc AS "AU", f1 AS "F1" FROM auc JOIN fixed USING (category)),
        b AS (SELECT "Category", round("AU", 9) AS "AU", round("F1", 9) AS "F1" FROM a UNION ALL SELECT 'mean', round(avg("AU"), 9), round(avg("F1"), 9) FROM a)
        SELECT (row_number() OVER (ORDER BY "Category" = 'mean', "Category") - 1)::INT AS place, * FROM b""",
    "fit_transform": """
        WITH v AS (SELECT vec_id, label, 'c' || (label % 2) AS category, l AS layer, embedding[32 * l + 1 : 32 * l + 32]::DOUBLE[] AS e FROM embeddings, range(2) t(l)),
        d AS (SELECT q.vec_id, q.label, q.category, q.layer, min(list_distance(q.e, b.e)) / 32 AS d FROM v q JOIN v b ON q.category = b.category AND q.layer = b.layer AND b.label <= 6 AND b.vec_id % 8 <> 0
              WHERE q.label > 6 OR q.vec_id % 8 = 0 GROUP BY ALL),
        s AS (SELECT vec_id, label, category, avg(d)::FLOAT::DOUBLE AS score FROM d GROUP BY ALL),
        t AS (SELECT category, quantile_cont(score, 0.95) * 1.421 AS threshold FROM s WHERE label <= 6 GROUP BY 1)
        SELECT category, vec_id, round(score, 9) AS score, score > threshold AS flag FROM s JOIN t USING (category)""",
    "evaluate_maps": f"""
        WITH {_MAPS}, z AS (SELECT 'c' || (label % 4) AS category, {_HALF.format(x='score')} AS score, vec_id % 3 <> 0 AND (vec_id * 7 + (y * 8 + x) * 13) % 10 < 2 AS truth, score > 0.1 AS flag FROM m JOIN embeddings USING (vec_id) WHERE vec_id % 11 <> 0),
        e AS (SELECT category, score, truth FROM z), {_AUC},
        q AS (SELECT category, count(*) FILTER (flag AND truth) AS tp, count(*) FILTER (flag <> truth) AS off FROM z GROUP BY 1),
        a AS (SELECT category AS "Category", auc AS "AU", 2.0::DOUBLE * q.tp / (2 * q.tp + off) AS "F1" FROM auc JOIN q USING (category))
        SELECT "Category", round("AU", 9) AS "AU", round("F1", 9) AS "F1" FROM a UNION ALL SELECT 'mean', round(avg("AU"), 9), round(avg("F1"), 9) FROM a""",
    "map_problems": "SELECT 'c' || label AS category, vec_id AS image_id, CASE WHEN vec_id % 5 = 0 THEN 'missing' ELSE 'size' END AS problem FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0",
    "clean_maps": f"""
        WITH RECURSIVE {_MAPS}, l AS (SELECT i, pi() * i / 8 AS a FROM range(8) t(i)),
        ends AS (SELECT i, round(2 - 2 * sin(a)) AS y0, round(2 - 2 * cos(a)) AS x0, round(2 + 2 * sin(a)) AS y1, round(2 + 2 * cos(a)) AS x1 FROM l),
        near AS (SELECT *, greatest(0, least(1, ((ky - y0) * (y1 - y0) + (kx - x0) * (x1 - x0)) / ((y1 - y0) ** 2 + (x1 - x0) ** 2))) AS t FROM ends, range(5) y(ky), range(5) x(kx)),
        k1 AS (SELECT i, ky, kx, count(*) OVER (PARTITION BY i) AS size FROM near WHERE sqrt((ky - y0 - t * (y1 - y0)) ** 2 + (kx - x0 - t * (x1 - x0)) ** 2) <= 1 + 1e-9),
        k2 AS (SELECT DISTINCT i, ky + a AS ky, kx + b AS kx FROM k1, range(2) s(a), range(2) u(b) WHERE ky + a < 5 AND kx + b < 5),
        wide AS (SELECT DISTINCT vec_id, i, y - (ky - 2) AS y, x - (kx - 2) AS x FROM front, k2),
        shut AS (SELECT vec_id, i, y - (ky - 2) AS y, x - (kx - 2) AS x FROM wide JOIN k1 USING (i) GROUP BY vec_id, i, y - (ky - 2), x - (kx - 2) HAVING count(*) = any_value(size)),
        joined AS (SELECT * FROM front UNION SELECT vec_id, y, x FROM shut WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7),
        closed AS (SELECT vec_id, y, x FROM joined JOIN m USING (vec_id, y, x) WHERE score > 0.08 * 0.5::DOUBLE),
        back AS (SELECT vec_id, y, x FROM m ANTI JOIN closed USING (vec_id, y, x)),
        reached AS (SELECT * FROM back WHERE y IN (0, 7) OR x IN (0, 7) UNION
                    SELECT b.vec_id, b.y, b.x FROM reached r JOIN back b ON b.vec_id = r.vec_id AND abs(b.y - r.y) + abs(b.x - r.x) = 1),
        filled AS (SELECT vec_id, y, x FROM m ANTI JOIN reached USING (vec_id, y, x))
        SELECT f.vec_id, f.y, f.x FROM filled f, cross5 LEFT JOIN filled g ON g.vec_id = f.vec_id AND g.y = f.y + dy AND g.x = f.x + dx
        GROUP BY ALL HAVING bool_and(g.vec_id IS NOT NULL OR f.y + dy NOT BETWEEN 0 AND 7 OR f.x + dx NOT BETWEEN 0 AND 7)""",
    "dilation": f"WITH {_MAPS} SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM front, cross5 WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7",
    "line_closing": f"""
        WITH {_MAPS}, wide AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM front, line3),
        shut AS (SELECT vec_id, y - dy AS y, x - dx AS x FROM wide, line3 GROUP BY ALL HAVING count(*) = 3)
        SELECT * FROM front UNION SELECT vec_id, y, x FROM shut WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7""",
    "ellipse_erosion": f"""
        WITH {_MAPS} SELECT f.vec_id, f.y, f.x FROM front f, cross5 LEFT JOIN front g ON g.vec_id = f.vec_id AND g.y = f.y + dy AND g.x = f.x + dx
        GROUP BY ALL HAVING bool_and(g.vec_id IS NOT NULL OR f.y + dy NOT BETWEEN 0 AND 7 OR f.x + dx NOT BETWEEN 0 AND 7)""",
    "fill_holes": f"""
        WITH RECURSIVE {_MAPS}, back AS (SELECT vec_id, y, x FROM m WHERE NOT score > 0.0),
        reached AS (SELECT * FROM back WHERE y IN (0, 7) OR x IN (0, 7) UNION
                    SELECT b.vec_id, b.y, b.x FROM reached r JOIN back b ON b.vec_id = r.vec_id AND abs(b.y - r.y) + abs(b.x - r.x) = 1)
        SELECT vec_id, y, x FROM m ANTI JOIN reached USING (vec_id, y, x)""",
    "brightness_clip": """
        SELECT vec_id, p::INT AS place, round(greatest(least(embedding[p + 1]::DOUBLE * (0.8 + ((vec_id * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE * 0.4), 1), 0), 7) AS value
        FROM embeddings, range(64) t(p)""",
    "channel_normalize": """
        SELECT vec_id, p::INT AS place, round((embedding[p + 1]::DOUBLE - [0.485::DOUBLE, 0.456, 0.406][p // 22 + 1]) / [0.229::DOUBLE, 0.224, 0.225][p // 22 + 1], 7) AS value FROM embeddings, range(64) t(p)""",
    "l2_normalize": """
        WITH e AS (SELECT vec_id, p, embedding[p + 1]::DOUBLE * (p + 1) AS v FROM embeddings, range(64) t(p))
        SELECT vec_id, p::INT AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 7) AS value FROM e""",
    "name_validation": f'WITH {_SAMPLES} SELECT sample_id, name, "index", suffix FROM parsed',
    "index_coverage": f"""
        WITH {_SAMPLES}, w AS (SELECT category, split, count(DISTINCT "index") + length(category) % 4 AS expected FROM parsed GROUP BY category, split),
        want AS (SELECT category, split, unnest(range(expected)) AS i FROM w), have AS (SELECT DISTINCT category, split, "index" AS i FROM parsed WHERE "index" IS NOT NULL),
        lack AS (SELECT * FROM want EXCEPT SELECT * FROM have), more AS (SELECT * FROM have EXCEPT SELECT * FROM want),
        u AS (SELECT *, true AS lacking FROM lack UNION ALL SELECT *, false FROM more),
        r AS (SELECT *, row_number() OVER (PARTITION BY category, split, lacking ORDER BY i) AS k FROM u)
        SELECT category, split, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (lacking), '') AS missing, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (NOT lacking), '') AS extra
        FROM r WHERE k <= 5 GROUP BY ALL""",
    "prediction_violations": f"""
        WITH {_SAMPLES}, n AS (SELECT * FROM parsed WHERE split IN ('test_private', 'test_private_mixed')),
        x AS (SELECT c AS category, s AS split, k AS expected FROM (VALUES ('can', 321), ('fabric', 314), ('fruit_jelly', 255), ('rice', 277), ('sheet_metal', 142), ('vial', 276), ('wallplugs', 232), ('walnuts', 228)) t(c, k),
              (VALUES ('test_private'), ('test_private_mixed')) u(s)),
        c AS (SELECT x.category, x.split, expected, count(n.name) AS k FROM x LEFT JOIN n USING (category, split) GROUP BY ALL),
        want AS (SELECT category, split, unnest(range(expected)) AS i FROM x), have AS (SELECT DISTINCT category, split, "index" AS i FROM n SEMI JOIN x USING (category, split) WHERE "index" IS NOT NULL),
        gap AS (SELECT DISTINCT category, split FROM ((SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL (SELECT * FROM have EXCEPT SELECT * FROM want))),
        one AS (SELECT kind || '_count' AS rule, category, split FROM c, (VALUES ('tiff'), ('png')) t(kind) WHERE k <> expected
                UNION ALL SELECT kind || '_index', category, split FROM gap, (VALUES ('tiff'), ('png')) t(kind)
                UNION ALL SELECT 'missing_folder', category, split FROM c WHERE k = 0
                UNION ALL SELECT kind || '_name', category, split FROM n, (VALUES ('tiff'), ('png')) t(kind) WHERE "index" IS NULL
                UNION ALL SELECT kind || '_suffix', category, split FROM n, (VALUES ('tiff'), ('png')) t(kind) WHERE suffix <> CASE split WHEN 'test_private' THEN 'regular' ELSE 'mixed' END
                UNION ALL SELECT 'tiff_type', category, split FROM n WHERE sample_id % 50 = 0
                UNION ALL SELECT 'png_shape', category, split FROM n WHERE sample_id % 70 = 0
                UNION ALL SELECT 'png_values', category, split FROM n WHERE sample_id % 60 = 0 AND sample_id % 70 <> 0)
        SELECT rule, category, split, count(*) AS n FROM one GROUP BY ALL""",
    "stream_scores": f"WITH {_BANK} SELECT vec_id, round(score, 9) AS score, score > 0.015 AS flag FROM top",
}

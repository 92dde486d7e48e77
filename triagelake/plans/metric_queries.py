"""Queries over scores, labels and a model's judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions.metrics import confusion, rates, ratio, wilson
from triagelake.operators import evaluation as E
from triagelake.operators import rules as R
from triagelake.plans.standin import sql, table, view
from triagelake.registry import register

RATES = "CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS \"precision\", CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CAST(tp + tn AS DOUBLE) / nullif(n, 0) AS accuracy, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity"


def counts(gold="y", predicted="score >= 0.5"):
    p = f"({predicted})"
    return f"sum(CASE WHEN {gold} AND {p} THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT {gold} AND {p} THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN {gold} AND NOT {p} THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT {gold} AND NOT {p} THEN 1 ELSE 0 END) AS tn, count(*) AS n"


def half():
    return F.col("score") >= 0.5


@register("agg10_confusion_metrics", sql("scored", body=f", c AS (SELECT class, {counts()} FROM scored GROUP BY class) SELECT class, tp, fp, fn, tn, n, {RATES} FROM c"))
def confusion_metrics(spark, d):
    return E.metrics(view(spark, d, "scored"), half(), "class")


@register("agg11_label_metrics", sql("scored", body=f", l AS (SELECT 'toxic' AS label, y AS gold, score >= 0.5 AS pred FROM scored UNION ALL SELECT 'good', judge, score_b >= 0.5 FROM scored) SELECT label, coalesce(CAST(sum(CASE WHEN gold AND pred THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN pred THEN 1 ELSE 0 END), 0), 0) AS \"precision\", coalesce(CAST(sum(CASE WHEN gold AND pred THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN gold THEN 1 ELSE 0 END), 0), 0) AS recall FROM l GROUP BY label"))
def label_metrics(spark, d):
    pair = lambda name, gold, pred: F.when(gold | pred, F.struct(F.lit(name).alias("label"), gold.alias("gold"), pred.alias("pred")))
    rows = view(spark, d, "scored").select(F.explode(F.array_compact(F.array(pair("toxic", F.col("y"), half()), pair("good", F.col("judge"), F.col("score_b") >= 0.5)))).alias("l"))
    hit = F.count_if(F.col("l.gold") & F.col("l.pred"))
    return rows.groupBy(F.col("l.label").alias("label")).agg(F.coalesce(ratio(hit, F.count_if("l.pred")), F.lit(0.0)).alias("precision"), F.coalesce(ratio(hit, F.count_if("l.gold")), F.lit(0.0)).alias("recall"))


@register("agg12_bucket_accuracy", sql("scored", body=" SELECT part, avg(CASE WHEN y = (score >= 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy, string_agg(CASE WHEN NOT y AND score >= 0.95 THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY item_id) AS false_flags FROM scored GROUP BY part"))
def bucket_accuracy(spark, d):
    false = F.array_sort(F.collect_list(F.when(~F.col("y") & (F.col("score") >= 0.95), F.col("item_id"))))
    joined = F.array_join(false.cast("array<string>"), ",")
    return view(spark, d, "scored").groupBy("part").agg(F.avg((F.col("y") == half()).cast("double")).alias("accuracy"), F.when(F.size(false) > 0, joined).alias("false_flags"))


@register("agg13_metrics_with_total", sql("scored", body=f", c AS (SELECT class, {counts()} FROM scored GROUP BY GROUPING SETS ((class), ())) SELECT coalesce(class, 'all') AS class, tp, fp, fn, tn, n, {RATES} FROM c"))
def with_total(spark, d):
    rolled = view(spark, d, "scored").rollup("class").agg(*confusion(F.col("y"), half())).withColumns(rates())
    return rolled.withColumn("class", F.coalesce("class", F.lit("all")))


@register("agg14_auroc", sql("scored", body=", p AS (SELECT a.score AS a, b.score AS b FROM scored a JOIN scored b ON a.y AND NOT b.y) SELECT CAST(avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS auroc, (SELECT sum(CASE WHEN y THEN 1 ELSE 0 END) FROM scored) AS p, (SELECT sum(CASE WHEN y THEN 0 ELSE 1 END) FROM scored) AS n FROM p"))
def auroc(spark, d):
    return E.auroc(view(spark, d, "scored"))


ROC = ", g AS (SELECT score, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY score), r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), c AS (SELECT score, CAST(tp AS DOUBLE) / p AS tpr, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp + fp AS DOUBLE) / (p + n) AS sent FROM r)"


@register("agg15_roc_points", sql("scored", body=ROC + " SELECT score, tpr, fpr, sent FROM c"))
def roc(spark, d):
    return E.roc(view(spark, d, "scored"))


@register("agg15_best_threshold", sql("scored", body=ROC + " SELECT score, tpr - fpr AS gain FROM c ORDER BY tpr - fpr DESC, score DESC LIMIT 1"))
def best_threshold(spark, d):
    return E.best_threshold(view(spark, d, "scored"))


@register("agg16_calibration", sql("scored", body=" SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS share FROM scored GROUP BY 1"))
def calibration(spark, d):
    return E.calibration(view(spark, d, "scored"))


@register("agg16_calibration_error", sql("scored", body=", b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS m, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS s FROM scored GROUP BY 1) SELECT sum(n * abs(m - s)) / sum(n) AS ece, (SELECT avg((score - CASE WHEN y THEN 1 ELSE 0 END) * (score - CASE WHEN y THEN 1 ELSE 0 END)) FROM scored) AS brier FROM b"))
def calibration_error(spark, d):
    return E.calibration_error(view(spark, d, "scored"))


@register("agg17_score_distribution", sql("scored", body=" SELECT class, avg(score) AS mean, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS half, sum(CASE WHEN score >= 0.35 AND score < 0.65 THEN 1 ELSE 0 END) AS middle, sum(CASE WHEN score < 0.1 THEN 1 ELSE 0 END) AS lowest FROM scored GROUP BY class"))
def distribution(spark, d):
    s = F.col("score")
    return view(spark, d, "scored").groupBy("class").agg(F.avg(s).alias("mean"), F.avg((s >= 0.5).cast("double")).alias("half"), F.count_if((s >= 0.35) & (s < 0.65)).alias("middle"), F.count_if(F.width_bucket(s, F.lit(0.0), F.lit(1.0), F.lit(10)) == 1).alias("lowest"))


@register("agg17_fixed_edges", sql("scored", body=""", e AS (SELECT unnest([0, 1, 2, 3]) AS bin, unnest([0.0, 25.0, 50.0, 75.0]) AS low, unnest([25.0, 50.0, 75.0, 101.0]) AS high), c AS (SELECT DISTINCT class FROM scored)
SELECT c.class, CAST(e.bin AS INTEGER) AS bin, CAST(e.low AS DOUBLE) AS low, (SELECT count(*) FROM scored s WHERE s.class IS NOT DISTINCT FROM c.class AND s.score * 100 >= e.low AND s.score * 100 < e.high) AS n FROM c, e"""))
def fixed_edges(spark, d):
    return E.histogram(view(spark, d, "scored"), F.col("score") * 100, [0, 25, 50, 75, 101], "class")


@register("agg17_deciles", sql("scored", body=""", e AS (SELECT unnest(range(10)) AS bin)
SELECT CAST(bin AS INTEGER) AS bin, CAST(bin AS DOUBLE) / 10 AS low, (SELECT count(*) FROM scored s WHERE s.score >= CAST(bin AS DOUBLE) / 10 AND (s.score < (CAST(bin AS DOUBLE) + 1) / 10 OR bin = 9 AND s.score = 1)) AS n FROM e"""))
def deciles(spark, d):
    return E.histogram(view(spark, d, "scored"), F.col("score"), [k / 10 for k in range(11)])


@register("agg18_recall_by_class", sql("scored", body=" SELECT class, avg(CASE WHEN y THEN CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END END) AS recall, avg(CASE WHEN (score >= 0.5) = y OR (score_b >= 0.5) = y THEN 1.0 ELSE 0.0 END) AS either FROM scored GROUP BY class"))
def recall_by_class(spark, d):
    hit = F.avg(F.when(F.col("y"), half().cast("double")))
    either = ((half() == F.col("y")) | ((F.col("score_b") >= 0.5) == F.col("y"))).cast("double")
    return view(spark, d, "scored").groupBy("class").agg(hit.alias("recall"), F.avg(either).alias("either"))


@register("agg19_slices", sql("scored", body=" SELECT sum(CASE WHEN y AND part < 'src5' THEN 1 ELSE 0 END) AS positives, sum(CASE WHEN y AND part < 'src5' AND score >= 0.5 THEN 1 ELSE 0 END) AS caught, sum(CASE WHEN NOT y AND part >= 'src5' THEN 1 ELSE 0 END) AS negatives, sum(CASE WHEN NOT y AND part >= 'src5' AND score >= 0.5 THEN 1 ELSE 0 END) AS flagged FROM scored"))
def slices(spark, d):
    y, a = F.col("y"), F.col("part") < "src5"
    return view(spark, d, "scored").agg(F.count_if(y & a).alias("positives"), F.count_if(y & a & half()).alias("caught"), F.count_if(~y & ~a).alias("negatives"), F.count_if(~y & ~a & half()).alias("flagged"))


@register("agg20_wilson", sql("scored", body=", c AS (SELECT class, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY class) SELECT class, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS high FROM c"))
def wilson_intervals(spark, d):
    rows = view(spark, d, "scored").groupBy("class").agg(F.count_if("y").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select("class", low.alias("low"), high.alias("high"))


@register("agg21_bootstrap_auroc")
def bootstrap(spark, d):
    return E.bootstrap_auroc(view(spark, d, "scored"))


@register("agg21_bootstrap_speed_up")
def bootstrap_speed(spark, d):
    return E.speed_up(view(spark, d, "scored"), half(), 0.05, 2.0)


THRESHOLD = "SELECT coalesce((SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) AS r FROM scored WHERE y) x WHERE r = 1 + CAST(floor((1 - 0.95) * (SELECT count(*) FROM scored WHERE y)) AS BIGINT)), 0.0) AS threshold"


@register("agg22_threshold_for_recall", sql("scored", body=" " + THRESHOLD))
def recall_threshold(spark, d):
    return E.threshold_for_recall(view(spark, d, "scored"), 0.95)


@register("agg23_recall_at_budget", sql("scored", body=", t AS (SELECT quantile_cont(score, 0.7) AS t FROM scored) SELECT (SELECT t FROM t) AS threshold, CAST(sum(CASE WHEN y AND score >= (SELECT t FROM t) THEN 1 ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN y THEN 1 ELSE 0 END), 1) AS recall FROM scored"))
def budget(spark, d):
    return E.recall_at_budget(view(spark, d, "scored"), 0.3)


CASCADE = f", c AS (SELECT {counts(predicted='score >= 0.4 AND judge')}, sum(CASE WHEN score >= 0.4 THEN 1 ELSE 0 END) AS sent, sum(CASE WHEN score < 0.4 AND y THEN 1 ELSE 0 END) AS lost FROM scored)"


@register("agg24_cascade", sql("scored", body=CASCADE + f" SELECT tp, fp, fn, tn, n, sent, lost, {RATES}, CAST(sent AS DOUBLE) / n AS share_sent, 0.0271 + CAST(sent AS DOUBLE) / n * 1.508 AS seconds, 1.508 / (0.0271 + CAST(sent AS DOUBLE) / n * 1.508) AS speed_up FROM c"))
def cascade(spark, d):
    return E.cascade(view(spark, d, "scored"), F.lit(0.4), 0.0271, 1.508)


@register("agg25_recall_curve", sql("scored", body=ROC + " SELECT sent, tpr AS recall FROM c"))
def recall_curve(spark, d):
    return E.roc(view(spark, d, "scored")).select("sent", F.col("tpr").alias("recall"))


@register("agg26_prevalence_projection", sql("scored", body=", r AS (SELECT avg(CASE WHEN y THEN CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END END) AS tpr, avg(CASE WHEN NOT y THEN CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END END) AS fpr FROM scored), v AS (SELECT unnest([0.5, 0.1, 0.05, 0.01]) AS prevalence) SELECT CAST(prevalence AS DOUBLE) AS prevalence, prevalence * tpr + (1 - prevalence) * fpr AS sent FROM r CROSS JOIN v"))
def projection(spark, d):
    sent = (F.col("score") >= 0.4).cast("double")
    r = view(spark, d, "scored").agg(F.avg(F.when(F.col("y"), sent)).alias("tpr"), F.avg(F.when(~F.col("y"), sent)).alias("fpr"))
    rows = r.withColumn("prevalence", F.explode(F.array(*map(F.lit, (0.5, 0.1, 0.05, 0.01)))))
    return rows.select("prevalence", (F.col("prevalence") * F.col("tpr") + (1 - F.col("prevalence")) * F.col("fpr")).alias("sent"))


@register("agg27_run_health", "SELECT count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN starts_with(event_type, 'c') THEN 1 ELSE 0 END) AS c_events, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS slow FROM events")
def health(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(t == "error").alias("errors"), F.count_if(t.startswith("c")).alias("c_events"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") > 50).alias("slow"))


@register("agg27_all_counts", sql("assessed", body=""", p AS (SELECT *, CASE WHEN item_id % 9 = 1 THEN 'invalid_json: x' WHEN item_id % 9 = 2 THEN 'timeout' WHEN item_id % 9 = 3 THEN 'server_error 500' END AS error, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'words' END AS reason, CASE WHEN item_id % 6 <> 0 THEN confidence_a END AS p_true FROM assessed)
SELECT count(*) AS n, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS valid, sum(CASE WHEN starts_with(error, 'invalid_json') THEN 1 ELSE 0 END) AS invalid_json, sum(CASE WHEN starts_with(error, 'timeout') THEN 1 ELSE 0 END) AS timeouts,
  sum(CASE WHEN starts_with(error, 'server_error') THEN 1 ELSE 0 END) AS server_errors, sum(CASE WHEN error IS NULL AND reason = '' AND NOT possible_minor THEN 1 ELSE 0 END) AS refusals,
  sum(CASE WHEN error IS NULL AND possible_minor THEN 1 ELSE 0 END) AS restricted, sum(CASE WHEN error IS NULL AND NOT possible_minor AND p_true IS NULL THEN 1 ELSE 0 END) AS without_probability FROM p"""))
def all_counts(spark, d):
    """The health of a run: what came back valid, what failed and how, refusals, restricted rows, missing probabilities."""
    n = F.col("item_id")
    error = F.when(n % 9 == 1, "invalid_json: x").when(n % 9 == 2, "timeout").when(n % 9 == 3, "server_error 500")
    rows = view(spark, d, "assessed").select("possible_minor", error.alias("error"), F.when(n % 4 == 0, "").otherwise("words").alias("reason"), F.when(n % 6 != 0, F.col("confidence_a")).alias("p_true"))
    return E.run_health(rows)


@register("agg28_throughput", "SELECT event_type, count(*) AS n, avg(value) AS mean_latency, max(value) AS max_latency, 60.0 * count(*) / sum(value) AS per_minute FROM events GROUP BY event_type")
def throughput(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(v).alias("mean_latency"), F.max(v).alias("max_latency"), (60.0 * F.count("*") / F.sum(v)).alias("per_minute"))


@register("agg28_run_throughput", sql("assessed", body=" SELECT count(*) AS n, 60.0 * count(*) / 3600.0 AS per_minute, 600.0 * count(*) / 3600.0 AS per_10_min, avg(length(content) / 1000.0) AS mean_latency, max(length(content) / 1000.0) AS max_latency, avg(coalesce(length(content), 0)) AS prompt_tokens_mean, avg(coalesce(CASE WHEN item_id % 4 < 3 THEN length(type_list) + length(pathway_list) END, 0)) AS completion_tokens_mean FROM assessed"))
def run_throughput(spark, d):
    size = F.length("content")
    usage = {"prompt_tokens": size, "completion_tokens": F.when(F.col("item_id") % 4 < 3, F.length("type_list") + F.length("pathway_list"))}
    return E.throughput(view(spark, d, "assessed"), size / 1000.0, 3600.0, usage)


@register("agg28_layer_counts", sql("assessed", body=" SELECT coalesce(relation, 'none') AS layer, count(*) AS n FROM assessed GROUP BY 1"))
def layer_counts(spark, d):
    return view(spark, d, "assessed").groupBy(F.coalesce("relation", F.lit("none")).alias("layer")).agg(F.count("*").alias("n"))


@register("agg29_stage_cost", sql("segments", body=", t AS (SELECT video, 'user' AS stage, sum(CASE WHEN role = 'user' THEN end_s - start_s ELSE 0 END) AS s, max(end_s) AS total FROM segments GROUP BY video UNION ALL SELECT video, 'rest', sum(CASE WHEN role <> 'user' THEN end_s - start_s ELSE 0 END), max(end_s) FROM segments GROUP BY video) SELECT stage, sum(s) AS seconds, sum(s) / (sum(total) / 60) AS per_minute FROM t GROUP BY stage"))
def stage_cost(spark, d):
    length = F.col("end_s") - F.col("start_s")
    per = view(spark, d, "segments").groupBy("video").agg(F.sum(F.when(F.col("role") == "user", length).otherwise(0)).alias("user"), F.sum(F.when(F.col("role") != "user", length).otherwise(0)).alias("rest"), F.max("end_s").alias("total"))
    long = per.unpivot(["video", "total"], ["user", "rest"], "stage", "s")
    return long.groupBy("stage").agg(F.sum("s").alias("seconds"), (F.sum("s") / (F.sum("total") / 60)).alias("per_minute"))


@register("agg32_most_serious", sql("assessed", body=", r AS (SELECT item_id % 50 AS grp, item_id, CASE model_route WHEN 'priority_review' THEN 4 WHEN 'standard_review' THEN 3 ELSE 1 END AS rank FROM assessed), m AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank DESC, item_id) AS n FROM r) SELECT grp, item_id, rank FROM m WHERE n = 1"))
def most_serious(spark, d):
    rows = view(spark, d, "assessed").select((F.col("item_id") % 50).alias("grp"), "item_id", R.lookup(F.col("model_route"), R.ROUTE_RANK).alias("rank"))
    return rows.groupBy("grp").agg(F.max_by(F.struct("item_id", "rank"), F.struct(F.col("rank"), -F.col("item_id"))).alias("m")).select("grp", "m.item_id", "m.rank")


@register("agg33_mcnemar", sql("scored", body=", c AS (SELECT sum(CASE WHEN (score >= 0.5) = y AND (score_b >= 0.5) <> y THEN 1 ELSE 0 END) AS b, sum(CASE WHEN (score >= 0.5) <> y AND (score_b >= 0.5) = y THEN 1 ELSE 0 END) AS c FROM scored), s AS (SELECT b, c, 0 AS i, -(b + c) * ln(2.0) AS l FROM c UNION ALL SELECT b, c, i + 1, l + ln(CAST(b + c - i AS DOUBLE) / (i + 1)) FROM s WHERE i < least(b, c)) SELECT max(b) AS b, max(c) AS c, CASE WHEN max(b) + max(c) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(l))) END AS p FROM s"))
def mcnemar(spark, d):
    return E.mcnemar(view(spark, d, "scored"), half() == F.col("y"), (F.col("score_b") >= 0.5) == F.col("y"))


@register("agg33_missed_by", sql("scored", body=" SELECT CAST(CASE WHEN (score >= 0.5) <> y THEN 1 ELSE 0 END + CASE WHEN (score_b >= 0.5) <> y THEN 1 ELSE 0 END + CASE WHEN judge <> y THEN 1 ELSE 0 END AS INTEGER) AS missed_by, count(*) AS items FROM scored GROUP BY 1"))
def missed_by(spark, d):
    y = F.col("y")
    n = (half() != y).cast("int") + ((F.col("score_b") >= 0.5) != y).cast("int") + (F.col("judge") != y).cast("int")
    return view(spark, d, "scored").groupBy(n.alias("missed_by")).agg(F.count("*").alias("items"))


@register("agg33_missed_items", sql("scored", body=" SELECT * FROM (SELECT item_id, CAST(CASE WHEN (score >= 0.5) <> y THEN 1 ELSE 0 END + CASE WHEN (score_b >= 0.5) <> y THEN 1 ELSE 0 END + CASE WHEN judge <> y THEN 1 ELSE 0 END AS INTEGER) AS missed_by, concat_ws(',', CASE WHEN (score >= 0.5) <> y THEN 'a' END, CASE WHEN (score_b >= 0.5) <> y THEN 'b' END, CASE WHEN judge <> y THEN 'judge' END) AS systems FROM scored) x WHERE missed_by > 0"))
def missed_items(spark, d):
    y = F.col("y")
    right = {"a": half() == y, "b": (F.col("score_b") >= 0.5) == y, "judge": F.col("judge") == y}
    return E.missed_items(view(spark, d, "scored"), "item_id", right).withColumn("systems", F.array_join("systems", ","))


@register("agg34_label_statistics", "SELECT d.lang, count(l.toxic) AS labelled, sum(l.toxic) AS toxic, sum(l.quality) AS good, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def label_statistics(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("good"), F.count("*").alias("n"))


ACCURACY = ", ".join(f"avg(CASE WHEN class = '{c}' THEN CASE WHEN (score >= 0.5) = y THEN 1.0 ELSE 0.0 END END) AS {c}" for c in ("de", "en", "es", "fr"))


@register("agg35_leaderboard", sql("scored", body=f", s AS (SELECT 'a' AS system, class, y, score FROM scored UNION ALL SELECT 'b', class, y, score_b FROM scored) SELECT system, {ACCURACY} FROM s WHERE class IS NOT NULL GROUP BY system"))
def leaderboard(spark, d):
    """Accuracy by system, a column for each class that there is."""
    rows = view(spark, d, "scored").where("class IS NOT NULL")
    long = rows.select(F.lit("a").alias("system"), "class", (half() == F.col("y")).cast("double").alias("ok")).unionByName(rows.select(F.lit("b").alias("system"), "class", ((F.col("score_b") >= 0.5) == F.col("y")).cast("double").alias("ok")))
    return long.groupBy("system").pivot("class").agg(F.avg("ok"))


@register("agg38_printed_numbers", "WITH m AS (SELECT source AS key, avg(n_chars) AS v FROM documents GROUP BY source), p AS (SELECT key, CASE WHEN key < 'src2' THEN round(v, 2) ELSE round(v, 2) + 0.01 END AS printed FROM m) SELECT m.key, abs(m.v - p.printed) <= 0.005 + 0.000000001 AS agrees FROM m JOIN p ON m.key = p.key")
def printed(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(F.avg("n_chars").alias("v"))
    p = m.select("key", F.when(F.col("key") < "src2", F.round("v", 2)).otherwise(F.round("v", 2) + 0.01).alias("printed"))
    return m.join(p, "key").select("key", (F.abs(F.col("v") - F.col("printed")) <= 0.005 + 1e-9).alias("agrees"))


@register("agg39_fixed_thresholds", sql("scored", body=f", t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS t), c AS (SELECT CAST(t AS DOUBLE) AS threshold, {counts(predicted='score >= t OR score_b >= 0.95')} FROM scored CROSS JOIN t GROUP BY t) SELECT threshold, tp, fp, fn, tn, n, {RATES} FROM c"))
def fixed(spark, d):
    rows = view(spark, d, "scored").withColumn("threshold", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.9)))))
    return E.metrics(rows, (F.col("score") >= F.col("threshold")) | (F.col("score_b") >= 0.95), "threshold")


@register("joi16_predictions_with_reference", "SELECT l.doc_id, l.toxic, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.n_chars > 500")
def with_reference(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("n_chars > 500").select("doc_id", "lang"), "doc_id").select("doc_id", "toxic", "lang")


@register("joi17_fixed_and_broken", sql("scored", body=" SELECT sum(CASE WHEN (score >= 0.5) <> y AND (score_b >= 0.5) = y THEN 1 ELSE 0 END) AS fixed, sum(CASE WHEN (score >= 0.5) = y AND (score_b >= 0.5) <> y THEN 1 ELSE 0 END) AS broken FROM scored"))
def fixed_and_broken(spark, d):
    rows = view(spark, d, "scored")
    old, new = rows.select("item_id", (half() == F.col("y")).alias("a")), rows.select("item_id", ((F.col("score_b") >= 0.5) == F.col("y")).alias("b"))
    return old.join(new, "item_id").agg(F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"))


@register("joi18_label_map", "SELECT sha256(d.text) AS key, max(CASE WHEN d.lang = 'en' THEN l.toxic END) AS en, max(CASE WHEN d.lang = 'de' THEN l.toxic END) AS de, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def label_map(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.sha2("text", 256).alias("key"), "lang", "toxic")
    named = rows.groupBy("key", "lang").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    maps = named.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "toxic"))).alias("m"), F.sum("n").alias("n"))
    return maps.select("key", F.col("m")["en"].alias("en"), F.col("m")["de"].alias("de"), "n")


@register("joi22_annotated_sets", "SELECT d.doc_id, CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'ambiguous' WHEN l.toxic = 1 THEN 'excluded' ELSE 'keep' END AS decision FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def annotated(spark, d):
    decision = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "ambiguous").when(F.col("toxic") == 1, "excluded").otherwise("keep")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", decision.alias("decision"))


@register("joi21_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


STANCE = "CASE WHEN stance = 'reports' AND NOT source_attributed THEN 'unclear' WHEN stance = 'quotes_to_condemn' AND NOT quote_present THEN 'unclear' ELSE stance END"
FLAG = "relation IS NOT NULL AND type_list <> '' AND pathway_list <> '' AND affiliation IN ('AFF-1', 'AFF-2', 'AFF-3') AND exclusion IS NULL"
LADDER = "CASE WHEN relation = 'SV-REL-2' AND (cta = 'explicit' OR modal IN ('future', 'imperative')) THEN 3 WHEN pathway_list LIKE '%HP-03%' AND identifiable_person THEN 3 WHEN relation = 'SV-REL-2' OR high_reach THEN 2 WHEN relation = 'SV-REL-5' AND (identifiable_person OR target = 'individual') THEN 2 WHEN mentions_minor THEN 2 ELSE 1 END"
NAMES = "CASE {} WHEN 3 THEN 'urgent' WHEN 2 THEN 'high' WHEN 1 THEN 'standard' ELSE 'none' END"
FINAL = f""", a AS (SELECT *, {STANCE} AS s2, possible_minor OR ((element_a IN ('likely', 'possible') OR act_list <> '' OR relation IS NOT NULL OR sv_signal) AND (age_indicator OR mentions_minor)) AS r FROM assessed),
f AS (SELECT *, NOT r AND {FLAG} AND s2 NOT IN ('reports', 'quotes_to_condemn') AS flagged,
  greatest({LADDER}, CASE model_priority WHEN 'urgent' THEN 3 WHEN 'high' THEN 2 ELSE 1 END) AS rank FROM a),
p AS (SELECT *, CASE WHEN r THEN 'urgent' WHEN flagged THEN {NAMES.format('rank')} ELSE 'none' END AS priority FROM f),
o AS (SELECT *, CASE WHEN r THEN 'restricted_escalation' WHEN NOT flagged THEN 'not_flagged' WHEN priority = 'urgent' OR (element_a = 'likely' AND element_b = 'likely' AND relation IN ('SV-REL-2', 'SV-REL-5') AND (identifiable_person OR modal IN ('future', 'imperative') OR cta <> 'none')) THEN 'priority_review' ELSE 'standard_review' END AS route,
  (lead OR s2 IN ('reports', 'quotes_to_condemn') OR coalesce(exclusion, '') = 'B2-3') AND coalesce(exclusion, '') NOT IN ('B2-1', 'B2-2', 'B2-4', 'B2-5') AND NOT flagged AND NOT r AS final_lead,
  CASE WHEN r THEN 'unclear' WHEN element_c = 'likely' THEN 'present' WHEN element_c IN ('possible', 'unclear') THEN 'unclear' ELSE 'absent' END AS conflict_link FROM p)"""


def assessed(spark, d):
    """The stand-in assessments with their lists of ids as arrays."""
    of = lambda name: F.filter(F.split(name, ","), lambda x: x != "")
    lists = {"types": "type_list", "pathways": "pathway_list", "named_acts": "act_list", "cited_ids": "cited_list", "secondary": "secondary_list"}
    return view(spark, d, "assessed").withColumns({k: of(v) for k, v in lists.items()})


@register("rul01_flag_rule", sql("assessed", body=f" SELECT item_id, coalesce({FLAG} AND stance NOT IN ('reports', 'quotes_to_condemn'), false) AS flagged FROM assessed"))
def flags(spark, d):
    rows = R.decide(assessed(spark, d).withColumn("restricted", F.lit(False)).withColumn("new_stance", F.col("stance")), R.FLAG_RULES)
    return rows.select("item_id", "flagged")


@register("rul02_rule_priority", sql("assessed", body=f" SELECT item_id, {NAMES.format(LADDER)} AS priority FROM assessed"))
def ladder(spark, d):
    """The ladder as a table of rules, read back and applied."""
    return R.decide(assessed(spark, d), R.rules_of(R.rule_table(spark, R.PRIORITY_RULES))).select("item_id", F.col("rule_priority").alias("priority"))


@register("rul03_finalize", sql("assessed", body=FINAL + """ SELECT item_id, r AS restricted, CASE WHEN r THEN CASE WHEN possible_minor THEN 'model' ELSE 'rule_age' END END AS restricted_reason, CASE WHEN NOT r THEN relation END AS relation, CASE WHEN NOT r THEN content END AS content, CASE WHEN NOT r THEN s2 END AS stance, flagged, final_lead, priority, route, conflict_link, r OR relation IS NOT NULL AS in_scope, CASE WHEN NOT r AND item_id % 7 > 4 THEN cited_list ELSE '' END AS invalid,
  concat_ws('; ', CASE WHEN r AND NOT possible_minor THEN 'restricted by rule' END, CASE WHEN NOT r AND s2 <> stance THEN 'stance unclear' END, CASE WHEN NOT r AND (route <> model_route OR priority <> model_priority) THEN 'route ' || model_route || '/' || model_priority || ' -> ' || route || '/' || priority END) AS notes FROM o"""))
def finalized(spark, d):
    rows = R.finalize(assessed(spark, d), [f"SV-REL-{k}" for k in range(1, 6)])
    return rows.withColumn("invalid", F.array_join("invalid_ids", ",")).drop("invalid_ids")


RELATION = "CASE {} WHEN 'SV-REL-2' THEN 'threat_incitement' WHEN 'SV-REL-4' THEN 'glorification' WHEN 'SV-REL-5' THEN 'stigmatization' ELSE 'unverified_sv_claim' END"


@register("rul04_short_labels", sql("assessed", body=FINAL + f" SELECT item_id, CASE WHEN flagged THEN concat_ws(',', {RELATION.format('relation')}, CASE WHEN secondary_list <> '' AND relation <> secondary_list THEN {RELATION.format('secondary_list')} END, CASE WHEN s2 = 'mocks' THEN 'mockery_dark_humor' END, CASE WHEN pathway_list LIKE '%HP-03%' THEN 'victim_identification' END, CASE WHEN type_list = 'HI-TYPE-02' THEN 'denial_or_disinformation' END) ELSE '' END AS labels FROM o"))
def short_labels(spark, d):
    return R.short_labels(assessed(spark, d)).select("item_id", F.array_join("labels", ",").alias("labels"))


@register("rul07_finalize_scores", sql("assessed", body=", e AS (SELECT *, sexual OR relation IS NOT NULL OR score_1 >= 50 OR score_2 >= 50 AS el FROM assessed), q AS (SELECT *, CASE WHEN possible_minor THEN 'model' WHEN el AND age_indicator THEN 'rule_age' WHEN el AND exposes_identity THEN 'rule_visual' END AS rr FROM e) SELECT item_id, rr AS restricted_reason, CASE WHEN rr IS NULL THEN score_1 END AS score_1, CASE WHEN rr IS NULL THEN score_2 END AS score_2, CASE WHEN rr IS NULL THEN sexual ELSE true END AS sexual, CASE WHEN rr IS NULL AND sexual THEN relation END AS relation, rr IS NULL AND NOT sexual AND relation IS NOT NULL AS cleared FROM q"))
def scores_final(spark, d):
    return R.finalize_scores(view(spark, d, "assessed"), F.col("exposes_identity"))


@register("rul08_finalize_compact", sql("assessed", body=f", a AS (SELECT *, CASE WHEN stance = 'reports' AND NOT source_attributed THEN 'unclear' ELSE stance END AS s2, possible_minor OR (relation IS NOT NULL AND age_indicator) AS r FROM assessed), f AS (SELECT *, NOT r AND {FLAG} AND s2 NOT IN ('reports', 'quotes_to_condemn') AS fl FROM a) SELECT item_id, r AS restricted, fl AS flagged, CASE WHEN r THEN 'restricted_escalation' WHEN NOT fl THEN 'not_flagged' WHEN relation = 'SV-REL-2' OR (relation = 'SV-REL-5' AND identifiable_person) THEN 'priority_review' ELSE 'standard_review' END AS route, (s2 IN ('reports', 'quotes_to_condemn') OR coalesce(exclusion, '') = 'B2-3') AND coalesce(exclusion, '') NOT IN ('B2-1', 'B2-2', 'B2-4', 'B2-5') AND NOT fl AND NOT r AS final_lead FROM f"))
def compact(spark, d):
    return R.finalize_compact(assessed(spark, d))


@register("rul09_judge_route", sql("assessed", body=" SELECT item_id, CASE WHEN possible_minor THEN 'restricted_escalation' WHEN sexual AND coalesce(relation, '') IN ('SV-REL-2', 'SV-REL-5') THEN 'priority_review' WHEN sexual THEN 'standard_review' ELSE 'not_flagged' END AS route FROM assessed"))
def judge_routes(spark, d):
    return view(spark, d, "assessed").select("item_id", R.judge_route(F.col("possible_minor"), F.col("sexual"), F.col("relation")).route.alias("route"))


@register("rul11_restriction", sql("assessed", body=" SELECT item_id, possible_minor AS restricted, CASE WHEN NOT possible_minor THEN score_1 END AS score_1, CASE WHEN NOT possible_minor THEN relation END AS relation, CASE WHEN possible_minor THEN 'modality,restricted' ELSE 'modality,summary' END AS kept FROM assessed"))
def restriction(spark, d):
    details = F.create_map(F.lit("modality"), F.lit("text"), F.lit("summary"), F.col("content"))
    rows = view(spark, d, "assessed").select("item_id", "possible_minor", F.lit(False).alias("restricted"), "score_1", "relation", details.alias("details"))
    return R.apply_restriction(rows).select("item_id", "restricted", "score_1", "relation", F.array_join(F.array_sort(F.map_keys("details")), ",").alias("kept"))


@register("rul12_safety", "SELECT event_id, concat_ws(',', CASE WHEN value / 40 >= 0.3 THEN 'falconsai' END, CASE WHEN value / 60 >= 0.7 THEN 'adamcodd' END, CASE WHEN value / 80 >= 0.9 THEN 'clip_explicit' END) AS reasons, coalesce(value / 40 >= 0.3, false) OR coalesce(value / 60 >= 0.7, false) OR coalesce(value / 80 >= 0.9, false) AS quarantine, coalesce(event_id % 5 < 4 AND value / 50 >= 0.7, false) AS child_visual FROM events")
def safety(spark, d):
    v = F.col("value")
    s = R.safety({"falconsai": v / 40, "adamcodd": v / 60, "clip_explicit": v / 80, "clip_child": F.when(F.col("event_id") % 5 < 4, v / 50)})
    return table(spark, d, "events").select("event_id", F.array_join(s.reasons, ",").alias("reasons"), s.quarantine.alias("quarantine"), s.child_visual.alias("child_visual"))


@register("rul13_confidence", "WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) SELECT event_id, CASE WHEN k % 3 = 0 THEN k / 100.0 WHEN k % 3 = 1 THEN CASE WHEN k > 50 THEN 0.9 ELSE 0.4 END ELSE coalesce(greatest(k, CAST(floor(value) AS INTEGER)) / 100.0, 0) END AS confidence FROM k")
def confidences(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    details = F.when(k % 3 == 0, F.to_json(F.struct((k / 100).alias("p")))).when(k % 3 == 1, F.to_json(F.struct(F.when(k > 50, "high").otherwise("low").alias("level")))).otherwise("{}")
    return table(spark, d, "events").select("event_id", R.confidence(details, k, F.floor("value").cast("int")).alias("confidence"))


@register("rul14_screening_outcome", "SELECT p.page_id, CASE WHEN l.doc_id IS NULL THEN 'unavailable' WHEN l.doc_id % 41 = 0 THEN 'restricted' WHEN l.toxic = 1 THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM pages p LEFT JOIN labels l ON p.page_id = l.doc_id")
def outcomes(spark, d):
    rows = table(spark, d, "pages").select("page_id").join(table(spark, d, "labels").withColumnRenamed("doc_id", "page"), F.col("page_id") == F.col("page"), "left")
    outcome = F.when(F.col("page").isNull(), "unavailable").when(F.col("page") % 41 == 0, "restricted").when(F.col("toxic") == 1, "flagged").otherwise("not_flagged")
    return rows.select("page_id", outcome.alias("outcome"))


@register("rul15_review_decision", "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'YES' ELSE 'NO' END AS decision FROM labels")
def decision(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "YES").otherwise("NO").alias("decision"))


@register("rul16_invariants", sql("assessed", body=FINAL + " SELECT sum(CASE WHEN r AND priority <> 'urgent' THEN 1 ELSE 0 END) AS restricted_not_urgent, sum(CASE WHEN flagged AND final_lead THEN 1 ELSE 0 END) AS flagged_leads, sum(CASE WHEN flagged AND priority = 'none' THEN 1 ELSE 0 END) AS flagged_without_priority, 0 AS content_on_restricted, count(*) AS n FROM o"))
def invariants(spark, d):
    c = F.col
    return R.finalize(assessed(spark, d)).agg(F.count_if(c("restricted") & (c("priority") != "urgent")).alias("restricted_not_urgent"), F.count_if(c("flagged") & c("final_lead")).alias("flagged_leads"), F.count_if(c("flagged") & (c("priority") == "none")).alias("flagged_without_priority"), F.count_if(c("restricted") & (c("content").isNotNull() | c("relation").isNotNull())).alias("content_on_restricted"), F.count("*").alias("n"))


@register("rul16_rule_invariants", sql("assessed", body=""", p AS (SELECT *, model_route IN ('standard_review', 'priority_review') AS up, CASE model_priority WHEN 'urgent' THEN 3 WHEN 'high' THEN 2 WHEN 'standard' THEN 1 ELSE 0 END AS rank FROM assessed)
SELECT sum(CASE WHEN possible_minor THEN 1 ELSE 0 END) AS minor_not_restricted, 0 AS content_on_restricted,
  sum(CASE WHEN up AND NOT (relation IS NOT NULL AND type_list <> '' AND pathway_list <> '' AND affiliation IN ('AFF-1', 'AFF-2', 'AFF-3') AND exclusion IS NULL) THEN 1 ELSE 0 END) AS flagged_without_axes,
  sum(CASE WHEN up AND stance IN ('reports', 'quotes_to_condemn') THEN 1 ELSE 0 END) AS reporting_flagged, sum(CASE WHEN up AND rank > 1 THEN 1 ELSE 0 END) AS priority_lowered, count(*) AS n FROM p"""))
def rule_invariants(spark, d):
    """What would be broken if a model's own routes were taken, all at standard priority."""
    rows = assessed(spark, d).withColumn("route", F.col("model_route")).withColumn("priority", F.lit("standard"))
    return R.broken_invariants(rows)


@register("rul17_field_agreement", sql("assessed", body=FINAL + ", u AS (SELECT 'route' AS field, route = model_route AS ok FROM o UNION ALL SELECT 'priority', priority = model_priority FROM o) SELECT field, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS agree, count(*) AS n FROM u GROUP BY field"))
def agreement(spark, d):
    rows = R.finalize(assessed(spark, d)).join(view(spark, d, "assessed").select("item_id", "model_route", "model_priority"), "item_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) == F.col(f"model_{f}")).alias("ok")) for f in ("route", "priority")])
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.field").alias("field")).agg(F.count_if("p.ok").alias("agree"), F.count("*").alias("n"))


FIELDS = {
    "flag": ("item_id % 3 > 0", "route IN ('priority_review', 'standard_review')"), "route": ("model_route", "route"), "priority": ("model_priority", "priority"),
    "lead": ("CASE WHEN item_id % 2 = 0 THEN item_id % 4 = 0 END", "final_lead"), "exclusion": ("CASE WHEN item_id % 26 = 0 THEN 'B2-1' END", "exclusion"),
    "affiliation": ("CASE WHEN item_id % 5 < 3 THEN 'AFF-1' END", "affiliation"), "ft_quote_present": ("item_id % 6 = 0", "quote_present"), "possible_minor": ("CASE WHEN item_id % 41 < 2 THEN true END", "possible_minor"),
    "element_a": ("'likely'", "element_a"),
}
STACKED = " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(({got}) = ({want}), false) AS ok FROM o WHERE ({want}) IS NOT NULL" for f, (want, got) in FIELDS.items())


@register("rul17_all_fields", sql("assessed", body=FINAL + f""", u AS ({STACKED} UNION ALL SELECT 'types', contains(',' || type_list || ',', ',HI-TYPE-04,') FROM o WHERE item_id % 2 = 0
UNION ALL SELECT 'low_confidence', least(confidence_a, confidence_b) < 0.7 FROM o WHERE item_id % 10 < 5) SELECT field, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS agree, count(*) AS n FROM u GROUP BY field"""))
def all_fields(spark, d):
    """Decisions and assessments against labels that each specify some of the fields."""
    rows = assessed(spark, d)
    own = rows.select("item_id", "exclusion", "affiliation", "types", "possible_minor", "element_a", "confidence_a", "confidence_b", "model_route", "model_priority", F.col("quote_present").alias("ft_quote_present"))
    rows = R.finalize(rows).select("item_id", "route", "priority", F.col("final_lead").alias("lead")).join(own, "item_id")
    expected = [F.expr(want).alias(f) for f, (want, _) in FIELDS.items()] + [F.expr("CASE WHEN item_id % 2 = 0 THEN array('HI-TYPE-04') END").alias("types"), F.expr("item_id % 10 < 5").alias("low_confidence")]
    return R.agreement(rows.select(F.struct(*(c for c in rows.columns if not c.startswith("model_"))).alias("got"), F.struct(*expected).alias("expected")))


@register("rul18_modality_route", sql("assessed", body=" SELECT item_id, CASE WHEN score_1 >= 90 THEN CASE WHEN identifiable_person THEN 'restricted_escalation' ELSE 'explicit_alert' END WHEN confidence_a < 0.2 THEN 'filtered_out' WHEN lead THEN 'judge_error' WHEN possible_minor THEN 'restricted_escalation' WHEN sexual AND coalesce(relation, '') IN ('SV-REL-2', 'SV-REL-5') THEN 'priority_review' WHEN sexual THEN 'standard_review' ELSE 'not_flagged' END AS route FROM assessed"))
def modality_routes(spark, d):
    c = F.col
    row = R.modality_row(c("score_1") >= 90, c("identifiable_person"), c("confidence_a"), 0.2, c("lead"), c("possible_minor"), c("sexual"), c("relation"))
    return view(spark, d, "assessed").select("item_id", row.route.alias("route"))


@register("rul19_true_probability", "SELECT event_id, (exp(-value / 50) + exp(-value / 30)) / (exp(-value / 50) + exp(-value / 30) + exp(-value / 20)) AS p_true FROM events")
def probability(spark, d):
    one = lambda t, k: F.struct(F.lit(t).alias("token"), (-F.col("value") / k).alias("logprob"))
    return table(spark, d, "events").select("event_id", R.true_probability(F.array(one(" true", 50), one("True", 30), one("false", 20), one("maybe", 10))).alias("p_true"))


@register("rul20_category_gate", sql("assessed", body=" SELECT item_id, CASE WHEN sexual THEN relation END AS category FROM assessed"))
def gate(spark, d):
    return view(spark, d, "assessed").select("item_id", F.when(F.col("sexual"), F.col("relation")).alias("category"))


@register("snk01_constraint_violations", sql("assessed", body=" SELECT item_id FROM assessed WHERE (possible_minor AND (score_1 IS NOT NULL OR relation IS NOT NULL OR sexual IS NOT NULL)) OR score_1 > 100"))
def broken(spark, d):
    rows = view(spark, d, "assessed").select("item_id", F.col("possible_minor").alias("restricted"), "score_1", "relation", "sexual", F.col("model_route").alias("route"))
    return R.violations(rows).select("item_id")


@register("ml07_frozen_filter_mix", sql("scored", body=f", m AS (SELECT y, judge, score FROM scored WHERE item_id % 2 = 0 UNION ALL SELECT y, judge, score FROM scored WHERE item_id % 2 = 1 AND NOT y), c AS (SELECT {counts(predicted='score >= 0.4')} FROM m) SELECT tp, fp, fn, tn, n, {RATES} FROM c"))
def frozen_mix(spark, d):
    rows = view(spark, d, "scored")
    mixed = rows.where("item_id % 2 = 0").unionByName(rows.where("item_id % 2 = 1 AND NOT y"))
    return E.metrics(mixed, F.col("score") >= 0.4)


@register("ml09_leave_one_out", "SELECT a.item_id, count(*) AS others, string_agg(CAST(b.item_id AS VARCHAR), ',' ORDER BY b.item_id) AS shots FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id GROUP BY a.item_id")
def leave_one_out(spark, d):
    """Every labelled example with all the others: the whole list once, less the row's own id, so nothing is paired."""
    shots = table(spark, d, "benchmark").agg(F.array_sort(F.collect_list("item_id")).alias("all_ids"))
    rows = table(spark, d, "benchmark").select("item_id").join(F.broadcast(shots))
    others = F.array_except("all_ids", F.array("item_id"))
    return rows.select("item_id", F.size(others).cast("long").alias("others"), F.array_join(others.cast("array<string>"), ",").alias("shots"))



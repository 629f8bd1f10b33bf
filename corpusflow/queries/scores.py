"""Queries over scored tables: ``embeddings`` plays logits / representations
(the vector = logits, of which labels name one, ``vec_id % 3`` = layer),
``labels`` gives token targets (absent row = ignored), ``events`` is the metric log."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import vectors as V
from corpusflow.operators.evaluation import (
    accuracy,
    cross_entropy,
    draw_from_probs,
    feature_covariance,
    feature_rank,
    last_position,
    masked_token_loss,
    mean_rank,
    metric_rollup,
    softmax_temperature,
    top_k_mask,
)
from corpusflow.operators.probes import covariance_tiles, fit_probes
from corpusflow.operators.splits import split_fraction
from corpusflow.plans.catalog import table
from corpusflow.queries import sql
from corpusflow.queries.registry import register
from corpusflow.session import materialise

N_BATCHES = 4
METRICS = ("click", "error", "purchase", "signup", "view")
EMB_SQL = """emb AS (SELECT vec_id, vec_id % 3 AS layer, embedding AS logits,
  CAST(embedding AS DOUBLE[]) AS dlogits, label FROM embeddings)"""


def emb(spark, base):
    return table(spark, base, "embeddings").select(
        "vec_id",
        F.pmod("vec_id", F.lit(3)).alias("layer"),
        "embedding",
        F.col("embedding").alias("logits"),
        "label",
    )


@register(
    "accuracy",
    f"""WITH {EMB_SQL}
SELECT layer, count(*) AS n, round(avg(CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy
FROM emb GROUP BY layer""",
)
def q_accuracy(spark, base):
    a = accuracy(emb(spark, base), "logits", "label", ["layer"])
    return a.select("layer", "n", (F.round("accuracy", 6) + F.lit(0.0)).alias("accuracy"))


@register(
    "accuracy_last_position",
    f"""WITH {EMB_SQL}, e AS (SELECT layer, vec_id // 12 AS example, arg_max(logits, vec_id) AS logits, arg_max(label, vec_id) AS label FROM emb GROUP BY ALL)
SELECT layer, count(*) AS n, round(avg(CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy
FROM e GROUP BY layer""",
)
def q_accuracy_last_position(spark, base):
    # twelve vectors are four positions of an example in each of three layers
    scored = emb(spark, base).withColumn("example", F.floor(F.col("vec_id") / 12))
    last = last_position(scored, ["layer", "example"], "vec_id", ["logits", "label"])
    a = accuracy(last, "logits", "label", ["layer"])
    return a.select("layer", "n", (F.round("accuracy", 6) + F.lit(0.0)).alias("accuracy"))


LSE = "(list_max(dlogits) + ln(list_sum(list_transform(dlogits, lambda x: exp(x - list_max(dlogits))))))"


@register(
    "cross_entropy",
    f"""WITH {EMB_SQL}
SELECT layer, count(*) AS n, round(avg({LSE} - dlogits[label + 1]), 6) + 0.0 AS loss FROM emb GROUP BY layer""",
)
def q_cross_entropy(spark, base):
    c = cross_entropy(emb(spark, base), "logits", "label", ["layer"])
    return c.select("layer", "n", (F.round("loss", 6) + F.lit(0.0)).alias("loss"))


@register(
    "masked_token_loss",
    f"""WITH {EMB_SQL}, t AS (SELECT e.*, coalesce(l.quality, -1) AS target FROM emb e LEFT JOIN labels l ON l.doc_id = e.vec_id)
SELECT layer, count(*) AS n_tokens, CAST(sum(CASE WHEN target <> -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_unmasked,
  round(sum(CASE WHEN target <> -1 THEN {LSE} - dlogits[target + 1] ELSE 0.0 END) / sum(CASE WHEN target <> -1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS loss
FROM t GROUP BY layer""",
)
def q_masked_token_loss(spark, base):
    labels = table(spark, base, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    scored = emb(spark, base).join(labels, "vec_id", "left").withColumn(
        "target", F.coalesce("quality", F.lit(-1))
    )
    m = masked_token_loss(scored, "logits", "target", ["layer"])
    return m.select("layer", "n_tokens", "n_unmasked", (F.round("loss", 6) + F.lit(0.0)).alias("loss"))


def _softmax_sql(t: float) -> str:
    return (f"list_transform(list_transform(dlogits, lambda x: exp((x - list_max(dlogits)) / {t!r})), "
            f"lambda y: y / list_sum(list_transform(dlogits, lambda x: exp((x - list_max(dlogits)) / {t!r}))))")


@register(
    "softmax_temperature",
    f"""WITH {EMB_SQL}, p AS (SELECT vec_id, {_softmax_sql(0.7)} AS probs FROM emb)
SELECT vec_id, round(list_max(probs), 6) + 0.0 AS p_max, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS p_argmax,
  round(list_sum(probs), 6) + 0.0 AS p_sum FROM p""",
)
def q_softmax_temperature(spark, base):
    p = softmax_temperature(emb(spark, base), "logits", 0.7)
    return p.select(
        "vec_id",
        (F.round(F.array_max("probs"), 6) + F.lit(0.0)).alias("p_max"),
        V.argmax(F.col("probs")).alias("p_argmax"),
        (F.round(V.array_sum(F.col("probs")), 6) + F.lit(0.0)).alias("p_sum"),
    )


@register(
    "draw_from_probs",
    f"""WITH {EMB_SQL}, p AS (SELECT vec_id, {_softmax_sql(1.0)} AS probs FROM emb),
u AS (SELECT vec_id, probs, {sql.hash_uniform(31, 'vec_id')} * list_sum(probs) AS t FROM p)
SELECT vec_id, CAST(coalesce(list_position(list_transform(range(1, len(probs) + 1), lambda k: list_sum(probs[1:k]) > t), true) - 1,
  len(probs) - 1) AS BIGINT) AS draw FROM u""",
)
def q_draw_from_probs(spark, base):
    p = softmax_temperature(emb(spark, base), "logits", 1.0)
    return draw_from_probs(p, "probs", "vec_id", 31).select("vec_id", "draw")


@register(
    "top_k_mask",
    f"""WITH {EMB_SQL}, k AS (SELECT vec_id, dlogits, list_reverse_sort(dlogits)[least(3, len(dlogits))] AS thr FROM emb)
SELECT vec_id, CAST(len(list_filter(dlogits, lambda x: x >= thr)) AS BIGINT) AS n_kept,
  round(list_sum(list_filter(dlogits, lambda x: x >= thr)), 4) + 0.0 AS kept_sum FROM k""",
)
def q_top_k_mask(spark, base):
    m = top_k_mask(emb(spark, base).withColumn("d", V.as_double(F.col("logits"))), "d", 3, "masked")
    kept = F.filter("masked", lambda x: x > F.lit(float("-inf")))
    return m.select(
        "vec_id", F.size(kept).cast("long").alias("n_kept"), (F.round(V.array_sum(kept), 4) + F.lit(0.0)).alias("kept_sum")
    )


@register(
    "feature_covariance",
    """WITH u AS (SELECT vec_id, vec_id % 3 AS layer, generate_subscripts(embedding, 1) - 1 AS i,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT a.layer, CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov
FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.layer, a.i, b.i""",
)
def q_feature_covariance(spark, base):
    cov = feature_covariance(emb(spark, base), "embedding", ["layer"])
    return cov.select(
        "layer", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n",
        (F.round("cov", 6) + F.lit(0.0)).alias("cov"),
    )


@register("feature_rank")
def q_feature_rank(spark, base):
    # a batch of representations per layer, ranked on its own; every batch counts in the mean
    reps = emb(spark, base).withColumn("batch", F.pmod(F.floor(F.col("vec_id") / 3), F.lit(N_BATCHES)))
    tiles = covariance_tiles(reps, "embedding", ["layer", "batch"])
    return mean_rank(feature_rank(tiles, ["layer", "batch"]), ["layer"])


@register("linear_probe")
def q_linear_probe(spark, base):
    # every step of every layer's probe; the validation row of the step that is kept has is_best
    data = materialise(split_fraction(emb(spark, base), "vec_id", 0.8, 2357), "probe-split")
    out = fit_probes(data, "embedding", "label", ["layer"]).accuracies
    return out.withColumn("accuracy", F.round("accuracy", 6) + F.lit(0.0))


@register(
    "metric_rollup",
    "SELECT CAST(ts AS DATE) AS day, "
    + ", ".join(
        f"max_by(value, struct_pack(ts := ts, id := event_id)) FILTER (WHERE event_type = '{n}') AS {n}" for n in METRICS
    )
    + " FROM events GROUP BY day",
)
def q_metric_rollup(spark, base):
    log = table(spark, base, "events").withColumn("day", F.to_date("ts")).withColumn("at", F.struct("ts", "event_id"))
    return metric_rollup(log, "day", "event_type", "value", "at", METRICS)

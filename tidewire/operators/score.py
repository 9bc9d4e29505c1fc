"""Ranking score of events and the publishing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import CENSUS, CONSERVATIVE, PROGRESSIVE, TOPIC_MULTIPLIERS
from tidewire.functions.text import capitalised


def _hours(a: Column, b: Column) -> Column:
    """Hours from b to a."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def topic_product(topics: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOPIC_MULTIPLIERS.items() for x in kv])
    weight = lambda t: F.coalesce(F.try_element_at(table, capitalised(t)), F.lit(1.0))
    return F.aggregate(F.coalesce(topics, F.array().cast("array<string>")), F.lit(1.0), lambda acc, t: acc * weight(t))


def impact_multiplier(i: Column) -> Column:
    return F.when(i < 30, 0.01 + 0.09 * i / 30).when(i < 50, 0.1 + 0.7 * (i - 30) / 20).otherwise(0.8 + 2.2 * (i - 50) / 50)


def spectrum_score(events: DataFrame, as_of: Column) -> DataFrame:
    """Adds hot_score, insights (sorted) and blind_side to events.

    Columns: editorial_score, n_sources (0 if unknown), article_count, first_article_date, created_at, topics, ai_impact,
    is_international, clickbait (mean), supportive, critical, independent (counts), biases (the outlets' biases).
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.when(zero("n_sources") > 0, F.col("n_sources")).otherwise(zero("article_count"))
    age = F.greatest(F.lit(0.0), _hours(as_of, F.coalesce("first_article_date", "created_at")))
    x = events.withColumn("_age", age).withColumn("_raw", F.coalesce(F.nullif(F.col("ai_impact"), F.lit(0)), F.lit(10)).cast("double"))
    x = x.withColumn("_impact", F.when(F.coalesce("is_international", F.lit(False)) & (F.col("_raw") < 70), F.col("_raw") * 0.85).otherwise(F.col("_raw")))
    score = F.when(zero("editorial_score") > 0, 40 * F.log1p("editorial_score")).otherwise(0.0) + 100 * F.log1p(n.cast("double"))
    score = score + F.when(F.col("_age") < 72, 150 * F.pow(F.lit(0.5), F.col("_age") / 3)).otherwise(-0.1 * F.col("_age"))
    score = score * topic_product(F.col("topics")) * impact_multiplier(F.col("_impact"))
    score = score / F.when(F.col("_age") > 6, 1 + 0.05 * F.pow(F.col("_age") - 6, 1.5)).otherwise(1.0)
    bait = F.coalesce(F.col("clickbait") > 0.7, F.lit(False))
    contested = (zero("supportive") > 1) & (zero("critical") > 1)
    independent = zero("independent") >= 2
    biases = F.coalesce("biases", F.array().cast("array<string>"))
    prog, cons, cent = (F.arrays_overlap(biases, F.array(*map(F.lit, g))) for g in (PROGRESSIVE, CONSERVATIVE, CENSUS))
    enough = zero("article_count") >= 2
    side = F.when(enough & prog & ~cons & ~cent, "BS_RIGHT").when(enough & cons & ~prog & ~cent, "BS_LEFT").when(enough & prog & cons & ~cent, "BS_CENTER")
    for cond, factor in ((bait, 0.7), (contested, 1.15), (independent, 1.1), (prog & cons, 1.25), (cent, 1.1), (prog & cons & cent, 1.3), (side.isNotNull(), 1.2)):
        score = score * F.when(cond, factor).otherwise(1.0)
    breaking = ((F.col("_age") < 6) & (F.col("_impact") >= 60)) | (F.col("_age") < 2)
    marks = [(bait, "CLICKBAIT_RISK"), (F.col("_impact") >= 80, "HIGH_IMPACT"), (F.col("_impact") <= 30, "LOW_IMPACT"), (breaking, "BREAKING"), (contested, "CONTROVERSIAL"), (independent, "INDEPENDENT_COVERAGE"), (prog & cons, "CROSS_BUBBLE"), (prog & cons & cent, "FULL_SPECTRUM"), (side.isNotNull(), "BLIND_SPOT")]
    insights = F.array_sort(F.array_compact(F.array(*[F.when(c, name) for c, name in marks], side)))
    blind = F.when(side == "BS_RIGHT", "right").when(side == "BS_LEFT", "left").when(side == "BS_CENTER", "center")
    return x.select(*events.columns, F.greatest(F.lit(0.0), F.round(score, 2)).alias("hot_score"), insights.alias("insights"), blind.alias("blind_side"))


#: Topics that need volume or impact, as they are written.
SOFT_TOPICS = ("Lifestyle", "Entertainment", "Nature", "Sports")


def publish_gate(scored: DataFrame, as_of: Column, soft_topics: tuple[str, ...] = SOFT_TOPICS) -> DataFrame:
    """Adds decision and reason.

    ``collision`` is what the collision check (R9) found: WAITING for an open proposal, AUTO or PROPOSE for a published
    event within reach, else null.
    """
    has = lambda k: F.array_contains("insights", k)
    strong = has("BREAKING") | has("HIGH_IMPACT")
    soft = F.exists("topics", lambda t: t.isin(list(soft_topics)))
    n = F.coalesce("article_count", F.lit(0))
    cases = [
        (~F.coalesce("is_active", F.lit(False)), "IGNORE", "inactive"),
        (F.col("first_article_date") > as_of + F.expr("make_dt_interval(0, 1)"), "WAIT", "future"),
        (F.col("collision") == "WAITING", "WAIT", "collision"),
        (F.col("collision") == "AUTO", "MERGE", "collision"),
        (F.col("collision") == "PROPOSE", "PROPOSE", "collision"),
        (soft & ~strong & (n < 5), "WAIT", "topic"),
        (~strong & ~has("BLIND_SPOT") & (n < 2), "WAIT", "volume"),
    ]
    decision, reason = None, None
    for cond, d, r in cases:
        decision = F.when(cond, d) if decision is None else decision.when(cond, d)
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
    return scored.withColumn("decision", decision.otherwise("PUBLISH")).withColumn("reason", reason)

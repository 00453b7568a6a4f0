"""Lane scores from weighted terms, ranking of lanes, the score with its factors and penalties, and age gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack import config
from tidewrack.functions.dates import age_hours
from tidewrack.functions.text import count_term, floor_round, lower

HEAD = 1200


def term_hits(low_title: Column, low_body: Column, terms: dict[str, float]) -> Column:
    """Array of struct(term, gain): each term found gains its weight, twice if in the title, times 1 + ln(count). Every term is
    a literal pattern, compiled once."""
    found = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight"), count_term(low_title, t).alias("head"), count_term(low_body, t).alias("rest")) for t, w in terms.items()])
    hits = F.filter(found, lambda x: x["head"] + x["rest"] > 0)
    gain = lambda x: x["weight"] * F.when(x["head"] > 0, 2.0).otherwise(1.0) * (1 + F.log((x["head"] + x["rest"]).cast("double")))
    return F.transform(hits, lambda x: F.struct(x["term"].alias("term"), gain(x).alias("gain")))


def lane_scores(items: DataFrame, lexicon: dict[str, dict[str, float]] | None = None, hints: dict[str, Column] | None = None, saturation: float = config.SATURATION, head: int | None = HEAD) -> DataFrame:
    """``items`` (title, body) with lanes: array of struct(order, lane, score, matched), in fixed order. A lane's score is the
    saturated sum of its terms' gains; the first 8 terms found are the evidence. A source's hint for a lane adds a quarter of
    itself, up to 1. Terms count in the first ``head`` characters of a body, or in all of it if that is None. Lower-cased text and hits are columns of their own, so each is worked out once."""
    lexicon, hints = lexicon or config.LANE_TERMS, hints or {}
    body = F.coalesce("body", F.lit(""))
    low = items.withColumns({"low_title_": lower(F.coalesce("title", F.lit(""))), "low_body_": lower(body if head is None else F.substring(body, 1, head))})
    hit = low.withColumns({f"hits_{i}_": term_hits(F.col("low_title_"), F.col("low_body_"), terms) for i, terms in enumerate(lexicon.values())})
    lanes = []
    for i, lane in enumerate(lexicon):
        raw = F.aggregate(f"hits_{i}_", F.lit(0.0), lambda s, x: s + x["gain"])
        score = F.least(F.lit(1.0), raw / (raw + saturation) + F.coalesce(hints.get(lane, F.lit(0.0)), F.lit(0.0)) * 0.25)
        lanes.append(F.struct(F.lit(i).alias("order"), F.lit(lane).alias("lane"), score.alias("score"), F.slice(F.transform(f"hits_{i}_", lambda x: x["term"]), 1, 8).alias("matched")))
    return hit.withColumn("lanes", F.array(*lanes)).drop("low_title_", "low_body_", *[f"hits_{i}_" for i in range(len(lexicon))])


def ranked_lanes(lanes: Column) -> Column:
    """Best first; equal scores keep the fixed order."""
    return F.transform(
        F.array_sort(F.transform(lanes, lambda x: F.struct((-x["score"]).alias("down"), x["order"].alias("order"), x["lane"].alias("lane"), x["score"].alias("score"), x["matched"].alias("matched")))),
        lambda x: F.struct(x["lane"].alias("lane"), x["score"].alias("score"), x["matched"].alias("matched")),
    )


def spread(ranked: Column) -> Column:
    """What the other lanes add up to, at most 0.3."""
    return F.least(F.lit(0.3), F.aggregate(F.slice(ranked, 2, 10), F.lit(0.0), lambda s, x: s + x["score"]))


def by_lane(lane: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(lane == name, float(value)).otherwise(out)
    return out


def recency(published: Column, now: Column, lane: Column) -> Column:
    return F.pow(F.lit(2.0), -age_hours(published, now) / by_lane(lane, config.HALF_LIFE_HOURS))


def best_event(events: Column) -> Column:
    """struct(boost, event): the highest boost, the first of equals."""
    def boost(e: Column) -> Column:
        out = F.lit(0.0)
        for name, value in config.EVENT_BOOSTS.items():
            out = F.when(e == name, value).otherwise(out)
        return out

    numbered = F.transform(events, lambda e, i: F.struct(boost(e).alias("boost"), (-i).alias("first"), e.alias("event")))
    return F.array_max(numbered)


def corroboration(publishers: Column) -> Column:
    return F.when(publishers > 1, F.least(F.lit(1.0), F.log2(publishers.cast("double")) / F.log2(F.lit(5.0))))


def too_old(published: Column, lane: Column, now: Column, academic: Column) -> Column:
    """Undated items pass; journals and preprints have at least the academic limit."""
    most = by_lane(lane, config.MAX_AGE_DAYS)
    most = F.when(academic, F.greatest(most, F.lit(float(config.MAX_AGE_DAYS_ACADEMIC)))).otherwise(most)
    return F.coalesce(age_hours(published, now) / 24 > most, F.lit(False))


def _factor(key: str | Column, raw: Column, weight: float, when: Column) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    return F.when(when, F.struct(name.alias("key"), raw.cast("double").alias("raw"), F.lit(float(weight)).alias("weight"), (raw * weight).cast("double").alias("contribution")))


def score(items: DataFrame, now: Column) -> DataFrame:
    """Adds primary_lane, score (0 to 100, one decimal), factors (largest contribution first) and penalties.

    ``items``: lanes (from ``lane_scores``), title, body, authority, published_at, events, publisher_count, watch_count,
    n_results, n_nct, has_deal, has_phase, has_enrollment, evidence_level, non_mammalian, delivered_before.
    """
    w, p = config.WEIGHTS, config.PENALTIES
    items = items.withColumn("ranked_", ranked_lanes(F.col("lanes"))).withColumn("best_", best_event(F.col("events")))
    first, other = F.element_at("ranked_", 1), spread(F.col("ranked_"))
    lane, always, dated = first["lane"], F.lit(True), F.col("published_at").isNotNull()
    facts = sum((c.cast("int") for c in (F.col("n_results") > 0, F.col("n_nct") > 0, F.col("has_deal"), F.col("has_phase"), F.col("has_enrollment"))), F.lit(0))
    density = F.least(F.lit(1.0), facts / F.lit(3.0))
    factors = F.array(
        _factor(F.concat(F.lit("lane."), lane), first["score"], w["lexicon"], always),
        _factor("laneSpread", other, w["laneSpread"], other > 0.02),
        _factor("authority", F.col("authority"), w["authority"], always),
        _factor("recency", recency(F.col("published_at"), now, lane), w["recency"], dated),
        _factor(F.concat(F.lit("event."), F.col("best_.event")), F.col("best_.boost"), w["event"], F.coalesce(F.col("best_.boost") > 0, F.lit(False))),
        _factor("corroboration", corroboration(F.col("publisher_count")), w["corroboration"], F.col("publisher_count") > 1),
        _factor("watchlist", F.least(F.lit(1.0), 0.6 + 0.2 * F.col("watch_count")), w["watchlist"], F.col("watch_count") > 0),
        _factor("factDensity", density, w["factDensity"], density > 0),
    )
    bench = F.col("evidence_level").isin("preclinical", "in-vitro")
    topical = F.exists("lanes", lambda x: F.size(x["matched"]) > 0)
    minus = lambda key, when: _factor(key, F.lit(1.0), -p[key], F.coalesce(when, F.lit(False)))
    penalties = F.array(
        minus("dateMissing", ~dated),
        minus("offTopic", ~topical),
        minus("staleRepeat", F.col("delivered_before")),
        minus("thinContent", F.length("body") < 200),
        minus("opinionRoundup", F.array_contains("events", "opinion")),
        minus("nonMammalianModel", F.col("non_mammalian")),
        minus("reviewArticle", F.col("evidence_level") == "review"),
        minus("inVitroOnly", F.col("evidence_level") == "in-vitro"),
        minus("preclinicalInClinicalLane", (lane == config.LANES[0]) & bench),
    )
    items = items.withColumns({"primary_lane": lane, "factors": F.filter(factors, lambda x: x.isNotNull()), "penalties": F.filter(penalties, lambda x: x.isNotNull())})
    total = F.aggregate(F.concat("factors", "penalties"), F.lit(0.0), lambda s, x: s + x["contribution"])
    items = items.withColumn("score", floor_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1))
    down = F.array_sort(F.transform("factors", lambda x, i: F.struct((-x["contribution"]).alias("down"), i.alias("i"), x.alias("f"))))
    return items.withColumn("factors", F.transform(down, lambda x: x["f"])).drop("ranked_", "best_")


def keep(score_: Column, priority_hit: Column, threshold: float = config.KEEP_THRESHOLD) -> Column:
    return (score_ >= threshold) | F.coalesce(priority_hit, F.lit(False))

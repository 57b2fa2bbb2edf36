"""Cross-venue divergence against a rolling baseline per pair of venues."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import combinations
from math import fsum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.market import divergence_bps, is_valid_quote, mid
from tickforge.operators.scans import numbered, running_last, running_max_before, with_rows_before
from tickforge.sources.shared import write_shared

#: Observations of a pair that one task scores at once.
BLOCK = 16_384


@dataclass(frozen=True)
class DivergenceRules:
    max_age_us: int = 5_000_000
    ring: int = 600
    warm: int = 30
    min_bps: float = 5.0
    min_zscore: float = 3.0


def accepted_quotes(quotes: DataFrame, order: str) -> DataFrame:
    """Quotes that aren't older than one already seen of their symbol and venue; equal times replace."""
    seen = running_max_before(quotes, ["symbol", "venue"], order, "event_time_us", "__seen")
    return seen.where("__seen is null or event_time_us >= __seen").drop("__seen")


#: Venues that a quote's row is compared with at most.
MOST_VENUES = 64


def venues_of(quotes: DataFrame) -> list[str]:
    """The venues that occur, sorted; they are few, which is checked, so they are brought to the driver."""
    found = [r[0] for r in quotes.where("venue is not null").select("venue").distinct().limit(MOST_VENUES + 1).collect()]
    if len(found) > MOST_VENUES:
        raise ValueError(f"more than {MOST_VENUES} venues")
    return sorted(found)


def pair_observations(quotes: DataFrame, venues: list[str], order: str, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """All fresh pairs at every accepted quote: (symbol, order, venue_a, venue_b, price_a, price_b, bps, times).

    The newest quote per venue is carried forward by a running scan in slices of ``order`` (a unique integer), so no
    join of quotes is needed and a hot symbol stays spread. A pair counts if both quotes are valid and at most
    ``max_age_us`` older than the arriving one.
    """
    state = F.struct("event_time_us", mid("bid_price", "ask_price").alias("mid"), is_valid_quote("bid_price", "ask_price").alias("ok"))
    # a scan reads its input twice, so each is written before the next: else the quotes would be read eight times
    accepted = accepted_quotes(quotes.select("symbol", "venue", order, "event_time_us", "bid_price", "ask_price"), order)
    needed = quotes.sparkSession.read.parquet(write_shared(accepted, "accepted"))
    newest = running_last(needed, ["symbol"], order, {f"v{i}": F.when(F.col("venue") == v, state) for i, v in enumerate(venues)})
    pairs = F.array(*[
        F.struct(F.lit(a).alias("venue_a"), F.lit(b).alias("venue_b"), F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b"))
        for i, a in enumerate(venues) for j, b in enumerate(venues) if a < b
    ])
    fresh = lambda x: F.col(f"p.{x}.ok") & (F.col("event_time_us") - F.col(f"p.{x}.event_time_us") <= rules.max_age_us)
    return (
        newest.withColumn("p", F.explode(pairs)).where(fresh("a") & fresh("b"))
        .select(
            "symbol", order, "p.venue_a", "p.venue_b", F.col("p.a.mid").alias("price_a"), F.col("p.b.mid").alias("price_b"),
            F.least("p.a.event_time_us", "p.b.event_time_us").alias("window_start_us"), F.greatest("p.a.event_time_us", "p.b.event_time_us").alias("event_time_us"),
        )
        .withColumn("divergence_bps", divergence_bps("price_a", "price_b"))
        .where("divergence_bps is not null and not isnan(divergence_bps)")
    )


def scored(observations: DataFrame, order: str, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """Observations with number, mean, deviation and z-score (prior_*, zscore) of the up to ``ring`` observations of their pair before them.

    A pair's observations are numbered and cut into blocks that also see the ``ring`` observations before them, so one
    pair's baseline can be computed by many tasks.
    """
    pair = ["symbol", "venue_a", "venue_b"]
    blocks = with_rows_before(numbered(observations, pair, order, "__number"), "__number", rules.ring, max(rules.ring, BLOCK))
    prior = Window.partitionBy(*pair, "__block").orderBy("__number").rowsBetween(-rules.ring, -1)
    d = F.col("divergence_bps")
    s = blocks.withColumns({"prior_n": F.count(d).over(prior), "prior_mean": F.avg(d).over(prior), "prior_sd": F.stddev_samp(d).over(prior)}).where("not is_halo")
    z = F.when(F.col("prior_n") < 2, None).when(F.col("prior_sd") == 0, 0.0).otherwise((d - F.col("prior_mean")) / F.col("prior_sd"))
    return s.withColumn("zscore", z).drop("__block", "__number", "is_halo")


def divergences(quotes: DataFrame, venues: list[str], order: str, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """Events where a warm baseline, the size and the z-score all say so."""
    observed = quotes.sparkSession.read.parquet(write_shared(pair_observations(quotes, venues, order, rules), "observed"))
    s = scored(observed, order, rules)
    fire = (F.col("prior_n") >= rules.warm) & (F.abs("divergence_bps") >= rules.min_bps) & (F.abs("zscore") >= rules.min_zscore)
    return s.where(fire).drop("prior_n", "prior_mean", "prior_sd")


class Detector:
    """The same detector for one symbol, quote by quote: the newest quote per venue and a ring of observations per pair."""

    def __init__(self, rules: DivergenceRules = DivergenceRules()):
        self.rules = rules
        self.quotes: dict[str, tuple[int, float, bool]] = {}
        self.rings: dict[tuple[str, str], deque[float]] = {}

    def observe(self, venue: str, bid: float, ask: float, event_time_us: int) -> list[tuple]:
        """(venue_a, venue_b, price_a, price_b, bps, zscore, window_start_us, event_time_us) of each event of this quote."""
        known = self.quotes.get(venue)
        if known is not None and known[0] > event_time_us:
            return []
        self.quotes[venue] = (event_time_us, (bid + ask) / 2, 0 < bid <= ask)
        fresh = sorted(v for v, (t, _, ok) in self.quotes.items() if ok and event_time_us - t <= self.rules.max_age_us)
        events = []
        for a, b in combinations(fresh, 2):
            (ta, ma, _), (tb, mb, _) = self.quotes[a], self.quotes[b]
            bps = (mb - ma) / ((ma + mb) / 2) * 10_000
            ring = self.rings.setdefault((a, b), deque(maxlen=self.rules.ring))
            n = len(ring)
            if n >= max(2, self.rules.warm):
                mean = fsum(ring) / n
                sd = (fsum((x - mean) ** 2 for x in ring) / (n - 1)) ** 0.5
                z = (bps - mean) / sd if sd else 0.0
                if abs(bps) >= self.rules.min_bps and abs(z) >= self.rules.min_zscore:
                    events.append((a, b, ma, mb, bps, z, min(ta, tb), max(ta, tb)))
            ring.append(bps)
        return events


def subscription(events: DataFrame, min_bps: float = 0.0, min_zscore: float = 0.0) -> DataFrame:
    """Events that a subscriber with these thresholds gets."""
    return events.where((F.abs("divergence_bps") >= min_bps) & (F.abs("zscore") >= min_zscore))

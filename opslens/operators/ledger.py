"""Model-call ledger: cost, daily spend, degradation levels, admission, routing.

Spend is kept in whole tokens and priced at the end: every call costs the same per token, so sums are
exact and do not depend on the order in which tasks add them up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.text import content_hash
from opslens.operators.running import MAX_SLOT_ROWS, running_sums, with_slots
from opslens.operators.ttl import cache_hits
from opslens.operators.windows import int_div
from opslens.session import cut_lineage

# Price, limit, lifetimes, level bounds.
USD_PER_1K = 0.0001
DAILY_LIMIT_USD = 50.0
RESPONSE_TTL_SECONDS = 86_400
STRETCH_CALLS = 100_000
DEGRADED_AT, CRITICAL_AT, EXHAUSTED_AT = 0.70, 0.90, 1.00
TIERS = ("TINY", "SMALL", "MEDIUM", "LARGE")


def price(tokens: Column, usd_per_1k: float = USD_PER_1K) -> Column:
    return tokens.cast("double") / F.lit(1000.0) * F.lit(usd_per_1k)


def token_bound(limit: float, share: float = 1.0, usd_per_1k: float = USD_PER_1K) -> int:
    """Smallest whole number of tokens whose price reaches ``share`` of the limit."""
    return math.ceil(Fraction(str(limit)) * Fraction(str(share)) * 1000 / Fraction(str(usd_per_1k)))


def level_of_ratio(ratio: Column) -> Column:
    return (
        F.when(ratio < DEGRADED_AT, "NORMAL").when(ratio < CRITICAL_AT, "DEGRADED")
        .when(ratio < EXHAUSTED_AT, "CRITICAL").otherwise("EXHAUSTED")
    )


def level_of_tokens(spent: Column, limit: float, usd_per_1k: float = USD_PER_1K) -> Column:
    """Degradation level of a spend in tokens; a limit of zero or less is always exhausted."""
    if limit <= 0:
        return F.lit("EXHAUSTED")
    b = [token_bound(limit, s, usd_per_1k) for s in (DEGRADED_AT, CRITICAL_AT, EXHAUSTED_AT)]
    return F.when(spent < b[0], "NORMAL").when(spent < b[1], "DEGRADED").when(spent < b[2], "CRITICAL").otherwise("EXHAUSTED")


def ratio_of(spend: Column, limit: float) -> Column:
    return spend / F.lit(limit) if limit > 0 else F.lit(1.0)


def charged_tokens() -> Column:
    """A failed call is charged its estimate, any other its measured tokens in and out."""
    return F.when(F.col("status") == "FAILED", F.col("est_tokens")).otherwise(F.col("tokens_in") + F.col("tokens_out"))


def call_costs(calls: DataFrame, usd_per_1k: float = USD_PER_1K) -> DataFrame:
    """Estimate, charge and estimation error of each call."""
    return calls.withColumn("charged_tokens", charged_tokens()).select(
        "*", price(F.col("est_tokens"), usd_per_1k).alias("est_cost"),
        price(F.col("charged_tokens"), usd_per_1k).alias("actual_cost"),
        F.when(F.col("status") != "FAILED", F.col("tokens_in") - F.col("est_tokens")).alias("estimation_delta"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by model, agent and cache outcome."""
    sent = (~F.col("is_hit")) & (F.col("status") != "FAILED")
    return calls.groupBy("model", "agent", F.when(F.col("is_hit"), "hit").otherwise("miss").alias("cache")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.when(sent, F.col("tokens_in")).otherwise(0)).alias("tokens_in"),
        F.sum(F.when(sent, F.col("tokens_out")).otherwise(0)).alias("tokens_out"),
    )


def daily_spend(calls: DataFrame, limit: float = DAILY_LIMIT_USD, usd_per_1k: float = USD_PER_1K) -> DataFrame:
    """Spend, utilisation and level per calendar day."""
    tokens = calls.groupBy(F.to_date("ts").alias("day")).agg(F.sum(charged_tokens()).alias("tokens"))
    spend = price(F.col("tokens"), usd_per_1k)
    return tokens.select(
        "day", "tokens", spend.alias("current_spend_usd"), F.lit(limit).alias("daily_budget_limit_usd"),
        (ratio_of(spend, limit) * 100).alias("utilization_percentage"),
        level_of_tokens(F.col("tokens"), limit, usd_per_1k).alias("level"),
    )


def running_spend(calls: DataFrame, limit: float = DAILY_LIMIT_USD, usd_per_1k: float = USD_PER_1K, slot_s: int = 60) -> DataFrame:
    """Spend reached at each call of its day, all calls admitted, and the level it leads to."""
    src = calls.withColumn("day", F.to_date("ts")).withColumn("charged_tokens", charged_tokens())
    out = running_sums(src, ["day"], {"spent_tokens": F.col("charged_tokens")}, "ts_us", "call_id", slot_s)
    spend = price(F.col("spent_tokens"), usd_per_1k)
    return out.withColumn("spend_usd", spend).withColumn("level", level_of_tokens(F.col("spent_tokens"), limit, usd_per_1k))


def response_cache_hits(calls: DataFrame, ttl_s: int = RESPONSE_TTL_SECONDS) -> DataFrame:
    """Calls answered from the cache; a failed call stores nothing."""
    src = calls.withColumn("prompt_hash", content_hash(F.col("prompt")))
    return cache_hits(src, "prompt_hash", ttl_s, row_id="call_id", writes=F.col("status") != "FAILED")


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the rows whose keys are equal, for sorted keys."""
    n = len(keys[0])
    if not n:
        return []
    edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), n]))


class Stretch:
    """What a run of calls makes of every budget left, from 1 to ``most``: pieces [lo, next lo) with what they lose.

    A call that fits (estimate under what is left) takes its charge off; so each piece is a shift, a call splits the
    piece its estimate falls in, and neighbours of equal loss are one. A budget of nothing stays as it is.
    """

    def __init__(self, most: int):
        self.most = most
        self.lo, self.lost = np.array([1], np.int64), np.array([0], np.int64)
        self.top = most

    def add(self, est: np.ndarray, charge: np.ndarray) -> None:
        at = 0
        while at < len(est):
            ahead = np.flatnonzero((est[at:at + 4096] < self.top) & (charge[at:at + 4096] != 0))
            if not len(ahead):
                at += 4096
                continue
            at += int(ahead[0])
            self._one(int(est[at]), int(charge[at]))
            at += 1

    def _one(self, est: int, charge: int) -> None:
        end = np.append(self.lo[1:], self.most + 1)
        first = est + self.lost + 1  # the least budget of each piece, before the run, that the call fits
        whole, split = first <= self.lo, (first > self.lo) & (first < end)
        lo = np.concatenate([self.lo, first[split]])
        lost = np.concatenate([np.where(whole, self.lost + charge, self.lost), self.lost[split] + charge])
        order = np.argsort(lo)
        lo, lost = lo[order], lost[order]
        keep = np.r_[True, lost[1:] != lost[:-1]]
        self.lo, self.lost = lo[keep], lost[keep]
        self.top = int((np.append(self.lo[1:], self.most + 1) - 1 - self.lost).max())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's map of budgets; holds one batch and one map."""
    now, made = None, None

    def out():
        n = len(made.lo)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.int32()).cast(pa.date32()), pa.array([now[1]] * n, pa.int64()),
                                           pa.array(made.lo), pa.array(made.lost)], names=["day", "stretch", "lo", "lost"])

    for b in batches:
        day = b.column(0).cast(pa.int32()).to_numpy()
        stretch, rest, est, charge = (b.column(i).to_numpy() for i in (1, 2, 3, 4))
        for lo, hi in _runs(day, stretch):
            if (day[lo], stretch[lo]) != now:
                if made:
                    yield out()
                now, made = (day[lo], stretch[lo]), Stretch(int(rest[lo]))
            made.add(est[lo:hi], charge[lo:hi])
    if made:
        yield out()


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left at the start of each stretch, by the maps before it; holds one number and the end of one map."""
    today = stretch = None
    rest, lost = 0, 0
    for b in batches:
        day = b.column(0).cast(pa.int32()).to_numpy()
        no, lo, off, start = (b.column(i).to_numpy() for i in (1, 2, 3, 4))
        rows = []
        for a, z in _runs(day, no):
            if (day[a], no[a]) != (today, stretch):
                rest = int(start[a]) if day[a] != today else rest - lost
                today, stretch, lost = day[a], no[a], 0
                rows.append((today, stretch, rest))
            at = np.searchsorted(lo[a:z], rest, side="right") - 1  # pieces may come in more than one batch
            if at >= 0:
                lost = int(off[a + at])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()).cast(pa.date32()), *(
            pa.array([int(r[i]) for r in rows], pa.int64()) for i in (1, 2))], names=["day", "stretch", "rest"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the calls of each stretch in order; gives back those that fit. Holds one batch and one number."""
    now, rest = None, 0
    for b in batches:
        day = b.column(0).cast(pa.int32()).to_numpy()
        stretch, start, est, charge = (b.column(i).to_numpy() for i in (1, 2, 3, 4))
        fit = []
        for lo, hi in _runs(day, stretch):
            if (day[lo], stretch[lo]) != now:
                now, rest = (day[lo], stretch[lo]), int(start[lo])
            at = lo
            while at < hi:
                ahead = np.flatnonzero(est[at:min(hi, at + 4096)] < rest)
                if not len(ahead):
                    at = min(hi, at + 4096)
                    continue
                at += int(ahead[0])
                fit.append(at)
                rest -= int(charge[at])
                at += 1
        yield b.select(["day", "ts_us", "call_id"]).take(pa.array(fit, pa.int64()))


def fitting_calls(open_calls: DataFrame, stretch_calls: int) -> DataFrame:
    """(day, ts_us, call_id) of the calls that fit, of (day, _slot, _cut, ts_us, call_id, rest, est, charge).

    ``rest`` is what the day has left in front of its first open call. A day's calls are cut into stretches of about
    ``stretch_calls``, at the ends of slots. Each stretch is summed up alone, as a map from what is left to what is
    left then; the maps, one short table a stretch, are followed in order; then all stretches are walked at once.
    """
    slots = open_calls.groupBy("day", "_slot", "_cut").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("day").orderBy("_slot", "_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stretches = slots.withColumn("stretch", int_div(before, stretch_calls)).drop("n")
    order = ["day", "stretch", "ts_us", "call_id"]
    rows = cut_lineage(open_calls.join(stretches, ["day", "_slot", "_cut"]).select(*order, "rest", "est", "charge"))

    def sorted_by_stretch(df: DataFrame) -> DataFrame:
        return df.repartition("day", "stretch").sortWithinPartitions(*order).select(
            "day", "stretch", "rest", "est", "charge", "ts_us", "call_id")

    maps = sorted_by_stretch(rows).mapInArrow(_summaries, "day date, stretch long, lo long, lost long")
    first = rows.groupBy("day").agg(F.min("rest").alias("rest"))
    starts = cut_lineage(maps.join(first, "day").repartition("day").sortWithinPartitions("day", "stretch", "lo").select(
        "day", "stretch", "lo", "lost", "rest").mapInArrow(_starts, "day date, stretch long, rest long"))
    ids = rows.select("day", "ts_us", "call_id").schema
    return sorted_by_stretch(rows.drop("rest").join(starts, ["day", "stretch"])).mapInArrow(_walk, ids)


def admit(calls: DataFrame, limit: float = DAILY_LIMIT_USD, usd_per_1k: float = USD_PER_1K, slot_s: int = 60,
          stretch_calls: int = STRETCH_CALLS) -> DataFrame:
    """Replay of the budget check over each day: adds spent_before, decision, level and charged tokens.

    A denied call spends nothing, which changes every later decision of its day. Up to the first call that does
    not fit, all are admitted: one distributed running sum finds that call and what is left then. Later calls whose
    estimate reaches what is left can never fit and fall away. The others depend on each other in order; they are
    settled in stretches (``fitting_calls``), so a day's calls run in as many tasks as it has stretches. Estimates
    and charges are whole numbers of at least 0.
    """
    c = F.col
    bound = token_bound(limit, EXHAUSTED_AT, usd_per_1k) if limit > 0 else 0
    src = calls.withColumn("day", F.to_date("ts")).withColumn("charge", charged_tokens())
    src = with_slots(src, ["day"], "ts_us", "call_id", slot_s, min(MAX_SLOT_ROWS, stretch_calls))
    at = F.struct("ts_us", "call_id")

    narrow = cut_lineage(src.select("day", "_slot", "_cut", "ts_us", "call_id", c("est_tokens").alias("est"), "charge"))
    run = running_sums(narrow, ["day"], {"used": c("charge")}, "ts_us", "call_id")
    first = run.filter(c("est") >= bound - (c("used") - c("charge"))).groupBy("day").agg(
        F.min(F.struct("ts_us", "call_id", (bound - (c("used") - c("charge"))).alias("rest"))).alias("p"))
    first = cut_lineage(first.select("day", F.struct("p.ts_us", "p.call_id").alias("p"), c("p.rest").alias("rest")))
    open_calls = narrow.join(first, "day").filter((at > c("p")) & (c("est") < c("rest")))
    fits = fitting_calls(open_calls, stretch_calls)

    marked = src.join(first, "day", "left").join(fits.withColumn("_fits", F.lit(True)), ["day", "ts_us", "call_id"], "left")
    admitted = c("p").isNull() | (at < c("p")) | c("_fits").isNotNull()
    marked = marked.withColumn("charged", F.when(admitted, c("charge")).otherwise(F.lit(0).cast("bigint"))).drop("p", "rest", "_fits")
    out = running_sums(marked, ["day"], {"_upto": c("charged")}, "ts_us", "call_id")
    spent = c("_upto") - c("charged")
    projected = spent + c("est_tokens")
    soft = token_bound(limit, DEGRADED_AT, usd_per_1k) if limit > 0 else 0
    decision = F.when(projected >= bound, "DENY").when(projected >= soft, "DEGRADE").otherwise("ALLOW")
    return out.select(
        *calls.columns, "day", spent.alias("spent_before"), decision.alias("decision"),
        level_of_tokens(spent, limit, usd_per_1k).alias("level"), "charged",
    )


def routing_level(level: Column, decision: Column) -> Column:
    return F.when((decision == "DEGRADE") & (level == "NORMAL"), "DEGRADED").otherwise(level)


def effective_tier(tier: Column, level: Column) -> Column:
    return F.when((level == "DEGRADED") & (tier == "LARGE"), "MEDIUM").when(level == "CRITICAL", "SMALL").otherwise(tier)


def route(tier: Column, level: Column, decision: Column, models: Mapping[str, str]) -> Column:
    """Model for a call: tier lowered by the routing level, then the tier's model; stub when exhausted or denied."""
    lvl = routing_level(level, decision)
    eff = effective_tier(tier, lvl)
    model = F.when((lvl == "EXHAUSTED") | (decision == "DENY"), "stub")
    for t, m in models.items():
        model = model.when(eff == t, m)
    missing = F.raise_error(F.concat(F.lit("no model for tier "), F.coalesce(eff, F.lit("null")))).cast("string")
    return model.otherwise(missing)


def gateway(calls: DataFrame, models: Mapping[str, str], limit: float = DAILY_LIMIT_USD, ttl_s: int = RESPONSE_TTL_SECONDS,
            stretch_calls: int = STRETCH_CALLS) -> DataFrame:
    """Every call through cache, budget and routing: adds is_hit, decision, level, model, charged.

    Only cache misses spend. ``status`` is the outcome of calls that were sent. A sent call that fails stores nothing;
    a denied one is answered by the stub, whose answer is stored whatever the call's status. So the cache decides which
    calls ask for budget, and the budget decides which failing calls store an answer. Both are replayed in turn: the
    cache takes a failing call as denied if the spend that the last replay had at its time leaves no room for it, until
    a replay changes none of these. What happens at a moment depends on earlier moments only, so every round settles
    all calls up to the first difference at least, and what the rounds end in is the replay call by call. Without
    failing calls one round is enough.
    """
    c = F.col
    failing = c("status") == "FAILED"
    bound = token_bound(limit) if limit > 0 else 0
    src = calls.withColumn("prompt_hash", content_hash(c("prompt")))
    own = src.columns
    none = F.lit(0).cast("bigint")
    stubbed, known = None, 0
    while True:
        rows = src.withColumn("_stub", F.lit(False)) if stubbed is None else src.join(
            stubbed.withColumn("_stub", F.lit(True)), "call_id", "left")
        stores = ~failing | F.coalesce("_stub", F.lit(False))
        marked = cut_lineage(cache_hits(rows, "prompt_hash", ttl_s, row_id="call_id", writes=stores).drop("_stub"))
        # a hit asks for nothing and is charged nothing, but learns the spend of its time as all others do
        asks = {name: F.when(c("is_hit"), none).otherwise(c(name)) for name in ("est_tokens", "tokens_in", "tokens_out")}
        asked = marked.select("*", c("est_tokens").alias("_est"), c("tokens_in").alias("_in"), c("tokens_out").alias("_out")).withColumns(asks)
        priced = cut_lineage(admit(asked, limit, stretch_calls=stretch_calls))
        denied = priced.filter(failing & (c("spent_before") + c("_est") >= bound)).select("call_id")
        now = denied.count()
        if now == known and (now == 0 or denied.join(stubbed, "call_id", "left_anti").isEmpty()):
            break
        stubbed, known = denied, now
    priced = priced.withColumns({"est_tokens": c("_est"), "tokens_in": c("_in"), "tokens_out": c("_out")})
    sent = priced.filter("NOT is_hit").withColumn("model", route(c("tier"), c("level"), c("decision"), models))
    hits = priced.filter("is_hit").withColumns({"decision": F.lit("CACHED"), "level": F.lit(None).cast("string"), "charged": none, "model": F.lit("cache")})
    names = [*own, "is_hit", "decision", "level", "charged", "model"]
    return hits.select(*names).unionByName(sent.select(*names))

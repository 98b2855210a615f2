"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents count their tokens by cell (source, language, topic). Raking scales the cells' token weights in
turn until the totals of each dimension meet its targets. A document is sampled with its cell's probability,
decided by a hash of its id, so no row depends on another and repeated runs agree.

No document is taken twice, so probabilities end at 1. Where scaled weights pass 1, raking goes on with that
bound, and the kept share falls to the largest one for which the sample's expected totals still meet all targets.

Few cells are raked on the driver, many as Spark joins. Both do the same steps in the same double arithmetic, and
sums don't depend on the order of their terms, so the results are equal to the last bit.
"""

from __future__ import annotations

from functools import reduce
from math import frexp

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import remove, result, saved, shared_dir

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}  # targets where none are given: shares to this power
KEEP, ROUNDS, CLOSE, DRIVER_CELLS, BROADCAST_CELLS = 0.8, 100, 1e-9, 100_000, 50_000
NEAR, MOST, STEPS, AHEAD = 1e-6, 1e12, 20, 4
DIGIT, DIGITS = float(1 << 30), 3  # sums are exact down to 2**-90 of their unit

# the first rule that holds names the topic
TOPICS = (
    ("legal", r"(?i)\b(?:licen[sc]e|copyright|rights reserved|warranty)\b"),
    ("contact", r"@[A-Za-z0-9-]+\.[A-Za-z]|\+[0-9][0-9 ().-]{7,}[0-9]"),
    ("tabular", r" \| [^|\n]* \| "),
    ("numeric", r"[0-9][0-9.,]*(?:\s+[0-9][0-9.,]*){3,}"),
)


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(F.length(F.trim(text)) == 0, "empty").otherwise(out)


def exact_sums(at: np.ndarray, x: np.ndarray, n: int, unit: float = 1.0) -> np.ndarray:
    """Sums by index of terms from 0 to unit (a power of two): whole numbers are added, so any order gives the same bits."""
    rest, digits = x / unit, []
    for _ in range(DIGITS):
        rest = rest * DIGIT
        whole = np.floor(rest)
        digits.append(np.zeros(n, np.int64))
        np.add.at(digits[-1], at, whole.astype(np.int64))
        rest = rest - whole
    return reduce(lambda low, digit: (low + digit.astype(np.float64)) / DIGIT, reversed(digits), np.zeros(n)) * unit


def exact_sum(x: Column, unit: float = 1.0) -> Column:
    """exact_sums() as an aggregate."""
    rest, digits = x / F.lit(unit), []
    for _ in range(DIGITS):
        rest = rest * F.lit(DIGIT)
        digits.append(F.sum(F.floor(rest)).cast("double"))
        rest = rest % F.lit(1.0)
    return reduce(lambda low, digit: (low + digit) / F.lit(DIGIT), reversed(digits), F.lit(0.0)) * F.lit(unit)


def unit_of(total: float) -> float:
    """A power of two above total."""
    return 2.0 ** frexp(total)[1]


def share_of(given: float | None) -> float:
    return max(0.0, float(given or 0.0))


def targets_of(totals: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    """Shares that sum to 1 over the values that occur; given values that don't occur count for nothing."""
    if given is None:
        shares = {k: v**power for k, v in totals.items()}
    else:
        shares = {k: share_of(given.get(k)) for k in totals}
    most = max(shares.values(), default=0.0)
    if not most:
        return {k: 1 / len(shares) for k in shares}
    whole = float(exact_sums(np.zeros(len(shares), np.int64), np.array(list(shares.values())) / most, 1)[0])
    return {k: v / most / whole for k, v in shares.items()}


def tempered(spark: SparkSession, totals: dict[str, float], power: float) -> dict[str, float]:
    """Totals to a power, as Spark has it: its last bit can differ from Python's."""
    rows = spark.createDataFrame(list(enumerate(totals.values())), "k long, t double").select("k", F.pow("t", F.lit(power)).alias("share")).collect()
    shares = {r["k"]: r["share"] for r in rows}
    return {v: shares[k] for k, v in enumerate(totals)}


def rake(tokens: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights w for which the sums of tokens * w by each index meet its targets (shares of 1)."""
    w = np.full(len(tokens), 1 / max(tokens.sum(), 1.0))
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(index, targets, strict=True):
            sums = exact_sums(at, tokens * w, len(target))
            factor = np.divide(target, sums, out=np.ones_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(factor[sums > 0] - 1).max(initial=0)))
            w = w * factor[at]
        if worst < close:
            break
    return w


def bounded(tokens: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], goal: float, q: np.ndarray, rounds: int = ROUNDS, near: float = NEAR) -> np.ndarray | None:
    """q by a factor for each value of each dimension, so that sums of tokens * min(1, q) meet goal times the targets; None where they don't.

    A group's sum is concave in its factor, so Newton's step from below and proportion from above never pass the goal.
    """
    unit = unit_of(tokens.sum())
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(index, targets, strict=True):
            sums = exact_sums(at, tokens * np.minimum(1, q), len(target), unit)
            slope = exact_sums(at, tokens * np.where(q < 1, q, 0), len(target), unit)
            gap = target * goal - sums
            worst = max(worst, float(np.abs(gap).max(initial=0)))
            up = 1 + np.divide(gap, slope, out=np.zeros_like(gap), where=slope > 0)
            q = np.minimum(q * np.where(gap > 0, up, np.divide(target * goal, sums, out=np.ones_like(gap), where=sums > 0))[at], MOST)
        if worst < near * goal:
            return q
    return None


def _halves(low: float, high: float, levels: int) -> list[float]:
    """What bisection can ask for in its next steps, whatever it finds."""
    if not levels:
        return []
    at = (low + high) / 2
    return [at, *_halves(low, at, levels - 1), *_halves(at, high, levels - 1)]


def largest(low: float, high: float, attempt, steps: int, ahead: int = 1):
    """(share, attempt's result) of the largest share in [low, high] found for which attempt gives one; (low, None) without.

    attempt gets all shares that the next ``ahead`` steps can ask for, and gives a result, or None, for each.
    """
    best, at, known = (low, None), high, {}
    for step in range(steps):
        if at not in known:
            known = attempt(list(dict.fromkeys(_halves(best[0], high, min(ahead, steps - step)))) if step else [at])
        if known[at] is None:
            high = at
        else:
            best = (at, known[at])
        if best[0] == high:
            break
        at = (best[0] + high) / 2
    return best


def _raked_frame(cells: DataFrame, targets: dict[str, DataFrame], total: float, work: str, rounds: int, close: float) -> DataFrame:
    """rake() over more cells than a driver should hold: each step is a grouped sum and a join."""
    now = cells.withColumn("w", F.lit(1 / max(total, 1.0)))
    for r in range(rounds):
        steps = []
        for d, target in targets.items():
            sums = now.groupBy(d).agg(exact_sum(F.col("tokens") * F.col("w")).alias("s")).join(target, d)
            factor = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(1.0)
            steps.append(saved(sums.select(d, factor.alias("f"), F.when(F.col("s") > 0, F.abs(factor - 1)).otherwise(0.0).alias("off")), f"{work}/{r}/f-{d}"))
            now = now.join(steps[-1].select(d, "f"), d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = saved(now, f"{work}/{r}/cells")
        remove(cells.sparkSession, f"{work}/{r - 1}")
        if reduce(DataFrame.union, (t.select("off") for t in steps)).agg(F.max("off")).first()[0] < close:
            break
    return now


def _bounded_frame(
    cells: DataFrame, targets: dict[str, DataFrame], total: float, shares: list[float], work: str, rounds: int, near: float
) -> dict[float, DataFrame | None]:
    """bounded() over more cells than a driver should hold, for several shares of total at once; cells have a column w."""
    spark, q, unit = cells.sparkSession, F.col("q"), unit_of(total)
    goals, found = [k * total for k in shares], dict.fromkeys(shares)
    tried = spark.createDataFrame(list(enumerate(goals)), "k int, goal double")
    now = cells.crossJoin(F.broadcast(tried)).withColumn("q", F.col("w") * F.col("goal"))
    for r in range(rounds):
        steps = []
        for d, target in targets.items():
            sums = now.groupBy("k", "goal", d).agg(
                exact_sum(F.col("tokens") * F.least(F.lit(1.0), q), unit).alias("s"), exact_sum(F.col("tokens") * F.when(q < 1, q).otherwise(0.0), unit).alias("slope")
            ).join(target, d).withColumn("gap", F.col("target") * F.col("goal") - F.col("s"))
            up = F.when(F.col("slope") > 0, 1 + F.col("gap") / F.col("slope")).otherwise(1.0)
            factor = F.when(F.col("gap") > 0, up).when(F.col("s") > 0, F.col("target") * F.col("goal") / F.col("s")).otherwise(1.0)
            steps.append(saved(sums.select("k", d, F.abs("gap").alias("off"), factor.alias("f")), f"{work}/{r}/f-{d}"))
            now = now.join(steps[-1].select("k", d, "f"), ["k", d]).withColumn("q", F.least(q * F.col("f"), F.lit(MOST))).drop("f")
        now = saved(now, f"{work}/{r}/cells")
        remove(spark, f"{work}/{r - 1}")
        off = reduce(DataFrame.union, (t.select("k", "off") for t in steps)).groupBy("k").agg(F.max("off")).collect()
        met = [k for k, worst in off if worst < near * goals[k]]
        for k in met:
            found[shares[k]] = saved(now.where(F.col("k") == k), f"{work}/met-{k}")
        if len(met) == len(off):
            break
        if met:
            now = now.where(~F.col("k").isin(met))
    remove(spark, f"{work}/{r}")
    return found


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: Column | None = None, lang: Column | None = None, topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 17, driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """One row per row of docs: id, tokens, source, lang, topic, weight, prob, kept.

    tokens are white-space words. targets has shares by dimension and value; a dimension left out is
    tempered (shares to the power TEMPER). weight times tokens, summed over all rows, is 1 and meets the
    targets; prob is weight times one factor for all, at most 1, so an expected sample meets the targets too.
    About ``keep`` of all tokens stay, or the largest share below that the targets allow. Targets that
    contradict each other are met as far as raking gets, with no more kept than leaves all prob at most 1.
    Null values form a group ``(none)``; a null text has no tokens and goes with its cell; rows that repeat
    an id and a text share their fate. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("bigint").alias("tokens"),
        name(F.col("source") if source is None else source).alias("source"), name(F.col("lang") if lang is None else lang).alias("lang"),
        name(topic_of(text) if topic is None else topic).alias("topic"),
        (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u"),
    )
    rows = saved(rows, f"{work}/rows")  # a few bytes for each text
    cells = saved(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")), f"{work}/cells")
    many = cells.count()
    given = targets or {}
    if many <= driver_cells:
        table = cells.toPandas().sort_values(list(DIMENSIONS)).reset_index(drop=True)
        tokens = table["tokens"].to_numpy(np.float64)
        index, goals = [], []
        for d in DIMENSIONS:
            totals = table.groupby(d)["tokens"].sum().to_dict()
            own = given.get(d)
            shares = targets_of(totals, tempered(spark, totals, TEMPER[d]) if own is None else own, 1.0)
            values = sorted(shares)
            index.append(table[d].map({v: k for k, v in enumerate(values)}).to_numpy(np.int64))
            goals.append(np.array([shares[v] for v in values]))
        w, total = rake(tokens, index, goals, ROUNDS, CLOSE), float(tokens.sum())
        top = w[tokens > 0].max(initial=0) * total
        limit = keep if total else 0.0
        for at, goal in zip(index, goals, strict=True):
            limit = min(limit, (np.bincount(at, tokens)[goal > 0] / goal[goal > 0]).min() / total) if total else 0.0
        share, q = min(limit, 1 / top if top else 0.0), None
        if share < limit:
            share, q = largest(share, limit, lambda ks: {k: bounded(tokens, index, goals, k * total, k * total * w, ROUNDS, NEAR) for k in ks}, STEPS)
        table["prob"] = np.minimum(1.0, share * total * w if q is None else q)
        table["weight"] = w if q is None else table["prob"] / (share * total)
        weighted = spark.createDataFrame(
            [(*map(str, r[:3]), float(r[3]), float(r[4])) for r in table[[*DIMENSIONS, "weight", "prob"]].itertuples(index=False)],
            "source string, lang string, topic string, weight double, prob double",
        )
    else:
        frames = {}
        for d in DIMENSIONS:
            sums, own = cells.groupBy(d).agg(F.sum("tokens").alias("t")), given.get(d)
            if own is None:
                sums = sums.withColumn("share", F.pow("t", F.lit(TEMPER[d])))
            else:
                own = spark.createDataFrame([(k, share_of(v)) for k, v in own.items() if isinstance(k, str)], f"{d} string, share double")
                sums = sums.join(own, d, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            sums = saved(sums, f"{work}/target-{d}")
            most, n = sums.agg(F.max("share"), F.count(F.lit(1))).first()
            whole = sums.agg(exact_sum(F.col("share") / most)).first()[0] if most else None
            frames[d] = saved(sums.select(d, (F.col("share") / most / whole if most else F.lit(1 / n)).alias("target")), f"{work}/goal-{d}")
        total = cells.agg(F.sum("tokens")).first()[0] or 0.0
        raked = _raked_frame(cells, frames, total, f"{work}/raked", ROUNDS, CLOSE)
        top = raked.where("tokens > 0").agg(F.max("w")).first()[0] or 0.0
        limit = keep if total else 0.0
        for d, target in frames.items():
            own = cells.groupBy(d).agg(F.sum("tokens").alias("t")).join(target, d).where("target > 0")
            limit = min(limit, own.agg(F.min(F.col("t") / F.col("target"))).first()[0] / total) if total else 0.0
        share, found = min(limit, 1 / (top * total) if top and total else 0.0), None
        if share < limit:

            def attempt(ks: list[float]) -> dict[float, DataFrame | None]:
                return _bounded_frame(raked, frames, total, ks, f"{work}/bounded-{ks[0]}", ROUNDS, NEAR)

            share, found = largest(share, limit, attempt, STEPS, AHEAD)
        prob = F.least(F.lit(1.0), F.col("w") * (share * total) if found is None else F.col("q"))
        weight = F.col("w") if found is None else prob / (share * total)
        weighted = (raked if found is None else found).select(*DIMENSIONS, weight.alias("weight"), prob.alias("prob"))
    weighted = saved(weighted, f"{work}/weighted")
    out = rows.join(F.broadcast(weighted) if many <= BROADCAST_CELLS else weighted, list(DIMENSIONS), "left")
    out = out.select(F.col("id").alias(id_col), "tokens", *DIMENSIONS, "weight", "prob", (F.col("u") < F.col("prob")).alias("kept"))
    return result(out, work)

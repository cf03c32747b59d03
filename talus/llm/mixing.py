"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 0 (uniform) and 1 (as they are), found by bisection:
the largest that reaches the target entropy, but no smaller than the repetition limit allows.
Normalised weights become token budgets. Each source is cut by hash into blocks, every epoch visits them in
its own permutation; full epochs take all, and the last one takes blocks in order until the budget is spent,
the block in which that happens up to a cut-off found by refining hash ranges. Unless a
budget is given, the largest source is taken exactly once, so that no document is lost.

Tokens are words. A null source is the source ''. Null texts have no tokens. Repeated rows are drawn each.
An empty table gives an empty result. Extra columns pass through ``apply_mix`` unchanged. Rows without an id share one place of the order, and with it one block: they are taken
together or not at all in the last epoch. Rows at one place are ties; they are taken together or not at all. A very long text is one row, which the budget counts whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import WS, materialize, small

BLOCKS = 256
#: Documents of a block stand in the order of a 40-bit hash, refined 1,024 ranges at a time.
_BITS, _STEP = 40, 30
#: With more sources than this the exponent is bisected by Spark jobs instead of on the driver.
DRIVER_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """Exponent, total budget in tokens and the decision table by source and block."""

    exponent: float
    budget: float
    decisions: DataFrame
    sources: DataFrame


def tokens(text: Column) -> Column:
    """Words of a text, counted without Python."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _key(seed: int) -> tuple[Column, Column]:
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << _BITS)).cast("long")
    return block, place


def _entropies(totals: DataFrame):
    """Entropy of the shares raised to an exponent, on the driver for few sources, else by Spark."""
    shares = totals.where("n_tokens > 0").select("n_tokens")
    if small(shares, DRIVER_SOURCES):
        sizes = sorted(float(r.n_tokens) for r in shares.collect())

        def entropy(a: float) -> float:
            raised = [math.exp(a * math.log(n / sizes[-1])) for n in sizes]
            z = math.fsum(raised)
            return -math.fsum(x / z * math.log(x / z) for x in raised if x)

        return entropy, len(sizes), sizes[0] if sizes else 0.0, sizes[-1] if sizes else 0.0
    row = shares.agg(F.count("*").alias("n"), F.min("n_tokens").alias("a"), F.max("n_tokens").alias("b")).first()

    def entropy_by_job(a: float) -> float:
        log = F.log(F.col("n_tokens") / F.lit(float(row.b))) * F.lit(a)
        z, s = shares.agg(F.sum(F.exp(log)), F.sum(F.exp(log) * log)).first()
        return math.log(z) - s / z

    return entropy_by_job, row.n, float(row.a), float(row.b)


def find_exponent(totals: DataFrame, target: float, max_repeats: float) -> float:
    """The exponent for source totals; ``target`` is a part of the largest possible entropy."""
    entropy, n, least, most = _entropies(totals)
    if n < 2 or least == most:
        return 1.0
    goal, low, high = target * math.log(n), 0.0, 1.0
    if entropy(1.0) >= goal:
        low = 1.0
    else:
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= goal else (low, mid)
    # repetitions of the smallest source: (most / least) ** (1 - exponent)
    a, b = 0.0, 1.0
    if (most / least) <= max_repeats:
        b = 0.0
    for _ in range(50):
        mid = (a + b) / 2
        a, b = (a, mid) if (most / least) ** (1 - mid) <= max_repeats else (mid, b)
    return max(low, b)


def plan(docs: DataFrame, target: float = 0.95, max_repeats: float = 4.0, budget: float | None = None, seed: int = 7) -> Mix:
    """Weights, budgets and the documents of each source's last epoch."""
    block, place = _key(seed)
    keyed = materialize(
        docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n"), block.alias("block"), place.alias("place")),
        "mix-tokens",
    )
    blocks = materialize(keyed.groupBy("source", "block").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("docs").alias("n_docs"))
    exponent = find_exponent(totals, target, max_repeats)
    raised = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    z, most = totals.agg(F.sum(raised), F.max("n_tokens")).first()
    z, most = z or 1.0, most or 0
    budget = float(most) ** (1 - exponent) * z if budget is None else float(budget)
    sources = totals.withColumn("weight", raised / F.lit(z)).withColumn("budget", F.round(F.col("weight") * F.lit(budget)).cast("long"))
    sources = sources.withColumn("full", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(F.lit(1)).cast("int"))
    sources = materialize(sources.withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("budget") - F.col("full") * F.col("n_tokens")).otherwise(F.lit(0))), "mix-sources")
    order = F.xxhash64(F.lit(seed), "source", F.col("full") + 1, "block")
    w = Window.partitionBy("source").orderBy("turn", "block")  # BLOCKS rows a source at most
    ranked = blocks.join(sources.select("source", "full", "rest"), "source").withColumn("turn", order).withColumn("upto", F.sum("n").over(w))
    ranked = ranked.select("source", "block", "full", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), F.col("n").alias("held"))
    # blocks that fit are taken whole, the first that does not is cut, later ones are left
    state = F.when(F.col("held") <= F.col("left"), 1).when(F.col("left") > 0, 2).otherwise(0)
    ranked = materialize(ranked.withColumn("state", state), "mix-ranked")
    cut = ranked.where("state = 2").select("source", "block", "left")
    inside = keyed.join(F.broadcast(cut) if small(cut) else cut, ["source", "block"]).withColumn("part", F.shiftright("place", _STEP))
    parts = inside.groupBy("source", "block", "left", "part").agg(F.sum("n").alias("n"))
    v = Window.partitionBy("source", "block").orderBy("part")  # 1,024 rows a source at most
    parts = parts.withColumn("upto", F.sum("n").over(v)).withColumn("still", F.col("left") - F.col("upto") + F.col("n"))
    edge = parts.where("still > 0 and upto > left").select("source", "block", "part", "still")
    last = inside.join(F.broadcast(edge) if small(edge) else edge, ["source", "block", "part"])
    u = Window.partitionBy("source", "block").orderBy("place")  # equal places together
    last = last.withColumn("upto", F.sum("n").over(u)).where(F.col("upto") <= F.col("still"))
    below = edge.select("source", "block", (F.shiftleft(F.col("part").cast("long"), _STEP) - 1).alias("place"))
    cutoff = last.select("source", "block", "place").unionByName(below).groupBy("source", "block").agg(F.max("place").alias("cutoff"))
    return Mix(exponent, budget, materialize(ranked.select("source", "block", "full", "state").join(cutoff, ["source", "block"], "left"), "mix-decisions"), sources)


def draw(docs: DataFrame, mix: Mix, seed: int = 7, names: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of ``docs``, one for each epoch that takes them, with epoch, block and turn."""
    block, place = _key(seed)
    own = [F.col(f"`{c}`") for c in (names or docs.columns)]
    decisions = mix.decisions.select(F.col("source").alias("_m_source"), F.col("block").alias("_m_block"), F.col("full").alias("_m_full"), F.col("state").alias("_m_state"), F.col("cutoff").alias("_m_cutoff"))
    decisions = F.broadcast(decisions) if small(decisions) else decisions
    keyed = docs.select(*own, block.alias("_m_b"), place.alias("_m_place"), F.coalesce("source", F.lit("")).alias("_m_s"))
    joined = keyed.join(decisions, (F.col("_m_s") == F.col("_m_source")) & (F.col("_m_b") == F.col("_m_block")))
    more = F.when(F.col("_m_state") == 1, 1).when((F.col("_m_state") == 2) & (F.col("_m_place") <= F.col("_m_cutoff")), 1).otherwise(0)
    times = F.col("_m_full") + more
    epoch = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    out = joined.select(*own, "_m_s", "_m_b", "_m_place", epoch.alias("_m_epoch"))
    return out.withColumn("_m_turn", F.xxhash64(F.lit(seed), "_m_s", "_m_epoch", "_m_b"))


def mix_sources(docs: DataFrame, target: float = 0.95, max_repeats: float = 4.0, budget: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, epoch, block, turn (order of the block in its epoch) and place (order in the block)."""
    docs = docs.select("doc_id", "text", "source")
    out = draw(docs, plan(docs, target, max_repeats, budget, seed), seed, ("doc_id", "source"))
    return out.select("doc_id", "source", *[F.col(f"_m_{a}").alias(b) for a, b in (("epoch", "epoch"), ("b", "block"), ("turn", "turn"), ("place", "place"))])


def apply_mix(docs: DataFrame, target: float = 0.95, max_repeats: float = 4.0, budget: float | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as its source's budget asks for, in its own columns."""
    return draw(docs, plan(docs, target, max_repeats, budget, seed), seed).select(*[F.col(f"`{c}`") for c in docs.columns])

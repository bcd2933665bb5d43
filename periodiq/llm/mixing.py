"""Mixing sources to target weights (problem 9): Sainte-Laguë apportionment.

Equal-token blocks are allocated to the sources by highest quotients
share / (2k + 1), none above its supply; each source's blocks are allocated to
its shards the same way; within a shard the texts stand in a seeded order, cut
into blocks, of which the first `quota` are taken, in as many passes as
max_repeats allows.

The divisor form gives the same seats as drawing the quotients one by one and
costs a bisection instead of a loop over the seats, so trillions of tokens need
no more driver time than thousands.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodiq.session import materialize

MAX_TARGETS = 10_000


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2k + 1), at most caps[i] each; ties go to the earlier entry."""
    n = len(weights)
    caps = caps or [seats] * n
    live = [i for i in range(n) if weights[i] > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in live))
    if seats <= 0 or not live:
        return [0] * n

    def given(d: float) -> list[int]:
        # seats whose quotient is at least d: w / (2k - 1) >= d
        return [min(caps[i], int((weights[i] / d + 1) // 2)) if i in alive else 0 for i in range(n)]

    alive = set(live)
    hi = max(weights[i] for i in live) * 2
    lo = min(weights[i] for i in live) / (4.0 * (seats + max(caps[i] for i in live)) + 4)
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if sum(given(mid)) > seats:
            lo = mid
        else:
            hi = mid
    out = given(hi)
    while sum(out) < seats:  # the seats that tie at the last divisor
        best = max((i for i in live if out[i] < caps[i]), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def mix_sources(
    sizes: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    total_tokens: int | None = None,
    block_tokens: int = 256,
    shard_tokens: int = 20_000_000,
    shard_texts: int = 200_000,
    seed: int = 17,
) -> DataFrame:
    """Selected texts (source, key, n_tokens, times, target_share, actual_share).

    sizes: (key, source, n_tokens). targets: (source, target_share,
    max_repeats), a fixed table within MAX_TARGETS rows. times is how often a
    text is used in all, at most max_repeats. total_tokens is the size to reach,
    by default that of all texts of the targeted sources. A source whose texts
    do not reach its share under max_repeats is used up, a target without texts
    gets nothing, and what they leave goes to the others in proportion; the
    deviation else is one text a shard. Texts of sources without a target, of
    null source or without tokens are not used. A null share or repeat count leaves its source out;
    repeated target rows count once, with the greatest share. An empty table
    selects nothing.
    """
    spark = sizes.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    schema = f"`{source}` string, `{key}` {kinds[key]}, n_tokens bigint, times int, target_share double, actual_share double"
    wanted = targets.groupBy(source).agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select(source, "t.*")
    wanted = wanted.where("target_share > 0 and max_repeats > 0")
    rows = wanted.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    texts = sizes.select(F.col(source).alias("_s"), F.col(key).alias("_k"), "n_tokens").where("n_tokens > 0")
    # sizes cost a pass of the tokenizer: once, for the supply and the shards
    texts = materialize(texts.where(F.col("_s").isin([r[0] for r in rows]) if rows else F.lit(False)))
    supply = {r[0]: (r[1], r[2]) for r in texts.groupBy("_s").agg(F.sum("n_tokens"), F.count("*")).collect()}
    t = sorted((r[0], float(r[1]), int(r[2])) for r in rows if r[0] in supply)
    if not t:
        return spark.createDataFrame([], schema)
    total = sum(supply[x[0]][0] for x in t) if total_tokens is None else total_tokens
    block = max(1, min(block_tokens, int(total // (8 * len(t))) or 1))
    caps = [-(-supply[s][0] * m // block) for s, _, m in t]
    quota = sainte_lague([w for _, w, _ in t], int(total // block), caps)

    plan = spark.createDataFrame(
        [(s, w, m, q, max(1, -(-supply[s][0] // shard_tokens), -(-supply[s][1] // shard_texts))) for (s, w, m), q in zip(t, quota, strict=True)],
        "_s string, share double, max_repeats int, quota bigint, shards bigint",
    )
    h = F.xxhash64(F.lit(seed), F.col("_k"))
    sharded = texts.join(F.broadcast(plan.select("_s", "shards")), "_s").withColumn("_shard", F.pmod(h, F.col("shards"))).drop("shards")
    sharded = materialize(sharded.withColumn("_h", h))
    held = sharded.groupBy("_s", "_shard").agg(F.sum("n_tokens").alias("tokens"))

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        reps, q = int(pdf["max_repeats"].iloc[0]), int(pdf["quota"].iloc[0])
        tokens = pdf["tokens"].tolist()
        # a block may lie across the last texts of a shard: round the supply up
        pdf["q"] = sainte_lague([float(x) for x in tokens], q, [-(-x * reps // block) for x in tokens])
        return pdf[["_s", "_shard", "tokens", "max_repeats", "share", "q"]]

    quotas = held.join(F.broadcast(plan), "_s").groupBy("_s").applyInPandas(share_out, "_s string, _shard bigint, tokens bigint, max_repeats int, share double, q bigint")
    w = Window.partitionBy("_s", "_shard").orderBy("_h", "_k", "n_tokens")
    placed = sharded.withColumn("_mid", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2)
    picked = (
        placed.join(quotas, ["_s", "_shard"])
        .withColumn("times", F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.ceil((F.col("q") * block - F.col("_mid")) / F.col("tokens")))).cast("int"))
        .where("times > 0")
    )
    chosen = materialize(picked.select("_s", "_k", "n_tokens", "times", "share"))
    got = {r[0]: r[1] for r in chosen.groupBy("_s").agg(F.sum(F.col("n_tokens") * F.col("times"))).collect()}
    all_got = sum(got.values()) or 1
    actual = spark.createDataFrame([(s, g / all_got) for s, g in sorted(got.items())] or [("", 0.0)], "_s string, actual_share double")
    return chosen.join(F.broadcast(actual), "_s").select(F.col("_s").alias(source), F.col("_k").alias(key), "n_tokens", "times", F.col("share").alias("target_share"), "actual_share")


def mix_report(mix: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """One row per target: its share and repeats, and the tokens, texts and share it got."""
    got = mix.groupBy(F.col(source).alias("_s")).agg(
        F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"), F.first("actual_share").alias("actual_share")
    )
    j = targets.join(F.broadcast(got), F.col(source) == F.col("_s"), "left")
    return j.select(source, "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "tokens", "most_times", "actual_share")])

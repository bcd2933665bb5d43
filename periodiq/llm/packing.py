"""Filling fixed-capacity containers with items (problem 8): hierarchical residual packing.

Round 0 runs best-fit inside every input partition, without a shuffle. Nearly
full bins are final. Each later round takes the underfull bins as items, spreads
them over as many tasks as their number needs, and runs best-fit again; the
number of tasks shrinks as bins are sealed, so the bins meet in a tree. It ends
after the round in one task, or when a round joins hardly any bins.

A task holds at most `per_task` bins or a chunk of as many items, so no task
ever sees all items. Every text takes at least one place, so a bin has at most
`capacity` members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodiq.session import materialize

_BIN = "container_id string, container_kind string, capacity bigint, fill bigint, ids array<bigint>, pieces array<int>, sizes array<bigint>"
MAX_KINDS = 1000


class Bins:
    """Open bins of one capacity, found by residual through a bit set."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.by_rest = capacity, 0, {}
        self.count = 0

    def put(self, size: int, members: list) -> None:
        """Into the bin with the least sufficient rest, or a new one."""
        above = self.mask >> size
        if above:
            rest = size + (above & -above).bit_length() - 1
            held = self.by_rest[rest]
            bin_members = held.pop()
            if not held:
                self.mask &= ~(1 << rest)
            bin_members.extend(members)
        else:
            rest, bin_members = self.capacity, list(members)
            self.count += 1
        rest -= size
        self.by_rest.setdefault(rest, []).append(bin_members)
        self.mask |= 1 << rest

    def take(self, max_rest: int | None = None) -> list[tuple[int, list]]:
        """Removes and returns (fill, members) of the bins with at most max_rest left, or of all."""
        out = []
        for rest in sorted(r for r in self.by_rest if self.by_rest[r] and (max_rest is None or r <= max_rest)):
            out.extend((self.capacity - rest, m) for m in self.by_rest.pop(rest))
            self.mask &= ~(1 << rest)
        self.count -= len(out)
        return out


def _frame(kind: str, capacity: int, bins: list[tuple[int, list]], name: Iterator[str]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "container_id": [f"{kind}-{next(name)}" for _ in bins],
            "container_kind": [kind] * len(bins),
            "capacity": [capacity] * len(bins),
            "fill": [f for f, _ in bins],
            "ids": [[m[0] for m in ms] for _, ms in bins],
            "pieces": [[m[1] for m in ms] for _, ms in bins],
            "sizes": [[m[2] for m in ms] for _, ms in bins],
        }
    )


def _names(round_no: int) -> Iterator[str]:
    """Names of the bins that this task makes; a bin that goes on is renamed by the next round."""
    task = TaskContext.get().partitionId()
    return (f"{round_no}-{task}-{n}" for n in count())


def _first_round(capacities: dict[str, int], seal: float, per_task: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_bins, name = {k: Bins(c) for k, c in capacities.items()}, _names(0)

        def pack(chunk: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
            for kind, cap in capacities.items():
                bins, pieces = open_bins[kind], []
                for key, n in chunk:
                    full, rest = divmod(max(n, 1), cap)
                    pieces.extend((cap, key, i, cap) for i in range(full))
                    if rest:
                        pieces.append((rest, key, full, n - full * cap))
                pieces.sort(key=lambda p: -p[0])
                for size, key, i, tokens in pieces:
                    bins.put(size, [(key, i, tokens)])
                done = bins.take(int(cap * (1 - seal)))
                if bins.count > per_task:
                    done += bins.take()
                if done:
                    yield _frame(kind, cap, done, name)

        chunk: list[tuple[int, int]] = []
        for pdf in batches:
            chunk.extend(zip(pdf["_key"].tolist(), pdf["n_tokens"].tolist(), strict=True))
            if len(chunk) >= per_task:
                yield from pack(chunk)
                chunk = []
        yield from pack(chunk)
        for kind, cap in capacities.items():
            if rest := open_bins[kind].take():
                yield _frame(kind, cap, rest, name)

    return run


def _merge_round(seal: float, per_task: int, round_no: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = _names(round_no)
        open_bins: dict[tuple[str, int], Bins] = {}
        waiting: dict[tuple[str, int], list] = {}

        def pack(k: tuple[str, int]) -> Iterator[pd.DataFrame]:
            bins = open_bins.setdefault(k, Bins(k[1]))
            for fill, members in sorted(waiting.pop(k, ()), key=lambda x: (-x[0], x[1][0])):
                bins.put(fill, members)
            done = bins.take(int(k[1] * (1 - seal)))
            if bins.count > per_task:
                done += bins.take()
            if done:
                yield _frame(*k, done, name)

        for pdf in batches:
            for _, kind, cap, fill, ids, pieces, sizes in pdf.itertuples(index=False, name=None):
                waiting.setdefault((kind, cap), []).append((fill, list(zip(ids, pieces, sizes, strict=True))))
            for k in [k for k, w in waiting.items() if len(w) >= per_task]:
                yield from pack(k)
        for k in list(waiting):
            yield from pack(k)
        for k, bins in open_bins.items():
            if rest := bins.take():
                yield _frame(*k, rest, name)

    return run


def pack_bins(
    sizes: DataFrame,
    specs: DataFrame,
    key: str = "doc_id",
    seal: float = 0.98,
    per_task: int = 20_000,
    rounds: int = 8,
) -> DataFrame:
    """Bins (container_id, container_kind, capacity, fill, ids, pieces, sizes) that hold every row of sizes, for every spec.

    sizes: (key bigint, n_tokens). specs: container_kind, capacity_tokens, a
    fixed table, read to the driver within MAX_KINDS rows; null, zero and
    negative capacities are left out. Rows larger than a capacity are cut into
    full pieces and a rest, others never. Empty texts take one place of size 1
    but count 0 tokens. Repeated keys are packed as often as they come. An
    empty table gives no bins.
    """
    rows = specs.select("container_kind", "capacity_tokens").distinct().limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    capacities = {r[0]: int(r[1]) for r in sorted(rows, key=str) if r[0] is not None and (r[1] or 0) > 0}
    spark = sizes.sparkSession
    if not capacities:
        return spark.createDataFrame([], _BIN)
    items = sizes.select(F.col(key).cast("bigint").alias("_key"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    now = materialize(items.mapInPandas(_first_round(capacities, seal, per_task), _BIN))
    sealed = F.col("fill") >= F.ceil(F.col("capacity") * seal)
    final, before = now.where(sealed), None
    for round_no in range(1, rounds + 1):
        under = now.where(~sealed)
        left = under.count()
        if not left or (before is not None and (before[0] == 1 or left > 0.99 * before[1])):
            break
        tasks = max(1, -(-left // per_task))
        order = F.xxhash64(F.get("ids", F.lit(0)), F.get("pieces", F.lit(0)), "container_kind")
        now = materialize(under.repartition(tasks, F.pmod(order, F.lit(tasks * 64))).mapInPandas(_merge_round(seal, per_task, round_no), _BIN))
        final, before = final.unionByName(now.where(sealed)), (tasks, left)
    return final.unionByName(now.where(~sealed))


def container_assignments(bins: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per piece: container, its fill, and the piece of the text that it holds."""
    member = F.inline(F.arrays_zip("ids", "pieces", "sizes"))
    return bins.select("container_kind", "capacity", "fill", "container_id", member).select(
        "container_kind", "container_id", F.col("ids").alias(key), F.col("pieces").alias("piece_no"), F.col("sizes").alias("n_tokens"), "fill", "capacity"
    )


def packing_report(bins: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the fewest containers that could do, and the share of space used."""
    return bins.groupBy("container_kind", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("fill").alias("tokens"),
        F.ceil(F.sum("fill") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("fill") / F.sum("capacity"), 4).alias("used_share"),
    )

"""Mapping free-entered values to a canonical list (problem 7).

Every token of the reference entries hangs in BK-trees; the metric is the
Levenshtein distance, so the triangle inequality prunes a tree. The trees are
sharded by a third of the word: within two edits one third stays whole, moved by
at most two, so a search enters only the shards that share one, and misses
nothing. Abbreviations and initials are met by the first letter. A value meets
every entry in which all its tokens have a partner, and every shorter entry of
whose anchor, the token that the fewest entries share, it has a partner: no pair
that can be aligned is left out. An optimal token assignment then
decides which of these the value denotes. The reference is cut into shards of a
bounded size, one if it is small; every distinct value is searched in every
shard, and the shard winners merge by one aggregation. There is one path at every
size: a shard is sent to the tasks that search it, nothing is collected, and since
no pair that can be aligned is left out, the cut does not change the answer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodiq.llm.names import Name, align, read_name, token_match
from periodiq.session import materialize

PER_SHARD = 50_000
_OUT = "v string, ref bigint, kind string, score double, rivals int"


def levenshtein(a: str, b: str) -> int:
    """Edit distance by bit-parallel columns."""
    if not a or not b:
        return max(len(a), len(b))
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


class BKTree:
    """Words under a true metric; search returns every word within the threshold."""

    def __init__(self) -> None:
        self.root: tuple[str, dict] | None = None

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = levenshtein(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, threshold: int) -> list[tuple[str, int]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = levenshtein(word, at)
            if d <= threshold:
                out.append((at, d))
            todo.extend(c for k, c in children.items() if d - threshold <= k <= d + threshold)
        return out


class ShardedTree:
    """BK-trees by (length, part, letters of the part); exact up to two edits."""

    MOST = 2

    def __init__(self) -> None:
        self.shards: dict[tuple[int, int, str], BKTree] = {}

    @staticmethod
    def parts(n: int) -> list[tuple[int, int]]:
        """(start, end) of the thirds of a word of n letters."""
        a, b = n // 3, 2 * n // 3
        return [(0, a), (a, b), (b, n)]

    def add(self, word: str) -> None:
        for k, (i, j) in enumerate(self.parts(len(word))):
            self.shards.setdefault((len(word), k, word[i:j]), BKTree()).add(word)

    def within(self, word: str, threshold: int) -> list[tuple[str, int]]:
        t = min(threshold, self.MOST)
        trees: dict[int, BKTree] = {}
        for n in range(max(1, len(word) - t), len(word) + t + 1):
            for k, (i, j) in enumerate(self.parts(n)):
                for at in range(max(0, i - t), i + t + 1):
                    tree = self.shards.get((n, k, word[at : at + j - i]))
                    if tree is not None:
                        trees[id(tree)] = tree
        return sorted({hit for tree in trees.values() for hit in tree.within(word, t)})


class Reference:
    """A shard of the reference list: (id, canonical or variant, acronym)."""

    def __init__(self, rows: list[tuple[int, str, str | None]], unique_acronyms: dict[str, int]) -> None:
        self.acronyms = unique_acronyms
        self.read = [(i, n) for i, t, _ in rows if t and (n := read_name(t)).tokens and not n.bare]
        self.by_token: dict[str, list[int]] = {}
        for at, (_, n) in enumerate(self.read):
            for t in set(n.tokens):
                self.by_token.setdefault(t, []).append(at)
        self.by_anchor: dict[str, list[int]] = {}
        self.typed: dict[str, list[str]] = {}
        self.initials: dict[str, list[str]] = {}
        self.tree = ShardedTree()
        for at, (_, n) in enumerate(self.read):
            anchor = min(n.tokens, key=lambda t: (len(self.by_token[t]), -len(t), t))
            self.by_anchor.setdefault(anchor, []).append(at)
        for t in self.by_token:
            w = t.rstrip(".")
            if w not in self.typed:
                self.tree.add(w)
                self.initials.setdefault(w[:1], []).append(w)
            self.typed.setdefault(w, []).append(t)
        self.cache: dict[str, list[str]] = {}

    def partners(self, token: str) -> list[str]:
        """All tokens of the list that may stand for the token: spellings by the trees, abbreviations by the first letter."""
        if token not in self.cache:
            w = token.rstrip(".")
            words = {x for x, _ in self.tree.within(w, 2)} | set(self.initials.get(w[:1], ()))
            self.cache[token] = sorted(t for x in words for t in self.typed[x] if token_match(token, t) or x.startswith(w) or w.startswith(x))
        return self.cache[token]

    def candidates(self, name: Name) -> set[int]:
        """Places of every listed name that may fit: all tokens of the shorter name have a partner in the longer."""
        options = [self.partners(t) for t in dict.fromkeys(name.tokens)]
        sizes = [sum(len(self.by_token[y]) for y in o) for o in options]
        # a listed name as long or longer holds a partner of every token: the tokens with the fewest listed names first
        near: set[int] | None = None
        for k in sorted(range(len(options)), key=lambda k: sizes[k]):
            if near is not None and len(near) <= 16:
                break
            held = {at for y in options[k] for at in self.by_token[y]}
            near = held if near is None else near & held
        # of a shorter one, the anchor is among the partners
        shorter = {at for o in options for y in o for at in self.by_anchor.get(y, ()) if len(self.read[at][1].tokens) < len(name.tokens)}
        return (near or set()) | shorter

    def find(self, value: str) -> tuple[int, str, float, int] | None:
        """(id, kind, score, rivals) of the entry that the value denotes, or None."""
        name = read_name(value)
        if name.bare or not name.tokens:
            i = self.acronyms.get(name.acronym)
            return (i, "acronym", 1.0, 0) if i is not None else None
        rank = {"full": 3, "short": 2, "cut": 1, "loose": 0}
        by_entry: dict[int, tuple[int, float]] = {}
        for at in self.candidates(name):
            i, r = self.read[at]
            f = align(name, r)
            if f.kind != "none" and (len(name.tokens) <= len(r.tokens) or f.kind == "short"):
                by_entry[i] = max(by_entry.get(i, (-1, 0.0)), (rank[f.kind], f.score))
        best = [(*f, i) for i, f in by_entry.items()]
        if not best:
            return None
        best.sort(key=lambda b: (-b[0], -b[1], b[2]))
        kind = next(k for k, r in rank.items() if r == best[0][0])
        rivals = sum(1 for b in best[1:] if b[:2] == best[0][:2])
        return best[0][2], kind, best[0][1], rivals


def _search(ref: Reference):
    def run(values: list[str]) -> pd.DataFrame:
        rows = []
        for v in values:
            hit = ref.find(v)
            if hit:
                rows.append((v, *hit))
        return pd.DataFrame(rows, columns=["v", "ref", "kind", "score", "rivals"])

    return run


def map_values(
    df: DataFrame,
    column: str,
    reference: DataFrame,
    variants: DataFrame,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """(value, ref, kind, score) of every distinct value of the column; ref is null where it denotes no entry.

    reference: (id, canonical, acronym); variants: (venue_acronym_id, variant).
    kind is exact for a value that is letter for letter an entry, else full,
    short, cut, loose or acronym. Values that fit two entries equally well, and
    acronyms of several entries, are left unmatched. Null values do not come
    out; blank ones come out unmatched. Null entries are no entries. Each
    distinct value is searched once, however often it is typed.
    """
    entries = reference.select(F.col("id").cast("bigint").alias("id"), F.col("canonical").alias("t"), "acronym").where("id is not null")
    more = variants.select(F.col("venue_acronym_id").cast("bigint").alias("id"), F.col("variant").alias("t"), F.lit(None).cast("string").alias("acronym")).where("id is not null")
    listed = entries.unionByName(more)
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    exact = listed.where("t is not null").groupBy("t").agg(F.min("id").alias("exact"))
    single = entries.where("acronym is not null").groupBy(F.upper("acronym").alias("a")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1")
    values = materialize(values)
    shards = max(1, -(-listed.count() // per_shard))
    # a value meets one shard at a time; parts keep what a task holds bounded and all tasks busy
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-values.count() // per_shard))
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    sharded = listed.join(single.select("id", F.col("a").alias("single")), "id", "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("part", numbered(parts))
    asked = values.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))).withColumn("shard", numbered(shards))

    built: dict[int, Reference] = {}  # the shard at hand, once per task

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] not in built:
            acronyms = {a: i for a, i in zip(right["single"], right["id"], strict=True) if isinstance(a, str)}
            rows = [(i, t if isinstance(t, str) else None, a) for i, t, a in zip(right["id"].tolist(), right["t"].tolist(), right["acronym"].tolist(), strict=True)]
            built.clear()
            built[key[0]] = Reference(rows, acronyms)
        return _search(built[key[0]])(left["v"].tolist())

    # the search is the costly part: once, whatever the plan makes of the joins
    found = materialize(asked.groupBy("shard", "part").cogroup(sharded.groupBy("shard", "part")).applyInPandas(pair, _OUT))
    rank = F.when(F.col("kind").isin("full", "acronym"), 3).when(F.col("kind") == "short", 2).when(F.col("kind") == "cut", 1).otherwise(0)
    top = found.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "score", (-F.col("ref")).alias("neg"), "kind", "rivals")), asc=False).alias("w"))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    tie = (first["rivals"] > 0) | F.coalesce((second["rank"] == first["rank"]) & (second["score"] == first["score"]), F.lit(False))
    won = top.where(~tie).select("v", (-first["neg"]).alias("ref"), first["kind"].alias("kind"), first["score"].alias("score"))
    out = values.join(exact, F.col("v") == F.col("t"), "left").join(won, "v", "left")
    return out.select(
        F.col("v").alias("value"),
        F.coalesce("exact", "ref").alias("ref"),
        F.when(F.col("exact").isNotNull(), "exact").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"),
    )


def mapped_entries(df: DataFrame, key: str, column: str, reference: DataFrame, variants: DataFrame) -> DataFrame:
    """(key, ref, kind) of the rows whose value denotes an entry without being it letter for letter.

    The value that many rows share is joined from its one distinct row; the map
    holds distinct values only, and adaptive execution splits a hot one.
    """
    hits = map_values(df, column, reference, variants).where("ref is not null and kind <> 'exact'")
    return df.select(F.col(key).alias("_key"), F.col(column).alias("value")).join(hits, "value").select(F.col("_key").alias(key), "ref", "kind")

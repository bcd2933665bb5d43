"""Matching entities across sources without keys (problem 3).

Cross-table retrieval: the left table is an inverted index over the terms of all
attributes (words and their beginnings, as corrected by the corpus, serial
numbers, publisher words), and every distinct record of the right table is a
BM25 query. Listings known to be one entity are one indexed record, the union of
their terms, so a match is a match of the entity and holds for all of them.

Pruning is exact. A query visits its weightiest terms up to the point where the
rest together cannot lift a record to the least score that is accepted, and of a
posting only records that still have as much from that term on. Where a term is
common, queries and records meet by two terms that both have, and by three where
two are common still: a beginning of what they share, so the pairs that meet grow
with the rows and not with the postings' length.

A pair stands if each record is among the other's nearest and an exact alignment
of the names, or a number in common where a name is missing, agrees. Confidence
is a logistic curve over the score, its gap to the nearest other entity and the
kind of alignment, calibrated on pairs whose serial numbers agree or clash; the
numbers are labels only and no feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodiq.llm.identifiers import issn_digits
from periodiq.llm.names import align, fold, read_name, token_match
from periodiq.llm.variants import token_classes
from periodiq.session import materialize

# words count by their beginning, and half as much again if they are the same to the end
SHARES = {"p": 1.0, "n": 0.5, "a": 1.0, "i": 1.0, "u": 0.2}
KINDS = ("full", "short", "cut", "loose", "near", "none")
_TERMS = "ent bigint, term string, kind string"


def _rows(df: DataFrame, columns: tuple[str, str, tuple[str, ...], str]) -> DataFrame:
    key, name, issns, publisher = columns
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.array(*[issn_digits(F.col(c)) for c in issns]))))
    return df.select(F.col(key).alias("_key"), F.col(name).alias("name"), numbers.alias("issns"), F.col(publisher).alias("publisher"))


def _entities(rows: DataFrame, classes: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """(_key, ent) of all rows, and their distinct (ent, name, issns, publisher); an entity is named by its smallest key."""
    said = ["name", "issns", "publisher"]
    if classes is None:
        own = rows.groupBy(*said).agg(F.min("_key").alias("ent"))
        alike = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in said]
        both = rows.alias("r").join(own.alias("o"), alike[0] & alike[1] & alike[2])
        return both.select("r._key", "o.ent"), own.select("ent", *said)
    of = classes.select(F.col(key).alias("_key"), "class")
    of = of.join(of.groupBy("class").agg(F.min("_key").alias("ent")), "class").select("_key", "ent")
    return of, rows.join(of, "_key").groupBy("ent", *said).agg(F.count("*").alias("n")).select("ent", *said)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ent, name, issns, publisher in zip(*(pdf[c].tolist() for c in ("ent", "name", "issns", "publisher")), strict=True):
            out: set[tuple[str, str]] = set()
            if isinstance(name, str):
                n = read_name(name)
                out.update((t.rstrip("."), "n") for t in n.tokens)
                if n.bare and n.acronym:
                    out.add((n.acronym, "a"))
            out.update((x, "i") for x in issns if x)
            if isinstance(publisher, str):
                out.update((w, "u") for w in fold(publisher).lower().replace(".", " ").split() if len(w) >= 3)
            rows.extend((ent, t, k) for t, k in out)
        yield pd.DataFrame(rows, columns=["ent", "term", "kind"])


def _corrected(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ent, t, kind): words replaced by the commonest spelling one edit away over both tables, with their beginnings."""
    both = left.unionByName(right).where("kind = 'n'").groupBy("term").agg(F.count("*").alias("df"))
    rep = materialize(token_classes(materialize(both.withColumnRenamed("term", "token"))).select(F.col("token").alias("term"), "rep", F.lit("n").alias("kind")))

    def apply(d: DataFrame) -> DataFrame:
        d = d.join(rep, ["term", "kind"], "left").withColumn("term", F.coalesce("rep", "term"))
        begun = (F.col("kind") == "n") & (F.length("term") >= 4)
        own = F.struct(F.concat("kind", F.lit(":"), "term").alias("t"), "kind")
        beginning = F.struct(F.concat(F.lit("p:"), F.substring("term", 1, 4)).alias("t"), F.lit("p").alias("kind"))
        return d.select("ent", F.inline(F.when(begun, F.array(own, beginning)).otherwise(F.array(own)))).distinct()

    return materialize(apply(left)), materialize(apply(right))


def _weighted(terms: DataFrame, dfs: DataFrame, n: Column) -> DataFrame:
    """(ent, t, kind, df, w): BM25 weights, terms that no record has with df 0."""
    share = F.lit(0.0)
    for kind, x in SHARES.items():
        share = F.when(F.col("kind") == kind, x).otherwise(share)
    df = F.coalesce("df", F.lit(0))
    return terms.join(dfs, "t", "left").select("ent", "t", "kind", df.alias("df"), (share * F.log(1 + (n - df + 0.5) / (df + 0.5))).alias("w"))


def _ordered(terms: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, ts): the terms of a record, the weightiest first, each with its weight, what it and the lighter ones weigh, and whether it is a serial number."""
    ts = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("neg"), "t", (F.col("kind") == "i").alias("number"))))
    rest = lambda i: F.aggregate(F.slice("ts", i + 1, F.size("ts")), F.lit(0.0), lambda a, x: a - x["neg"])
    told = F.transform("ts", lambda x, i: F.struct(x["t"].alias("t"), (-x["neg"]).alias("w"), rest(i).alias("rest"), x["number"].alias("number")))
    return terms.groupBy(F.col("ent").alias(key)).agg(ts.alias("ts"), *more).withColumn("ts", told)


def _longer(chains: DataFrame, key: str, least: str) -> DataFrame:
    """(key, least, chain, at, sum, most): each chain with each further term of its record, as long as it and all lighter ones reach the least score."""
    step = F.transform("ts", lambda x, i: F.struct(i.alias("at"), F.xxhash64("chain", x["t"]).alias("chain"), (F.col("sum") + x["w"]).alias("sum"), (F.col("sum") + x["rest"]).alias("most")))
    step = F.filter(step, lambda x: (x["at"] > F.col("at")) & (x["most"] >= F.col(least)))
    return chains.select(key, least, F.explode(step).alias("x")).select(key, least, "x.*")


def _met(q: DataFrame, docs: DataFrame, per_row: int, longest: int) -> DataFrame:
    """(q, c) of all that may score theta, and few more. q: (q, theta, ts), docs: (c, ts).

    A chain is the beginning of the list of terms that two records share, the
    weightiest first. Whatever scores theta shares such a beginning of any length
    until that alone weighs theta. Records meet by a chain of one term where that
    is rare; a chain by which more than `per_row` pairs for each of its records
    would meet is made longer by one term on both sides.
    """
    none = [F.lit(0).cast("bigint").alias("chain"), F.lit(-1).alias("at"), F.lit(0.0).alias("sum")]
    asked = materialize(_longer(q.select("q", "theta", "ts", *none), "q", "theta"))
    held = docs.select("c", F.lit(0.0).alias("least"), "ts", *none)
    every = None
    for length in range(1, longest + 1):
        open_ = F.col("sum") < F.col("theta")
        wanted = asked.groupBy("chain").agg(F.min("theta").alias("low"), F.sum(open_.cast("bigint")).alias("n"), F.min(F.when(open_, F.col("theta"))).alias("least"))
        have = materialize(_longer(held, "c", "least").drop("least").join(wanted.select("chain", "low"), "chain").where("most >= low").drop("low"))
        hot = have.groupBy("chain").agg(F.count("*").alias("m")).join(wanted.where("n > 0"), "chain")
        hot = materialize(hot.where(F.col("n") * F.col("m") > per_row * (F.col("n") + F.col("m"))).select("chain", "least"))
        last = length == longest or not hot.limit(1).count()
        now = asked if last else asked.join(hot.select("chain", F.lit(True).alias("hot")), "chain", "left").where((F.col("sum") >= F.col("theta")) | F.col("hot").isNull())
        pairs = now.select("chain", "q", "theta").join(have.select("chain", "c", "most"), "chain").where("most >= theta").select("q", "c")
        every = pairs if every is None else every.unionByName(pairs)
        if last:
            return every.distinct()
        asked = materialize(_longer(asked.where(open_).join(hot.select("chain"), "chain").join(q.select("q", "ts"), "q"), "q", "theta"))
        held = have.join(hot, "chain").where("most >= least").join(docs, "c")
    return every


def retrieve(docs: DataFrame, queries: DataFrame, floor: float, near: float = 0.0, sure: float = 0.8, per_row: int = 16, longest: int = 5) -> DataFrame:
    """(q, c, score, plain, own) of all pairs that score at least `floor` of what the query's name would score and `near` of the query's best.

    docs, queries: (ent, t, kind, df, w). plain is the score without serial
    numbers, own what the query's name scores by itself, or all of it if it has
    none. Exact: nothing that reaches the score is left out, whatever its terms.
    The best score is bounded from below by a first search for what scores
    `sure`, which few records can; the second search then need not go below
    `near` of that, so only queries without a good answer go down to the floor.
    per_row and longest tell how long chains of common terms get, not what is found.
    """
    named = F.col("kind").isin("n", "p", "a")
    owns = queries.groupBy(F.col("ent").alias("q")).agg(F.coalesce(F.sum(F.when(named, F.col("w"))), F.sum("w")).alias("own"))
    q = materialize(_ordered(queries.where("df > 0"), "q").join(owns, "q"))
    docs = materialize(_ordered(docs, "c"))

    def search(q: DataFrame) -> DataFrame:
        met = _met(q, docs, per_row, longest)
        both = met.join(docs.select("c", F.transform("ts", lambda x: x["t"]).alias("has")), "c").join(q.select("q", "theta", "own", "ts"), "q")
        both = both.select("q", "c", "own", "theta", F.filter("ts", lambda x: F.array_contains("has", x["t"])).alias("ts"))
        score = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x["w"])
        plain = F.aggregate("ts", F.lit(0.0), lambda a, x: a + F.when(x["number"], 0.0).otherwise(x["w"]))
        return both.select("q", "c", score.alias("score"), plain.alias("plain"), "own", "theta").where("score >= theta").drop("theta")

    floored = q.withColumn("theta", F.col("own") * floor - 1e-9)
    if not near:
        return search(floored)
    first = materialize(search(q.withColumn("theta", F.col("own") * max(sure, floor) - 1e-9)).groupBy("q").agg((near * F.max("score") - 1e-9).alias("bound")))
    found = materialize(search(materialize(floored.join(first, "q", "left").withColumn("theta", F.greatest("theta", F.coalesce("bound", F.lit(0.0)))).drop("bound"))))
    return found.join(found.groupBy("q").agg(F.max("score").alias("q_best")), "q").where(F.col("score") >= near * F.col("q_best"))


def _aligned(name_q: pd.Series, names: pd.Series) -> pd.DataFrame:
    """The best alignment of a record's name with one of the entity's names, and which of the two is part of the other."""
    order = {"full": 5, "short": 4, "cut": 3, "loose": 2, "near": 1, "none": 0}
    rows = []
    for q, all_c in zip(name_q, names, strict=True):
        best = ("none", 0.0, "none")
        a = read_name(q) if isinstance(q, str) else None
        for c in all_c if a else ():
            b = read_name(c)
            fit = align(a, b)
            if fit.kind == "none" and len(a.tokens) == len(b.tokens) > 2 and sum(any(token_match(t, u) for u in b.tokens) for t in a.tokens) == len(a.tokens) - 1:
                got = ("near", 0.0, "none")  # one word beyond recognition: for the numbers to decide
            else:
                shorter = len(a.tokens) < len(b.tokens) or (len(a.tokens) == len(b.tokens) and sum(map(len, a.tokens)) < sum(map(len, b.tokens)))
                got = (fit.kind, fit.score, "none" if fit.kind in ("full", "none") else "q" if shorter else "c")
            best = max(best, got, key=lambda g: (order[g[0]], g[1]))
        rows.append(best)
    return pd.DataFrame(rows, columns=["kind", "fit", "part"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic curve by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def calibration(pairs: DataFrame, sample: int) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """Weights of the curve and its reliability, (mean confidence, share that agrees, pairs) by tenths of held-out pairs.

    pairs: (features, y). Of the at most `sample` pairs with the least hashes, every second fits the curve; the others test it.
    """
    got = pairs.where("y is not null").select("features", "y", F.xxhash64("features", "q", "c").alias("h")).orderBy("h").limit(sample).toPandas()
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), 3 + len(KINDS) - 1)
    y = got["y"].to_numpy(dtype=float)
    w = fit_logistic(x[::2], y[::2])
    p = 1 / (1 + np.exp(-x[1::2] @ w))
    tenth = np.minimum((p * 10).astype(int), 9)
    return w, [(float(p[tenth == k].mean()), float(y[1::2][tenth == k].mean()), int((tenth == k).sum())) for k in range(10) if (tenth == k).any()]


def entity_pairs(
    left: DataFrame,
    right: DataFrame,
    left_columns: tuple[str, str, tuple[str, ...], str],
    right_columns: tuple[str, str, tuple[str, ...], str],
    floor: float,
    near: float,
    near_record: float,
    left_classes: DataFrame | None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of entities that are near each other, with features and label, and the rows of both sides."""
    l_of, lp = _entities(_rows(left, left_columns), left_classes, left_columns[0])
    r_of, rp = _entities(_rows(right, right_columns), None, right_columns[0])
    l_of, lp, r_of, rp = materialize(l_of), materialize(lp), materialize(r_of), materialize(rp)
    d_terms, q_terms = _corrected(materialize(lp.mapInPandas(_terms, _TERMS).distinct()), materialize(rp.mapInPandas(_terms, _TERMS)))
    n = F.lit(lp.select("ent").distinct().count())
    dfs = d_terms.groupBy("t").agg(F.count("*").alias("df"))
    docs, queries = materialize(_weighted(d_terms, dfs, n)), materialize(_weighted(q_terms, dfs, n))
    scored = materialize(retrieve(docs, queries, floor, near))
    # each among the other's nearest: the records of an entity are compared by the share of themselves that they find in it
    share = F.col("score") / F.col("own")
    c_best = scored.groupBy("c").agg(F.max(share).alias("c_best"))
    close = scored.join(c_best, "c").where(share >= near_record * F.col("c_best"))
    # an entity shows its fullest and its commonest name
    names = lp.where("name is not null").groupBy("ent", "name").agg(F.count("*").alias("n")).groupBy("ent")
    names = names.agg(F.array_distinct(F.array(F.max_by("name", F.struct(F.length("name"), F.col("name"))), F.max_by("name", F.struct("n", "name")))).alias("names"))
    numbers = lp.select("ent", F.explode("issns").alias("x")).groupBy("ent").agg(F.collect_set("x").alias("ic"))
    shown = lp.select("ent").distinct().join(names, "ent", "left").join(numbers, "ent", "left")
    shown = shown.select("ent", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("ic", F.array().cast("array<string>")).alias("ic"))
    pairs = close.join(shown.withColumnRenamed("ent", "c"), "c").join(rp.select(F.col("ent").alias("q"), F.col("name").alias("name_q"), F.col("issns").alias("iq")), "q")
    alike = F.exists("iq", lambda x: F.exists("ic", lambda y: F.levenshtein(x, y) <= 2))
    said = F.when((F.size("iq") > 0) & (F.size("ic") > 0), F.when(F.arrays_overlap("iq", "ic"), 1).when(~alike, -1).otherwise(0)).otherwise(0)
    aligned = F.pandas_udf(_aligned, "kind string, fit double, part string")
    pairs = pairs.withColumn("said", said).withColumn("a", aligned("name_q", "names"))
    pairs = materialize(pairs.select("q", "c", "score", "plain", "own", "said", "a", (F.size("names") > 0).alias("named_c"), F.col("name_q").isNotNull().alias("named_q")))
    rank = F.element_at(F.create_map(*[F.lit(x) for k, r in (("full", 4), ("short", 3), ("cut", 2), ("loose", 1), ("near", 0), ("none", 0)) for x in (k, r)]), F.col("a.kind"))
    pairs = pairs.withColumn("rank", rank)
    other = pairs.where("rank = 0").groupBy("q").agg(F.max("plain").alias("rival"))
    pairs = pairs.join(other, "q", "left")
    # nothing near that does not align is at most at the border of what is near
    gap = F.col("plain") - F.when(F.col("rank") > 0, F.coalesce("rival", near * F.col("plain"))).otherwise(near * F.col("plain"))
    kinds = [(F.col("a.kind") == k).cast("double") for k in KINDS[:-1]]
    features = F.array(F.lit(1.0), F.col("plain") / F.col("own"), gap / F.col("own"), *kinds)
    pairs = pairs.select("q", "c", "score", "own", "said", "a", "rank", "named_q", "named_c", features.alias("features"), F.when(F.col("named_q") & F.col("named_c"), F.when(F.col("said") > 0, 1).when(F.col("said") < 0, 0)).alias("y"))
    return pairs, l_of, r_of


def link_entities(
    left: DataFrame,
    right: DataFrame,
    left_columns: tuple[str, str, tuple[str, ...], str] = ("id", "display_name", ("issn", "eissn"), "publisher"),
    right_columns: tuple[str, str, tuple[str, ...], str] = ("id", "display_name", ("issn", "issn_l"), "publisher"),
    floor: float = 0.45,
    near: float = 0.6,
    near_record: float = 0.5,
    sample: int = 20_000,
    left_classes: DataFrame | None = None,
) -> DataFrame:
    """(left_id, right_id, score, confidence) of pairs of rows that describe one entity.

    Each side names its key, name, serial numbers and publisher. left_classes
    (key, class) tells which left rows are known to be one entity; without it
    equal rows are. Candidates are all entities that score at least `floor` of
    what the record's name scores by itself. near is the share of a record's best
    score that an entity must reach, near_record that of the best share of itself
    that a record finds in the entity. The calibration is fitted on at most
    `sample` pairs whose serial numbers agree or clash, the only sampled step.
    Rows with null or empty attributes are matched by what they have; those with
    nothing match nothing. Equal rows are searched once and all come out. Empty
    tables give no pairs. Other columns are not looked at.
    """
    pairs, l_of, r_of = entity_pairs(left, right, left_columns, right_columns, floor, near, near_record, left_classes)
    pairs = materialize(pairs)
    w, _ = calibration(pairs, sample)
    logit = F.lit(0.0)
    for i, x in enumerate(w):
        logit = logit + F.lit(float(x)) * F.col("features")[i]
    # a name that is part of the other belongs to what fits it best, among all that are near
    pref = F.struct(F.greatest("said", F.lit(0)), "rank", F.round("a.fit", 6))
    q_pref = pairs.where("a.part = 'q'").groupBy("q").agg(F.max(pref).alias("q_pref"))
    c_pref = pairs.where("a.part = 'c'").groupBy("c").agg(F.max(pref).alias("c_pref"))
    stands = (
        F.when(F.col("rank") == 4, True)
        .when(F.col("a.part") == "q", pref == F.col("q_pref"))
        .when(F.col("a.part") == "c", pref == F.col("c_pref"))
        .otherwise((F.col("said") > 0) & (~F.col("named_q") | ~F.col("named_c") | (F.col("a.kind") == "near")))
    )
    kept = pairs.join(q_pref, "q", "left").join(c_pref, "c", "left").where(stands).select("q", "c", "score", (1 / (1 + F.exp(-logit))).alias("confidence"))
    return (
        l_of.select(F.col("_key").alias("left_id"), F.col("ent").alias("c"))
        .join(kept, "c")
        .join(r_of.select(F.col("_key").alias("right_id"), F.col("ent").alias("q")), "q")
        .select("left_id", "right_id", "score", "confidence")
    )

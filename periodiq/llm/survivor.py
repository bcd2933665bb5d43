"""Best representative of each duplicate group (problem 4): a latent truth model.

Every listing of a venue claims values; a value is true or not, and each source
has a sensitivity and a specificity per field. Expectation-maximisation infers
both from all groups together: a value's posterior follows from who claims it
and who could have but did not, and a source's two rates from the posteriors of
what it claimed and left out. Several values of a field may be judged true; the
survivor takes the most probable.

A shortened or damaged value is read as support, of half weight, for the value
that it comes from. What a value looks like (markup, broken-off ends,
abbreviations, spellings that the corpus corrects, a wrong check character, a
number that another venue holds) is evidence like any other: every sign is an
observer with two rates per field, inferred in the same rounds, so no weight of a
sign is set by hand. The rounds end when no rate changes any more.

Claims are pre-aggregated by (group, field, value, source), so a venue with any
number of equal listings is one small record. A value of a group is one row with
what all observers say of it; a round reads those rows and sums per observer on
the map side, so nothing that grows with the data is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodiq.llm.identifiers import issn_digits, issn_valid
from periodiq.llm.names import STOP, align, fold, generic, read_name, token_match
from periodiq.llm.variants import token_classes
from periodiq.session import materialize

MAX_OBSERVERS = 20_000
FIELDS = ("display_name", "issn", "eissn", "publisher")
# fixed values: what stands where there is no value
NO_VALUE = r"^(?:|[\W_]+|n\.?\s*/?\s*a\.?|n\.\s*n\.|none|null|nil|unknown|publisher|publisher name|tba|tbd|various|not available|k\.\s*a\.|s\.\s*n\.)$"
_DAMAGE = re.compile(r"<[a-z/]|&[a-z]+;|&#\d|[{}\\]|…|\.\.\.|�|[ãâ][\u0080-¿Œ-ƒˆ˜‐-›€™]|\bissn\b|\bvol\b")
# fixed values: short words that are whole in publishers' names
_WHOLE = frozenset("ltd inc co llc gmbh ag sa bv kg plc y e et and und".split())
_SPLIT = re.compile(r"[^\W_]+\.?")


def _words(v: str) -> list[str]:
    return [w for w in _SPLIT.findall(fold(v).lower()) if w.rstrip(".") not in STOP]


_words_of = lru_cache(maxsize=1 << 14)(_words)


def _shortened(raw: str, field: str) -> bool:
    """Whether a value holds abbreviations or letters for words."""
    words = _SPLIT.findall(fold(raw))
    cased = not raw.isupper()
    for w in words:
        plain = w.rstrip(".")
        low = plain.lower()
        if low in STOP or low in _WHOLE:
            continue
        if w.endswith(".") or len(plain) == 1 and field == "display_name" and low not in "ab":
            return True
        if field == "publisher" and cased and len(plain) <= 4 and sum(c.isupper() for c in plain) >= 2:
            return True
    return False


@lru_cache(maxsize=1 << 17)
def _supports(field: str, small: str, big: str) -> bool:
    """Whether the value may be a shortened or damaged form of the other."""
    if field in ("issn", "eissn"):
        return (len(small) >= 4 and big.startswith(small)) or (len(small) == len(big) == 8 and sum(a != b for a, b in zip(small, big, strict=True)) == 1)
    if field == "display_name":
        a, b = _name(small), _name(big)
        return bool(a.tokens) and len(a.tokens) <= len(b.tokens) and align(a, b).kind != "none"
    x, y = _words_of(small), _words_of(big)
    told = [w for w in x if len(w.rstrip(".")) >= 4 and any(token_match(w, u) and not generic(u) for u in y)]
    return bool(told) and len(small) <= len(big) + 1


_name = lru_cache(maxsize=1 << 14)(read_name)
# what an observer of each field looks at
SIGNS = {
    "display_name": ("damaged", "shortened", "misspelt", "dominated", "stale", "unfinished"),
    "publisher": ("damaged", "shortened", "misspelt", "dominated", "stale"),
    "issn": ("invalid", "elsewhere"),
    "eissn": ("invalid", "elsewhere"),
}


def _sign(sign: str, field: str, v: str, c: dict, n: int) -> bool:
    """Whether a value shows a sign that needs no other value of its group."""
    if sign == "damaged":
        return bool(_DAMAGE.search(v))
    if sign == "shortened":
        return _shortened(c["shown"], field)
    if sign == "misspelt":
        return bool(c["misspelt"])
    if sign == "dominated":
        return bool(c["dominated"])
    if sign == "invalid":
        return not c["valid"]
    if sign == "elsewhere":
        return c["elsewhere"] > n
    if sign == "unfinished":
        name = _name(c["shown"])
        return not name.tokens or bool(name.acronym) or name.bare or name.open_end or name.cut
    return False


_FACT = "grp string, field string, v string, first_id bigint, support double, observer array<int>, yes array<double>, no array<double>"
_CLAIM = ["grp", "field", "salt", "v", "source", "n", "first_id", "newest", "shown", "valid", "misspelt", "dominated", "elsewhere", "own"]


def _facts(index: dict[tuple[str, str], int]):
    """One row per value with what every observer says of it, from claims in the order of (grp, field, salt).

    A group of many values comes once per salt, with the values that the salt answers for marked as its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, [], []

        def close() -> None:
            if not held:
                return
            (grp, field, _), values = at, {}
            for c in held:
                x = values.setdefault(c["v"], {"id": c["first_id"], "by": {}, "c": c, "n": 0, "at": None})
                x["id"] = min(x["id"], c["first_id"])
                x["by"][c["source"]] = x["by"].get(c["source"], 0) + c["n"]
                x["n"] += c["n"]
                if not pd.isna(c["newest"]) and (x["at"] is None or c["newest"] > x["at"]):
                    x["at"] = c["newest"]
            total: dict[str, int] = {}
            for x in values.values():
                for s, n in x["by"].items():
                    total[s] = total.get(s, 0) + n
            signs = {v: {s: _sign(s, field, v, x["c"], x["n"]) for s in SIGNS[field]} for v, x in values.items()}
            # values without a fault of their own: what shortens one of them, or was last seen before one that is no form of it, shows it
            sound = {w for w in values if not any(signs[w].values())}
            whole = sound if field in ("display_name", "publisher") else set()
            for v, x in values.items():
                c = x["c"]
                if not c["own"]:
                    continue
                if "dominated" in signs[v]:
                    signs[v]["dominated"] |= any(w != v and len(w) > len(v) + 2 and _supports(field, v, w) for w in whole)
                    later = [w for w in whole if values[w]["at"] is not None and (x["at"] is None or x["at"] < values[w]["at"])]
                    signs[v]["stale"] = any(not _supports(field, w, v) and not _supports(field, v, w) for w in later)
                yes: dict[str, float] = dict(x["by"])
                for w, y in values.items():
                    # a flawed value speaks for the one it comes from, never the other way about
                    if w != v and (v in sound or w not in sound) and _supports(field, w, v):
                        for s, n in y["by"].items():
                            yes[s] = yes.get(s, 0.0) + 0.5 * n
                said = [(index[field, s], yes.get(s, 0.0), max(0.0, n - yes.get(s, 0.0))) for s, n in total.items()]
                for sign, bad in signs[v].items():
                    said.append((index[field, f"\u0001{sign}"], float(not bad), float(bad)))
                support = float(sum(yes.values()))
                out.append((grp, field, v, x["id"], support, [o for o, _, _ in said], [float(y) for _, y, _ in said], [float(n) for _, _, n in said]))

        names = [c.split()[0] for c in _FACT.split(", ")]
        for pdf in batches:
            for row in pdf[_CLAIM].itertuples(index=False, name=None):
                c = dict(zip(_CLAIM, row, strict=True))
                if (c["grp"], c["field"], c["salt"]) != at:
                    close()
                    at, held = (c["grp"], c["field"], c["salt"]), []
                held.append(c)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        close()
        yield pd.DataFrame(out, columns=names)

    return run


def dominated_values(words: DataFrame) -> DataFrame:
    """(v) of which a value at least twice as common holds all words and more.

    words: (v, n, token, df). A value looks up its rarest word among the words
    of commoner values: an equi-join, not pairs of a group.
    """
    sets = words.groupBy("v", "n").agg(F.array_sort(F.collect_set("token")).alias("ws"), F.min(F.struct("df", "token"))["token"].alias("token"))
    bigger = words.where("n > 1").select(F.col("v").alias("b"), F.col("n").alias("m"), "token").join(sets.select(F.col("v").alias("b"), F.col("ws").alias("bs")), "b")
    met = sets.join(bigger, "token").where("b <> v and m >= 2 * n and size(bs) > size(ws)")
    return met.where(F.size(F.array_except("ws", "bs")) == 0).select("v").distinct()


def _tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, v, n, w.rstrip(".")) for f, v, n in zip(pdf["field"].tolist(), pdf["v"].tolist(), pdf["n"].tolist(), strict=True) for w in set(_words(v)) if len(w) > 1]
        yield pd.DataFrame(rows, columns=["field", "v", "n", "token"])


def group_claims(listings: DataFrame, classes: DataFrame, key: str, source: str, updated: str) -> DataFrame:
    """(grp, field, v, source, n, first_id, newest, shown) of the groups of two or more listings."""
    sizes = classes.groupBy("class").agg(F.count("*").alias("size"), F.min(key).alias("grp")).where("size > 1")
    d = listings.select(F.col(key).alias("_key"), F.coalesce(source, F.lit("?")).alias("source"), F.col(updated).alias("_at"), *[F.col(f) for f in FIELDS])
    d = d.join(classes.join(sizes, "class").select(F.col(key).alias("_key"), F.col("grp").cast("string").alias("grp")), "_key")

    def canonical(f: str):
        t = F.lower(F.trim(F.regexp_replace(F.col(f), r"[\s\p{Z}]+", " ")))
        return F.regexp_replace(F.upper(t), r"[\s\-‐-―]", "") if f in ("issn", "eissn") else t

    number = F.col("field").isin("issn", "eissn")
    cells = d.select("_key", "grp", "source", "_at", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), canonical(f).alias("v"), F.col(f).alias("shown")) for f in FIELDS])))
    return (
        cells.where("v is not null").where(number | ~F.col("v").rlike(NO_VALUE)).where("v <> ''")
        .groupBy("grp", "field", "v", "source")
        .agg(F.count("*").alias("n"), F.min("_key").cast("bigint").alias("first_id"), F.max("_at").alias("newest"), F.min(F.struct((F.upper("shown") == F.col("shown")).alias("caps"), "shown"))["shown"].alias("shown"))
    )


def latent_truth(facts: DataFrame, sources: int, observers: int, rounds: int = 100, settled: float = 1e-3) -> tuple[DataFrame, list[tuple[float, float]], int]:
    """Facts with the logit of being true, the two rates of every observer, and the rounds it took.

    Observers below `sources` are sources, the others signs. Expectation-
    maximisation over all facts until no rate moves by more than `settled`.
    Rates stay on the driver: `observers` is checked against MAX_OBSERVERS.
    """
    if observers > MAX_OBSERVERS:
        raise ValueError(f"{observers} observers; at most {MAX_OBSERVERS} sources and signs are held at once")
    spark = facts.sparkSession
    # where the rounds start, and the mean of the Beta priors that keep the rates of rarely seen observers moderate
    begin = [(0.7, 0.8) if i < sources else (0.9, 0.5) for i in range(observers)]
    rates, weight = list(begin), 20.0
    said = F.arrays_zip("observer", "yes", "no")

    def scored(rates: list[tuple[float, float]]) -> DataFrame:
        told = spark.createDataFrame([([math.log(a / (1 - b)) for a, b in rates], [math.log((1 - a) / b) for a, b in rates])], "up array<double>, down array<double>")
        logit = F.aggregate(said, F.lit(0.0), lambda t, o: t + o["yes"] * F.get("up", o["observer"]) + o["no"] * F.get("down", o["observer"]))
        return facts.crossJoin(F.broadcast(told)).withColumn("logit", logit).drop("up", "down")  # one row of bounded size

    for n in range(1, rounds + 1):
        p = F.lit(1.0) / (1 + F.exp(-F.least(F.greatest("logit", F.lit(-30.0)), F.lit(30.0))))
        each = scored(rates).select(p.alias("p"), F.explode(said).alias("o")).select("p", "o.observer", "o.yes", "o.no")
        sums = each.groupBy("observer").agg(F.sum(F.col("p") * F.col("yes")), F.sum(F.col("p") * (F.col("yes") + F.col("no"))), F.sum((1 - F.col("p")) * F.col("no")), F.sum((1 - F.col("p")) * (F.col("yes") + F.col("no"))))
        new = list(begin)
        for i, yes, true, no, false in sums.collect():
            a, b = begin[i]
            new[i] = (min(max((yes + weight * a) / (true + weight), 1e-4), 1 - 1e-4), min(max((no + weight * b) / (false + weight), 1e-4), 1 - 1e-4))
        moved = max((abs(x - y) for old, now in zip(rates, new, strict=True) for x, y in zip(old, now, strict=True)), default=0.0)
        rates = new
        if moved <= settled:
            break
    return scored(rates), rates, n


def claim_facts(listings: DataFrame, classes: DataFrame, key: str, source: str, updated: str, per_salt: int = 64) -> tuple[DataFrame, int, int]:
    """Facts of all groups of two or more listings, the number of sources, and that of all observers."""
    claims = materialize(group_claims(listings, classes, key, source, updated))
    values = materialize(claims.groupBy("field", "v").agg(F.sum("n").alias("n")))
    words = materialize(values.where("field in ('display_name', 'publisher')").mapInPandas(_tokens_of, "field string, v string, n bigint, token string"))
    flawed, dominated = None, None
    for f in ("display_name", "publisher"):
        w = words.where(F.col("field") == f)
        common = materialize(w.groupBy("token").agg(F.sum("n").alias("df")))
        better = token_classes(common).where("rep <> token and length(token) >= 5").join(common, "token").select("token", "rep", "df")
        bad = better.join(common.select(F.col("token").alias("rep"), F.col("df").alias("more")), "rep").where("more > df").select("token")
        bad = w.join(bad, "token").select("field", "v").distinct()
        flawed = bad if flawed is None else flawed.unionByName(bad)
        if f == "publisher":
            dominated = dominated_values(w.join(common, "token")).withColumn("dominated", F.lit(True)).withColumn("field", F.lit(f))
    # a number that another venue holds more often is not this venue's
    held = claims.where("field in ('issn', 'eissn')").groupBy("grp", "v").agg(F.sum("n").alias("n"))
    strongest = held.groupBy("v").agg(F.max(F.struct("n", "grp")).alias("m")).select("v", F.col("m.n").alias("most"), F.col("m.grp").alias("holder"))
    d = claims.join(flawed.withColumn("misspelt", F.lit(True)), ["field", "v"], "left").join(dominated, ["field", "v"], "left").join(strongest, "v", "left")
    digits = issn_digits(F.col("v"))
    d = d.withColumns(
        {
            "valid": F.col("field").isin("issn", "eissn") & digits.isNotNull() & issn_valid(digits),
            "misspelt": F.coalesce("misspelt", F.lit(False)),
            "dominated": F.coalesce("dominated", F.lit(False)),
            "elsewhere": F.when(F.col("field").isin("issn", "eissn") & (F.col("holder") != F.col("grp")), F.col("most")).otherwise(0),
        }
    ).drop("most", "holder")
    # groups of very many values are answered for in parts, so no task compares all pairs of one
    size = claims.groupBy("grp", "field").agg(F.count_distinct("v").alias("m")).select("grp", "field", F.ceil(F.col("m") / per_salt).cast("int").alias("salts"))
    d = d.join(size, ["grp", "field"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int") == F.col("salt"))
    known = [tuple(r) for r in claims.select("field", "source").distinct().orderBy("field", "source").limit(MAX_OBSERVERS + 1).collect()]
    index = {k: i for i, k in enumerate(known)}
    for f in FIELDS:
        for sign in SIGNS[f]:
            index[f, f"\u0001{sign}"] = len(index)
    ordered = d.repartition("grp", "field", "salt").sortWithinPartitions("grp", "field", "salt", "first_id", "v", "source")
    return materialize(ordered.mapInPandas(_facts(index), _FACT)), len(known), len(index)


def field_truths(listings: DataFrame, classes: DataFrame, key: str = "id", source: str = "source_name", updated: str = "updated_at", rounds: int = 100) -> DataFrame:
    """(grp, field, v, first_id, support, logit) of every value claimed in a group of two or more listings.

    classes: (key, class). first_id is the smallest id that holds the value,
    equal up to case, blanks and hyphens of serial numbers. Null and blank
    values and stand-ins for no value are no claims, null sources are one source,
    repeated listings count as often as they come, ties go to the smaller id. No
    groups, no rows.
    """
    facts, sources, observers = claim_facts(listings, classes, key, source, updated)
    truths, _, _ = latent_truth(facts, sources, observers, rounds)
    return materialize(truths.select("grp", "field", "v", "first_id", "support", "logit"))


def judged_true(truths: DataFrame, least_logit: float = 0.0) -> DataFrame:
    """(group_id, field_name, value, record_id, probability) of every value judged true: a field may have several.

    A number claimed as print and as electronic stays with the field where it is the likelier.
    """
    good = _good(truths, least_logit)
    return good.select(F.col("grp").cast("bigint").alias("group_id"), F.col("field").alias("field_name"), F.col("v").alias("value"), F.col("first_id").alias("record_id"), (1 / (1 + F.exp(-F.col("logit")))).alias("probability"))


def _good(truths: DataFrame, least_logit: float) -> DataFrame:
    good = truths.where(F.col("logit") > least_logit)
    number = F.col("field").isin("issn", "eissn")
    likelier = good.where(number).groupBy("grp", "v").agg(F.max_by("field", F.struct("logit", "support", "field")).alias("place"))
    return good.join(likelier, ["grp", "v"], "left").where(~number | (F.col("place") == F.col("field")))


def survivors(truths: DataFrame, least_logit: float = 0.0) -> DataFrame:
    """(group_id, field_name, record_id): the most probable value judged true, by the smallest listing that holds it.

    A number claimed as print and as electronic stays with the field where it is the likelier.
    """
    good = _good(truths, least_logit)
    best = good.groupBy("grp", "field").agg(F.max(F.struct("logit", "support", (-F.col("first_id")).alias("neg"))).alias("b"))
    return best.select(F.col("grp").cast("bigint").alias("group_id"), F.col("field").alias("field_name"), (-F.col("b.neg")).alias("record_id"))

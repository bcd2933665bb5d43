"""Variant spellings of names typed by people (problem 6).

Distinct strings are read once into token keys. A symmetric-delete index over
the tokens finds, for every token, the commonest spelling one edit away; by the
rarest of its so corrected tokens a key falls into a block, so that all
spellings of a name meet without pairs being formed. In a block, keys join the
fullest name with which an optimal assignment pairs all their tokens.

So that a misspelling as its rarest word does not part a key from its kin, it
also goes to the blocks of pairs of its three rarest words, one of them told only
by how it begins or by its first and last letter: spellings that align share one
of these, whatever the size of the table, and common words never make a block by
themselves. The edges are star-shaped and are closed into classes by rounds of
minimum labels, run until nothing changes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodiq.llm.names import GENERIC, Name, align, read_name, token_match, word_partners
from periodiq.session import materialize

# fixed values: what is typed where there is no venue
NO_VENUE = frozenset(
    "submitted|in press|to appear|n/a|na|none|unknown|unpublished|preprint|personal communication|technical report|phd thesis|master thesis|"
    "masters thesis|thesis|manuscript|in preparation|under review|accepted|forthcoming|working paper|report|book|-|null|nan|tba|tbd".split("|")
)


def read_strings(strings: DataFrame, text: str = "s") -> DataFrame:
    """(s, key, acronym, bare, joints) of distinct strings; key is null where nothing can be read.

    key and joints hold all of the reading that an alignment looks at, so no
    string is read twice. Blocks of Arrow batches, no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf["s"].tolist():
                if s.strip().lower().strip(" .,;:\"'()[]{}") in NO_VENUE:
                    rows.append((s, None, None, False, None))
                    continue
                n = read_name(s)
                key = None if n.bare or not n.tokens else " ".join(n.tokens) + (" …" if n.cut else "")
                rows.append((s, key, n.acronym or None, n.bare, None if key is None else _joints(n)))
            yield pd.DataFrame(rows, columns=["s", "key", "acronym", "bare", "joints"])

    return strings.select(F.col(text).alias("s")).mapInPandas(run, "s string, key string, acronym string, bare boolean, joints string")


def _joints(n: Name) -> str:
    """Where small words stand in a name: a digit for each token, and a plus for an open end."""
    return "".join("01"[x] for x in n.joined) + "+" * n.open_end


def _name_of(key: str, joints: str) -> Name:
    """The name of a key, as read, but for its acronym."""
    tokens = key.split(" ")
    cut = tokens[-1] == "…"
    return Name(tuple(tokens[:-1] if cut else tokens), "", cut, False, tuple(x == "1" for x in joints.rstrip("+")), joints.endswith("+"))


def _deletes(t, least: int):
    """The word, and from a length on all words with one letter left out."""
    n = F.length(t)
    return F.array_distinct(F.concat(F.array(t), F.when(n >= least, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))).otherwise(F.array())))


def _prefixes(t, least: int, most: int):
    return F.when(F.length(t) >= least, F.transform(F.sequence(F.lit(least), F.least(F.length(t), F.lit(most))), lambda i: F.substring(t, F.lit(1), i))).otherwise(F.array())


def token_classes(tokens: DataFrame) -> DataFrame:
    """(token, rep, weight): rep is the commonest spelling one edit away, weight how common its word is.

    tokens: (token, df). A token moves to a neighbour only if that is three
    times as common, or if it is itself met at most twice. weight also counts
    longer words that the token, or a spelling one edit away, abbreviates.
    """
    near = tokens.select("token", "df", F.explode(_deletes(F.col("token"), 5)).alias("sig"))
    best = near.groupBy("sig").agg(F.max(F.struct("df", "token")).alias("b"))
    rep = near.join(best, "sig").groupBy("token", "df").agg(F.max("b").alias("b"))
    moves = (F.col("b.df") >= 3 * F.col("df")) | ((F.col("df") <= 2) & (F.struct(F.col("b.df"), F.col("b.token")) > F.struct(F.col("df"), F.col("token"))))
    rep = materialize(rep.select("token", "df", F.when(moves, F.col("b.token")).otherwise(F.col("token")).alias("rep1")))
    second = rep.select(F.col("token").alias("rep1"), F.col("rep1").alias("rep"))
    rep = rep.join(second, "rep1").drop("rep1")
    # an abbreviation is as common as the word it begins
    whole = tokens.select("df", F.explode(_prefixes(F.col("token"), 3, 40)).alias("sig"))
    misspelt = tokens.select("df", F.explode(F.array_distinct(F.flatten(F.transform(_prefixes(F.col("token"), 4, 8), lambda p: _deletes(p, 4))))).alias("sig"))
    common = whole.unionByName(misspelt).groupBy("sig").agg(F.max("df").alias("common"))
    sought = rep.select("token", F.explode(F.when(F.length("token") <= 8, F.array_distinct(F.concat(F.array("rep"), _deletes(F.col("token"), 4)))).otherwise(F.array("rep"))).alias("sig"))
    weight = sought.join(common, "sig").groupBy("token").agg(F.max("common").alias("weight"))
    return rep.join(weight, "token", "left").select("token", "rep", F.coalesce("weight", F.col("df")).alias("weight"))


def cluster_names(names: list[tuple[str, Name, int]]) -> list[tuple[str, str, str]]:
    """(key, hub key, kind) for the names of one block: (key, name, strings)."""
    seen = Counter(t for _, n, _ in names for t in n.tokens)
    short = {t for t in seen if t.endswith(".") or len(t) < 4}
    order = sorted(names, key=lambda r: (r[1].cut, -len(r[1].tokens), sum(t in short for t in r[1].tokens), -r[2], -sum(map(len, r[1].tokens)), r[0]))
    # whatever the fit, each word of the shorter name has a partner: a name is sought by its word whose partners are fewest
    partners = word_partners(list(seen))
    reach = {t: sum(seen[u] for u in some) for t, some in partners.items()}
    hubs: list[tuple[str, Name, str]] = []
    holding: dict[str, list[int]] = {}  # hubs by token
    led: dict[str, list[int]] = {}  # hubs by the token that they are sought by
    out: list[tuple[str, str, str]] = []
    for key, name, _ in order:
        size = len(name.tokens)
        full: list[tuple[float, str]] = []
        part: list[tuple[float, str, str]] = []
        loose: list[tuple[float, str, Name]] = []
        sought = min(name.tokens, key=lambda t: (reach[t], t))
        longest = max(name.tokens, key=len)
        met = {i for t in partners[sought] for i in holding.get(t, ()) if len(hubs[i][1].tokens) >= size}
        met.update(i for t in set(name.tokens) for u in partners[t] for i in led.get(u, ()) if len(hubs[i][1].tokens) < size)
        for i in sorted(met):
            hub_key, hub, hub_longest = hubs[i]
            if not (any(token_match(longest, u) for u in hub.tokens) if size <= len(hub.tokens) else any(token_match(hub_longest, u) for u in name.tokens)):
                continue
            fit = align(name, hub)
            if fit.kind == "full" and not _two_words(name, hub, seen):
                full.append((fit.score, hub_key))
            elif fit.kind in ("short", "cut"):
                part.append((fit.score, hub_key, fit.kind))
            elif fit.kind == "loose":
                loose.append((fit.score, hub_key, hub))
        if full:
            out.append((key, max(full, key=lambda f: f[0])[1], "full"))  # of equals the commoner, which came first
            continue
        best = sorted(part, reverse=True)
        # a broken-off name is its shortest continuation; a short form must be plain
        if best and (len(best) == 1 or best[0][0] > best[1][0]):
            out.append((key, best[0][1], best[0][2]))
            continue
        loose.sort(key=lambda r: (-r[0], r[1]))
        if loose and not best and all(_extends(h, loose[0][2]) for _, _, h in loose[1:]):
            out.append((key, loose[0][1], "loose"))
            continue
        for t in set(name.tokens):
            holding.setdefault(t, []).append(len(hubs))
        led.setdefault(sought, []).append(len(hubs))
        hubs.append((key, name, longest))
        out.append((key, key, "hub"))
    return out


def _extends(longer: Name, shorter: Name) -> bool:
    """Whether all tokens of the shorter name are in the longer, more than it has."""
    return len(longer.tokens) > len(shorter.tokens) and all(any(token_match(t, u) for u in longer.tokens) for t in shorter.tokens)


def _two_words(a: Name, b: Name, seen: Counter) -> bool:
    """Whether a pair one edit apart are both common spellings, so two words."""
    for x in a.tokens:
        if x in b.tokens or len(x) < 5 or seen[x] < 4:
            continue
        for y in b.tokens:
            if y not in a.tokens and seen[y] >= 4 and token_match(x, y) == 2 and seen[y] < 5 * seen[x] and seen[x] < 5 * seen[y]:
                return True
    return False


def asked_blocks(blocks: DataFrame) -> DataFrame:
    """(block) of those that can tell something new; blocks: (key, rarest, block), each key once in a block.

    A block of one key tells nothing, keys of one rarest word have all met in its
    own block, and of blocks of the same keys, told by 128 bits, one is enough.
    """
    bits = lambda i: F.bit_xor(F.xxhash64("key", F.lit(i)))
    d = blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("rarest").alias("lo"), F.max("rarest").alias("hi"), bits(0).alias("h0"), bits(1).alias("h1"))
    return d.where("n > 1 and (lo <> hi or block = lo)").groupBy("n", "h0", "h1").agg(F.min("block").alias("block")).select("block")


def name_classes(read: DataFrame) -> DataFrame:
    """(key, class) of every key of read_strings."""
    keys = read.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max_by("joints", F.struct(F.length("s"), F.col("s"))).alias("joints"))
    keys = materialize(keys)
    word = F.explode(F.array_distinct(F.transform(F.split("key", " "), lambda w: F.regexp_replace(w, r"\.$", "")))).alias("token")
    of_key = keys.select("key", word).where("token <> '…'")
    tokens = materialize(token_classes(of_key.groupBy("token").agg(F.count("*").alias("df"))))
    ranked = of_key.join(tokens, "token").where(F.length("rep") >= 2)
    dull = F.col("rep").isin(sorted(GENERIC)) | (F.length("rep") < 4)
    ranked = ranked.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct(dull.alias("dull"), "weight", "rep"))), 1, 3).alias("r"))
    # of two words, the one told by how it begins and by its first and last letter may be misspelt or cut short
    marks = lambda w: F.array(F.substring(w, 1, 2), F.concat(F.substring(w, 1, 1), F.lit("."), F.right(w, F.lit(1))))
    telling = F.transform(F.filter("r", lambda x: ~x["dull"]), lambda x: x["rep"])
    split = F.flatten(F.transform("t", lambda x: F.flatten(F.transform(F.filter("t", lambda y: y != x), lambda y: F.transform(marks(y), lambda m: F.concat(x, F.lit("|"), m))))))
    ranked = ranked.select("key", F.col("r")[0]["rep"].alias("rarest"), telling.alias("t"))
    blocks = materialize(ranked.select("key", "rarest", F.explode(F.array_distinct(F.concat(F.array("rarest"), split))).alias("block")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # blocks arrive in order; most are tiny, so they share frames
        at, held, out = None, [], []

        def close() -> None:
            if held:
                out.extend(e[:2] for e in cluster_names([(k, _name_of(k, j), n) for k, j, n in held]) if e[2] != "hub")

        for pdf in batches:
            for block, k, j, n in zip(*(pdf[c].tolist() for c in ("block", "key", "joints", "n")), strict=True):
                if block != at:
                    close()
                    at, held = block, []
                held.append((k, j, n))
            if out:
                yield pd.DataFrame(out, columns=["key", "hub"])
                out = []
        close()
        yield pd.DataFrame(out, columns=["key", "hub"])

    ordered = blocks.join(asked_blocks(blocks), "block").join(keys, "key").repartition("block").sortWithinPartitions("block", "key")
    edges = ordered.select("block", "key", "joints", "n").mapInPandas(run, "key string, hub string")
    return classes_of(keys.select("key"), materialize(edges.where("key <> hub").distinct()))


def classes_of(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(key, class): connected components by minimum labels and jumps to the label's label; stars end after two or three rounds.

    Labels that still change after `rounds` are an error, never a result.
    """
    both = edges.select(F.col("key").alias("a"), F.col("hub").alias("b")).unionByName(edges.select(F.col("hub").alias("a"), F.col("key").alias("b")))
    linked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("class"))
    label = materialize(linked)
    for _ in range(rounds):
        offer = both.join(label.select(F.col("key").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("offer"))
        new = label.join(offer.withColumnRenamed("a", "key"), "key").select("key", F.least("class", "offer").alias("new"), "class")
        # jump to the label of the label
        jump = new.select(F.col("key").alias("new"), F.col("new").alias("further"))
        new = materialize(new.join(jump, "new", "left").select("key", F.coalesce("further", "new").alias("class"), F.col("class").alias("old")))
        label = new.select("key", "class")
        if not new.where("class <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"classes still change after {rounds} rounds")
    return nodes.join(label, "key", "left").select("key", F.coalesce("class", "key").alias("class"))


def string_classes(strings: DataFrame, text: str = "s", known: DataFrame | None = None) -> DataFrame:
    """(s, class) of the distinct non-null strings; strings that name nothing are left out.

    A string that is only an acronym joins the class beside whose names the
    acronym is given, if there is exactly one; known (acronym, name) adds
    meanings. Acronyms without a meaning form a class with their own spellings.
    """
    asked = strings.select(F.col(text).alias("s")).where(F.col("s").rlike(r"\p{L}")).distinct()
    read = read_strings(asked).withColumn("asked", F.lit(True))
    if known is not None:
        told = read_strings(known.where("name is not null").select(F.col("name").alias("s")).distinct())
        read = read.unionByName(told.withColumn("asked", F.lit(False)))
    read = materialize(read)
    classes = materialize(name_classes(read))
    named = materialize(read.where("key is not null").join(classes, "key").select("s", "class", "acronym", "asked"))
    said = named.where("acronym is not null").select("acronym", "class", F.lit(1).alias("rank"))
    if known is not None:
        listed = known.select(F.upper("acronym").alias("acronym"), F.col("name").alias("s")).where("acronym is not null")
        said = said.unionByName(listed.join(named.select("s", "class").distinct(), "s").select("acronym", "class", F.lit(0).alias("rank")))
    # what the list says goes before what stands beside names
    best = F.min("rank").alias("rank")
    meaning = said.join(said.groupBy("acronym").agg(best), ["acronym", "rank"]).groupBy("acronym").agg(F.min("class").alias("class"), (F.min("class") == F.max("class")).alias("one"))
    bare = read.where("bare and asked").join(meaning, "acronym", "left").where("coalesce(one, true)")
    bare = bare.select("s", F.coalesce("class", F.concat(F.lit("\u0001acronym "), F.col("acronym"))).alias("class"))
    return named.where("asked").select("s", "class").unionByName(bare)


def variant_pairs(classed: DataFrame, per_salt: int = 256) -> DataFrame:
    """(name_a, name_b) of all pairs of strings of a class, name_a < name_b by code point.

    The pairs are the result asked for; a class of many strings is spread over
    salts in proportion to its size, so no task holds more than its share.
    """
    size = classed.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / per_salt).cast("int"))
    d = classed.join(size, "class")
    left = d.select("class", F.col("s").alias("name_a"), F.pmod(F.xxhash64("s"), F.col("salts")).cast("int").alias("salt"))
    right = d.select("class", F.col("s").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["class", "salt"]).where("name_a < name_b").select("name_a", "name_b")


def _every(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    every = None
    for df, column in frames:
        d = df.select(F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct()
        every = d if every is None else every.unionByName(d)
    return every


def variant_classes(frames: list[tuple[DataFrame, str]], known: DataFrame | None = None) -> DataFrame:
    """(name, class, links): the class of every string, named by its least string, and how many others it links to.

    The form of link_variants that grows with the strings and not with the pairs.
    """
    classed = materialize(string_classes(_every(frames), known=known))
    size = classed.groupBy("class").agg(F.min("s").alias("least"), (F.count("*") - 1).alias("links"))
    return classed.join(size, "class").select(F.col("s").alias("name"), F.col("least").alias("class"), "links")


def link_variants(frames: list[tuple[DataFrame, str]], known: DataFrame | None = None) -> DataFrame:
    """Pairs of different strings of the given columns that denote the same venue.

    Null and blank strings, and strings without a letter, are no names. Repeated
    strings count once. Empty tables give no rows. Very long strings are read
    whole. Other columns are not looked at. known (acronym, name) tells what
    acronyms stand for; its names come out only if a column holds them.
    """
    return variant_pairs(materialize(string_classes(_every(frames), known=known)))

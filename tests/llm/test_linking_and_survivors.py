import random
from datetime import datetime
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from periodiq.llm.linking import _met, _ordered, fit_logistic, link_entities, retrieve
from periodiq.llm.survivor import _supports, claim_facts, dominated_values, field_truths, judged_true, latent_truth, survivors
from periodiq.llm.venues import venue_classes

PLACES = ["Gidonheim", "Pakolund", "Zirbova", "Mukatres", "Denifol", "Wostrina", "Halubek", "Torvimar"]
SUBJECTS = ["Optics", "Geodesy", "Virology", "Phonetics"]


def issn(n):
    d = f"{n:07d}"
    c = -sum(int(x) * w for x, w in zip(d, range(8, 1, -1), strict=True)) % 11
    return f"{d[:4]}-{d[4:]}{'X' if c == 10 else c}"


def left_rows():
    out, i = [], 0
    for k, p in enumerate(PLACES):
        for m, s in enumerate(SUBJECTS):
            i += 1
            out.append((i, f"{p} Journal of {s}", issn(1000 + 10 * k + m), None, f"Press of {p}", "x"))
    return out


def pairs(spark, left, right, **how):
    j = spark.createDataFrame(left, "id bigint, display_name string, issn string, eissn string, publisher string, score string")
    o = spark.createDataFrame(right, "id bigint, display_name string, issn string, issn_l string, publisher string, pid string")
    return {(r.left_id, r.right_id): r.confidence for r in link_entities(j, o, **how).collect()}


def test_links_against_brute_force(spark):
    left = left_rows()
    right = [(100 + i, n.replace("Journal of", "J.") if i % 2 else n.upper(), s if i % 3 else None, None, None, "y") for i, n, s, _, _, _ in left if i % 4]
    want = {(i - 100, i) for i, *_ in right}
    got = pairs(spark, left, right)
    assert set(got) == want and all(c >= 0.5 for c in got.values())


def test_pruned_retrieval_equals_scoring_of_all_pairs(spark):
    rng = random.Random(5)
    words = [f"n:w{i}" for i in range(40)] + [f"i:{i}" for i in range(10)] + [f"u:{i}" for i in range(4)]
    weight = {t: round(rng.uniform(0.05, 8), 3) for t in words}
    docs = {i: rng.sample(words, rng.randint(1, 9)) for i in range(150)}
    asked = {1000 + i: rng.sample(words, rng.randint(1, 7)) for i in range(120)} | {2000: ["u:1"], 2001: ["i:1", "u:2"]}
    seen = {t for ts in docs.values() for t in ts}
    frame = lambda x: spark.createDataFrame([(e, t, t[0], int(t in seen), weight[t]) for e, ts in x.items() for t in ts], "ent bigint, t string, kind string, df int, w double")
    want = set()
    for q, ts in asked.items():
        own = sum(weight[t] for t in ts if t[0] == "n") or sum(weight[t] for t in ts)
        for c, us in docs.items():
            score = sum(weight[t] for t in set(ts) & set(us))
            if score >= 0.45 * own - 1e-9:
                want.add((q, c, round(score, 6), round(sum(weight[t] for t in set(ts) & set(us) if t[0] != "i"), 6)))
    got = {(r.q, r.c, round(r.score, 6), round(r.plain, 6)) for r in retrieve(frame(docs), frame(asked), 0.45).collect()}
    assert got == want and len(want) > 300
    best = {}
    for q, _, score, _ in want:
        best[q] = max(score, best.get(q, 0))
    got = {(r.q, r.c, round(r.score, 6), round(r.plain, 6)) for r in retrieve(frame(docs), frame(asked), 0.45, 0.6).collect()}
    assert got == {w for w in want if w[2] >= 0.6 * best[w[0]]}


def test_records_of_common_words_meet_by_chains(spark):
    # two words of all records and one of six: by single terms all 14,400 pairs would meet
    rng = random.Random(8)
    words = {"a": 2.0, "b": 1.9} | {f"{k}{i}": w for k, w in (("c", 1.8), ("d", 1.7), ("e", 1.6)) for i in range(6)}
    side = lambda at: {at + i: ["a", "b"] + [f"{k}{rng.randrange(6)}" for k in "cde"] for i in range(120)}
    docs, asked = side(0), side(1000)
    frame = lambda x: spark.createDataFrame([(e, t, "n", 1, words[t]) for e, ts in x.items() for t in ts], "ent bigint, t string, kind string, df int, w double")
    want = {(q, c) for q, ts in asked.items() for c, us in docs.items() if sum(words[t] for t in set(ts) & set(us)) >= 0.7 * sum(words[t] for t in ts) - 1e-9}
    for per_row, longest in ((1, 1), (1, 2), (4, 3), (1, 9)):
        assert {(r.q, r.c) for r in retrieve(frame(docs), frame(asked), 0.7, per_row=per_row, longest=longest).collect()} == want
    q = _ordered(frame(asked), "q").withColumn("theta", F.aggregate("ts", F.lit(0.0), lambda a, x: a + x["w"]) * 0.7 - 1e-9)
    met = [_met(q, _ordered(frame(docs), "c"), 1, n).count() for n in (1, 9)]
    assert len(want) > 100 and met[0] == 120 * 120 and met[1] < 2 * len(want)


def test_links_found_by_common_words_alone(spark):
    # every place is misspelt beyond correction, so only words of a quarter of all records are shared
    rng, places = random.Random(3), []
    for _ in range(64):
        places.append("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)))
    words = [("Applied", "Formal", "Nautical", "Sacred"), ("Optics", "Geodesy", "Virology", "Phonetics"), ("Dynamics", "Ecology", "Tomography", "Rhetoric")]
    subjects = [" ".join(t) for t in product(*words)]
    right = [(100 + i, f"{p} Journal of {s}", None, None, None, "y") for i, (p, s) in enumerate(zip(places, subjects, strict=True))]
    left = [(i, f"{p[:2]}x{p[3]}x{p[5:]} Journal of {s}", None, None, None, "x") for i, (p, s) in enumerate(zip(places, subjects, strict=True))]
    want = {(i, 100 + i) for i in range(64)}
    assert set(pairs(spark, left, right)) == want


def test_copies_twins_sisters_and_nulls(spark):
    name = "Gidonheim Journal of Optics"
    left = [(1, name, issn(1), None, "P", ""), (2, name, issn(1), None, "P", ""), (3, f"{name} Letters", issn(2), None, "P", ""), (4, None, issn(1), None, None, ""), (5, None, None, None, None, ""), (6, "", "", "", "", "")]
    right = [(10, "gidonheim j. of optics", issn(1), None, None, ""), (11, "The Gidonheim Journal of Optics", None, issn(1), "P", ""), (12, None, None, None, None, ""), (13, "Zirbova Review of Geodesy", None, None, None, "")]
    got = set(pairs(spark, left, right))
    assert {(1, 10), (1, 11), (2, 10), (2, 11)} <= got
    assert not any(a in (3, 5, 6) or b in (12, 13) for a, b in got)
    assert not pairs(spark, left, []) and not pairs(spark, [], right)


def test_links_reach_the_whole_class(spark):
    left = [(1, "Gidonheim Journal of Optics", issn(1), None, "P", ""), (2, "Gidonheim…", None, None, None, ""), (3, "Zirbova Review of Geodesy", None, None, None, "")]
    classes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, class string")
    got = pairs(spark, left, [(10, "Gidonheim J. of Optics", issn(1), None, None, "")], left_classes=classes)
    assert set(got) == {(1, 10), (2, 10)}


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert np.allclose(fit_logistic(x, y), [0.5, 2], atol=0.25)


LISTINGS = "id bigint, display_name string, issn string, eissn string, publisher string, source_name string, updated_at timestamp, v string"


def listing(i, name, a=None, b=None, pub=None, src="s", day=1):
    return (i, name, a, b, pub, src, datetime(2024, 1, day), "x")


def truth(spark, data):
    d = spark.createDataFrame(data, LISTINGS)
    classes = venue_classes(d, "id", "display_name", ("issn", "eissn"))
    return {(r.group_id, r.field_name): r.record_id for r in survivors(field_truths(d, classes)).collect()}


def test_survivors(spark):
    name = "Gidonheim Journal of Optics"
    got = truth(
        spark,
        [
            listing(1, "Gidonheim J. Opt.", issn(5)[:6], issn(9), "Univ. Pr. Bo", "a", 1),
            listing(2, name, issn(5), issn(9), "University Press of Bo", "b", 5),
            listing(3, name.upper(), issn(5).replace("-", ""), "0000-0000", "unknown", "a", 3),
            listing(4, "Gidonheim Journal of Op…", "1234-5670", None, "University  press of Bo", "c", 9),
            listing(7, "Zirbova Review of Geodesy", None, None, None, "a", 1),
            listing(8, "Zirbova Review of Geodesy", None, "", "N.N.", "b", 1),
            listing(9, "Denifol Letters in Virology", issn(77), None, "P", "a", 1),
        ],
    )
    assert got == {(1, "display_name"): 2, (1, "issn"): 2, (1, "eissn"): 1, (1, "publisher"): 2, (7, "display_name"): 7}


def test_groups_by_number_and_repeats(spark):
    got = truth(spark, [listing(1, None, issn(5)), listing(2, "Gidonheim Journal of Optics", issn(5)), listing(2, "Gidonheim Journal of Optics", issn(5))])
    assert got[(1, "issn")] == 1 and got[(1, "display_name")] == 2


def test_no_groups(spark):
    assert truth(spark, []) == {}
    assert truth(spark, [listing(1, "Gidonheim Journal of Optics"), listing(2, None), listing(3, "y" * 20_000)]) == {}


def test_rates_are_inferred_and_decide(spark):
    # source "good" is right, "bad" mostly wrong; in a third of the groups only these two differ
    rng, data, i = random.Random(11), [], 0
    for g in range(120):
        right, wrong = issn(2000 + g), issn(7000 + g)
        for src in ("good", "bad", "x", "y")[: 2 if g % 3 == 0 else 4]:
            i += 1
            data.append(listing(i, f"{PLACES[g % 8]}{chr(97 + g // 8)} Journal of {SUBJECTS[g % 4]}", wrong if src == "bad" and rng.random() < 0.8 else right, None, None, src))
    d = spark.createDataFrame(data, LISTINGS)
    classes = d.selectExpr("id", "display_name as class")
    facts, sources, observers = claim_facts(d, classes, "id", "source_name", "updated_at")
    _, rates, rounds = latent_truth(facts, sources, observers)
    assert 1 < rounds < 100
    truths = field_truths(d, classes)
    got = {r.record_id for r in survivors(truths).where("field_name = 'issn'").collect()}
    good = {r[0] for r in data if int(r[2][:4] + r[2][5:8]) < 7000}
    assert len(got & good) >= 0.95 * 120
    once = survivors(field_truths(d, classes, rounds=1)).where("field_name = 'issn'").collect()
    assert {r.record_id for r in once} != got or len(once) == len(got)


def test_several_values_may_be_true(spark):
    data = [listing(1, "Gidonheim Journal of Optics", issn(1), issn(2), None, "a"), listing(2, "Gidonheim Journal of Optics", issn(1), issn(3), None, "b"), listing(3, "Gidonheim Journal of Optics", issn(1), issn(3), None, "c"), listing(4, "Gidonheim Journal of Optics", issn(1), issn(2), None, "d")]
    d = spark.createDataFrame(data, LISTINGS)
    got = judged_true(field_truths(d, d.selectExpr("id", "display_name as class")), -50.0)
    assert {(r.field_name, r.record_id) for r in got.collect()} == {("display_name", 1), ("issn", 1), ("eissn", 1), ("eissn", 2)}


def test_groups_answered_for_in_parts(spark):
    data = [listing(i, f"Gidonheim Journal of Optics{'' if i % 3 else ', Vol. ' + str(i)}", issn(i % 7 + 1), None, f"Press of {PLACES[i % 8]}", "ab"[i % 2]) for i in range(1, 60)]
    d = spark.createDataFrame(data, LISTINGS)
    classes = d.selectExpr("id", "'k' as class")
    rows_of = lambda n: sorted((r.field, r.v, r.support, tuple(r.observer), tuple(r.yes), tuple(r.no)) for r in claim_facts(d, classes, "id", "source_name", "updated_at", n)[0].collect())
    assert rows_of(3) == rows_of(1000)


def test_dominated_values_against_all_pairs(spark):
    rng = random.Random(2)
    values = {" ".join(sorted(rng.sample("abcdefgh", rng.randint(1, 5)))): rng.randint(1, 9) for _ in range(80)}
    df = {t: sum(n for v, n in values.items() if t in v.split()) for t in "abcdefgh"}
    words = spark.createDataFrame([(v, n, t, df[t]) for v, n in values.items() for t in v.split()], "v string, n int, token string, df int")
    want = {v for v, n in values.items() if any(m >= 2 * n and set(v.split()) < set(w.split()) for w, m in values.items())}
    assert {r.v for r in dominated_values(words).collect()} == want


def test_values_are_compared_once():
    _supports.cache_clear()
    assert all(_supports("publisher", "Gidon Pr.", "Gidon Press") and not _supports("publisher", "Pako Verlag", "Gidon Press") for _ in range(50))
    assert _supports.cache_info().misses == 2

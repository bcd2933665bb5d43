from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodiq.llm.mixing import mix_report, mix_sources, sainte_lague
from periodiq.llm.packing import Bins, container_assignments, pack_bins, packing_report
from periodiq.llm.tokens import encoder, token_sizes, VOCABULARY

SPECS = [("s", 10), ("m", 50), ("bad", 0), (None, 5), ("m", 50)]


def packed(spark, sizes, **how):
    d = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, fill string")
    return pack_bins(d, spark.createDataFrame(SPECS, "container_kind string, capacity_tokens bigint"), **how)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_plain_search(sizes):
    bins, plain = Bins(30), []
    for n in sizes:
        bins.put(n, [n])
        fit = min((r for r in plain if r >= n), default=None)
        if fit is None:
            plain.append(30 - n)
        else:
            plain.remove(fit)
            plain.append(fit - n)
    assert sorted(30 - f for f, _ in bins.take()) == sorted(plain)


def test_every_piece_once_and_none_split_needlessly(spark):
    sizes = [(i, (i * 7919) % 37, "x") for i in range(3000)] + [(9001, 120, "x"), (9002, None, "x"), (9003, 0, "x"), (5, 3, "again")]
    bins = packed(spark, sizes, per_task=100)
    a = container_assignments(bins).collect()
    for kind, cap in (("s", 10), ("m", 50)):
        mine = [r for r in a if r.container_kind == kind]
        want = Counter()
        for k, n, _ in sizes:
            for p in range(max(1, -(-max(n or 0, 1) // cap))):
                want[(k, p, min(cap, (n or 0) - p * cap) if n else 0)] += 1
        assert Counter((r.doc_id, r.piece_no, r.n_tokens) for r in mine) == want
        load = Counter()
        for r in mine:
            load[r.container_id] += max(r.n_tokens, 1)
        assert all(v <= cap for v in load.values())
        assert all(load[r.container_id] == r.fill for r in mine)
    report = {r.container_kind: r for r in packing_report(bins).collect()}
    assert set(report) == {"s", "m"} and report["m"].containers <= 1.03 * report["m"].least_containers + 1


def test_packing_of_nothing(spark):
    assert packed(spark, []).count() == 0
    d = spark.createDataFrame([(1, 3)], "doc_id bigint, n_tokens bigint")
    assert pack_bins(d, spark.createDataFrame([], "container_kind string, capacity_tokens bigint")).count() == 0


def test_large_items_stop_the_rounds(spark):
    assert packed(spark, [(i, 6, "x") for i in range(500)], per_task=50).where("container_kind = 's'").count() == 500


def quotients(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        out[max(open_, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 15)), min_size=1, max_size=6), st.integers(0, 40))
def test_sainte_lague_equals_highest_quotients(parties, seats):
    w, caps = [float(a) for a, _ in parties], [b for _, b in parties]
    assert sainte_lague(w, seats, caps) == quotients(w, seats, caps)


def test_mix_reaches_shares_and_respects_repeats(spark):
    sizes = [(i, "a", 20 + i % 5, 1) for i in range(2000)] + [(10_000 + i, "b", 20, 1) for i in range(300)] + [(20_000, "c", 30, 1), (30_000, None, 50, 1), (40_000, "z", 50, 1), (40_001, "a", 0, 1)]
    d = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint, times int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.05, 2), ("none", 0.05, 3), ("a", 0.1, 1), ("n", None, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(d, t, shard_tokens=5000)
    report = {r.source: r for r in mix_report(mix, t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))).collect()}
    assert report["c"].tokens == 60 and report["c"].most_times == 2
    assert abs(report["a"].actual_share / report["b"].actual_share - 0.5 / 0.4) < 0.06
    assert report["none"].texts == 0 and report["b"].most_times <= 4
    assert {r.source for r in mix.select("source").distinct().collect()} == {"a", "b", "c"}
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mix_sources(d, t, shard_tokens=5000).collect()))
    assert mix.groupBy("doc_id").count().where("count > 1").count() == 0


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mix_sources(d, t).count() == 0
    assert mix_sources(spark.createDataFrame([(1, "a", 3)], "doc_id bigint, source string, n_tokens bigint"), t.limit(0)).count() == 0


def test_token_sizes(spark):
    pytest.importorskip("tiktoken")
    texts = ["", None, "Ein Text über Zeitschriften.", "a " * 50_000, "x" * 20_000]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = dict(token_sizes(d).collect())
    assert got == {i: len(encoder(VOCABULARY).encode_ordinary(t or "")) for i, t in enumerate(texts)}

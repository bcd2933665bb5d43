from datetime import datetime, timezone

from conftest import rows

from periodiq.operators.snapshot_diff import url_snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, id bigint, normalized_name string, url string, last_seen_at timestamp, _s int, extra string"


def at(day, us=0):
    return datetime(2024, 1, day, 12, 0, 0, us, tzinfo=timezone.utc)


def frame(spark, data):
    return spark.createDataFrame([(*r, 9, "x") for r in data], SCHEMA)


def test_kinds_and_fields(spark):
    d = frame(
        spark,
        [
            (1, at(1), 1, "a", "http://x.test/", at(1)),
            (2, at(2), 1, "a", "HTTP://X.TEST", at(1, 5)),  # only writing differs
            (1, at(1), 2, "b", "http://y.test/A", None),
            (2, at(2), 2, "b", "http://y.test/a", None),  # the path's case counts
            (1, at(1), 3, "c", None, at(1)),
            (2, at(2), 4, None, None, None),
            (3, at(3), 4, None, None, None),
            (3, at(3), 3, "c", None, at(1)),
        ],
    )
    got = {(r.snapshot_no, r.id): (r.change_kind, r.changed_fields) for r in url_snapshot_changes(d).collect()}
    assert got == {
        (2, 2): ("changed", ["url"]),
        (2, 3): ("removed", None),
        (2, 4): ("added", None),
        (3, 1): ("removed", None),
        (3, 2): ("removed", None),
        (3, 3): ("added", None),
    }


def test_late_delivery_repeats_and_unicode(spark):
    d = frame(
        spark,
        [
            (1, at(9), 1, " café", "u", None),
            (1, at(1), 1, "old", "u", None),
            (2, at(2), 1, "café ", "u", None),
            (2, at(2), 1, "café ", "u", None),
            (2, None, None, "no identity", "u", None),
        ],
    )
    assert url_snapshot_changes(d).count() == 0


def test_missing_snapshot_is_empty(spark):
    d = frame(spark, [(1, at(1), 1, "a", "u", None), (3, at(3), 1, "a", "u", None)])
    assert rows(url_snapshot_changes(d).select("snapshot_no", "id", "change_kind")) == [(2, 1, "removed"), (3, 1, "added")]


def test_empty_and_hot_key(spark):
    assert url_snapshot_changes(frame(spark, [])).count() == 0
    d = frame(spark, [(1, at(1), 7, f"n{i}", "u", None) for i in range(500)] + [(2, at(2), 7, "z", "u" * 50_000, None)])
    assert rows(url_snapshot_changes(d).select("id", "change_kind")) == [(7, "changed")]

import csv
import io
import random

from conftest import rows

from periodiq.operators.strict_load import RETRACTION_FIELDS, rejected_records, strict_load

GOOD = ["1", "T", "Journal of X", "P", "A", "R", "1/2/2020 0:00", "d", "o", "Retraction", "r"]


def line(**change):
    f = dict(zip(RETRACTION_FIELDS, GOOD, strict=True)) | change
    return ",".join(f'"{v.replace(chr(34), chr(34) * 2)}"' if set(v) & set(',"\n') else v for v in f.values())


def run(spark, lines):
    d = spark.createDataFrame([(i, s, "k") for i, s in lines], "line_id bigint, raw_line string, _offset string")
    return {r[0]: r[1] for r in rejected_records(d).collect()}, strict_load(d)


def test_reasons_in_order(spark):
    lines = [
        (1, line()),
        (2, line() + "\r"),
        (3, line(title='say "x", y\nz')),
        (4, line().replace("Journal of X", 'Journal "of" X')),
        (5, line() + ",more"),
        (6, line(journal="---")),
        (7, line(retraction_date="02/30/2020 00:00")),
        (8, line(retraction_date="")),
        (9, line(retraction_date="0")),
        (10, line(retraction_date="01/02/2020 24:00")),
        (11, line(retraction_date="1/2/20 0:00")),
        (12, '"open,quote'),
        (13, ""),
        (14, None),
        (15, line(journal="Журнал")),
    ]
    bad, good = run(spark, lines)
    assert bad == {4: "quoting", 5: "column_count", 6: "bad_value", 7: "bad_value", 10: "bad_value", 11: "bad_value", 12: "quoting", 13: "column_count", 14: "column_count"}
    assert {r._offset for r in good.collect()} == {1, 2, 3, 8, 9, 15}
    assert [r.title for r in good.where("_offset = 3").collect()] == ['say "x", y\nz']


def test_same_offset_good_and_bad(spark):
    bad, good = run(spark, [(1, line()), (1, "x"), (None, "y"), (None, line())])
    assert bad == {1: "column_count", None: "column_count"}
    assert good.count() == 2


def test_empty_and_very_long(spark):
    assert run(spark, [])[0] == {}
    long = '"' + 'a""b,\n' * 60_000 + '"'
    bad, good = run(spark, [(1, line().replace("T", long, 1)), (2, '"' + "x" * 300_000), (3, "," * 100_000)])
    assert bad == {2: "quoting", 3: "column_count"}
    assert good.count() == 1


def test_round_trip_of_written_csv(spark):
    rng = random.Random(3)
    data = []
    for i in range(300):
        f = list(GOOD)
        f[1] = "".join(rng.choice('ab,"\n ') for _ in range(rng.randint(0, 12)))
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n").writerow(f)
        data.append((i, out.getvalue(), f[1]))
    bad, good = run(spark, [(i, s) for i, s, _ in data])
    assert not bad
    assert {r._offset: r.title for r in good.collect()} == {i: t for i, _, t in data}


def test_typed_rows(spark):
    _, good = run(spark, [(1, line(retraction_date="0"))])
    assert rows(good.select("retraction_date")) == [(None,)]
    assert dict(good.dtypes)["retraction_date"] == "timestamp"

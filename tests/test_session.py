import os

from periodiq.session import materialize, release, shared_dir


def test_tables_in_the_shared_folder(spark):
    d = materialize(spark.range(5))
    assert d.count() == 5
    own = os.path.join(shared_dir(spark).removeprefix("file://"), "periodiq", spark.sparkContext.applicationId)
    assert os.listdir(own)
    release(spark)
    assert not os.path.exists(own)


def test_empty_table(spark):
    assert materialize(spark.range(0)).count() == 0

"""Stored tables are read back, and are gone after clear()."""

import os

from pitchlake import storage


def test_stored_tables_are_cleared(spark):
    back = storage.stored(spark.range(10))
    assert back.count() == 10
    at = storage.folder(spark).removeprefix("file:")
    assert os.listdir(at)
    storage.clear(spark)
    assert not os.path.exists(at)
    assert storage.stored(spark.range(3)).count() == 3

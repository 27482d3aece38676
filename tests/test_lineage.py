import os

import pytest

from nightjar.operators.lineage import Tables


def test_an_owner_deletes_the_tables_it_wrote(spark):
    owner = Tables(spark)
    kept, gone = owner.write(spark.range(5).toDF("x"), "kept"), owner.write(spark.range(3).toDF("x"), "gone")
    places = {name: owner.paths[id(t)][0].removeprefix("file:") for name, t in (("kept", kept), ("gone", gone))}
    owner.drop(gone)
    assert os.path.exists(places["kept"]) and not os.path.exists(places["gone"])
    assert kept.count() == 5
    with pytest.raises(KeyError):
        owner.drop(gone)
    owner.drop_all()
    assert not os.path.exists(places["kept"])

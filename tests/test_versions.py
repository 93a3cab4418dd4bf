"""Versioned tables: commits show whole or not at all."""
import pytest

from lettergraph.shared import shared_path
from lettergraph.versions import Conflict, Versions


def test_commits_conflicts_and_expiry(spark):
    v = Versions(spark, shared_path(spark, "versions"))
    assert v.at().number == 0 and v.numbers() == []
    df = lambda *xs: spark.createDataFrame([(x, f"p{x % 2}") for x in xs], "x long, part string")
    first = v.commit(v.at(), {"a": v.put(df(1, 2), "a"), "b": v.put(df(), "b")}, {"mark": "1"})
    second = v.commit(first, {"a": v.put(df(3), "a")}, {"mark": "2", "more": "x"}, add=True)
    third = v.commit(second, {"b": v.put(df(9, 10), "b", ("part",))})
    assert [v.numbers(), third.facts] == [[1, 2, 3], {"mark": "2", "more": "x"}]
    xs = lambda table, at: sorted(r.x for r in v.read(table, v.at(at)).collect())
    assert xs("a", 1) == [1, 2] and xs("a", 2) == xs("a", None) == [1, 2, 3]
    assert xs("b", 2) == [] and xs("b", 3) == [9, 10] and v.read("b").columns == ["x", "part"]
    # Two writers from one base: the second is told.
    with pytest.raises(Conflict):
        v.commit(second, {"a": v.put(df(7), "a")})
    assert xs("a", None) == [1, 2, 3]
    v.put(df(8), "a")  # a writer that died before its commit
    gone = v.expire(keep=1)
    assert len(gone) == 3 and v.numbers() == [3] and xs("a", None) == [1, 2, 3] and xs("b", None) == [9, 10]
    with pytest.raises(Exception, match="0000000001"):
        v.at(1)

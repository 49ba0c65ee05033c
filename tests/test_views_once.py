"""What the drawing queries write: only the columns and rows that they ask for."""

from boxloom.plans import views as pv
from boxloom.plans.derive import Tables


def test_prepared_writes_what_is_asked(spark, folder):
    t = Tables(spark, folder)
    _, parts, draws = pv.prepared(t, ("reason", "cx"), "role = 'ignore'")
    assert parts.columns == ["view_id", "role", "class_id", "reason", "cx"]
    assert "lineitem" not in " ".join(parts.inputFiles())
    want = sorted(map(str, pv.routed(t).filter("role = 'ignore'").select(*parts.columns).collect()))
    assert want and sorted(map(str, parts.collect())) == want
    views, none, same = pv.prepared(t)
    assert none is None and sorted(map(tuple, same.collect())) == sorted(map(tuple, draws.collect()))

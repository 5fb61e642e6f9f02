"""Intakes are dealt over tasks by their number, and what takes long is worked out once per row."""

from docketlake.functions.core import dealt
from docketlake.plans import catalog


def test_dealt(spark):
    assert dealt(spark.range(25_000).coalesce(1)).rdd.getNumPartitions() == 3
    assert dealt(spark.range(0)).count() == 0 and dealt(spark.range(25_000).coalesce(1)).distinct().count() == 25_000


def test_matters_counted_once(spark):
    for name in ("int3_matter_type", "int7_checklist"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("replace(") == 1, name


def test_dates_found_once(spark):
    plan = catalog.queries()["int8_incident_date"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4

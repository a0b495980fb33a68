from pyspark.sql import functions as F

from stacklight.operators import marc, state
from stacklight.plans import QUERIES

SF = "/root/testdata/sf0.001"


def record(*tags):
    return "<record>" + "".join(f'<datafield tag="{t}" ind1=" " ind2=" "><subfield code="a">x</subfield></datafield>' for t in tags) + "</record>"


def test_records_are_dealt_to_all_tasks(spark):
    # part.parquet is one file with one row group
    for name in ("marc_works", "marc_details", "unimarc_works"):
        assert QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() >= 4, name


def test_counts_need_no_works(spark):
    rows = spark.createDataFrame([("1", False, record("245")), ("2", True, None), ("3", False, record("300")), ("4", False, record("200"))], "source_record_id string, deleted boolean, xml string")
    mapped = marc.map_records(rows.select("source_record_id", "deleted", marc.parse(F.col("xml")).alias("rec")), "marc21")
    before = len(state._written)
    counts = marc.counted(mapped)
    assert {r.status: r.n for r in counts.collect()} == {"mapped": 1, "deleted": 1, "unmappable": 1, "flavour_change": 1}
    assert len(state._written) == before
    assert marc.store_mapped(mapped)[1] == {"mapped": 1, "deleted": 1, "unmappable": 1, "flavour_change": 1}


def test_field_profile_counts_within_rows(spark):
    # one id twice, no id, no fields: a record is its row
    rows = spark.createDataFrame([("1", record("245", "650", "650")), ("1", record("245")), (None, record("245")), ("4", record())], "source_record_id string, xml string")
    got = marc.field_profile(rows.select("source_record_id", marc.parse(F.col("xml")).alias("rec")))
    assert {r.tag: (r.percent, r.percent_repeated) for r in got.collect()} == {"245": (75.0, 0.0), "650": (25.0, 25.0)}

"""Record ids with the signs that separate fields, and null digests and ids, are told apart."""

from mediaspan.llm import warc_audit


def test_fields_do_not_run_into_each_other(spark):
    schema = "file int, offset long, record_id string, digest string"
    one = spark.createDataFrame([(1, 0, "x", "aa"), (1, 5, "y", "bb")], schema)
    two = spark.createDataFrame([(1, 0, "x:aa|5:y", "bb")], schema)
    got = sorted((r.record_id, r.kind) for r in warc_audit.audit(one, two).collect())
    assert got == [("x", "missing"), ("x:aa|5:y", "extra"), ("y", "missing")]
    nulls = spark.createDataFrame([(1, 0, None, "aa"), (2, 0, "z", None)], schema)
    texts = spark.createDataFrame([(1, 0, "", "aa"), (2, 0, "z", "-")], schema)
    assert sorted((r.file, r.kind) for r in warc_audit.audit(nulls, texts).collect()) == [(1, "extra"), (1, "missing"), (2, "changed")]
    assert warc_audit.audit(nulls, nulls).count() == 0


def test_equal_roots_of_other_counts_differ(spark):
    schema = "file int, offset long, record_id string, digest string"
    one = spark.createDataFrame([(1, 0, "x", "aa")] * 2, schema)
    two = spark.createDataFrame([(1, 0, "x", "aa")], schema)
    assert [r.kind for r in warc_audit.audit(one, two).collect()] == ["missing"]

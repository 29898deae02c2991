from factloom.operators import validation

FACTS = "func long, param int, offset int, width int, is_load boolean, copied boolean"


def test_each_outcome_and_what_comes_first(spark):
    signatures = spark.createDataFrame([(1, 0, "s"), (1, 1, None), (1, 2, "gone")], "func long, param int, struct string")
    layouts = spark.createDataFrame([("s", 0, 4, False), ("s", 0, 2, None), ("s", 4, 1, True), ("s", 8, 4, False), ("s", 8, 1, True)], "struct string, offset int, width int, padding boolean")
    rows = [
        ((2, 0, 0, 4, True, True), "no_signature"),
        ((None, 0, 0, 4, True, False), "no_signature"),
        ((1, 1, -4, 4, True, False), "param_not_struct"),
        ((1, 2, -4, 4, True, False), "struct_unknown"),
        ((1, 0, -4, 4, True, True), "negative_offset"),
        ((1, 0, 6, 4, True, True), "offset_uncovered"),
        ((1, 0, None, 4, True, True), "offset_uncovered"),
        ((1, 0, 4, 1, True, True), "offset_in_padding"),
        ((1, 0, 0, 4, True, True), "bulk_copy_excluded"),
        ((1, 0, 0, 2, None, None), "agree"),
        ((1, 0, 0, 1, True, None), "subfield_read"),
        ((1, 0, 8, 1, True, None), "subfield_read"),
        ((1, 0, 0, 1, False, False), "disagree"),
        ((1, 0, 0, 8, True, False), "disagree"),
        ((1, 0, 0, None, True, False), None),
    ]
    held = validation.held_against_layouts(spark.createDataFrame([f for f, _ in rows], FACTS), signatures, layouts)
    got = sorted(((r.func, r.param, r.offset, r.width, r.is_load, r.copied), r.outcome) for r in held.filter("func is not null and offset is not null and copied is not null").collect())
    want = sorted((f, o) for f, o in rows if o and f[0] is not None and f[2] is not None and f[5] is not None)
    assert got == want and held.count() == len(rows) - 1
    found = {r.outcome: (r.n, r.accuracy_milli) for r in validation.census(held).collect()}
    assert set(found) == set(validation.OUTCOMES)
    assert found["no_signature"] == (2, 200) and found["offset_uncovered"][0] == 2 and found["subfield_read"][0] == 2 and found["disagree"][0] == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], FACTS)
    held = validation.held_against_layouts(none, spark.createDataFrame([], "func long, param int, struct string"), spark.createDataFrame([], "struct string, offset int, width int, padding boolean"))
    assert held.count() == 0 and validation.census(held).count() == 0

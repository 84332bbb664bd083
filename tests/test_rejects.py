from pyspark.sql import types as T

from bandloom.operators.rejects import parse_records, split_rejects

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))])
CASES = [
    ('1,plain,2,1.5 -2e3', None),
    ('x,unjudged id,1,.5', None),
    ('2,"a, ""b""\nc",1,\t+7. ', None),
    ("3,line\nbreak,1,4", None),
    ('4,"open,1,4', "quoting"),
    ('5,in"side,1,4', "quoting"),
    ('6, "late",1,4', "quoting"),
    ('7,"shut"x,1,4', "quoting"),
    ("8,few,1", "column_count"),
    ("9,many,1,4,5", "column_count"),
    ("", "column_count"),
    (None, "missing"),
    ("10,zero,0,", "not_a_count: n"),
    ("11,words,1e1,4", "not_a_count: n"),
    ("12,arabic,٣,1 2 3", "not_a_count: n"),
    ("13,none,1,", "not_numbers: v"),
    ("14,nan,1,NaN", "not_numbers: v"),
    ("15,dots,1,1.2.3", "not_numbers: v"),
    ("16,short,3,1 2", "length_mismatch: v"),
    ("17,huge,99999999999999999999,1", "length_mismatch: v"),
    ("18," + "," * 6000, "column_count"),
    ("19,long,20000," + "1 " * 20000, None),
]


def parse(spark, rows, columns="key long, line string, note string"):
    df = spark.createDataFrame(rows, columns)
    return parse_records(df, "line", SCHEMA, counts=["n"], lists={"v": "n"})


def test_reasons(spark):
    got = parse(spark, [(i, c[0], "clash") for i, c in enumerate(CASES)]).select("key", "reject_reason").collect()
    assert {r[0]: r[1] for r in got} == {i: c[1] for i, c in enumerate(CASES)}


def test_typed_cells(spark):
    rows = {r["key"]: r for r in parse(spark, [(i, c[0], "clash") for i, c in enumerate(CASES)]).collect()}
    assert rows[0]["v"] == [1.5, -2000.0] and rows[0]["id"] == 1 and rows[0]["note"] == "plain"
    assert rows[1]["id"] is None and rows[2]["note"] == 'a, "b"\nc' and rows[2]["v"] == [7.0]
    assert rows[4]["v"] is None and rows[4]["line"].startswith("4,")


def test_split_empty_and_repeats(spark):
    good, bad = split_rejects(parse(spark, []), "line", SCHEMA)
    assert good.count() == bad.count() == 0
    good, bad = split_rejects(parse(spark, [(1, "1,a,1,2", "n")] * 2 + [(2, "x", "n")] * 3), "line", SCHEMA)
    assert good.count() == 2 and bad.count() == 3 and "line" in bad.columns and "v" not in bad.columns

"""Vector records, their storage form, and checks of texts and vectors."""

from pyspark.sql import functions as F

from forgeline.operators import records

SCHEMA = "chunk_id string, repository_id long, file_path string, language string, symbol_type string, symbol_name string, start_line int, end_line int, code string, metadata map<string,string>"


def test_round_trip_and_broken_metadata(spark):
    rows = [("c1", 1, "a.py", "python", None, None, None, 3, "x", {"team": "core", "code": "y"}), ("c2", 1, "b.py", "python", "class", "A", 1, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    stored = records.to_storage(df)
    assert stored.filter("start_line = -1 or end_line = -1").count() == 2
    back = {r.chunk_id: r for r in records.from_storage(stored).collect()}
    assert back["c1"].metadata == {"team": "core"} and back["c1"].symbol_name is None and back["c1"].start_line is None and back["c1"].end_line == 3
    assert back["c2"].metadata == {} and back["c2"].symbol_name == "A"
    broken = stored.withColumn("metadata_json", F.when(F.col("chunk_id") == "c1", "{nope").otherwise('{"code": "inside"}'))
    again = {r.chunk_id: r for r in records.from_storage(broken).collect()}
    assert again["c1"].metadata == {} and again["c2"].code == "inside"
    assert records.from_storage(stored.limit(0)).count() == 0


def test_metadata_keeps_its_own_keys(spark):
    df = spark.createDataFrame([("c", 1, "a", "p", None, None, 1, None, "x", {"code": "own"})], SCHEMA)
    assert records.with_code(df).first().metadata == {"code": "own", "start_line": "1"}


def test_blank_texts_and_faulty_vectors(spark):
    df = spark.createDataFrame([(1, "a"), (2, " \n\t"), (3, None), (4, "")], "id long, text string")
    good, skipped = records.blank_texts(df, "id", "text")
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in skipped.collect()) == [2, 3, 4]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None), (4, [1.0]), (5, [float("nan"), 1.0])], "id long, embedding array<float>")
    assert sorted(r.id for r in records.vector_faults(v, dimension=2).collect()) == [2, 3, 4, 5]
    e = [r.e for r in df.select("id", records.hashed_embedding(8)(F.col("text")).alias("e")).orderBy("id").collect()]
    assert len(e[0]) == 8 and abs(sum(x * x for x in e[0]) - 1) < 1e-6 and e[1:] == [None, None, None]

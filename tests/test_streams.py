"""Streams: replayed batches, readers during a write, late and repeated rows; files with malformed rows and their order."""

from pyspark.sql import functions as F

from rollscope.sources import rolls, schemas
from rollscope.sources.shared import clear_shared, new_folder, stored
from rollscope.streaming import rolls as streams
from rollscope.streaming.rolls import VersionedTable


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert table.read() is None
    assert table.write_batch(batch(("a", 1), ("b", 1)), 0)
    assert table.write_batch(batch(("a", 2)), 1)
    assert not table.write_batch(batch(("a", 99)), 1)
    assert rows_of(table.read()) == [("a", 2), ("b", 1)]
    table.compact()
    assert [name for _, name in table.versions()] == ["all-1"]
    assert not table.write_batch(batch(("a", 99)), 0) and rows_of(table.read()) == [("a", 2), ("b", 1)]
    table.write_batch(batch(("c", 5)), 2)
    assert rows_of(table.read()) == [("a", 2), ("b", 1), ("c", 5)]


def test_readers_see_whole_batches_only(spark, tmp_path):
    """A batch that is being written, or died half-way, is not part of the table; written again it is."""
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    table.write_batch(spark.createDataFrame([("a", 1)], "k string, n long"), 0)
    before = table.read()
    half = spark.createDataFrame([("a", 7)], "k string, n long")
    half.write.parquet(str(tmp_path / "t/batch-1"))  # files, but no marker
    assert rows_of(table.read()) == rows_of(before) == [("a", 1)]
    assert table.write_batch(spark.createDataFrame([("a", 2), ("b", 3)], "k string, n long"), 1)
    assert rows_of(before) == [("a", 1)]  # a reader from before still reads what it began with
    assert rows_of(table.read()) == [("a", 2), ("b", 3)]


def test_batches_hold_changed_keys_only(spark, tmp_path):
    schema = schemas.strings("last_name", "state")
    (tmp_path / "in").mkdir()
    for i, body in enumerate(["sood,delhi\ngowda,kar\n", "sood,delhi\n", "rao,tel\n"]):
        (tmp_path / f"in/{i}.csv").write_text("last_name,state\n" + body)
        source = streams.stream_rolls(spark, str(tmp_path / "in"), schema)
        streams.incremental_counts(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    table = streams.counts_table(spark, str(tmp_path / "out"))
    assert rows_of(table.read()) == [("gowda", "kar", 1), ("rao", "tel", 1), ("sood", "delhi", 2)]
    sizes = [spark.read.parquet(f"{table.path}/{name}").count() for _, name in table.versions()]
    assert sizes == [2, 1, 1]


def test_late_and_repeated_rows(spark, tmp_path):
    """A name is written once within the delay, again after it; late rows drop out; the state does not grow with the stream."""
    (tmp_path / "in").mkdir()
    known = spark.createDataFrame([("a", 0.5)], "last_name string, delhi double")
    batches = [
        "a,2024-01-01 00:00:00\na,2024-01-01 00:10:00\nb,2024-01-01 00:20:00\n",
        "a,2024-01-01 00:50:00\nc,2024-01-01 05:00:00\n",
        "a,2024-01-01 05:10:00\nlate,2024-01-01 01:00:00\n",
        *(f"n{i},2024-01-0{2 + i // 10} {i % 10 + 10}:00:00\n" for i in range(30)),
    ]
    last = None
    for i, body in enumerate(batches):
        (tmp_path / f"in/{i:02}.csv").write_text("name,ts\n" + body)
        source = streams.stream_rolls(spark, str(tmp_path / "in"), schemas.strings("name", "ts")).withColumn("ts", F.to_timestamp("ts"))
        query = streams.stream_last_state(source, "name", known, str(tmp_path / "out"), str(tmp_path / "log"), "ts", "1 hour")
        query.awaitTermination()
        last = query.lastProgress or last
    found = [(r.name, r.delhi) for r in spark.read.parquet(str(tmp_path / "out")).select("name", "delhi").collect()]
    assert found.count(("a", 0.5)) == 2 and ("late", None) not in found
    assert len(found) == 2 + 2 + 30
    assert last.stateOperators[0].numRowsTotal <= 3


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    head = "elector_name,father_or_husband_name,sex,state\n"
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.csv").write_text(head + 'A B,C D,Male,x\nbad\n"Q, R",S,Male,y\none,two,three,four,five\n')
    (tmp_path / "x/b.csv").write_text(head + ",,,\nA,B,Male,z\n")
    (tmp_path / "x/none.csv").write_text(head)
    rows = rolls.read_with_malformed(spark, str(tmp_path / "x"))
    found = {r.file.rsplit("/", 1)[1]: (r.n_good, r.n_malformed) for r in rolls.malformed_counts(rows).collect()}
    assert found == {"a.csv": (2, 2), "b.csv": (2, 0)}
    assert sorted(r.malformed for r in rows.filter("malformed is not null").collect()) == ["bad", "one,two,three,four,five"]
    assert rows.filter("malformed is null").count() == 4


def test_row_order_over_files(spark, tmp_path):
    for name, states in {"b.csv": ["C", "D"], "a.csv": ["A", "B"], "c.csv": []}.items():
        (tmp_path / name).write_text(",".join(schemas.STATE_LANGUAGES.names) + "\n" + "".join(f"{s},,,,,,,\n" for s in states))
    found = {r.state: r.seq for r in rolls.state_languages(spark, str(tmp_path)).collect()}
    assert found == {"A": 0, "B": 1, "C": 2, "D": 3}


def test_shared_folders_are_cleared(spark):
    df = spark.range(5)
    path = new_folder(spark, "some")
    df.write.parquet(path)
    assert stored(df, "other").count() == 5
    clear_shared(spark)
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)

"""Files in and out, and streams against batches."""

import gzip

from pyspark.sql import functions as F

from rollscope.functions.sql import register
from rollscope.operators import counts
from rollscope.sources import rolls, schemas
from rollscope.streaming import rolls as streams


def write(path, text, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if packed else open(path, "w") as f:
        f.write(text)


def test_state_from_path_and_variants(spark, tmp_path):
    head = "elector_name,father_or_husband_name,sex,state\n"
    write(tmp_path / "delhi_2021-eng.csv", head + "Asha Sood,Ram Sood,Female,x\n")
    write(tmp_path / "dadra_guj_2017.csv", head + "A B,C D,Male,x\n")
    write(tmp_path / "goa_1.csv", head + "A B,C D,Male,x\n")
    df = rolls.with_state_from_path(rolls.read_rolls(spark, str(tmp_path)), unsupported=["goa"])
    assert [tuple(r) for r in df.select("elector_name", "state").collect()] == [("Asha Sood", "delhi")]
    write(tmp_path / "t/assam_all_clean+t13n.csv.gz", "elector_name_t13n,father_or_husband_name_t13n,state,sex\nAsha,Ram,as,Male\n", True)
    t13n = rolls.reconcile_roll(rolls.read_rolls(spark, str(tmp_path / "t"), schemas.ROLL_T13N), "t13n")
    write(tmp_path / "d/delhi.csv", "name,father's name,husband's name\nAsha,,Ram\n")
    delhi = rolls.reconcile_roll(rolls.read_rolls(spark, str(tmp_path / "d"), schemas.ROLL_DELHI), "delhi")
    both = rolls.union_rolls(t13n, delhi)
    assert sorted(r.father_or_husband_name for r in both.collect()) == ["Ram", "Ram"]
    assert rolls.path_tokens(F.lit("/a/up_x-1.csv")) is not None


def test_other_reads(spark, tmp_path):
    head = "elector_name,father_or_husband_name,sex,state\n"
    write(tmp_path / "a/x/one.tab", head + "A B,C D,Male,x\n")
    write(tmp_path / "a/y/two.tab", head + "bad\nA B,C D,Male,x\n")
    df = rolls.read_rolls(spark, str(tmp_path / "a"), glob="*.tab", recursive=True, columns=["elector_name"])
    assert df.columns == ["elector_name"] and df.count() >= 2
    write(tmp_path / "dim.csv", 'state,official_languages,addl_official_languages,most_spoken_lang,second_most_spoken_lang,third_most_spoken_lang,fourth_most_spoken_lang,fifth_most_spoken_lang\nDelhi,"Hindi, English",,Hindi,Punjabi,Urdu,Bengali,Maithili\n')
    assert rolls.state_languages(spark, str(tmp_path / "dim.csv")).first()["official_languages"] == "Hindi, English"
    write(tmp_path / "langs.txt", "hindi\nurdu\n")
    assert rolls.read_vocabulary(spark, str(tmp_path / "langs.txt")) == ["hindi", "urdu"]
    write(tmp_path / "c.json", '{"a": 1, "b": 2}')
    assert rolls.read_character_map(spark, str(tmp_path / "c.json")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "last_name string, state string")
    rolls.write_csv(df, str(tmp_path / "csv"), by="state")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    rolls.write_corpus(df, str(tmp_path / "pq"))
    assert rolls.peek(rolls.read_corpus(spark, str(tmp_path / "pq")), 1).count() == 1
    write(tmp_path / "f1.csv", "last_name,state\na,x\n")
    write(tmp_path / "f2.csv", "last_name,state\nb,y\n")
    rolls.append_files(spark, [str(tmp_path / "f1.csv"), str(tmp_path / "f2.csv")], df.schema, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    schema = schemas.strings("last_name", "state")
    for i in range(3):
        write(tmp_path / f"in/{i}.csv", "last_name,state\n" + "sood,delhi\ngowda,kar\n" * (i + 1))
    rows = streams.stream_rolls(spark, str(tmp_path / "in"), schema)
    streams.incremental_counts(rows, str(tmp_path / "running"), str(tmp_path / "ck")).awaitTermination()
    batch = counts.name_state_counts(spark.read.schema(schema).option("header", True).csv(str(tmp_path / "in")))
    assert sorted(map(tuple, streams.counts_table(spark, str(tmp_path / "running")).read().collect())) == sorted(map(tuple, batch.collect()))
    known = spark.createDataFrame([("sood", 0.5)], "last_name string, delhi double")
    streams.stream_last_state(rows, "last_name", known, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.last_name, r.delhi) for r in found.collect()) == [("gowda", None), ("sood", 0.5)]
    dim = spark.createDataFrame([("delhi", "hindi")], "state string, l string")
    streams.stream_state_to_lang(rows.withColumnRenamed("state", "st"), "st", dim, str(tmp_path / "o2"), str(tmp_path / "ck3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2")).filter("l = 'hindi'").count() == 6


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select normalize_name('  Sood ') as n, is_predictable('x1y') as p, char_bigrams('ab') as g").first() == ("sood", False, ["ab"])

"""The given tables as names and rolls, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollscope.operators.ranking import hash32 as hash32_column
from rollscope.sources.shared import kept

SOURCES = [f"src{i}" for i in range(20)]
LANGS = ["de", "en", "es", "fr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, state, lang, last_name): words of three letters or more of every document."""
    return tokens_of(table(spark, sf_dir, "documents"))


def tokens_of(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("source").alias("state"), "lang", F.lower("text").alias("low"))
    rows = docs.select("doc_id", "state", "lang", F.explode(F.split("low", r"[^\p{L}]+")).alias("last_name"))
    return rows.filter(F.length("last_name") > 2)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ASCII ones."""
    return tokens(spark, sf_dir).filter(F.col("last_name").rlike("^[a-z]+$"))


def roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, elector_name, father_or_husband_name, state, sex): one elector a line item."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sex = F.when(F.col("l_returnflag") == "A", "Male").when(F.col("l_returnflag") == "N", "UNREADABLE").otherwise("Female")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sex.alias("sex"))
        .join(part.withColumnsRenamed({"p_partkey": "l_partkey", "p_name": "elector_name"}), "l_partkey")
        .join(part.withColumnsRenamed({"p_partkey": "l_suppkey", "p_name": "father_or_husband_name"}), "l_suppkey")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("l_orderkey", "l_linenumber", "elector_name", "father_or_husband_name", "state", "sex")
    )


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(last_name): every word of every part name."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("last_name"))


#: Searches ask for the names whose hash is divisible by this.
ASKED_EACH = 50


def counted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(last_name, lang, count), kept, since searches take both their names and their corpora from it."""
    return kept(names(spark, sf_dir).groupBy("last_name", "lang").agg(F.count("*").alias("count")))


def asked_names(counted: DataFrame, each: int = ASKED_EACH) -> DataFrame:
    """(last_name, n): the names that the searches ask for, a stated set that grows with the documents, and how often they came."""
    asked = counted.filter(hash32_column("last_name") % each == 0)
    return asked.groupBy("last_name").agg(F.sum("count").alias("n"))


def known_names(counted: DataFrame, least: int = 3) -> DataFrame:
    """(last_name): the names that came `least` times or more."""
    return counted.groupBy("last_name").agg(F.sum("count").alias("n")).filter(F.col("n") >= least).select("last_name")


TOKENS = r"""
tokens0 as (
  select doc_id, source as state, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as last_name from documents
), tokens as (select * from tokens0 where length(last_name) > 2),
names as (select * from tokens where regexp_matches(last_name, '^[a-z]+$'))"""

ROLL = """
roll as (
  select l_orderkey, l_linenumber, e.p_name as elector_name, f.p_name as father_or_husband_name, n_name as state,
    case l_returnflag when 'A' then 'Male' when 'N' then 'UNREADABLE' else 'Female' end as sex
  from lineitem join part e on l_partkey = e.p_partkey join part f on l_suppkey = f.p_partkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
)"""

CORPUS = "corpus as (select last_name from names group by 1 having count(*) >= 3)"


def hash32(key: str, seed: str = "0") -> str:
    return f"('0x' || substr(md5('{seed}:' || ({key})::varchar), 1, 8))::bigint"


ASKED_WORDS = f"words as (select last_name from names where {hash32('last_name')} % {ASKED_EACH} = 0)"

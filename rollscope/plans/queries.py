"""Registered queries over the given tables, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollscope.constants import ALPHABET
from rollscope.functions import names as fn
from rollscope.functions.sql import register
from rollscope.operators import classify, corpus, counts, enrich, evaluate, labels, ranking, sampling, similarity
from rollscope.plans import tables as t
from rollscope.sources import rolls, schemas
from rollscope.sources.shared import kept, new_folder
from rollscope.streaming.rolls import counts_table, incremental_counts, stream_last_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- counts


@query(f"with {t.TOKENS} select last_name, count(*) as count from tokens group by 1")
def name_counts(spark, sf):
    return counts.name_counts(t.tokens(spark, sf))


@query(f"with {t.TOKENS} select last_name, state, count(*) as count from tokens group by 1, 2")
def name_source_counts(spark, sf):
    return counts.name_state_counts(t.tokens(spark, sf))


@query(f"with {t.TOKENS} select last_name, state, count(*)::bigint as count from tokens group by 1, 2")
def merge_counts(spark, sf):
    """Counts of each language's documents, merged."""
    rows = t.tokens(spark, sf)
    parts = [counts.name_state_counts(rows.filter(F.col("lang") == c)) for c in t.LANGS]
    rest = counts.name_state_counts(rows.filter(~F.coalesce(F.col("lang"), F.lit("")).isin(t.LANGS)))
    return counts.merge_counts(*parts, rest)


@query(
    f"""with {t.TOKENS}, c as (select distinct * from (select last_name, state, count(*) as count from tokens group by lang, 1, 2))
    select last_name, state, sum(count)::bigint as count from c where last_name is not null group by 1, 2"""
)
def cleanup_counts(spark, sf):
    rows = t.tokens(spark, sf).groupBy("lang", "last_name", "state").agg(F.count("*").alias("count")).drop("lang")
    return counts.cleanup_counts(rows)


@query(
    f"""with {t.TOKENS}, c as (select last_name from names group by 1 having count(*) >= 3)
    select last_name, state, count(*) as n from names where last_name in (select last_name from c) group by 1, 2"""
)
def min_occurrence(spark, sf):
    kept = counts.min_occurrence(t.names(spark, sf), 3)
    return kept.groupBy("last_name", "state").agg(F.count("*").alias("n"))


@query(
    f"""with {t.TOKENS}, c as (select last_name, count(*) as count from names group by 1)
    select last_name, count from c where count > 10"""
)
def min_count(spark, sf):
    return counts.min_count(counts.name_counts(t.names(spark, sf)))


@query(
    f"""with {t.TOKENS}, c as (select last_name, count(*) as count from names group by 1)
    select last_name, count, count / (select sum(count) from c) as share from c"""
)
def name_share(spark, sf):
    return counts.name_share(t.names(spark, sf))


@query(
    f"""with {t.TOKENS}, c as (select last_name, state, count(*) as count from names group by 1, 2)
    select *, count / sum(count) over (partition by last_name) * 100 as percent from c"""
)
def state_percent(spark, sf):
    return counts.state_percent(counts.name_state_counts(t.names(spark, sf)))


@query(
    f"""with {t.TOKENS}, c as (select state, last_name, count(*) as n from names group by 1, 2)
    select last_name, string_agg(state, ',' order by n desc, state) as labels from c group by 1"""
)
def ordered_labels(spark, sf):
    found = counts.ordered_labels(t.names(spark, sf), "last_name", "state")
    return found.withColumn("labels", F.concat_ws(",", "labels"))


@query(f"with {t.TOKENS} select distinct last_name, state from names")
def unique_pairs(spark, sf):
    return counts.unique_pairs(t.names(spark, sf))


@query(
    f"""with {t.TOKENS} select last_name, count(*) as count from names group by 1 order by 2 desc, 1 limit 3000"""
)
def popularity_slice(spark, sf):
    return counts.popularity_slice(t.names(spark, sf), 3000)


@query(
    f"""with {t.TOKENS}, c as (select count(*) as n from names group by last_name)
    select min(n) as min, avg(n) as mean, max(n) as max, {", ".join(f"quantile_cont(n, {q}) as q{str(q)[2:]}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.997))} from c"""
)
def freq_quantiles(spark, sf):
    return counts.frequency_summary(counts.name_counts(t.names(spark, sf)))


@query(
    f"""with {t.TOKENS}, c as (select last_name, count(*) as n from names group by 1)
    select min(n)::double as least, avg(n) as mean, max(n)::double as most, true as near from c"""
)
def sketched_quantiles(spark, sf):
    """Counts by sketches of each first letter's names, merged; `near` says that median and number of names are within their bounds."""
    counted = counts.name_counts(t.names(spark, sf)).withColumn("letter", F.substring("last_name", 1, 1))
    parts = counts.summary_sketches(counted, "count", "last_name", "letter")
    found = counts.read_sketches(counts.merge_sketches(parts))
    rank = F.avg((F.col("count") < F.col("q5")).cast("int"))
    upto = F.avg((F.col("count") <= F.col("q5")).cast("int"))
    checked = counted.crossJoin(F.broadcast(found)).groupBy("min", "mean", "max").agg(  # one row
        (rank - 0.03 <= 0.5) & (upto + 0.03 >= 0.5) & (F.abs(F.first("distinct") / F.count("*") - 1) < 0.05)
    ).toDF("least", "mean", "most", "near")
    return checked


@query(
    """select source as value, row_number() over (order by min(doc_id), source) - 1 as code from documents
    where source is not null group by 1"""
)
def first_appearance_codes(spark, sf):
    return counts.first_appearance_codes(t.table(spark, sf, "documents"), "source", "doc_id").withColumnRenamed("source", "value")


@query(
    f"""with {t.TOKENS}, c as (select distinct unnest(string_split(last_name, '')) as "char" from tokens)
    select "char", row_number() over (order by "char") as code from c where "char" <> ''"""
)
def char_vocab(spark, sf):
    return counts.char_vocab(t.tokens(spark, sf))


# --- rolls


@query(f"with {t.ROLL} select string_split(elector_name, ' ')[-1] as last_name, avg(case sex when 'Male' then 0 when 'UNREADABLE' then null else 1 end) as female_prop from roll group by 1")
def female_share(spark, sf):
    rows = t.roll(spark, sf).withColumn("last_name", fn.last_name_fallback("elector_name", "father_or_husband_name"))
    return counts.female_share(rows)


@query(
    f"""with {t.ROLL}, s as (select *, string_split(elector_name, ' ') as a, string_split(father_or_husband_name, ' ') as b from roll),
    r as (select state, case when len(a) > 1 then a[-1] when len(b) > 1 then b[-1] else 'LNU' end as last_name from s)
    select last_name, state, count(*) as n from r group by 1, 2"""
)
def last_name_fallback(spark, sf):
    name = fn.last_name_fallback("elector_name", "father_or_husband_name")
    return t.roll(spark, sf).select(name.alias("last_name"), "state").groupBy("last_name", "state").agg(F.count("*").alias("n"))


@query(
    f"""with {t.ROLL}, s as (select *, string_split(elector_name, ' ') as a, string_split(father_or_husband_name, ' ') as b from roll)
    select a[1] || ' ' || case when len(a) > 1 then a[-1] when len(b) > 1 then b[-1] else 'LNU' end as full_name, count(*) as n
    from s group by 1"""
)
def full_name(spark, sf):
    name = fn.full_name("elector_name", "father_or_husband_name")
    return t.roll(spark, sf).groupBy(name.alias("full_name")).agg(F.count("*").alias("n"))


@query(
    f"""with {t.ROLL}, s as (select state, string_split(elector_name, ' ') as a, string_split(father_or_husband_name, ' ') as b from roll)
    select a[-1] as last_name, state, count(*) as n from s
    where len(a) > 1 and len(b) > 1 and a[-1] = b[-1] and length(a[-1]) > 2 group by 1, 2"""
)
def last_name_household(spark, sf):
    rows = t.roll(spark, sf).filter(fn.is_full_name("elector_name") & fn.is_full_name("father_or_husband_name"))
    rows = rows.select(fn.last_name_household("elector_name", "father_or_husband_name").alias("last_name"), "state")
    return rows.na.drop(subset=["last_name"]).groupBy("last_name", "state").agg(F.count("*").alias("n"))


@query(
    f"""with {t.ROLL}, s as (select state, string_split(elector_name, ' ') as a, string_split(father_or_husband_name, ' ') as b from roll),
    r as (select state, lower(list_filter(a, lambda x: list_contains(b, x))[1]) as last_name from s)
    select last_name, state, count(*) as n from r where length(last_name) >= 3 group by 1, 2"""
)
def last_name_shared(spark, sf):
    rows = t.roll(spark, sf).select(fn.last_name_shared("elector_name", "father_or_husband_name").alias("last_name"), "state")
    return rows.na.drop(subset=["last_name"]).groupBy("last_name", "state").agg(F.count("*").alias("n"))


@query(
    f"""with {t.ROLL} select string_split(elector_name, ' ')[-1] as last_name, state, sex, count(*) as n from roll
    where length(string_split(elector_name, ' ')[-1]) >= 3 group by 1, 2, 3"""
)
def clean_names(spark, sf):
    rows = t.roll(spark, sf).withColumn("last_name", fn.last_name_fallback("elector_name", "father_or_husband_name"))
    return counts.clean_names(rows).groupBy("last_name", "state", "sex").agg(F.count("*").alias("n"))


# --- corpora and enrichment

_SRC_WIDE = ", ".join(f"count(*) filter (state = '{c}') / count(*) as {c}" for c in t.SOURCES)
_STATE_CORPUS = f"corpus as (select last_name, {_SRC_WIDE}, count(*) as total_n from names where state in ({', '.join(repr(c) for c in t.SOURCES)}) group by 1)"


@query(f"with {t.TOKENS}, {_STATE_CORPUS} select * from corpus")
def source_distribution_wide(spark, sf):
    return corpus.build_state_corpus(t.names(spark, sf), t.SOURCES)


@query(
    f"""with {t.TOKENS}, p as (select last_name, state, count(*) as n from names group by 1, 2)
    select *, (sum(n) over (partition by last_name))::bigint as total_n, n / sum(n) over (partition by last_name) as proportion from p"""
)
def source_proportions(spark, sf):
    return corpus.state_proportions(t.names(spark, sf))


_USERS = r"users as (select doc_id, unnest(regexp_split_to_array(text, '\s+')) as name from documents)"


def _users(spark, sf):
    """A user's table: every word of every document as it is written."""
    return t.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("name"))


@query(
    f"""with {t.TOKENS}, {_STATE_CORPUS}, {_USERS},
    u as (select * from users qualify row_number() over (partition by name order by doc_id) = 1),
    k as (select *, lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) as __last_name from u)
    select doc_id, name, __last_name, corpus.* exclude (last_name, total_n) from k left join corpus on __last_name = last_name"""
)
def last_state_enrich(spark, sf):
    found = corpus.build_state_corpus(t.names(spark, sf), t.SOURCES).drop("total_n")
    return enrich.last_state(_users(spark, sf), "name", found, order_by="doc_id")


@query(
    f"""with {_USERS}, f as (
      select doc_id, name, lower(name) as low from users
      where regexp_matches(name, '^\\p{{L}}+$') and regexp_matches(name, '(?i)[a-z]') and length(name) > 2)
    select low as name, min(doc_id) as doc_id from f group by 1"""
)
def predictable_names(spark, sf):
    rows = _users(spark, sf).filter(fn.is_predictable("name")).withColumn("name", fn.normalize_name("name"))
    return ranking.keep_first(rows, ["name"], ["doc_id"])


_CASE = lambda v, n: " ".join(f"when {v} = {c} then '{c}'" for c in n)


@query(
    f"""with {t.TOKENS}, {_STATE_CORPUS}
    select last_name, case {_CASE(f"greatest({', '.join(t.SOURCES)})", t.SOURCES)} end as modal from corpus"""
)
def modal_source(spark, sf):
    found = corpus.build_state_corpus(t.names(spark, sf), t.SOURCES)
    return labels.modal_label(found, t.SOURCES).select("last_name", "modal")


_LANG_WIDE = ", ".join(f"count(*) filter (lang = '{c}') as {c}" for c in t.LANGS)


@query(
    f"""with {t.TOKENS}, w as (select last_name, {_LANG_WIDE} from names group by 1),
    s as (select *, list_reverse_sort([de, en, es, fr]) as v from w)
    select last_name, case {_CASE("v[1]", t.LANGS)} end as first_lang,
      case when v[2] = v[1] then case {_CASE("v[1]", t.LANGS)} end else case {_CASE("v[2]", t.LANGS)} end end as second_lang,
      case {_CASE("v[3]", t.LANGS)} end as third_lang from s"""
)
def top3_labels(spark, sf):
    wide = corpus.pivot_states(counts.name_state_counts(t.names(spark, sf), state="lang"), t.LANGS, state="lang")
    return labels.top3_labels(wide, t.LANGS).select("last_name", "first_lang", "second_lang", "third_lang")


#: A dimension of states and languages made of the nations, whose regions choose the languages.
_DIM = """dim as (
  select 'Land of ' || replace(n_name, '_', ' ') as state, n_nationkey as seq,
    ['hindi (including x)', 'urdu', 'hindi', 'odia', 'tamil'][n_regionkey + 1] as first,
    ['urdu', 'odia', 'tamil', 'telugu', 'odia'][n_regionkey + 1] as second,
    ['bengali', 'hindi', 'nepali', 'odia', 'tamil'][n_regionkey + 1] as third,
    ['odia', 'odia', 'hindi', 'mizo', 'odia'][n_regionkey + 1] as fourth from nation where n_nationkey <> 7)"""


def _dimension(spark, sf):
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), F.col("n_regionkey"))
    return t.table(spark, sf, "nation").filter("n_nationkey <> 7").select(  # one state has no row
        F.concat(F.lit("Land of "), F.replace("n_name", F.lit("_"), F.lit(" "))).alias("state"),
        F.col("n_nationkey").alias("seq"),
        pick("Hindi (including x)", "Urdu", "Hindi", "Odia", "Tamil").alias("most_spoken_lang"),
        pick("Urdu", "Odia", "Tamil", "Telugu", "Odia").alias("second_most_spoken_lang"),
        pick("Bengali", "Hindi", "Nepali", "Odia", "Tamil").alias("third_most_spoken_lang"),
        pick("Odia", "Odia", "Hindi", "Mizo", "Odia").alias("fourth_most_spoken_lang"),
    )


@query(
    f"""with {_DIM}, m as (
      select n_name as state, arg_max(dim.state, dim.seq) as matched from nation
      left join dim on contains(lower(dim.state), lower(replace(n_name, '_', ' '))) group by 1)
    select * from m"""
)
def state_match_containment(spark, sf):
    states = t.table(spark, sf, "nation").select(F.col("n_name").alias("state"))
    return corpus.match_states(states, _dimension(spark, sf))


_ALLOC = f"""{t.ROLL}, {_DIM}, m as (
  select n_name as state, arg_max(dim.state, dim.seq) as matched from nation
    left join dim on contains(lower(dim.state), lower(replace(n_name, '_', ' '))) group by 1),
l as (select m.state, regexp_replace(first, 'hindi .including.*', 'hindi') as first, second, third, fourth from m left join dim on matched = dim.state),
c as (select string_split(elector_name, ' ')[-1] as last_name, state, count(*) as count from roll group by 1, 2),
a as (
  select last_name, unnest([first, second, third, fourth]) as lang, unnest([0.5, 0.25, 0.125, 0.125]::double[]) as w,
    unnest([1, 2, 3, 4]) as r, count, state from c left join l using (state)),
alloc as (select last_name, lang, count * w as weight from a where lang is not null qualify row_number() over (partition by last_name, state, lang order by r desc) = 1
  union all select last_name, null as lang, 0.0::double as weight from c left join l using (state) where first is null)"""


def _allocated(spark, sf):
    states = t.table(spark, sf, "nation").select(F.col("n_name").alias("state"))
    langs = corpus.state_langs(states, _dimension(spark, sf))
    rows = t.roll(spark, sf).withColumn("last_name", fn.last_name_fallback("elector_name", "father_or_husband_name"))
    return corpus.allocate_languages(counts.name_state_counts(rows), langs)


@query(f"with {_ALLOC} select last_name, lang, sum(weight) as weight from alloc group by 1, 2")
def language_allocation(spark, sf):
    return _allocated(spark, sf).groupBy("last_name", "lang").agg(F.sum("weight").alias("weight"))


_SPOKEN = ["hindi", "urdu", "odia", "tamil", "telugu", "bengali", "nepali", "mizo"]


@query(
    f"with {_ALLOC} select last_name, {', '.join(f'coalesce(sum(weight) filter (lang = {c!r}), 0) as {c}' for c in _SPOKEN)} from alloc group by 1"
)
def language_corpus(spark, sf):
    return corpus.build_language_corpus(_allocated(spark, sf), _SPOKEN)


@query(
    """select n_name, n_regionkey, d.state as s from nation n left join (
      select r_regionkey, r_name as state from region) d on n.n_regionkey = d.r_regionkey"""
)
def state_to_lang(spark, sf):
    """The dimension join of `state_to_lang`, with regions as its states."""
    dim = t.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("state"), F.col("r_name").alias("s"))
    rows = t.table(spark, sf, "nation").select("n_name", "n_regionkey", F.col("n_regionkey").cast("string").alias("k"))
    return enrich.state_to_lang(rows, "k", dim).drop("k")


@query("select distinct source as state from documents where source is not null")
def list_states(spark, sf):
    return enrich.list_states(t.table(spark, sf, "documents").select(F.col("source").alias("state")).na.drop())


_DICT = """dictionary as (
  select distinct last_name as "Name", upper(last_name) as "Translated" from (select unnest(string_split(p_name, ' ')) as last_name from part))"""


def _dictionary(spark, sf):
    words = t.part_words(spark, sf).distinct()
    return words.select(F.col("last_name").alias("Name"), F.upper("last_name").alias("Translated"))


@query(f"with {t.TOKENS}, {_DICT} select distinct last_name from names where last_name not in (select \"Name\" from dictionary)")
def pending_names(spark, sf):
    return corpus.pending_names(t.names(spark, sf), _dictionary(spark, sf))


@query(
    f"""with {t.TOKENS}, {_DICT}, c as (select last_name, state, count(*) as count from names group by 1, 2)
    select "Translated" as last_name, coalesce(count, 0) as count, state from c full outer join dictionary on last_name = "Name" """
)
def translation_outer(spark, sf):
    merged = corpus.apply_transliteration(counts.name_state_counts(t.names(spark, sf)), _dictionary(spark, sf))
    return merged.na.fill(0, ["count"])


@query("select event_id, unnest(json_keys(props)) as source, json_extract_string(props, '$.k') as target from events")
def json_map_explode(spark, sf):
    return t.table(spark, sf, "events").select("event_id", F.explode(fn.parse_transliteration("props")).alias("source", "target"))


@query(f"with {t.TOKENS} select last_name, state, count(*) as count from tokens group by 1, 2")
def streaming_counts(spark, sf):
    """Running counts over the documents' files as they arrive, after the last of them."""
    folder = new_folder(spark, "stream")
    schema = t.table(spark, sf, "documents").schema
    # A pattern, since the table may be one file or a folder.
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/documents.parque[t]")
    incremental_counts(t.tokens_of(arriving), f"{folder}/counts", f"{folder}/log").awaitTermination()
    return counts_table(spark, f"{folder}/counts").read()


@query(
    """with c as (select user_id::varchar as last_name, count(*) as total_n, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view
      from events where event_type in ('click', 'view') group by 1),
    u as (select distinct user_id::varchar as name from events)
    select name, lower(name) as __last_name, click / total_n as click, view / total_n as view from u left join c on lower(name) = last_name"""
)
def streaming_last_state(spark, sf):
    """Arriving users with the distribution of their events, each once within a day of event time."""
    folder = new_folder(spark, "stream")
    events = t.table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    known = corpus.build_state_corpus(events.select(user.alias("last_name"), F.col("event_type").alias("state")), ["click", "view"]).drop("total_n")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parque[t]")
    arriving = arriving.select(user.alias("name"), F.col("ts").cast("timestamp").alias("ts"))
    stream_last_state(arriving, "name", known, f"{folder}/rows", f"{folder}/log", "ts", "36500 days").awaitTermination()
    return spark.read.schema("name string, ts timestamp, __last_name string, click double, view double").parquet(f"{folder}/rows").drop("ts")


# --- sources and sinks


def _written(spark, sf, layout, name, by=None):
    """The roll as gzipped CSV files in the shared folder."""
    path = f"{new_folder(spark, 'rolls')}/{name}"
    rolls.write_csv(t.roll(spark, sf).select(*layout), path, by)
    return path


@query(f"with {t.ROLL}, twice as (select * from roll union all select * from roll) select elector_name, father_or_husband_name, state, sex, count(*) as n from twice group by all")
def roll_layouts(spark, sf):
    """The roll through files of two layouts, a renamed and a transliterated one, read back as one table."""
    other = [F.col(c).alias(f"{c}_t13n") for c in ("elector_name", "father_or_husband_name")]
    named = _written(spark, sf, [F.col("elector_name").alias("name"), "father_or_husband_name", "sex", "state"], "named")
    t13n = _written(spark, sf, [*other, "state", "sex"], "t13n")
    rows = rolls.union_rolls(
        rolls.reconcile_roll(rolls.read_rolls(spark, named, schemas.ROLL_NAMED), "named"),
        rolls.reconcile_roll(rolls.read_rolls(spark, t13n, schemas.ROLL_T13N), "t13n"),
    )
    return rows.groupBy("elector_name", "father_or_husband_name", "state", "sex").agg(F.count("*").alias("n"))


def _state_files(spark, sf, name, compress=True):
    """The roll as files of one state each, in a tree; `name` gives a file's name by its state, with `~` for `_`, and number."""
    columns = ["elector_name", "father_or_husband_name", "sex"]
    path = f"{new_folder(spark, 'rolls')}/tree"
    rolls.write_csv(t.roll(spark, sf).select(*columns, F.replace("state", F.lit("_"), F.lit(" ")).alias("file")), path, "file", compress)
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(root):  # one a state
        if folder.isDirectory():
            state = folder.getPath().getName().split("=")[1].replace("%20", " ").replace(" ", "~")
            for k, file in enumerate(store.listStatus(folder.getPath())):
                store.rename(file.getPath(), fs.Path(folder.getPath(), name(state, k)))
    return path


def _of_files(rows, unsupported=()):
    rows = rolls.with_state_from_path(rows, unsupported).withColumn("state", F.replace("state", F.lit("~"), F.lit("_")))
    return rows.groupBy("state", "elector_name").agg(F.count("*").alias("n"))


_FILE_COLUMNS = schemas.strings("elector_name", "father_or_husband_name", "sex")


@query(f"with {t.ROLL} select state, elector_name, count(*) as n from roll group by all")
def roll_file_names(spark, sf):
    """Files of one state each, in a tree, with the states read from their names."""
    path = _state_files(spark, sf, lambda state, k: f"{state}_2021-{k}.csv.gz")
    return _of_files(rolls.read_rolls(spark, path, _FILE_COLUMNS, recursive=True))


@query(f"with {t.ROLL} select state, elector_name, count(*) as n from roll where state not like 'I%' and state <> 'FRANCE' group by all")
def roll_file_set(spark, sf):
    """The same without the files of copies in another script and of an unsupported state."""
    path = _state_files(spark, sf, lambda state, k: f"{state}_{'guj' if state.startswith('I') else 'eng'}_2021-{k}.csv.gz")
    return _of_files(rolls.read_rolls(spark, path, _FILE_COLUMNS, recursive=True), ["FRANCE"])


@query(f"with {t.ROLL} select state, elector_name, count(*) as n from roll group by all")
def tab_files(spark, sf):
    """Files called `.tab` that hold CSV, one column of them read."""
    path = _state_files(spark, sf, lambda state, k: f"{state}-{k}.tab", compress=False)
    return _of_files(rolls.read_rolls(spark, path, _FILE_COLUMNS, ["elector_name", "_metadata"], "*.tab", recursive=True))


@query(
    f"""with {t.ROLL} select state, count(*) filter (l_orderkey % 7 <> 0 and l_orderkey % 11 <> 0) as n_good,
    count(*) filter (l_orderkey % 7 = 0 or l_orderkey % 11 = 0) as n_malformed from roll group by 1"""
)
def malformed_rolls(spark, sf):
    """Rows with a column too few or too many, counted apart from the others by file."""
    path = f"{new_folder(spark, 'rolls')}/broken"
    whole = F.concat_ws(",", "elector_name", "father_or_husband_name", "sex")
    line = F.when(F.col("l_orderkey") % 7 == 0, F.col("elector_name")).when(F.col("l_orderkey") % 11 == 0, F.concat(whole, F.lit(",x,y"))).otherwise(whole)
    t.roll(spark, sf).select(line.alias("value"), "state").write.partitionBy("state").text(path)
    rows = rolls.read_with_malformed(spark, path, _FILE_COLUMNS, "*.txt", header=False)
    state = F.regexp_extract("file", "/state=([^/]*)/", 1)
    return rolls.malformed_counts(rows.withColumn("state", F.replace(state, F.lit("%20"), F.lit(" "))), "state")


@query(f"with {t.ROLL} select elector_name, count(*)::bigint as n from (select * from roll union all select * from roll where sex = 'Male') group by 1")
def appended_rolls(spark, sf):
    """Files of one layout appended to one table, some of them again."""
    out = f"{new_folder(spark, 'rolls')}/all"
    columns = schemas.ROLL.names
    path = _written(spark, sf, columns, "by-sex", "sex")
    schema = schemas.strings(*(c for c in columns if c != "sex"))
    for files in ([path], [f"{path}/sex=Male"]):
        rolls.append_files(spark, files, schema, out)
    return spark.read.parquet(out).groupBy("elector_name").agg(F.count("*").alias("n"))


@query("select n_name as state, row_number() over (order by n_regionkey, n_nationkey) - 1 as seq from nation")
def dimension_order(spark, sf):
    """The order of a dimension's rows over several files."""
    path = f"{new_folder(spark, 'dimension')}/states"
    rows = t.table(spark, sf, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    empty = [F.lit("x").alias(c) for c in schemas.STATE_LANGUAGES.names[1:]]
    rolls.write_csv(rows.select(F.col("n_name").alias("state"), *empty, "n_regionkey"), path, "n_regionkey", compress=False)
    return rolls.state_languages(spark, path, recursive=True).select("state", "seq")


@query(
    f"""with {t.TOKENS}, c as (select distinct unnest(string_split(last_name, '')) as "char" from names)
    select "char", row_number() over (order by "char") as code, row_number() over (order by "char") as line from c where "char" <> ''"""
)
def vocabulary_files(spark, sf):
    """The letters in use as a JSON object of their numbers and as lines of a text, read back."""
    folder = new_folder(spark, "vocabulary")
    known = counts.char_vocab(t.names(spark, sf)).select("char", "code")  # an alphabet
    entries = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("char", "code"))))).alias("value")
    known.agg(entries).coalesce(1).write.text(f"{folder}/map")
    known.orderBy("code").select(F.col("char").alias("value")).coalesce(1).write.text(f"{folder}/lines")
    lines = [(c, i) for i, c in enumerate(rolls.read_vocabulary(spark, f"{folder}/lines"), 1)]
    return rolls.read_character_map(spark, f"{folder}/map").join(spark.createDataFrame(lines, "char string, line int"), "char")


@query(
    f"""with {t.ROLL} select elector_name, case when sex = 'Male' and l_orderkey % 3 > 0 then father_or_husband_name when l_orderkey % 5 > 0 then elector_name end as father_or_husband_name,
    count(*) as n from roll group by all"""
)
def delhi_rolls(spark, sf):
    """The layout with a father's and a husband's name, of which the first that is there counts."""
    father = F.when((F.col("sex") == "Male") & (F.col("l_orderkey") % 3 > 0), F.col("father_or_husband_name")).alias("father's name")
    husband = F.when(F.col("l_orderkey") % 5 > 0, F.col("elector_name")).alias("husband's name")
    path = _written(spark, sf, [F.col("elector_name").alias("name"), father, husband], "delhi")
    rows = rolls.reconcile_roll(rolls.read_rolls(spark, path, schemas.ROLL_DELHI), "delhi")
    return rows.groupBy("elector_name", "father_or_husband_name").agg(F.count("*").alias("n"))


@query(f"with {t.ROLL}, c as (select elector_name as last_name, state, count(*) as n from roll group by all) select last_name, state, n from c")
def corpus_round_trip(spark, sf):
    """A corpus written by state, read back."""
    path = new_folder(spark, "corpus")
    found = t.roll(spark, sf).groupBy(F.col("elector_name").alias("last_name"), "state").agg(F.count("*").alias("n"))
    rolls.write_corpus(found, path, "state")
    return rolls.read_corpus(spark, path).select("last_name", "state", "n")


# --- nearest names


@query(
    f"""with {t.TOKENS}, {t.CORPUS}, {t.ASKED_WORDS}, q as (select distinct last_name as query from words),
    p as (select query, last_name as neighbour, levenshtein(query, last_name) as distance from q, corpus)
    select *, row_number() over (partition by query order by distance, neighbour)::int as rank from p qualify rank <= 3"""
)
def edit_knn_top3(spark, sf):
    counted = t.counted_names(spark, sf)
    return similarity.edit_knn(t.asked_names(counted), t.known_names(counted)).select("query", "neighbour", "distance", "rank")


_LOOKUP = f"""w as (select last_name, {_LANG_WIDE} from names group by 1 having count(*) >= 3),
    p as (select query, w.*, levenshtein(query, last_name) as distance from q, w),
    n as (select * from p qualify row_number() over (partition by query order by distance, last_name) <= 3),
    s as (select query, sum(de) as de, sum(en) as en, sum(es) as es, sum(fr) as fr from n group by 1),
    best as (select query, case {_CASE("greatest(de, en, es, fr)", t.LANGS)} end as predicted_lang from s)"""


@query(
    f"""with {t.TOKENS}, {t.ASKED_WORDS}, q as (select distinct last_name as query from words), {_LOOKUP}
    select last_name, predicted_lang, count(*) as n from words left join best on last_name = query group by 1, 2"""
)
def lookup_lang(spark, sf):
    counted = t.counted_names(spark, sf)
    wide = corpus.pivot_states(counted.join(t.known_names(counted), "last_name"), t.LANGS, state="lang")
    return similarity.lookup_lang(t.asked_names(counted), "last_name", wide, t.LANGS).select("last_name", "predicted_lang", "n")


_GRAMS = """d as (select distinct last_name as name from names),
g0 as (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from d),
tf as (select name, gram, count(*) as tf from g0 group by 1, 2),
df0 as (select gram, count(*) as df, (select count(*) from d) as n_names from tf group by 1)"""


@query(f"with {t.TOKENS}, {_GRAMS} select gram, count(*) as df, sum(tf)::bigint as total from tf group by 1")
def gram_totals(spark, sf):
    return similarity.gram_totals(t.names(spark, sf))


@query(f"with {t.TOKENS}, {_GRAMS} select gram, df from df0")
def bigram_df(spark, sf):
    return similarity.ngram_features(t.names(spark, sf)).select("gram", "df").distinct()


@query(
    f"""with {t.TOKENS}, {_GRAMS}, r as (select name, gram, tf * (ln((1 + n_names) / (1 + df)) + 1) as w from tf join df0 using (gram))
    select name, gram, round(w / sqrt(sum(w * w) over (partition by name)), 6) as w from r"""
)
def tfidf_terms(spark, sf):
    found = similarity.tfidf(similarity.ngram_features(t.names(spark, sf)))
    return found.select("name", "gram", F.round("w", 6).alias("w"))


_COSINE = f"""d as (select last_name as name from names group by 1 having count(*) >= 3),
g0 as (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from d),
tf as (select name, gram, count(*) as tf from g0 group by 1, 2),
df0 as (select gram, count(*) as df, (select count(*) from d) as n_names from tf group by 1),
kept as (select * from df0 where df <= n_names * 0.5 and df >= 1),
r as (select name, gram, tf * (ln((1 + n_names) / (1 + df)) + 1) as w from tf join kept using (gram)),
c as (select name, gram, w / sqrt(sum(w * w) over (partition by name)) as w from r),
q0 as (select distinct last_name as name from words),
q1 as (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from q0),
q2 as (select name, gram, count(*) as tf from q1 group by 1, 2),
q3 as (select name, gram, tf * (ln((1 + n_names) / (1 + df)) + 1) as w from q2 join kept using (gram)),
q as (select name, gram, w / sqrt(sum(w * w) over (partition by name)) as w from q3),
p as (select q.name as query, c.name as neighbour, round(sum(q.w * c.w), 9) as similarity from q join c using (gram) group by 1, 2),
nn as (select *, row_number() over (partition by query order by similarity desc, neighbour)::int as rank from p qualify rank <= 10)"""


@query(f"with {t.TOKENS}, {t.ASKED_WORDS}, {_COSINE} select query, neighbour, round(similarity, 6) as similarity, rank from nn where rank <= 5")
def cosine_knn(spark, sf):
    counted = t.counted_names(spark, sf)
    pairs = similarity.cosine_knn(t.asked_names(counted), t.known_names(counted), 5)
    return pairs.select("query", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def _lang_corpus(counted):
    """(last_name, a proportion a language) of the known names."""
    wide = corpus.pivot_states(counted.join(t.known_names(counted), "last_name"), t.LANGS, state="lang")
    total = sum((F.col(c) for c in t.LANGS), F.lit(0))
    return wide.select("last_name", *((F.col(c) / total).alias(c) for c in t.LANGS))


_KNN = f"""{_COSINE}, lc as (select last_name, {", ".join(f"count(*) filter (lang = '{c}') / count(*) as {c}" for c in t.LANGS)} from names
  where lang in ('de', 'en', 'es', 'fr') group by 1)"""


@query(
    f"""with {t.TOKENS}, {t.ASKED_WORDS}, {_KNN},
    k as (select query, rank, lc.* from nn join lc on neighbour = last_name),
    e as (select unnest([3, 5, 10]) as k),
    m as (select query, e.k, {", ".join(f"round(avg({c}), 9) as {c}" for c in t.LANGS)} from k, e where rank <= e.k group by 1, 2)
    select query, k, case {_CASE("greatest(de, en, es, fr)", t.LANGS)} end as pred from m"""
)
def knn_sweep(spark, sf):
    counted = t.counted_names(spark, sf)
    return similarity.knn_sweep(t.asked_names(counted), _lang_corpus(counted), t.LANGS, (3, 5, 10))


@query(
    f"""with {t.TOKENS}, {t.ASKED_WORDS}, {_KNN},
    m as (select query, {", ".join(f"round(avg({c}), 9) as {c}" for c in t.LANGS)} from nn join lc on neighbour = last_name where rank <= 5 group by 1),
    u as (select query, unnest(['de', 'en', 'es', 'fr']) as label, unnest([de, en, es, fr]) as v from m),
    best as (select *, row_number() over (partition by query order by v desc, label) as place from u qualify place <= 3)
    select query, string_agg(label, ',' order by place) as pred_state from best group by 1"""
)
def knn_state(spark, sf):
    counted = t.counted_names(spark, sf)
    found = similarity.knn_state(t.asked_names(counted), _lang_corpus(counted), t.LANGS, k=5)
    return found.withColumn("pred_state", F.concat_ws(",", "pred_state"))


@query()
def closest_match(spark, sf):
    """For the names whose hash is divisible by 200, as each is compared letter by letter with many."""
    counted = t.counted_names(spark, sf)
    return similarity.closest_match(t.asked_names(counted, 200), t.known_names(counted))


# --- splits and samples

_H = t.hash32("last_name")


@query(f"with {t.TOKENS} select last_name, case when {_H} % 10000 < 8000 then 0 else 1 end as part, count(*) as n from names group by 1, 2")
def split_80_20(spark, sf):
    rows = sampling.split_by_key(t.names(spark, sf), "last_name")
    return rows.groupBy("last_name", "part").agg(F.count("*").alias("n"))


@query(f"with {t.TOKENS} select last_name, case when {_H} % 10000 < 8000 then 0 when {_H} % 10000 < 9000 then 1 else 2 end as part, count(*) as n from names group by 1, 2")
def split_80_10_10(spark, sf):
    return sampling.split_by_key(t.names(spark, sf), "last_name", (0.8, 0.1, 0.1)).groupBy("last_name", "part").agg(F.count("*").alias("n"))


@query(f"with {t.TOKENS} select last_name, case when {_H} % 10000 < 9025 then 0 when {_H} % 10000 < 9500 then 1 else 2 end as part, count(*) as n from names group by 1, 2")
def split_nested_95_5(spark, sf):
    return sampling.split_by_key(t.names(spark, sf), "last_name", (0.9025, 0.0475, 0.05)).groupBy("last_name", "part").agg(F.count("*").alias("n"))


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name, state from names)
    select last_name, state, (row_number() over (partition by state order by {_H}, last_name)
      <= round(0.2 * count(*) over (partition by state)))::int as part from p"""
)
def stratified_quota(spark, sf):
    return sampling.stratified_split(counts.unique_pairs(t.names(spark, sf)), "last_name", "state", 0.2)


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name, state from names)
    select last_name, state from p qualify row_number() over (partition by state order by {_H}, last_name) <= round(0.1 * count(*) over (partition by state))"""
)
def sample_per_group(spark, sf):
    return sampling.sample_per_group(counts.unique_pairs(t.names(spark, sf)), "last_name", "state", 0.1)


@query(f"with {t.TOKENS} select last_name from (select distinct last_name from names) order by {_H}, last_name limit 1000")
def sample_n(spark, sf):
    return sampling.sample_n(kept(t.names(spark, sf).select("last_name").distinct()), 1000, "last_name")


@query(
    f"""with {t.TOKENS}, c as (select last_name, count(*) as count from names group by 1)
    select last_name, count from c order by -ln(({_H} + 1) / 4294967297.0::double) / count, last_name limit 3000"""
)
def weighted_sample(spark, sf):
    return sampling.weighted_sample(kept(counts.name_counts(t.names(spark, sf))), 3000, "last_name", "count")


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name, state from names),
    r as (select *, row_number() over (partition by state order by {_H}, last_name) as r from p),
    s as (select state, count(*) as n from p group by 1),
    d as (select state, i as draw, {t.hash32("state || ':' || i", "0-draw")} % n + 1 as r from s, range(1000) x(i))
    select state, draw::int as draw, last_name from d join r using (state, r)"""
)
def bootstrap_per_group(spark, sf):
    pairs = counts.unique_pairs(t.names(spark, sf))
    return sampling.bootstrap_per_group(pairs, "last_name", "state", 1000).select("state", "draw", "last_name")


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name, lang from names),
    r as (select *, row_number() over (partition by lang order by {_H}, last_name) as r from p),
    s as (select lang, count(*) as n, row_number() over (order by lang) - 1 as c from p group by 1),
    d as (select i as draw, {t.hash32("i", "0-class")} % (select count(*) from s) as c, {t.hash32("i", "0-row")} as h from range(2000) x(i))
    select draw, lang, last_name from d join s using (c) join r using (lang) where r.r = h % n + 1"""
)
def balanced_draws(spark, sf):
    pairs = t.names(spark, sf).select("last_name", "lang").distinct()
    return sampling.balanced_draws(pairs, "last_name", "lang", 2000).select("draw", "lang", "last_name")


# --- classifiers and evaluation

_NB = f"""pairs as (select distinct last_name as name, lang as label from names),
part as (select *, case when {t.hash32("name")} % 10000 < 8000 then 0 else 1 end as part from pairs),
tr as (select name, label from part where part = 0),
tg as (select label, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from tr),
cn as (select gram, label, count(*) as n from tg group by 1, 2),
lb as (select label, ln(seen / (select count(*) from tr)) as prior, ln(total + (select count(distinct gram) from cn)) as base
  from (select label, count(*) as seen from tr group by 1) join (select label, sum(n) as total from cn group by 1) using (label)),
te as (select distinct name from part where part = 1),
qg as (select name, gram, count(*) as tf from (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from te) group by 1, 2),
gain as (select name, label, sum(tf * ln(n + 1)) as gain from qg join cn using (gram) group by 1, 2),
sc as (select te.name, lb.label, round(prior + coalesce(gain, 0) - (length(te.name) - 1) * base, 6) as score
  from te cross join lb left join gain on gain.name = te.name and gain.label = lb.label),
top as (select name, label, row_number() over (partition by name order by score desc, label) as r from sc qualify r <= 3),
pred as (select name, list(label order by r) as pred from top group by 1)"""


def _split_pairs(spark, sf):
    pairs = kept(t.names(spark, sf).select("last_name", F.col("lang").alias("label")).distinct())  # both parts are read several times
    rows = sampling.split_by_key(pairs, "last_name")
    return rows.filter("part = 0"), rows.filter("part = 1")


@query(f"with {t.TOKENS}, {_NB} select name, array_to_string(pred, ',') as pred from pred")
def nb_topk_lang(spark, sf):
    train, test = _split_pairs(spark, sf)
    found = classify.NaiveBayes(train).top_k(test, 3)
    return found.withColumn("pred", F.concat_ws(",", "pred"))


def _judged(spark, sf):
    """(name, truth list, label, pred list, best) of the test names."""
    train, test = _split_pairs(spark, sf)
    pred = classify.NaiveBayes(train).top_k(test, 3)
    truth = test.groupBy("last_name").agg(F.sort_array(F.collect_set("label")).alias("truth"))
    return truth.join(pred, F.col("last_name") == F.col("name")).select(
        "name", "truth", F.col("truth")[0].alias("label"), "pred", F.col("pred")[0].alias("best")
    )


_JUDGED = f"""{_NB}, judged as (select name, truth, truth[1] as label, pred, pred[1] as best from pred
  join (select name, list_sort(list(distinct label)) as truth from part where part = 1 group by 1) using (name))"""


@query(f"with {t.TOKENS}, {_JUDGED} select label as truth, {', '.join(f'count(*) filter (best = {c!r}) as {c}' for c in t.LANGS)} from judged group by 1")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_judged(spark, sf), "label", "best", t.LANGS)


@query(
    f"""with {t.TOKENS}, {_JUDGED},
    l as (select label from judged union select best from judged),
    c as (select l.label, count(*) filter (j.label = l.label) as support, count(*) filter (best = l.label) as said,
      count(*) filter (j.label = l.label and best = l.label) as hit from l, judged j group by 1),
    e as (select label, coalesce(hit / nullif(said, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, support from c),
    f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from e),
    a as (select * from f union all by name select 'macro avg' as label, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1, sum(support)::bigint as support from f
      union all by name select 'weighted avg', sum(precision * support) / sum(support) as precision, sum(recall * support) / sum(support) as recall, sum(f1 * support) / sum(support) as f1, sum(support)::bigint as support from f)
    select coalesce(label, 'weighted avg') as label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from a"""
)
def classification_report(spark, sf):
    found = evaluate.classification_report(_judged(spark, sf), "label", "best")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""with {t.TOKENS}, {_JUDGED} select avg((label = best)::int) as accuracy, avg(list_has_any(truth[1:3], pred)::int) as topk,
    avg(list_contains(pred, label)::int) as in_topk from judged"""
)
def topk_accuracy(spark, sf):
    rows = _judged(spark, sf)
    folder = new_folder(spark, "judged")
    rows.write.parquet(folder)  # a row a test name, read three times
    rows = spark.read.parquet(folder)
    parts = [
        evaluate.accuracy(rows, "label", "best"),
        evaluate.topk_accuracy(rows, "truth", "pred").withColumnRenamed("accuracy", "topk"),
        evaluate.truth_in_topk(rows, "label", "pred").withColumnRenamed("accuracy", "in_topk"),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query(
    f"""with {t.TOKENS}, {_JUDGED}, c as (select unnest(truth[1:3]) as one, pred from judged)
    select avg(list_contains(pred, one)::int) as accuracy from c"""
)
def pair_accuracy(spark, sf):
    return evaluate.pair_accuracy(_judged(spark, sf), "truth", "pred")


@query(
    f"""with {t.TOKENS}, {_JUDGED}, f as (select last_name, count(*) as total_freq, count(*) / (select count(*) from names) as total_freq_n from names group by 1)
    select name as last_name, array_to_string(pred, ',') as pred, total_freq, total_freq_n, label from judged join f on name = last_name"""
)
def evaluation_table(spark, sf):
    """Predictions of the test names with their counts and true labels."""
    rows = _judged(spark, sf)
    predictions = rows.select(F.col("name").alias("last_name"), F.concat_ws(",", "pred").alias("pred"))
    frequencies = counts.name_share(t.names(spark, sf)).withColumnsRenamed({"count": "total_freq", "share": "total_freq_n"})
    return evaluate.evaluation_table(predictions, frequencies, rows.select(F.col("name").alias("last_name"), "label"))


@query(
    f"""with {t.TOKENS}, {_JUDGED} select avg(coalesce(truth[1] = pred[1], false)::int) as first, avg(coalesce(truth[2] = pred[2], false)::int) as second,
    avg(coalesce(truth[3] = pred[3], false)::int) as third,
    avg((coalesce(truth[1] = pred[1], false) and coalesce(truth[2] = pred[2], false) and coalesce(truth[3] = pred[3], false))::int) as "all" from judged"""
)
def position_accuracy(spark, sf):
    return evaluate.position_accuracy(_judged(spark, sf), "truth", "pred")


@query(
    f"""with {t.TOKENS}, {_JUDGED}, s as (
      select 'all' as slice, (label = best)::int as hit from judged union all
      select 'long', (label = best)::int from judged where length(name) > 8 union all
      select 'one language', (label = best)::int from judged where len(truth) = 1)
    select slice, count(*) as n, avg(hit) as accuracy from s group by 1"""
)
def accuracy_slices(spark, sf):
    rows = _judged(spark, sf).withColumn("hit", (F.col("label") == F.col("best")).cast("int"))
    tests = {"all": F.lit(True), "long": F.length("name") > 8, "one language": F.size("truth") == 1}
    return evaluate.accuracy_slices(rows, "hit", tests)


@query(
    f"""with {t.TOKENS}, {_JUDGED} select label, avg((label = best)::int) * 100 as hit, avg(list_contains(pred, label)::int) * 100 as hit3 from judged group by 1"""
)
def accuracy_by_lang(spark, sf):
    rows = _judged(spark, sf).withColumns(
        {"hit": (F.col("label") == F.col("best")).cast("int"), "hit3": F.array_contains("pred", F.col("label")).cast("int")}
    )
    return evaluate.accuracy_by(rows, "label", ["hit", "hit3"])


@query(
    f"""with {t.TOKENS}, {_JUDGED} select name, 'hit' as model, (label = best)::int as hit from judged
    union all select name, 'hit3', list_contains(pred, label)::int from judged"""
)
def unpivot_models(spark, sf):
    rows = _judged(spark, sf).select(
        "name", (F.col("label") == F.col("best")).cast("int").alias("hit"), F.array_contains("pred", F.col("label")).cast("int").alias("hit3")
    )
    return evaluate.unpivot_models(rows, ["name"], ["hit", "hit3"])


@query(
    f"""with {t.TOKENS}, c as (select lang, count(*) as n from names group by 1)
    select lang, n / (select sum(n) from c) as share from c order by n desc, lang limit 1"""
)
def constant_baseline(spark, sf):
    return evaluate.constant_baseline(t.names(spark, sf), "lang")


@query(
    f"""with {t.TOKENS}, c as (select last_name, lang, count(*) as n from names group by 1, 2),
    r as (select *, row_number() over (partition by last_name order by n desc, lang) as r from c qualify r <= 3)
    select last_name, string_agg(lang, ',' order by r) as pred from r group by 1"""
)
def frequency_model(spark, sf):
    found = classify.frequency_model(t.names(spark, sf), label="lang")
    return found.withColumn("pred", F.concat_ws(",", "pred"))


@query(
    f"""with {_USERS.replace("users", "users")}, {t.TOKENS}, f as (
      select distinct lower(name) as name from users
      where regexp_matches(name, '^\\p{{L}}+$') and regexp_matches(name, '(?i)[a-z]') and length(name) > 2),
    pairs as (select distinct last_name as name, state as label from tokens),
    tg as (select label, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from pairs),
    cn as (select gram, label, count(*) as n from tg group by 1, 2),
    lb as (select label, ln(seen / (select count(*) from pairs)) as prior, ln(total + (select count(distinct gram) from cn)) as base
      from (select label, count(*) as seen from pairs group by 1) join (select label, sum(n) as total from cn group by 1) using (label)),
    qg as (select name, gram, count(*) as tf from (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from f) group by 1, 2),
    gain as (select name, label, sum(tf * ln(n + 1)) as gain from qg join cn using (gram) group by 1, 2),
    sc as (select f.name, lb.label, round(prior + coalesce(gain, 0) - (length(f.name) - 1) * base, 6) as score
      from f cross join lb left join gain on gain.name = f.name and gain.label = lb.label),
    top as (select name, label, row_number() over (partition by name order by score desc, label) as r from sc qualify r <= 3)
    select name, string_agg(label, ',' order by r) as pred_state from top group by 1"""
)
def pred_last_state(spark, sf):
    model = classify.NaiveBayes(counts.unique_pairs(t.tokens(spark, sf)), label="state")
    found = classify.pred_last_state(_users(spark, sf), "name", model, order_by="doc_id")
    return found.select("name", F.concat_ws(",", "pred_state").alias("pred_state"))


def _nb_sql(p: str, pairs: str, names: str, k: int = 3) -> str:
    """Scores `{p}_sc` and the k best labels `{p}_top` (name, pred) of `names` (name), trained on `pairs` (name, label)."""
    return f"""{p}_tg as (select label, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from {pairs}),
    {p}_cn as (select gram, label, count(*) as n from {p}_tg group by 1, 2),
    {p}_lb as (select label, ln(seen / (select count(*) from {pairs})) as prior, ln(total + (select count(distinct gram) from {p}_cn)) as base
      from (select label, count(*) as seen from {pairs} group by 1) join (select label, sum(n) as total from {p}_cn group by 1) using (label)),
    {p}_qg as (select name, unnest([substr(name, i, 2) for i in range(1, length(name))]) as gram from {names}),
    {p}_gain as (select name, label, sum(ln(n + 1)) as gain from {p}_qg join {p}_cn using (gram) group by 1, 2),
    {p}_sc as (select q.name, l.label, prior + coalesce(gain, 0) - (length(q.name) - 1) * base as raw
      from {names} q cross join {p}_lb l left join {p}_gain g on g.name = q.name and g.label = l.label),
    {p}_r as (select name, label, row_number() over (partition by name order by round(raw, 6) desc, label) as r from {p}_sc qualify r <= {k}),
    {p}_top as (select name, list(label order by r) as pred from {p}_r group by 1)"""


_HEADS = f"""{t.ASKED_WORDS}, wide as (select last_name as name, {_LANG_WIDE} from names group by 1),
    v as (select *, list_reverse_sort([de, en, es, fr]) as v from wide),
    ranked as (select name, case {_CASE("v[1]", t.LANGS)} end as a, case {_CASE("v[2]", t.LANGS)} end as b, case {_CASE("v[3]", t.LANGS)} end as c from v),
    pa as (select name, a as label from ranked where a is not null), pb as (select name, b as label from ranked where b is not null),
    pc as (select name, c as label from ranked where c is not null), q as (select distinct last_name as name from words),
    {_nb_sql("x", "pa", "q")}, {_nb_sql("y", "pb", "q")}, {_nb_sql("z", "pc", "q")},
    h as (select x_top.name, x_top.pred as x, y_top.pred as y, z_top.pred as z from x_top join y_top using (name) join z_top using (name)),
    two as (select *, case when y[1] = x[1] then y[2] else y[1] end as second from h)"""


@query(
    f"""with {t.TOKENS}, {_HEADS},
    best as (select name, concat_ws(',', x[1], second, case when z[1] = x[1] or z[1] = second then z[3] else z[1] end) as predicted_lang from two)
    select last_name, predicted_lang, count(*) as n from words left join best on last_name = name group by 1, 2"""
)
def predict_lang(spark, sf):
    """Three models on the first, second and third label of each name, applied to the names asked for."""
    counted = t.counted_names(spark, sf)
    ranked = labels.top3_labels(corpus.pivot_states(counted, t.LANGS, state="lang"), t.LANGS)
    models = tuple(classify.NaiveBayes(ranked, label=c) for c in ("first_lang", "second_lang", "third_lang"))
    found = classify.predict_lang(t.asked_names(counted), "last_name", models)
    return found.select("last_name", F.concat_ws(",", "predicted_lang").alias("predicted_lang"), "n")


@query(
    f"""with {t.TOKENS}, {t.ASKED_WORDS}, pairs as (select distinct last_name as name, lang as label from names where lang is not null),
    q as (select distinct last_name as name from words), {_nb_sql("x", "pairs", "q")},
    m as (select *, max(raw) over (partition by name) as most from x_sc)
    select name, label, round(raw, 6) as score, round(raw - most - ln(sum(exp(raw - most)) over (partition by name)), 6) + 0.0::double as log_prob from m"""
)
def label_probabilities(spark, sf):
    """Scores of all languages for the names asked for, and their logarithms normalised to one."""
    counted = t.counted_names(spark, sf)
    return classify.NaiveBayes(counted, label="lang").scores(t.asked_names(counted))


@query()
def forest_lang(spark, sf):
    train, test = _split_pairs(spark, sf)
    found = classify.forest_state(train, test)
    return found.groupBy("label", "pred").agg(F.count("*").alias("n"))


def _smooth_sql(points: str, span: float = 0.75, degree: int = 2) -> str:
    """`fit` (g, x, fit) of `points` (g, x, y)."""
    curved = "whole > 1e-9 * s0 * s0 * s0" if degree > 1 else "false"
    return f"""grid0 as (select g, x::double as x, count(*) as n, sum(y::double) as sy from {points} where x is not null and y is not null group by 1, 2),
    grid as (select *, (sum(n) over (partition by g order by x))::bigint as upto, (sum(n) over (partition by g))::bigint as every from grid0),
    ends as (select g, min(x) as lo, max(x) as hi, first(every) as every,
      greatest(pow(2, ceil(log2(first(every) / greatest(floor(first(every) * {span}::double * {evaluate.CELL}::double), 1)) - 1e-9))::bigint, 1) as cells from grid group by 1),
    wanted as (select g, k, unnest([greatest(every * k // cells, 1), greatest(every * k // cells, 1) + 1]) as pos from (select *, unnest(range(1, cells)) as k from ends)),
    vx as (select g, avg(x) as v from (select w.g, k, x from wanted w join grid on w.g = grid.g and pos > upto - n and pos <= upto) group by g, k
      union select g, lo - greatest(hi - lo, greatest(abs(lo), abs(hi)) * 1e-10 + 1e-30) * {evaluate.MARGIN}::double from ends
      union select g, hi + greatest(hi - lo, greatest(abs(lo), abs(hi)) * 1e-10 + 1e-30) * {evaluate.MARGIN}::double from ends),
    vi as (select *, row_number() over (partition by g order by v) as i from vx),
    met as (select vi.g, i, v, x, n, sy, every, abs(x - v) as d from vi join grid on vi.g = grid.g),
    run as (select *, sum(n) over (partition by g, i order by d range between unbounded preceding and current row) as got from met),
    wide as (select *, min(case when got >= ceil(every * {span}::double) then d end) over (partition by g, i) as reach from run),
    near as (select *, case when reach > 0 then reach * {evaluate.WIDER}::double else 1.0::double end as h from wide),
    wt as (select g, i, v, h, (x - v) / h as t, pow(1 - (d / h) * (d / h) * (d / h), 3) as w, n, sy from near where d < h),
    sums as (select g, i, v, h, {", ".join(f"sum(w * n * pow(t, {k})) as s{k}" for k in range(5))}, {", ".join(f"sum(w * sy * pow(t, {k})) as y{k}" for k in range(3))} from wt group by all),
    det as (select *, s2 * s4 - s3 * s3 as minor, s0 * s2 - s1 * s1 as line,
      s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as whole from sums),
    vertex as (select g, i, v,
      case when {curved} then (y0 * minor - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / whole
        when line > 1e-9 * s0 * s0 then (s2 * y0 - s1 * y1) / line else y0 / s0 end as b0,
      case when {curved} then (s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / whole
        when line > 1e-9 * s0 * s0 then (s0 * y1 - s1 * y0) / line else 0 end / h as b1 from det),
    cell as (select *, lead(v) over o as vr, lead(b0) over o as b0r, lead(b1) over o as b1r from vertex window o as (partition by g order by i)),
    place as (select grid.g, x, (x - v) / (vr - v) as t, vr - v as h, b0, b1, b0r, b1r from grid join cell on grid.g = cell.g and vr is not null and (x > v and x <= vr or i = 1 and x <= v)),
    fit as (select g, x, (1 + 2 * t) * (1 - t) * (1 - t) * b0 + t * (1 - t) * (1 - t) * h * b1 + t * t * (3 - 2 * t) * b0r + t * t * (t - 1) * h * b1r as fit from place)"""


_EN_BY_FREQ = """points as (select substr(last_name, 1, 1) as g, freq as x, en as y from (
      select last_name, count(*) as freq, avg((lang = 'en')::int) as en from names group by 1) where freq <= 2000)"""


def _english_by_frequency(spark, sf):
    rows = t.names(spark, sf).groupBy("last_name").agg(F.count("*").alias("freq"), F.avg((F.col("lang") == "en").cast("int")).alias("en"))
    return rows.withColumn("letter", F.substring("last_name", 1, 1)).filter("freq <= 2000")


@query(f"with {t.TOKENS}, {_EN_BY_FREQ}, {_smooth_sql('points')} select g as letter, x as freq, round(fit, 5) + 0.0::double as fit from fit")
def local_smooth(spark, sf):
    """Share of English over the frequency of names, by first letter, by parabolas."""
    return evaluate.local_smooth(_english_by_frequency(spark, sf), "freq", "en", "letter").withColumn("fit", F.round("fit", 5) + F.lit(0.0))  # no -0.0


@query(f"with {t.TOKENS}, {_EN_BY_FREQ}, {_smooth_sql('points', degree=1)} select g as letter, x as freq, round(fit, 5) + 0.0::double as fit from fit")
def local_linear(spark, sf):
    """The same by lines."""
    return evaluate.local_smooth(_english_by_frequency(spark, sf), "freq", "en", "letter", degree=1).withColumn("fit", F.round("fit", 5) + F.lit(0.0))  # no -0.0


@query(
    f"""with {t.TOKENS} select lower(last_name) as name, len([x for x in range(1, length(last_name))])::int as bigrams,
      count(*) as n from names group by 1, 2"""
)
def sql_functions(spark, sf):
    """The registered SQL functions in a SQL query."""
    register(spark)
    t.names(spark, sf).createOrReplaceTempView("rollscope_names")
    return spark.sql(
        "select normalize_name(last_name) as name, size(char_bigrams(last_name)) as bigrams, count(*) as n "
        "from rollscope_names group by 1, 2"
    )


_LAST = "string_split({0}, ' ')[-1]"


@query(
    f"""with {t.ROLL}, w as (select elector_name as a, father_or_husband_name as b from roll),
    s as (select a, b, {_LAST.format("a")} as fallback,
      case when {_LAST.format("a")} = {_LAST.format("b")} and length({_LAST.format("a")}) > 2 then {_LAST.format("a")} end as household,
      lower([x for x in string_split(a, ' ') if list_contains(string_split(b, ' '), x)][1]) as shared from w)
    select a, b, fallback, household, case when length(shared) >= 3 then shared end as shared, count(*) as n from s group by all"""
)
def sql_name_rules(spark, sf):
    """The rules for last names as SQL functions."""
    register(spark)
    t.roll(spark, sf).createOrReplaceTempView("rollscope_roll")
    return spark.sql(
        "select elector_name as a, father_or_husband_name as b, last_name_fallback(elector_name, father_or_husband_name) as fallback, "
        "last_name_household(elector_name, father_or_husband_name) as household, "
        "last_name_shared(elector_name, father_or_husband_name) as shared, count(*) as n from rollscope_roll group by all"
    )


# --- encoders and lists

_GRAM_WORDS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd"]


@query(
    f"""with {t.TOKENS}, d as (select distinct last_name from names),
    c as (select *, [unicode(x) - 96 for x in string_split(last_name, '')] as codes, [substr(last_name, i, 2) for i in range(1, length(last_name))] as grams from d)
    select last_name, array_to_string(codes, ' ') as codes, array_to_string(codes || [0 for i in range(24 - len(codes))], ' ') as padded,
      array_to_string([greatest(coalesce(list_position({_GRAM_WORDS}, g), 0) - 1, 0) for g in grams], ' ') as gram_codes,
      array_to_string([case when strpos('etaoin', x) > 0 then repeat('0', strpos('etaoin', x)::int - 1) || '1' || repeat('0', 6 - strpos('etaoin', x)::int) else '000001' end
        for x in string_split(last_name, '')], ' ') as one_hot from c"""
)
def name_codes(spark, sf):
    """Names as letter numbers, padded, as places of bigrams in a vocabulary, and letter by letter as 0 and 1."""
    codes = fn.char_codes("last_name", ALPHABET)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    places = fn.ngram_index(fn.char_ngrams("last_name", 2), F.array(*map(F.lit, _GRAM_WORDS)))
    hot = F.transform(fn.one_hot_name("last_name", "etaoin"), lambda row: F.array_join(F.transform(row, lambda x: x.cast("string")), ""))
    distinct = t.names(spark, sf).select("last_name").distinct()
    return distinct.select("last_name", joined(codes).alias("codes"), joined(fn.pad_codes(codes, 24)).alias("padded"), joined(places).alias("gram_codes"), F.array_join(hot, " ").alias("one_hot"))


@query(
    f"""with {t.TOKENS}, c as (select last_name, lang, state, count(*) as n from tokens group by all)
    select last_name, sum(n)::bigint as n, bool_and(regexp_matches(last_name, '^[A-Za-z]+$')) as ascii, case when state = 'src1' then 'Src1' else upper(state[1]) || lower(state[2:]) end as shown
    from c where regexp_matches(last_name, '[a-z]') and regexp_matches(last_name, '^\\p{{L}}+$') group by last_name, state"""
)
def name_filters(spark, sf):
    """Names fit for a corpus, whether they are ASCII, and the printed names of their states."""
    rows = t.tokens(spark, sf).filter(fn.is_corpus_name("last_name"))
    grouped = rows.groupBy("last_name", "state").agg(F.count("*").alias("n"))
    return grouped.select("last_name", "n", fn.is_ascii_name("last_name").alias("ascii"), fn.state_display_name("state").alias("shown"))


@query(
    f"""with {_DIM}, u as (select state, unnest([first, second, third]) as lang from dim)
    select state, lang, dense_rank() over (order by lang) - 1 as code, lang as label from u"""
)
def unrolled_languages(spark, sf):
    """The languages of each state as rows, with their codes and the labels of these."""
    columns = ["most_spoken_lang", "second_most_spoken_lang", "third_most_spoken_lang"]
    dim = enrich.column_range(_dimension(spark, sf), columns[0], columns[-1], "state").withColumns({c: F.lower(c) for c in columns})
    listed = dim.select("state", fn.top_languages(*columns).alias("languages"))
    labels_ = enrich.label_union(dim, columns)
    codes = labels_.withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)  # a row a language
    coded = enrich.with_codes(counts.unroll_languages(listed), "lang", codes)
    return enrich.with_labels(coded, "code", codes).select(F.lower("state").alias("low"), "state", "lang", "code", "label").drop("low")


@query(
    f"""with {t.TOKENS}, {_JUDGED}, s as (select last_name, list_sort(list(state)) as states, count(*) as n from names where state is not null group by 1)
    select name, array_to_string(pred, ',') as pred, array_to_string(states, ',') as states from judged join s on name = last_name"""
)
def prediction_states(spark, sf):
    """Predictions with the states that each name came from, as a list."""
    states = counts.collect_by_name(t.names(spark, sf).select("last_name", "state"), ["state"])
    rows = _judged(spark, sf).select(F.col("name").alias("last_name"), F.concat_ws(",", "pred").alias("pred"))
    return counts.attach_aggregate(rows, states).select(F.col("last_name").alias("name"), "pred", F.array_join("states" if "states" in states.columns else "state", ",").alias("states"))


@query(
    f"""with {t.TOKENS}, c as (select state, count(*) as count from names where last_name = 'the' group by 1)
    select 'the' as last_name, state, count, count / (select sum(count) from c) * 100 as percent from c"""
)
def name_profile(spark, sf):
    """The states of one name."""
    return counts.name_profile(counts.name_state_counts(t.names(spark, sf)), "the")


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name, state from names),
    r as (select *, row_number() over (partition by state order by {_H}, last_name) as r from p) select last_name, state from r where (r - 1) % 99 = 0"""
)
def every_nth(spark, sf):
    return sampling.every_nth(counts.unique_pairs(t.names(spark, sf)), "last_name", "state", 99)


@query(
    f"""with {t.TOKENS}, p as (select distinct last_name from names), r as (select *, row_number() over (order by {_H}, last_name) as r from p),
    d as (select i as draw, {t.hash32("'1:' || i", "0-draw")} % (select count(*) from p) + 1 as r from range(1000) x(i))
    select draw::int as draw, last_name from d join r using (r)"""
)
def bootstrap(spark, sf):
    return sampling.bootstrap(t.names(spark, sf).select("last_name").distinct(), 1000, "last_name").select("draw", "last_name")

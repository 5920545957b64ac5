"""Spelling variants of corpus words by asymmetric q-chunks.

A word of n letters is cut into two disjoint chunks, and one edit leaves one of them whole. The other word of a pair
contributes positional grams, and a chunk meets the grams at its own place shifted by the difference of the two lengths,
0 or 1. What lies beside the preserved chunk differs by the same one edit, so one of its two halves is whole as well:
chunk and half together are the key, which keeps a beginning or an ending that many words share from becoming a group of
all their pairs. The edit distance is verified inside the join.

Everything is DataFrame operations. Of a pair the shorter word, or the smaller of two equally long ones, has the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollscope.llm.common import checkpointed

LETTERS = "a-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE_EACH = 97
LEAD = 2


def corpus_words(docs: DataFrame, damage_each: int = DAMAGE_EACH) -> DataFrame:
    """(word, n): words of MIN_LENGTH letters or more that occur MIN_COUNT times or more in all texts.

    Where damage_each divides the CRC-32 of `doc_id:run`, one letter of the run is left out; 0 leaves all runs as they are.
    """
    low = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.split(low, f"[^{LETTERS}]+")).alias("_run"))
    word = F.col("_run")
    if damage_each:
        hashed = F.crc32(F.concat_ws(":", "_id", "_run"))
        at = (hashed % F.length("_run")).cast("int")
        damaged = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
        word = F.when(hashed % damage_each == 0, damaged).otherwise(word)
    long_enough = runs.filter(F.length("_run") >= MIN_LENGTH).select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _half(c: Column) -> Column:
    return F.ceil(c / 2).cast("int")


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Structs (`_n`, `_which`, `_key`): each chunk of a word of `length` letters with each half of what lies beside it.

    With shift 0 the word's own; with shift 1 the grams of a word with one letter more at the places where the chunks
    of a word of `length` letters lie if the added letter is outside chunk and half.
    """
    first = _half(length)
    second = length - first
    cut = lambda start, size: F.substring(word, start + 1, size)
    # (chunk start, chunk size, start of the rest, size of the rest): the rest holds the edit, so it is longer by shift.
    places = [(F.lit(0), first, first, second), (first + shift, second, F.lit(0), first)]
    keys = []
    for i, (start, size, rest, left) in enumerate(places):
        ahead = _half(left)
        for j, (half, half_size) in enumerate([(rest, ahead), (rest + ahead + shift, left - ahead)]):
            key = F.concat(cut(start, size), cut(half, half_size))
            keys.append(F.struct(length.alias("_n"), F.lit(2 * i + j).alias("_which"), key.alias("_key")))
    return F.array(*keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of distinct words that differ by one inserted, deleted or replaced letter.

    A pair may come more than once, at most once a key.
    """
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.inline(_keys(F.col("word"), length, 0)))
    shorter = F.when(length > MIN_LENGTH, _keys(F.col("word"), length - 1, 1))
    grams = F.concat(_keys(F.col("word"), length, 0), F.coalesce(shorter, F.array().cast(_KEYS)))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.inline(grams))
    on = ["_n", "_which", "_key"]
    same = [chunks[c] == grams[c] for c in on]
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return chunks.join(grams, [*same, ordered, F.expr("levenshtein(a, b, 1) = 1")]).select("a", "a_n", "b", "b_n")


_KEYS = "array<struct<_n:int,_which:int,_key:string>>"


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that the forms lead to, by pointer jumping.

    Counts at least double from word to form, so chains have at most 62 links and six rounds reach their ends.
    """
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = checkpointed(found.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if moved.filter("_moved").isEmpty():
            return moved.select("word", "root")
        found = moved.drop("_moved")


def spelling_variants(docs: DataFrame, damage_each: int = DAMAGE_EACH) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of `corpus_words`.

    `form` is the near word with the largest n, ties by code points, if that n is LEAD times the word's or more, else null;
    `root` is where the forms lead, the word itself without any. Null and empty texts have no words, texts are read whole, a
    null doc_id counts as an empty one, repeated rows count each, an empty table gives no rows, other columns are ignored.
    """
    words = checkpointed(corpus_words(docs, damage_each))
    pairs = near_pairs(words)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("other")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("other")),
    )
    # A word has at most 2 * length + 1 near words a letter of the alphabet, so a set is small.
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.collect_set("other").alias("near"))
    best = near.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    led = -F.col("best.less") >= LEAD * F.col("n")
    found = checkpointed(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = follow_forms(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: CRC-32 byte by byte over code points under 256 as UTF-8; the bits are shifted as the polynomial 0xEDB88320 says.
CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''),
  lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + unicode(x) // 64)::bigint, (128 + unicode(x) % 64)::bigint] end))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: xor(d >> 1, 3988292384::bigint * (d & 1)))), 4294967295::bigint)"""

ORACLE = rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run
  from documents
), each as (select id, run, count(*) as c from runs where length(run) >= 5 group by 1, 2),
hashed as (select *, {CRC32.format("id || ':' || run")} as h from each),
whole as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from hashed
), words as (select word, sum(c)::bigint as n from whole where length(word) >= 5 group by 1 having sum(c) >= 3),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as part from (select *, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from cut a join cut b on a.part = b.part and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.part = b.word
  union select b.word, a.word, a.n from cut a join words b on a.part = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by 1
), found as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * w.n then near end as form,
    case when near_n >= 2 * w.n then near_n end as form_n
  from words w left join best b on w.word = b.word
), up as (
  select word, word as root, 0 as step from found
  union all select up.word, f.form, step + 1 from up join found f on up.root = f.word where f.form is not null
), roots as (select word, arg_max(root, step) as root from up group by 1)
select f.*, r.root from found f join roots r on f.word = r.word
"""

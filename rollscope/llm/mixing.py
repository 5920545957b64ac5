"""Mixing sources to target weights with a low-discrepancy slot schedule.

Golden-ratio points are mapped through the cumulative source targets, which gives a schedule of slots in
which every source comes up evenly. The slots of a source are ranked; each source's shuffled word stream is
cut into as many equal-token blocks as it has slots, and slot and block are joined by (source, rank).

Everything is DataFrame operations. No window spans a whole source: the shuffled stream is laid out in two
levels, hash bucket sums first and then running sums inside each bucket, so a hot source is spread over
`BUCKETS` groups. The schedule has `SLOTS` rows whatever the input, plus one a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollscope.llm.common import checkpointed

GOLDEN = 0.6180339887498949
SLOTS = 65536
BUCKETS = 4096
PIECES = 1024
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> sid, source, source_size, target, goal.

    Sources weigh 1, 2, 3, 1, ... by code point, null last. A target stops at `MAX_EPOCHS` times the size and
    the excess goes to the others by weight until none is above: with sources sorted by cap over weight, one is
    capped if its ratio is under the water level that holds when all before it are capped.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.select("source", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("w", (F.col("sid") % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * MAX_EPOCHS)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("total_w", F.sum("w").over(everything))
        .withColumn("left_before", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("w_before", F.col("total_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
        .withColumn(
            "capped",
            F.col("cap").cast("double") * F.col("w_before").cast("double")
            < F.col("w").cast("double") * F.col("left_before").cast("double"),
        )
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("left_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    )
    share = F.try_divide(F.col("w").cast("double") * F.col("left").cast("double"), F.col("left_w").cast("double"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))
    return (
        ranked.withColumn("target", target)
        .withColumn("goal", F.least(F.floor("target").cast("long"), F.col("cap")))
        .select("sid", "source", "source_size", "target", "goal")
    )


def slot_schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Golden-ratio points through the cumulative goals -> sid, rank (from 0 in its source), slot.

    Each source with a goal also gets one slot of its own after the others, so that a share under one slot is
    not lost.
    """
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        targets.filter("goal > 0")
        .withColumn("lo", F.coalesce(F.sum("goal").over(before), F.lit(0)))
        .withColumn("hi", F.col("lo") + F.col("goal"))
        .withColumn("all", F.sum("goal").over(Window.partitionBy()))
        .withColumn("width", F.ceil(F.col("all") / PIECES).cast("long"))
        .select("sid", "lo", "hi", "all", "width")
    )
    pieces = spans.select(
        "sid", "lo", "hi", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)")).alias("piece")
    )
    whole = spans.agg(F.first("all").alias("all"), F.first("width").alias("width"))
    points = (
        targets.sparkSession.range(slots)
        .withColumnRenamed("id", "slot")
        .join(F.broadcast(whole))  # one row
        .withColumn("at", (F.col("slot") + 0.5) * GOLDEN)
        .withColumn("at", F.least(F.floor((F.col("at") - F.floor("at")) * F.col("all")).cast("long"), F.col("all") - 1))
        .withColumn("piece", F.expr("at div width"))
        .select("slot", "at", "piece")
    )
    hits = points.join(pieces, "piece").filter("at >= lo and at < hi").select("sid", "slot")
    own = spans.select("sid", (F.lit(slots) + F.col("sid")).cast("long").alias("slot"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1
    return hits.unionByName(own).select("sid", rank.cast("long").alias("rank"), "slot")


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """By which rows are shuffled: a digest of id and text, so that rows of one id, or without one, lie apart."""
    plain = F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), plain))


def mix(docs: DataFrame, slots: int = SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(laid, cuts): every document with its place in its source's stream, and what each slot takes of it.

    `laid`: doc_id, source, hash, size, sid, source_size, target, offset. `cuts`: sid, offset, slot, words.
    Documents without words (null, empty or blank texts) are laid at size 0 and never taken. Repeated rows lie
    side by side as separate stretches of the stream; ties in the shuffle hash are such rows. Texts of any
    length are counted whole. Reruns agree: the shuffle hash is a function of doc_id, text and the seed. Null
    sources are one source, null doc_ids are kept, an empty table gives none, other columns are ignored.
    """
    # Counted once: texts are read a single time, what follows works on narrow columns.
    hashed = row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")
    sized = checkpointed(docs.select("doc_id", "source", hashed, n_words(F.col("text")).alias("size")))
    targets = checkpointed(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    t = targets.withColumnRenamed("source", "t_source")
    keyed = (
        sized.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumn("bucket", (F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
    )
    in_source = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        keyed.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select("sid", "bucket", F.coalesce(F.sum("in_bucket").over(in_source), F.lit(0)).alias("base"))
    )
    in_bucket = (
        Window.partitionBy("sid", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(sums, ["sid", "bucket"])
        .withColumn("offset", F.col("base") + F.col("inside"))
        .select("doc_id", "source", "hash", "size", "sid", "source_size", "target", "goal", "offset")
    )
    schedule = checkpointed(slot_schedule(targets, slots))
    counts = schedule.groupBy("sid").agg(F.count("*").alias("n"))
    blocks = (
        laid.filter("size > 0 and goal > 0")
        .join(counts, "sid")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
        .withColumn("lo", F.col("offset") + F.col("epoch") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal")))
        .filter("lo < hi")
        .withColumn("rank", F.explode(F.expr("sequence(((lo + 1) * n - 1) div goal, (hi * n - 1) div goal)")))
    )
    cuts = (
        blocks.join(schedule, ["sid", "rank"])
        .withColumn(
            "words",
            F.expr("least(hi, ((rank + 1) * goal) div n) - greatest(lo, (rank * goal) div n)"),
        )
        .select("sid", "offset", "slot", "words")
    )
    return laid, cuts


def mix_documents(docs: DataFrame, slots: int = SLOTS, seed: int = 7, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, first_slot, n_slots and, if asked for, text.

    `first_slot` is the earliest slot of the schedule that takes words of the document (null if none does), `n_slots`
    the number of its pieces. Rows are those of `mix`.
    """
    laid, cuts = mix(docs, slots, seed)
    taken = cuts.groupBy("sid", "offset").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots")
    )
    stretch = F.when(F.col("size") > 0, F.col("offset"))  # rows without words share the offset of the next one
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_slots")]
    mixed = (
        laid.withColumn("offset", stretch)
        .join(taken, ["sid", "offset"], "left")
        .select("doc_id", "source", "hash", "size", "source_size", "target", *counts, "first_slot")
    )
    if with_text:
        texts = docs.select(row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"), "text").dropDuplicates(["hash"])
        mixed = mixed.join(texts, "hash")
    return mixed.drop("hash")


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('7:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as hash
  from documents
), per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, row_number() over (order by source nulls last) - 1 as sid from per
), w as (
  select *, sid % 3 + 1 as w, 3 * source_size as cap, (sum(source_size) over ())::bigint as total from ranked
), o as (
  select *, (total - coalesce(sum(cap) over r, 0))::double as left_before,
    ((sum(w) over ()) - coalesce(sum(w) over r, 0))::double as w_before
  from w window r as (order by cap / w, sid rows between unbounded preceding and 1 preceding)
), c as (select *, cap::double * w_before < w::double * left_before as capped from o),
t as (
  select sid, source, source_size, cap, case when capped then cap::double else coalesce(
    w::double * (total - sum(case when capped then cap else 0 end) over ())::double
      / nullif((sum(case when capped then 0 else w end) over ())::double, 0), 0) end as target from c
), g as (
  select *, coalesce(sum(goal) over (order by sid rows between unbounded preceding and 1 preceding), 0)::bigint as lo,
    (sum(goal) over ())::bigint as every
  from (select *, least(floor(target)::bigint, cap)::bigint as goal from t)
), points as (
  select slot, (slot + 0.5::double) * 0.6180339887498949::double as x from (select unnest(range(65536)) as slot)
), hits as (
  select sid, slot from points join g
    on least(floor((x - floor(x)) * every)::bigint, every - 1) >= lo and least(floor((x - floor(x)) * every)::bigint, every - 1) < lo + goal
  union all select sid, 65536 + sid from g where goal > 0
), schedule as (
  select sid, slot, row_number() over (partition by sid order by slot) - 1 as rank, count(*) over (partition by sid) as n
  from hits
), laid as (
  select h.doc_id, h.size, g.sid, g.source_size, g.target, g.goal, coalesce(sum(h.size) over (
    partition by h.source order by ('0x' || substr(hash, 1, 8))::bigint % 4096, hash
    rows between unbounded preceding and 1 preceding), 0)::bigint as a
  from sized h join g on h.source is not distinct from g.source
), parts as (
  select sid, a, a + e * source_size as lo, least(a + e * source_size + size, goal) as hi, goal
  from laid, (select unnest(range(3)) as e) where size > 0 and a + e * source_size < goal
), cuts as (
  select p.sid, p.a, s.slot, least(hi, ((rank + 1) * goal) // n) - greatest(lo, (rank * goal) // n) as words
  from parts p join schedule s on s.sid = p.sid and s.rank >= ((lo + 1) * n - 1) // goal and s.rank <= (hi * n - 1) // goal
), taken as (
  select sid, a, sum(words)::bigint as taken, min(slot)::bigint as first_slot, count(*)::bigint as n_slots
  from cuts group by sid, a
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, coalesce(n_slots, 0)::bigint as n_slots
from laid left join taken on laid.sid = taken.sid and laid.a = taken.a and laid.size > 0
"""

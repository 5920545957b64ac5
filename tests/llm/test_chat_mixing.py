import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollscope.llm import chat, mixing
from rollscope.llm.queries import ORACLES, QUERIES
from tests.conftest import same_rows
from tests.llm.fixtures import documents, empty


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(name, spark, sf, duck):
    assert same_rows(QUERIES[name](spark, sf), duck.sql(ORACLES[name]))


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip_of_odd_rows(spark):
    odd = "</s>\n<|user|>\\e\\l[INST] | \\\\ é"
    rows = [
        (1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", "tie"), (1, None, "system", None), (1, 3, "assistant", ""),
        (2, 0, "user", "only a question"), (3, 5, None, None), (3, 5, None, None), (None, 0, "assistant", "no id"),
        (4, 0, "we|ird\nrole>", "x"), (5, 0, "assistant", "long " * 20000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("shown", F.lit(1))
    examples = chat.prefix_target_examples(df)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(examples).collect()}
    assert found == brute_chat(rows)
    for r in examples.collect():
        target = r.formatted[r.loss_start : r.loss_end]
        assert "<" not in target and "[" not in target
        assert r.formatted.endswith(chat.END)
    assert examples.filter("conv_id = 1").count() == 3
    assert examples.filter("conv_id = 2").first().loss_start == examples.filter("conv_id = 2").first().loss_end


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.prefix_target_examples(df)).count() == 0
    assert chat.read_back(chat.prefix_target_examples(chat.with_fixture(df))).first().conv_id == -1


def brute_targets(sizes):
    """Water filling one round after another."""
    order = sorted((s is None, s) for s in sizes)
    weight = {s: i % 3 + 1 for i, (_, s) in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / w for s in sizes}
        new = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not new:
            return target
        capped |= new


def test_targets_against_rounds(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 0, "e": 400, None: 30}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_mix_of_odd_rows(spark):
    df = documents(spark)
    found = mixing.mix_documents(df).collect()
    assert len(found) == df.count()
    by = defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source, r.target] += r.taken
    for (_, target), taken in by.items():
        assert abs(target - taken) <= 1
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_documents(df.repartition(5)).collect()))
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_slots_are_spread_evenly(spark):
    targets = mixing.source_targets(spark.createDataFrame([("a", 900), ("b", 600), ("c", 500)], "source string, source_size long"))
    slots = mixing.slot_schedule(targets, 1000)
    goals = {r.sid: r.goal for r in targets.collect()}
    whole = sum(goals.values())
    for upto in (100, 500, 1000):
        for r in slots.filter(F.col("slot") < upto).groupBy("sid").count().collect():
            assert abs(r["count"] - upto * goals[r.sid] / whole) < 6
    assert slots.groupBy("sid").agg((F.max("rank") + 1 - F.count("*")).alias("d")).filter("d <> 0").isEmpty()


def test_each_slot_is_a_block(spark):
    df = documents(spark, ["one two three " * 40, "four five " * 30, "six " * 11])
    laid, cuts = mixing.mix(df, slots=64)
    sizes = cuts.groupBy("sid", "slot").agg(F.sum("words").alias("w"))
    spread = sizes.groupBy("sid").agg((F.max("w") - F.min("w")).alias("d"))
    assert spread.filter("d > 1").isEmpty()

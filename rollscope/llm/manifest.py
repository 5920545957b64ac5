"""A Merkle manifest of a dataset, with versions of its tree that share what tampering leaves untouched.

Every row is a leaf. Leaves are ranked per source over a range partitioning, without a task that sees a source whole, and cut
into aligned blocks of 4096, which are three levels of the 16-ary tree; a task holds one block. The roots of the blocks are
the leaves of a tree above, cut into blocks in the same way until one node a source is left, and the sources' roots are
the leaves of the last tree. What lies beside a block's path to the root is handed down from block to block, so a leaf is
proved, or changed, in the task that has its block.

A tampered leaf makes a version of the tree: the ancestors of the leaf are copied, first inside its block, then through the
blocks above, and all other nodes stay those of the first version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollscope.llm.common import bounded_batches, checkpointed

FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS
TAMPER_EACH = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A path is one (left siblings, right siblings) a level, each the siblings' digests side by side.
PATH = "array<struct<l:string,r:string>>"
_PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
Path = list[tuple[str, str]]


def leaf_digest(*values: Column) -> Column:
    """sha256 over the fields, each `-` if null, else its UTF-8 length in bytes, `:` and itself."""
    parts = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*parts), 256)


def hashed_leaves(docs: DataFrame, tamper_each: int = TAMPER_EACH) -> DataFrame:
    """(source, doc_id, leaf, tampered): `tampered` is the leaf after A-Z in the text are lower-cased, null where nothing is done to it."""
    fields = [F.col(c) for c in FIELDS]
    low = leaf_digest(*fields[:-1], F.translate("text", UPPER, UPPER.lower()))
    chosen = F.crc32(F.col("doc_id").cast("string")) % tamper_each == 0
    return docs.select("source", "doc_id", leaf_digest(*fields).alias("leaf"), F.when(chosen, low).alias("tampered"))


def group_key(c: Column) -> Column:
    """A source as a string of its own for null, which sorts first."""
    return F.coalesce(F.concat(F.lit("+"), c), F.lit(""))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `_before`, the leaves of the group earlier in this sorted partition, and `_upto`, those up to here."""
    group, n = None, 0
    for batch in batches:
        before, upto = [], []
        for key, copies in zip(batch.column("group").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            if key != group:
                group, n = key, 0
            before.append(n)
            n += copies
            upto.append(n)
        yield batch.append_column("_before", pa.array(before, pa.int64())).append_column("_upto", pa.array(upto, pa.int64()))


def _kinds(df: DataFrame, *leave: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in leave)


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """`leaves` (group, copies and others) with `at`, the leaves before it in its group by `order`, and the group's `size`.

    Rows are range-partitioned, so neighbours in a group lie in one task or in the next ones; a group of any size is spread out.
    """
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = leaves.repartitionByRange(n, "group", *order).sortWithinPartitions("group", *order)
    counted = laid.mapInArrow(_running, f"{_kinds(laid)}, _before bigint, _upto bigint").withColumn("_part", F.spark_partition_id())
    counted = checkpointed(counted)  # frozen, so that counts and rows have the same borders
    parts = counted.groupBy("group", "_part").agg(F.max("_upto").alias("_n"))
    group = Window.partitionBy("group")  # a row a partition that the group reaches into
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("group", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("size"))
    return counted.join(base, ["group", "_part"]).withColumn("at", F.col("_base") + F.col("_before")).drop("_part", "_base", "_before", "_upto")


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def block_levels(leaves: list[str], whole: bool) -> list[list[str]]:
    """The nodes of a block level by level. A `whole` tree ends where one node is left, a block of a larger one after LEVELS."""
    levels = [leaves]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([_digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def path_in(levels: list[list[str]], at: int) -> Path:
    """What lies left and right of the path from leaf `at` to the top of `levels`."""
    path = []
    for nodes in levels[:-1]:
        run = at - at % FAN
        path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FAN])))
        at //= FAN
    return path


def copied(node: str, path: Path) -> list[str]:
    """The copies that a version with this node has of the node's ancestors, the nearest first; all else is shared."""
    copies = []
    for left, right in path:
        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
        copies.append(node)
    return copies


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, list], list[list[str]], list[int]]]:
    """Of each row of blocks: the row without `rows`, the columns of `rows`, the levels, and the row number of each leaf."""
    for batch in batches:
        rest = batch.drop_columns(["rows"]).to_pylist()
        for i, row in enumerate(rest):
            inner = batch.column("rows")[i].values
            rows = {inner.type.field(j).name: inner.field(j).to_pylist() for j in range(inner.type.num_fields)}
            leaves = [j for j, n in enumerate(rows["copies"]) for _ in range(n)]
            yield row, rows, block_levels([rows["node"][j] for j in leaves], row["whole"]), leaves


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [levels[-1][0] for _, _, levels, _ in _each_block(iter([batch]))]
        yield batch.append_column("root", pa.array(found, pa.string()))


def in_blocks(cut: DataFrame) -> DataFrame:
    """Rows (group, block, size, row) as one row a block: group, block, size, whole, rows in order, root. Written to the shared folder."""
    blocks = cut.groupBy("group", "block").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("row")).alias("rows"))
    blocks = blocks.select("group", "block", "size", (F.col("size") <= BLOCK).alias("whole"), "rows")
    return checkpointed(blocks.mapInArrow(_roots, f"{_kinds(blocks)}, root string"))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The tree of each group over `ranked` leaves (group, at, size, copies, node and others) as tables of blocks, leaves first.

    Copies of a leaf that cross a border are dealt to the blocks that they lie in.
    """
    cut = leaves.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + copies - 1) div {BLOCK})")))
    low, high = F.greatest("at", F.col("block") * BLOCK), F.least(F.col("at") + F.col("copies"), (F.col("block") + 1) * BLOCK)
    others = [c for c in leaves.columns if c not in ("group", "at", "size", "copies")]
    row = F.struct(low.alias("at"), (high - low).cast("int").alias("copies"), *others).alias("row")
    tables = [in_blocks(cut.select("group", "block", "size", row))]
    while not (rest := tables[-1].filter("not whole")).isEmpty():
        row = F.struct(F.col("block").alias("at"), F.lit(1).alias("copies"), F.col("root").alias("node")).alias("row")
        above = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size")
        tables.append(in_blocks(rest.select("group", F.expr(f"block div {BLOCK}").alias("block"), above, row)))
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """(group, root)."""
    found = [t.filter("whole").select("group", "root") for t in tables]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _handing(columns: list[str], schema: pa.Schema) -> Callable:
    """Hands (path and more) down from a block to what lies under it: `columns` of its rows, `given` ones of its own."""

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, levels, leaves in _each_block(batches):
            above = [(p["l"], p["r"]) for p in row["path"]]
            found = {c: rows[c] for c in columns} | {c: [row[c]] * len(leaves) for c in schema.names if c in row and c not in columns}
            found["path"] = [[{"l": a, "r": b} for a, b in path_in(levels, i) + above] for i in range(len(leaves))]
            yield pa.RecordBatch.from_pylist([dict(zip(found, v, strict=True)) for v in zip(*found.values(), strict=True)], schema=schema)

    return hand


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of leaves with the columns of `above` (group, path, subroot, root), where `path` leads from the block to the root."""
    given = ["path", "subroot", "top"]
    under = None
    for number in reversed(range(len(tables))):
        table = tables[number].drop("root")
        entered = table.filter("whole").join(above, "group")
        if under is not None:
            entered = entered.unionByName(table.filter("not whole").join(under, ["group", "block"]))
        if number:
            schema = pa.schema([("group", pa.string()), ("at", pa.int64()), ("path", _PATH), ("subroot", pa.string()), ("top", pa.string())])
            handed = entered.select("group", "whole", "rows", *given).mapInArrow(_handing(["at"], schema), f"group string, at bigint, path {PATH}, subroot string, top string")
            under = handed.withColumnRenamed("at", "block")
    return entered


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a leaf: its proof, and the root that its version comes to."""
    for row, rows, levels, leaves in _each_block(batches):
        above = [(p["l"], p["r"]) for p in row["path"]]
        proofs, versions = [], []
        for i, j in enumerate(leaves):
            path = path_in(levels, i) + above
            proofs.append(_digest([x for sides in path for x in sides]))
            node = rows["tampered"][j] or rows["node"][j]
            versions.append([node, *copied(node, path)])
        n = len(leaves)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([rows["doc_id"][j] for j in leaves], pa.int64()), "leaf": [rows["node"][j] for j in leaves],
                "subroot": [row["subroot"]] * n, "root": [row["top"]] * n, "proof_sha256": proofs,
                "version": pa.array(versions, pa.list_(pa.string())),
            }
        )


def dataset_manifest(docs: DataFrame, tamper_each: int = TAMPER_EACH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, version) of every row.

    `version` is what this leaf's version of the tree does not share with the first one: the leaf, tampered if it is to be, and
    the copies of its ancestors up to the root. Leaves of a source ascend by doc_id, null first, ties by digest. A null source is
    one of its own, nulls in any field are part of the leaf, empty and very long texts are hashed whole, equal rows are leaves
    each, an empty table gives no rows, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    leaves = hashed_leaves(docs, tamper_each).withColumnRenamed("leaf", "node").withColumn("group", group_key(F.col("source")))
    leaves = leaves.groupBy("group", "doc_id", "node", "tampered").agg(F.count("*").alias("copies"))
    tables = build(ranked(leaves, "doc_id", "node"))
    sources = tops(tables).select(F.lit("").alias("group"), F.col("group").alias("source"), F.col("root").alias("node"), F.lit(1).cast("long").alias("copies"))
    upper = build(ranked(sources, "source"))
    crown = tops(upper).select("group", F.lit(None).cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("root").alias("top"))
    crown = crown.withColumn("path", F.array().cast(PATH))
    schema = pa.schema([("source", pa.string()), ("node", pa.string()), ("path", _PATH), ("top", pa.string())])
    entered = descend(upper, crown).select("whole", "rows", "path", "top")
    above = entered.mapInArrow(_handing(["source", "node"], schema), f"source string, node string, path {PATH}, top string")
    above = checkpointed(above.withColumnsRenamed({"source": "group", "node": "subroot"}))
    blocks = descend(tables, above).select("whole", "rows", "path", "subroot", "top")
    return blocks.mapInArrow(_prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, version array<string>")


def verified(manifest: DataFrame) -> DataFrame:
    """The manifest with `folded_root`, the root of each leaf's version, and whether it is the root of the first one, `verified`."""
    return manifest.withColumn("folded_root", F.element_at("version", -1)).withColumn("verified", F.col("folded_root") == F.col("root")).drop("version")


def _oracle(levels: int = 5, upper: int = 3) -> str:
    """DuckDB form for sources of up to 16 ** levels rows, and 16 ** upper sources."""
    from rollscope.llm.spelling import CRC32

    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    plain = " || ".join(map(field.format, FIELDS))
    low = " || ".join([*map(field.format, FIELDS[:-1]), field.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")])
    ctes = [
        f"h as (select doc_id, source, sha256({plain}) as leaf, case when {CRC32.format('doc_id::varchar')} % {TAMPER_EACH} = 0 then sha256({low}) end as tampered from documents)",
        "base as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as g from h)",
    ]

    def tree(name: str, start: str, depth: int) -> None:
        ctes.append(f"{name}0 as ({start})")
        for k in range(depth):
            below = f"{name}{k}"
            ctes.append(f"{name}_runs{k} as (select g, pos // {FAN} as run, list(node order by pos) as nodes from {below} where g in (select g from {below} where pos > 0) group by all)")
            ctes.append(f"{name}{k + 1} as (select g, run as pos, sha256(array_to_string(nodes, '')) as node from {name}_runs{k})")
        tops = " union all ".join(f"select {depth - k} as d, g, node from {name}{k} where pos = 0 and g not in (select g from {name}{k} where pos > 0)" for k in range(depth + 1))
        ctes.append(f"{name}_top as ({tops})")

    def climb(rows: str, name: str, g: str, pos: str, depth: int) -> str:
        for k in range(depth):
            i = f"({pos} // {FAN**k} % {FAN})"
            ctes.append(f"""{name}_way{k} as (select r.*, coalesce(array_to_string(nodes[1:{i}], ''), '') as le, coalesce(array_to_string(nodes[{i} + 2:], ''), '') as ri, nodes is null as over
              from {rows} r left join {name}_runs{k} s on s.g = {g} and s.run = {pos} // {FAN ** (k + 1)})""")
            ctes.append(f"{name}_up{k} as (select * exclude (le, ri, over, proof, fold), proof || le || ri as proof, case when over then fold else sha256(le || fold || ri) end as fold from {name}_way{k})")
            rows = f"{name}_up{k}"
        return rows

    tree("n", "select g, pos, leaf as node from base", levels)
    tree("s", "select 0 as g, g as pos, node from n_top", upper)
    ctes.append("rows0 as (select *, 0 as zero, '' as proof, coalesce(tampered, leaf) as fold from base)")
    last = climb(climb("rows0", "n", "r.g", "r.pos", levels), "s", "r.zero", "r.g", upper)
    return f"""with {", ".join(ctes)} select doc_id, leaf, n_top.node as subroot, s_top.node as root, sha256(proof) as proof_sha256, fold as folded_root,
      fold = s_top.node as verified from {last} r join n_top on n_top.g = r.g, s_top"""


ORACLE = _oracle()

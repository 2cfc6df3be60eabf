"""A Merkle manifest of a dataset: a digest for each row, a root for each group and one for all, and a proof for each row.

A row's leaf is the hash of its columns. The leaves of a group stand in the order of the ids; every ``FANOUT`` consecutive
nodes become the hash of their digests, until one is left, the group's subroot. The subroots, in the order of the groups,
become the root in the same way.

Positions are given by a range partition and the starts of its parts, so that no group is sorted in one task. ``FANOUT**HEIGHT``
nodes that are aligned are a block. A task traverses a block by recursion in postorder: a subtree returns its digest, and
while it unwinds the digests beside each child are appended to all leaves below that child. The roots of blocks are the nodes
of another distributed traversal, until a group has one node. Proofs are made from the top down: what lies above a block is
known once, and the block's leaves are met with it. Only digests are shuffled, never texts, and the proofs themselves are not written.

Defined results: a null column is ``-``, which no value's field looks like; rows that share an id stand in the order of
their leaves, and equal rows are leaves of their own; null ids come first in their group, and are never tampered with; a null
group is a group of its own and the first one; an empty text is ``0:``; very long texts are hashed whole; an empty table
gives no rows; only the named columns are looked at, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.llm.text import bound_batches
from seqforge.session import materialise, ship_package

#: Children of a node, and levels of a block.
FANOUT, HEIGHT = 16, 3
BLOCK = FANOUT**HEIGHT
#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon and value, so that fields can't run into one another."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def height_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


def traverse(digests: list[str], height: int, befores: list[list[str]] | None = None, afters: list[list[str]] | None = None, first: int = 0) -> str:
    """The digest of a subtree, in postorder. Where ``befores`` and ``afters`` are given, each leaf's gets the digests before and
    after its own node in the run of each level, as the recursion unwinds."""
    if height == 0:
        return digests[0]
    width = FANOUT ** (height - 1)
    starts = range(0, len(digests), width)
    children = [traverse(digests[i : i + width], height - 1, befores, afters, first + i) for i in starts]
    if befores is not None:
        for k, i in enumerate(starts):
            before, after = "".join(children[:k]), "".join(children[k + 1 :])
            for at in range(first + i, first + min(i + width, len(digests))):
                befores[at].append(before)
                afters[at].append(after)
    return hashlib.sha256("".join(children).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp and others) with pos, the place in the group by ``order``, and n, the rows of the group; written."""
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("part", F.shiftright("at", 33)), "merkle-dealt")
    runs = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has as many runs as parts of the range partition at most
    starts = runs.select("grp", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("n"))
    return materialise(dealt.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "merkle-nodes")


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos").combine_chunks()


def block_root(block: pa.Table) -> pa.Table:
    block = in_order(block)
    n = block["n"][0].as_py()
    root = traverse(block["digest"].to_pylist(), min(HEIGHT, height_of(n)))
    return pa.table({"grp": block["grp"][:1], "pos": block["block"][:1], "digest": pa.array([root]), "n": pa.array([-(-n // BLOCK)], pa.int64())})


def roots(nodes: DataFrame) -> DataFrame:
    """The blocks' roots, as nodes of the next traversal."""
    return nodes.select("grp", "pos", "digest", "n", block()).groupBy("grp", "block").applyInArrow(block_root, "grp string, pos long, digest string, n long")


def block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long").alias("block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (grp, pos, digest, n) and the block roots above them, level after level, down to one node in each group."""
    ship_package(nodes.sparkSession)
    bound_batches(nodes.sparkSession)
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialise(roots(levels[-1]), "merkle-roots"))
        most = -(-most // BLOCK)
    return levels


def with_siblings(carried: list[str]):
    """A function of a block and what lies above it: the block's nodes with all that is beside and above each."""

    def proofs(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return pa.table({c: nodes[c] for c in carried} | {"root": above["root"][:0], "befores": above["befores"][:0], "afters": above["afters"][:0]})
        nodes = in_order(nodes)
        befores, afters = ([[] for _ in range(nodes.num_rows)] for _ in range(2))
        traverse(nodes["digest"].to_pylist(), min(HEIGHT, height_of(nodes["n"][0].as_py())), befores, afters)
        higher = (above["befores"][0].as_py(), above["afters"][0].as_py())
        lists = [pa.array([x + more for x in own], pa.list_(pa.string())) for own, more in zip((befores, afters), higher, strict=True)]
        root = pa.array([above["root"][0].as_py()] * nodes.num_rows, pa.string())
        return pa.table({c: nodes[c] for c in carried} | {"root": root, "befores": lists[0], "afters": lists[1]})

    return proofs


def descend(levels: list[DataFrame], above: DataFrame, payload: Iterable[str] = ()) -> DataFrame:
    """The lowest nodes of ``levels`` with root, befores and afters; ``above`` has these for the topmost node of each group
    (grp, pos, root, befores, afters)."""
    for depth, nodes in enumerate(reversed(levels[:-1])):
        lowest = depth == len(levels) - 2
        carried = ["grp", "pos", "digest", *(payload if lowest else ())]
        kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in carried)
        schema = f"{kinds}, root string, befores array<string>, afters array<string>"
        left = nodes.select(*carried, "n", block()).groupBy("grp", "block")
        right = above.select("grp", F.col("pos").alias("block"), "root", "befores", "afters").groupBy("grp", "block")
        above = left.cogroup(right).applyInArrow(with_siblings(carried), schema)
        if not lowest:
            above = materialise(above, "merkle-paths")
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", altered: Column | None = None) -> DataFrame:
    """For each row its ``order`` column, leaf, subroot, root, and for each level up to the root befores and afters: the digests in
    its run before and after its own node. ``altered``: a leaf that is carried along, as that of a later state of the row."""
    none = F.array().cast("array<string>")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(key.alias("grp"), F.col(order).alias("id"), leaf(*map(F.col, columns)).alias("digest"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    leaves = numbered(materialise(rows, "merkle-leaves"), ["id", "digest"])
    levels = climb(leaves)
    tops = levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    upper = climb(numbered(tops, ["of"]))
    whole = upper[-1].select("grp", "pos", F.col("digest").alias("root"), none.alias("befores"), none.alias("afters"))
    # a single group's subroot is the root
    groups = whole if len(upper) == 1 else descend(upper, whole, ["of"])
    groups = upper[0].select("of", F.col("digest").alias("root"), none.alias("befores"), none.alias("afters")) if len(upper) == 1 else groups
    subroots = materialise(groups.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "root", "befores", "afters"), "merkle-paths")
    found = subroots.first()
    root = F.lit(found["root"] if found else None).cast("string")
    # of each group, its own topmost digest goes down with the paths
    own = levels[-1].select("grp", F.col("digest").alias("subroot"))
    above = subroots.join(own, "grp").select("grp", "pos", F.col("subroot").alias("root"), "befores", "afters")
    if len(levels) == 1:  # every group has one leaf
        out = leaves.join(above.drop("pos"), "grp")
    else:
        out = descend(levels, above, ["id", "altered"])
    return out.select(F.col("id").alias(order), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), root.alias("root"), "befores", "afters", "altered")


def proof_digest(befores: Column, afters: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(befores, afters, lambda a, b: F.concat(a, b)), ""), 256)


def fold(digest: Column, befores: Column, afters: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(F.arrays_zip(befores.alias("a"), afters.alias("b")), digest, lambda own, x: F.sha2(F.concat(x["a"], own, x["b"]), 256))


def report(docs: DataFrame) -> DataFrame:
    """Every row's place in the manifest, and whether the row still leads to the root after a fifth of the texts was lower-cased."""
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    lowered = F.translate("text", UPPER, LOWER)
    altered = F.when(tampered, leaf(*(lowered if c == "text" else F.col(c) for c in COLUMNS)))
    found = manifest(docs.select(*COLUMNS), altered=altered)
    folded = fold(F.coalesce("altered", "leaf"), F.col("befores"), F.col("afters"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("befores"), F.col("afters")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the SQL's trees: up to 16**LEVELS leaves of a source, and as many sources.
LEVELS = 6


def _tree_sql(name: str, start: str) -> str:
    """Levels of a tree over ``start`` (g, pos, n, d): <name><k>, and <name>s<k> with the digests before and after each node."""
    parts = [f"{name}0 as materialized ({start})"]
    for k in range(LEVELS):
        here, run = f"{name}{k}", "partition by g, pos // 16 order by pos"
        parts.append(f"""{name}s{k} as materialized (select g, pos, n > 1 multiple, case when n > 1 then coalesce(string_agg(d, '') over ({run} rows between unbounded preceding and 1 preceding), '') else '' end a,
  case when n > 1 then coalesce(string_agg(d, '') over ({run} rows between 1 following and unbounded following), '') else '' end b from {here})""")
        parts.append(f"""{name}{k + 1} as materialized (select g, pos // 16 pos, max((n + 15) // 16) n, case when max(n) = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end d from {here} group by g, pos // 16)""")
    return ",\n".join(parts)


def _walk_sql(name: str, g: str, pos: str, number: int) -> tuple[str, str, str]:
    """Joins from a leaf up a tree, the siblings in order, and the folding step by step."""
    joins = " ".join(f"join {name}s{k} {name}x{k} on {name}x{k}.g = {g} and {name}x{k}.pos = {pos} // {16**k}" for k in range(LEVELS))
    siblings = " || ".join(f"{name}x{k}.a || {name}x{k}.b" for k in range(LEVELS))
    steps = "\n".join(f"w{number + k + 1} as (select * replace (case when {name}m{k} then sha256({name}a{k} || cur || {name}b{k}) else cur end as cur) from w{number + k})" + "," for k in range(LEVELS))
    return joins, siblings, steps


def _field_sql(x: str) -> str:
    return f"coalesce(cast(strlen(cast({x} as varchar)) as varchar) || ':' || cast({x} as varchar), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(text if c == 'text' else c) for c in COLUMNS)})"


def _oracle_sql() -> str:
    # the reflected CRC-32 (polynomial 0xEDB88320): a byte is put in, then eight shifts
    crc = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: list_concat([ascii(substr(cast(doc_id as varchar), i, 1))::bigint], list_transform(range(8), lambda j: -1::bigint))))), lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end), 4294967295::bigint)"
    joins, siblings, steps = _walk_sql("t", "l.g", "l.pos", 0)
    joins2, siblings2, steps2 = _walk_sql("u", "'all'", "s.pos", LEVELS)
    kept = ", ".join(f"{n}x{k}.a {n}a{k}, {n}x{k}.b {n}b{k}, {n}x{k}.multiple {n}m{k}" for n in "tu" for k in range(LEVELS))
    return f"""with lf as materialized (select doc_id, coalesce('=' || source, '') g, {_leaf_sql('text')} d, case when coalesce({crc} % 5 = 0, false) then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} end altered from documents),
l as materialized (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 pos, count(*) over (partition by g) n from lf),
{_tree_sql('t', 'select g, pos, n, d from l')},
s as materialized (select g, d, row_number() over (order by g) - 1 pos, count(*) over () n from t{LEVELS}),
{_tree_sql('u', "select 'all' g, pos, n, d from s")},
w0 as (select l.doc_id, l.d leaf, s.d subroot, (select d from u{LEVELS}) root, sha256({siblings} || {siblings2}) proof_sha256, coalesce(l.altered, l.d) cur, {kept} from l join s on s.g = l.g {joins} {joins2}),
{steps}
{steps2.rstrip(',')}
select doc_id, leaf, subroot, root, proof_sha256, cur folded_root, cur = root verified from w{2 * LEVELS}"""


ORACLE_SQL = _oracle_sql()

"""A Merkle manifest of a table: leaves by group, subroots, one root, a proof for each leaf.

Within a group, nodes in order are hashed by runs of up to 16 until one is left;
the groups' last nodes are hashed to the root the same way.

A leaf's proof needs the siblings on each level. All children of a node share
their sibling list, so the list is kept once, with the node, and a child is a
slot in it. Every node holds a segment of such lists towards an ancestor, at
first its own list towards its parent. Joining the nodes with themselves
appends the ancestor's segment and doubles the distance, until all reach the
root; each leaf then joins its parent's segment. Segments are held by a
sixteenth of the rows.

Order is global: rows are range-partitioned and sorted once, and a row's place is
its number in its partition behind the rows of the partitions before. A node thus
covers a range of places. An ancestor near the root is asked for by the whole
table, so the join key also holds the place in units of ``SPREAD``, and an
ancestor is listed once for each unit it covers: no key meets more than
``SPREAD`` leaves' worth of nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.ranks import placed
from annalist.session import cut_lineage

ARITY, BITS, DIGEST = 16, 4, 64
SPREAD = 1 << 16
#: The tree of the groups' last nodes.
TOP = -1


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The leaf of a row: lowercase hex SHA-256 of its encoded values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _climbed(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (tree, level 0, ix, ``of``: nodes of that level in the tree,
    lo, hi, digest) the inner nodes by level, with their children's digests
    joined to one text, and the last node of each tree. ``most`` is the greatest
    ``of``."""
    inner, tops, level, here = [], [nodes.where("of = 1").select("tree", "lo", "hi", "digest")], 0, nodes
    while most > 1:
        level, most = level + 1, -(-most // ARITY)
        runs = here.where("of > 1").groupBy("tree", F.shiftright("ix", BITS).alias("ix")).agg(
            F.max("of").alias("below"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "digest"))), lambda x: x["digest"]), "").alias("children"),
        )
        here = cut_lineage(
            runs.select(
                "tree", F.lit(level).alias("level"), "ix", F.expr(f"(below + {ARITY - 1}) div {ARITY}").alias("of"), "lo", "hi", "children",
                F.sha2("children", 256).alias("digest"),
            )
        )
        inner.append(here)
        tops.append(here.where("of = 1").select("tree", "lo", "hi", "digest"))
    last = tops[0]
    for more in tops[1:]:
        last = last.unionByName(more)
    return inner, last


def _pointed(nodes: DataFrame, groups: int) -> DataFrame:
    """Inner nodes with their parents (``to_tree``, ``to_level``, ``to_ix``; null
    at the root) and segments: lists, digests and slots from the node on."""
    inside, above = F.col("of") > 1, F.lit(groups > 1) & (F.col("tree") != TOP)
    position = F.when(inside, F.col("ix")).when(above, F.col("tree"))
    return nodes.select(
        "tree", "level", "ix", "lo", "hi",
        F.when(inside, F.col("tree")).when(above, F.lit(TOP)).alias("to_tree"),
        F.when(inside, F.col("level") + 1).when(above, F.lit(1)).alias("to_level"),
        F.shiftright(position, BITS).alias("to_ix"),
        F.array("children").alias("lists"),
        F.array("digest").alias("digests"),
        F.array(position.bitwiseAND(ARITY - 1).cast("int")).alias("slots"),
    )


def _doubled(nodes: DataFrame) -> DataFrame:
    """Each node's segment with that of the ancestor it ends at."""
    unit = lambda c: F.expr(f"{c} div {SPREAD}")
    asked = nodes.withColumn("unit", unit("lo"))
    given = nodes.select(
        F.col("tree").alias("g_tree"), F.col("level").alias("g_level"), F.col("ix").alias("g_ix"),
        F.explode(F.sequence(unit("lo"), unit("(hi - 1)"))).alias("g_unit"),
        F.col("to_tree").alias("g_to_tree"), F.col("to_level").alias("g_to_level"), F.col("to_ix").alias("g_to_ix"),
        F.col("lists").alias("g_lists"), F.col("digests").alias("g_digests"), F.col("slots").alias("g_slots"),
    )
    met = [F.col(a) == F.col(b) for a, b in (("to_tree", "g_tree"), ("to_level", "g_level"), ("to_ix", "g_ix"), ("unit", "g_unit"))]
    longer = asked.where("to_tree is not null").join(given, met[0] & met[1] & met[2] & met[3])
    both = lambda c: F.concat(c, f"g_{c}").alias(c)
    grown = longer.select("tree", "level", "ix", "lo", "hi", *[F.col(f"g_to_{c}").alias(f"to_{c}") for c in ("tree", "level", "ix")], both("lists"), both("digests"), both("slots"))
    return cut_lineage(grown.unionByName(nodes.where("to_tree is null")))


def _at_slot(children: Column, slot: Column) -> tuple[Column, Column]:
    return F.substring(children, 1, F.lit(DIGEST) * slot), F.substring(children, F.lit(DIGEST) * slot + (DIGEST + 1), F.lit(DIGEST * ARITY))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def manifest(rows: DataFrame, leaf: str, identity: str = "doc_id", group: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """(identity, leaf, ``subroot``, ``root``, ``proof``, carried columns) of each row.

    ``leaf`` names the column with the row's digest; leaves ascend by identity
    within a group (null first, ties by digest), groups by their text's bytes
    (null is a group and comes first). ``proof`` lists from the leaf to the root
    the digests ``before`` and ``after`` the node among its siblings, each joined
    to one text; a node without siblings has a step with two empty texts.

    A null digest raises. Repeated rows are leaves of their own. A group of one
    row has its leaf as subroot, a table of one group has its subroot as root; an
    empty table gives no rows. Columns that are not named are left out; named ones
    may not be called subroot, root or proof, nor begin with two underscores.
    """
    names = [identity, leaf, *carry]
    if {"subroot", "root", "proof"} & set(names) or any(c.startswith("__") for c in names) or len(set(names)) < len(names):
        raise ValueError("identity, leaf and carried columns must differ and not be named like a result")
    given = rows.select(
        F.col(group).cast("string").alias("__group"), F.col(identity).alias("__id"),
        F.coalesce(F.col(leaf), F.raise_error(F.lit("a leaf's digest is null"))).alias("__leaf"),
        *[F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry)],
    )
    leaves = placed(cut_lineage(given), ["__group", "__id", "__leaf"], "__place")
    counted = leaves.groupBy("__group").agg(F.count(F.lit(1)).alias("of"), F.min("__place").alias("start"))
    groups = cut_lineage(placed(counted, ["start"], "tree").select("__group", "tree", "of", "start"))
    sizes = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("of"), F.lit(0)).alias("most")).first()
    unit = lambda c: F.expr(f"{c} div {SPREAD}")
    covering = groups.select("tree", "of", "start", F.col("__group").alias("__of_group"), F.explode(F.sequence(unit("start"), unit("(start + of - 1)"))).alias("__of_unit"))
    leaves = cut_lineage(
        leaves.withColumn("__unit", unit("__place"))
        .join(covering, F.col("__group").eqNullSafe(F.col("__of_group")) & (F.col("__unit") == F.col("__of_unit")))
        .select("__id", "__leaf", *[f"__carry_{k}" for k in range(len(carry))], "tree", "of", (F.col("__place") - F.col("start")).alias("ix"), "__place")
    )
    whole = leaves.select("tree", "ix", "of", F.col("__place").alias("lo"), (F.col("__place") + 1).alias("hi"), F.col("__leaf").alias("digest"))
    inner, subroots = _climbed(whole, sizes["most"])
    above, _ = _climbed(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("ix"), F.lit(sizes["groups"]).alias("of"), "lo", "hi", "digest"), sizes["groups"])
    alone = F.col("of") == 1
    first = leaves.withColumn("__tree", F.when(alone, F.lit(TOP)).otherwise(F.col("tree"))).withColumn("__ix", F.when(alone, F.col("tree")).otherwise(F.col("ix")))
    empty = F.array().cast("array<string>")
    if inner or above:
        nodes = None
        for level in inner + above:
            nodes = _pointed(level, sizes["groups"]) if nodes is None else nodes.unionByName(_pointed(level, sizes["groups"]))
        reach = 1
        while reach < len(inner) + len(above):
            nodes, reach = _doubled(nodes), reach * 2
        parents = nodes.where("level = 1").select(F.col("tree").alias("__p_tree"), F.col("ix").alias("__p_ix"), "lists", "digests", "slots")
        first = first.join(parents, (F.col("__tree") == F.col("__p_tree")) & (F.shiftright("__ix", BITS) == F.col("__p_ix")), "left")
        first = first.select("*", F.coalesce("lists", empty).alias("__lists"), F.coalesce("digests", empty).alias("__digests"))
        own = F.concat(F.array(F.col("__ix").bitwiseAND(ARITY - 1).cast("int")), F.coalesce("slots", F.array().cast("array<int>")))
    else:
        first = first.select("*", empty.alias("__lists"), empty.alias("__digests"))
        own = F.array(F.lit(0))

    def step(children: Column, slot: Column) -> Column:
        before, after = _at_slot(children, slot)
        return F.struct(before.alias("before"), after.alias("after"))

    proof = F.zip_with("__lists", F.slice(own, F.lit(1), F.size("__lists")), step)
    depth = F.size(F.filter(F.lit([ARITY**k for k in range(15)]), lambda reached: reached < F.col("of")))
    return first.select(
        F.col("__id").alias(identity),
        F.col("__leaf").alias(leaf),
        F.coalesce(F.get("__digests", depth - 1), F.col("__leaf")).alias("subroot"),
        F.coalesce(F.get("__digests", F.size("__digests") - 1), F.col("__leaf")).alias("root"),
        proof.alias("proof"),
        *[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(carry)],
    )

"""A Merkle manifest of a table: a hash tree over the rows of each group, a tree over the groups' roots, and a proof for every row.

H is the sha256 of its inputs' concatenation; digests are hex text. A row's leaf is H of its fields; a group's leaves ascend by their id, and while a group has
several nodes, each 16 following ones become their H. The groups' roots, in the order of the groups' names, are the leaves of the last tree.

* ``build`` goes bottom up: a level is a table (group, position, digest, children); each is one group-by of at most 16 rows a key, and is written to the shared folder.
* ``push_proofs`` goes top down: a level's children join their parents, and each prepends its siblings to the proof that its parent inherited.
  Leaves take theirs last and aren't written with them, as a proof is longer than many a document.
* ``fold`` recomputes the root from a leaf and its proof; a proof has, for each level, what stands left and right of the node in its run.

Ranks come from a range partitioning and row counts of (partition, group), so that a group of any size is spread evenly, also where a third of all rows are equal. All is DataFrame
functions.

Defined cases: a null field is hashed as ``-``. Null groups come first, null ids come first in their group, repeated ids are ordered by their leaves (equal leaves are interchangeable, and have
proofs of their own). A group of one row has its leaf as root. An empty table has no rows and no root. Columns that aren't named are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, own, width

FAN = 16
HEX = 64
PROOF = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each as its length in bytes, a colon and its value, or ``-``."""
    text = [f.cast("string") for f in fields]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def group_key(c: Column) -> Column:
    """A text that is never null and sorts as the group does: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place in their ``grp`` by ``order``, and ``m``, the group's size. Sorted rows and the runs of each group and part are written;
    what joins them has the size of the smaller one known, so that Spark broadcasts it only below its threshold."""
    n = width(rows.sparkSession)
    at = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order)
    placed = materialise(sorted_.select("*", at.alias("at"), F.shiftright(at, 33).alias("part")), f"{name}-sorted")
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_group = F.struct("part", "n", "first")
    # runs of a group: one for each part at most
    groups = runs.groupBy("grp").agg(F.array_sort(F.collect_list(of_group)).alias("runs"), F.sum("n").alias("m"))
    earlier = F.aggregate(F.filter("runs", lambda r: r["part"] < F.col("run.part")), F.lit(0).cast("long"), lambda s, r: s + r["n"])
    runs = groups.select("grp", "m", "runs", F.explode("runs").alias("run")).select("grp", "m", F.col("run.part").alias("part"), (earlier - F.col("run.first")).alias("shift"))
    runs = materialise(runs, f"{name}-runs", small=True)
    return placed.join(runs, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _upper(level: DataFrame) -> DataFrame:
    """The next level: a row for each run of FAN nodes of groups that have several; ``m`` is its group's number of nodes."""
    up = level.where("m > 1").groupBy("grp", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("m") / FAN).alias("m"))
    children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda c: c["digest"])
    return up.agg(F.array_join(children, "").alias("children")).withColumn("digest", F.sha2("children", 256))


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Levels above ``leaves`` (``grp``, ``pos``, ``m``, ``digest``), bottom up, each written. ``children`` has the run's digests end to end."""
    levels, now = [], leaves
    most = leaves.agg(F.max("m")).first()[0] or 0
    while most > 1:
        now = materialise(_upper(now), f"{name}-level", small=name == "groups")
        levels.append(now)
        most = -(-most // FAN)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``grp`` and its ``root``."""
    tops = leaves.where("m = 1").select("grp", F.col("digest").alias("root"))
    for level in levels:
        tops = tops.unionByName(level.where("m = 1").select("grp", F.col("digest").alias("root")))
    return tops


def _siblings(children: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(F.substring(children, F.lit(1), place * HEX).alias("left"), F.substr(children, (place + 1) * HEX + 1).alias("right"))


def _pushed(child: DataFrame, parents: DataFrame, tops: DataFrame) -> DataFrame:
    """Children with ``proof`` and what else ``tops`` gives each group: by their parent, or as the top of their group."""
    further = [c for c in parents.columns if c not in ("grp", "pos", "m", "digest", "children", "proof")]
    up = parents.select("grp", F.col("pos").alias("parent"), F.col("children").alias("run"), F.col("proof").alias("inherited"), *further)
    below = child.where("m > 1").withColumn("parent", F.floor(F.col("pos") / FAN)).join(up, ["grp", "parent"])
    own_proof = F.concat(F.array(_siblings(F.col("run"), (F.col("pos") % FAN).cast("int"))), "inherited")
    below = below.select(*child.columns, *further, own_proof.cast(PROOF).alias("proof"))
    return below.unionByName(child.where("m = 1").join(tops, "grp").select(*child.columns, *further, "proof"))


def push_proofs(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """``leaves`` with their ``proof`` and the further columns of ``tops``, which has ``grp`` and the ``proof`` of each group's root.

    Each level but the leaves' is written before its children join it."""
    tops = materialise(tops, f"{name}-tops", small=True)
    further = [c for c in tops.columns if c != "grp"]
    above = None
    for level in reversed(levels):
        if above is None:
            pushed = level.join(tops, "grp").select(*level.columns, *further)
        else:
            pushed = _pushed(level, above, tops)
        above = materialise(pushed, f"{name}-proofs", small=name == "groups")
    if above is None:
        return leaves.join(tops, "grp").select(*leaves.columns, *further)
    return _pushed(leaves, above, tops)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda digest, step: hashed(step["left"], digest, step["right"]))


@dataclass
class Manifest:
    """``rows``: what was kept of each row, with ``grp``, ``pos``, ``m`` and its ``digest``; the levels of the groups' trees; the tree over the groups."""

    rows: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    group_levels: list[DataFrame]

    def proofs(self) -> DataFrame:
        """``rows`` with ``subroot``, ``root`` and ``proof``."""
        spark = self.rows.sparkSession
        none = F.array().cast(PROOF)
        root = roots(self.groups, self.group_levels).select("grp", F.col("root"), none.alias("proof"))
        tops = push_proofs(self.groups, self.group_levels, root, "groups")
        tops = tops.select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "root", "proof")
        return push_proofs(self.rows, self.levels, tops, "rows").drop("grp", "pos", "m")


def manifest(docs: DataFrame, fields: list[Column], id_col: str, group_col: str, keep: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``docs``, whose leaves hash ``fields``. ``keep`` names further values that stay beside each leaf."""
    kept = {k: c for k, c in (keep or {}).items()}
    base = docs.select(F.monotonically_increasing_id().alias("tie"), group_key(own(group_col)).alias("grp"), own(id_col).alias("id"), leaf_digest(fields).alias("digest"), *(c.alias(k) for k, c in kept.items()))
    base = materialise(base, "leaves")  # texts are read once; ties have a fixed order from here on
    rows = ranked(base, ["id", "digest", "tie"], "leaves").drop("tie")
    levels = build(rows, "rows")
    named = roots(rows, levels).select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest"))
    groups = ranked(named, ["key"], "groups")
    return Manifest(rows, levels, groups, build(groups, "groups"))


TEXT_UPPER, TEXT_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def proof_digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by source, each row's proof, and whether a changed copy of a fifth of the rows still verifies.

    Rows whose id's crc32 is a multiple of five are folded with A-Z of their text lower-cased; a row without id isn't."""
    def columns(text):
        return [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]

    changed = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(changed, leaf_digest(columns(F.translate("text", TEXT_UPPER, TEXT_LOWER))))
    made = manifest(docs.withColumn("doc_id", F.col("doc_id").cast("long")), columns(F.col("text")), "doc_id", "source", {"tampered": tampered})
    found = made.proofs()
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("tampered", "digest"), F.col("proof"))
    out = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL has for a source's rows and for the sources: 16**5 rows a source and 16**3 sources.
SQL_LEVELS = 5
SQL_GROUP_LEVELS = 3


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of the levels above ``{name}0`` (grp, pos, m, digest), and the roots of its groups."""
    up = [
        f"{name}{k} AS (SELECT grp, pos // {FAN} AS pos, (m + {FAN - 1}) // {FAN} AS m, string_agg(digest, '' ORDER BY pos) AS children, "
        f"sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k - 1} WHERE m > 1 GROUP BY 1, 2, 3)"
        for k in range(1, levels + 1)
    ]
    tops = " UNION ALL ".join(f"SELECT grp, digest FROM {name}{k} WHERE m = 1" for k in range(levels + 1))
    return ", ".join([*up, f"{name}_top AS ({tops})"])


def _path_sql(start: str, name: str, levels: int, grp: str, pos: str) -> str:
    """CTEs ``{start}_{name}1`` ...: ``siblings`` and ``folded`` of the rows of ``start`` carried up the levels of a tree."""
    out, before = [], start
    for k in range(1, levels + 1):
        place = f"(d.{pos} // {FAN ** (k - 1)} % {FAN})::INTEGER * {HEX}"
        left, right = f"substr(p.children, 1, {place})", f"substr(p.children, {place} + {HEX + 1})"
        out.append(
            f"{start}_{name}{k} AS (SELECT d.* EXCLUDE (siblings, folded), siblings || coalesce({left} || {right}, '') AS siblings, CASE WHEN p.grp IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
            f"FROM {before} d LEFT JOIN {name}{k} p ON p.grp = d.{grp} AND p.pos = d.{pos} // {FAN**k})"
        )
        before = f"{start}_{name}{k}"
    return ", ".join(out)


def _sql() -> str:
    """The same in SQL: a fixed number of levels written out, and each fold carried up level by level."""

    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295)"
    lowered = f"translate(text, '{TEXT_UPPER}', '{TEXT_LOWER}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '') AS grp, {leaf("text")} AS digest, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents),
r0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS m FROM d),
{_tree_sql("r", SQL_LEVELS)},
g0 AS (SELECT '' AS grp, grp AS key, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS m FROM r_top),
{_tree_sql("g", SQL_GROUP_LEVELS)},
s AS (SELECT r0.*, g0.grp AS all_groups, g0.pos AS group_pos, g0.digest AS subroot, g_top.digest AS root, '' AS siblings, coalesce(tampered, r0.digest) AS folded FROM r0 JOIN g0 ON g0.key = r0.grp, g_top),
{_path_sql("s", "r", SQL_LEVELS, "grp", "pos")},
t AS (SELECT * FROM s_r{SQL_LEVELS}),
{_path_sql("t", "g", SQL_GROUP_LEVELS, "all_groups", "group_pos")}
SELECT doc_id, digest AS leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM t_g{SQL_GROUP_LEVELS}"""


ORACLE_SQL = _sql()

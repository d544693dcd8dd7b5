"""Merkle manifest of a dataset, with a proof of every row (operator 12).

Each row is a leaf: the SHA-256 of its fields, each ``-`` if null and else its
length in bytes, a colon and its value. The leaves of a group stand in order;
neighbours are hashed two by two (a last one alone) until one is left, the
group's subroot; subroots, in order of their groups, make the root likewise.

The manifest keeps for every parent its preimage: the digests of its children one
after another. Levels are built ``LEVELS`` at a time, where a block of
2 ** LEVELS neighbours makes one row, and the tops of blocks are the next
blocks' members; so a group of any size is many small rows, and ten billion
leaves take four steps. A leaf's proof is joined the other way, from the top
down: a block joins the path of its top once, and its members take the preimages
of their own ancestors in it. From a preimage the 64 characters of one's own slot
are excised, and what is left is the sibling; with another digest in that slot it
is the preimage of the folded path.

Nulls in any field, and a null group, have their own codes and places (first). A
null id is a leaf like others. Equal ids go by their leaf; repeated rows are
repeated leaves. The empty table has no root and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .ranks import positions

LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    v = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def _parents(level: Column) -> Column:
    """The preimages of a level's parents: two digests each, the last perhaps one."""
    last = F.floor((F.size(level) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, block, members, preimages, top, n) of nodes (g, i, n, digest, extra).

    ``n`` is the number of nodes, and then of blocks, of the group; ``preimages``
    has an array for each level above the members."""
    size = 1 << levels
    own = nodes.groupBy("g", F.expr(f"i div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "extra"))).alias("members"), F.first("n").alias("n"))
    own = own.withColumn("__0", F.transform("members", lambda x: x["digest"]))
    for k in range(levels):
        # a group of one block ends when one node is left; the blocks of larger ones rise alike
        more = (F.size(f"__{k}") > 1) | (F.col("n") > size)
        own = own.withColumn(f"__p{k}", F.when(more, _parents(F.col(f"__{k}"))))
        own = own.withColumn(f"__{k + 1}", F.coalesce(F.transform(f"__p{k}", lambda p: F.sha2(p, 256)), F.col(f"__{k}")))
    made = F.filter(F.array(*[f"__p{k}" for k in range(levels)]), lambda p: p.isNotNull())
    return own.select("g", "block", "members", made.alias("preimages"), F.get(f"__{levels}", F.lit(0)).alias("top"), F.expr(f"(n + {size - 1}) div {size}").alias("n"))


_PATH = "array<struct<slot: int, preimage: string>>"


class Tree:
    """The trees of all groups of ``nodes`` (g, i, digest, extra), numbered from
    0 in their group, and null being a group."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, levels: int = LEVELS):
        self.levels = levels
        counts = nodes.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        level = nodes.join(counts, F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
        self.steps: list[DataFrame] = []
        while True:
            b = scratch.save(blocks(level, levels))
            self.steps.append(b)
            if most <= 1 << levels:
                break
            most = -(-most // (1 << levels))
            level = b.select("g", F.col("block").alias("i"), "n", F.col("top").alias("digest"), F.lit(None).cast("int").alias("extra"))

    def tops(self) -> DataFrame:
        """(g, top): the one node that is left of each group."""
        return self.steps[-1].select("g", "top")

    def preimages(self) -> DataFrame:
        """(g, level, parent, preimage): the manifest, level 1 above the leaves."""
        out = None
        for k, b in enumerate(self.steps):
            one = b.select("g", "block", F.posexplode("preimages").alias("__l", "__p")).select("g", "block", "__l", F.posexplode("__p").alias("__j", "preimage"))
            one = one.select("g", (F.col("__l") + k * self.levels + 1).alias("level"), F.expr(f"block * shiftleft(1L, {self.levels - 1} - __l) + __j").alias("parent"), "preimage")
            out = one if out is None else out.unionByName(one)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(g, i, digest, extra, path): (slot, preimage) from each node's parent
        up, and on with the path that ``above`` (g, path) gives its group."""
        up = above.select(F.col("g").alias("__g"), F.lit(0).cast("long").alias("__i"), F.col("path").alias("__up"))
        for b in reversed(self.steps):
            joined = b.join(up, F.col("g").eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__i")))

            def own(j: Column) -> Column:
                right = lambda k: F.call_function("shiftright", j, k)
                return F.transform("preimages", lambda p, k: F.struct(right(k).bitwiseAND(F.lit(1)).alias("slot"), F.get(p, right(k + 1)).alias("preimage")))

            # a block's rows are made at once, so that its preimages aren't copied for every member
            each = F.transform("members", lambda m, j: F.struct(m["i"].alias("i"), m["digest"].alias("digest"), m["extra"].alias("extra"), F.concat(own(j), F.col("__up")).cast(_PATH).alias("path")))
            found = joined.select("g", F.inline(each))
            up = found.select(F.col("g").alias("__g"), F.col("i").alias("__i"), F.col("path").alias("__up"))
        return found


def siblings(path: Column) -> Column:
    """What is left of the preimages without one's own slots, level by level."""
    return F.array_join(F.transform(path, lambda x: F.when(x["slot"] == 0, F.substring(x["preimage"], 65, 64)).otherwise(F.substring(x["preimage"], 1, 64))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives in its place: each digest spliced into its parent's preimage."""
    return F.aggregate(path, leaf, lambda d, x: F.sha2(F.when(x["slot"] == 0, F.concat(d, F.substring(x["preimage"], 65, 64))).otherwise(F.concat(F.substring(x["preimage"], 1, 64), d)), 256))


def manifest(leaves: DataFrame, scratch: Scratch, levels: int = LEVELS) -> tuple[Tree, Tree]:
    """The trees of groups and the tree of their subroots. ``leaves`` are (g, id, leaf, extra)."""
    placed = positions(leaves, ["g"], ["id", "leaf"], "i", scratch)
    trees = Tree(placed.select("g", "i", F.col("leaf").alias("digest"), "extra"), scratch, levels)
    tops = positions(trees.tops().withColumn("__all", F.lit(0)), ["__all"], ["g"], "i", scratch)
    return trees, Tree(tops.select(F.lit(0).alias("g"), "i", F.col("top").alias("digest"), F.struct("g").alias("extra")), scratch, levels)


def prove(leaves: DataFrame, spark: SparkSession, levels: int = LEVELS) -> DataFrame:
    """(g, leaf, extra, subroot, root, path) of each of ``leaves`` (g, id, leaf, extra)."""
    scratch = Scratch(spark)
    trees, top = manifest(leaves, scratch, levels)
    one = top.paths(spark.range(1).select(F.lit(0).alias("g"), F.expr(f"cast(array() as {_PATH})").alias("path")))
    root = top.tops().select(F.lit(True).alias("__any"), F.col("top").alias("root"))  # one row
    groups = one.select(F.lit(True).alias("__any"), F.col("extra")["g"].alias("__group"), F.col("digest").alias("subroot"), "path").join(F.broadcast(root), "__any").drop("__any")
    groups = scratch.save(groups)
    found = trees.paths(groups.select(F.col("__group").alias("g"), "path"))
    out = found.join(groups.drop("path"), F.col("g").eqNullSafe(F.col("__group"))).select("g", F.col("digest").alias("leaf"), "extra", "subroot", "root", "path")
    return scratch.release(out)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    extra = F.struct("doc_id", F.when(chosen & F.col("n_chars").isNotNull(), leaf_of(tampered)).alias("tampered")).alias("extra")
    rows = prove(docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), leaf_of(fields).alias("leaf"), extra), spark)
    given = F.coalesce(F.col("extra")["tampered"], F.col("leaf"))
    rows = rows.select(F.col("extra")["doc_id"].alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(given, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


# DuckDB has no crc32, so the SQL folds both leaves of every row; the bitwise form of the checksum picks one
OP12_SQL = f"""
WITH RECURSIVE table_ AS (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)),
steps AS (SELECT list(c ORDER BY i) AS t FROM table_),
docs AS (SELECT row_number() OVER () AS r, doc_id, lang, {_sql_leaf('n_chars')} AS leaf, {_sql_leaf('(n_chars + 1)')} AS other, CAST(doc_id AS VARCHAR) AS id FROM documents),
sums AS (SELECT r, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(id[k]) AS BIGINT) FOR k IN range(1, len(id) + 1)]), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM docs, steps WHERE id IS NOT NULL),
leaves AS (SELECT docs.r, doc_id, lang, leaf, CASE WHEN coalesce(crc % 7 = 0, false) THEN other ELSE leaf END AS given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs LEFT JOIN sums USING (r)),
nodes AS (
  SELECT lang, 0 AS lvl, i, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, max(lvl) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, i // 2),
depth AS (SELECT lang, max(lvl) AS deep FROM nodes GROUP BY lang),
subs AS (SELECT n.lang, deep, h AS subroot, row_number() OVER (ORDER BY encode(n.lang) NULLS FIRST) - 1 AS i FROM nodes n JOIN depth d ON n.lang IS NOT DISTINCT FROM d.lang AND lvl = deep),
tops AS (
  SELECT 0 AS lvl, i, subroot AS h FROM subs
  UNION ALL
  SELECT max(lvl) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY i // 2),
high AS (SELECT max(lvl) AS deep FROM tops),
near AS (SELECT r, k AS lvl, (l.i >> k) & 1 AS slot, coalesce(n.h, '') AS h FROM (SELECT r, lang, i, unnest(range(deep)) AS k FROM leaves JOIN depth d USING (lang)
           UNION ALL SELECT r, l.lang, i, unnest(range(deep)) FROM leaves l JOIN depth d ON l.lang IS NULL AND d.lang IS NULL) l
         LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.lvl = k AND n.i = xor(l.i >> k, 1)),
far AS (SELECT lang, 1000 + k AS lvl, (s.i >> k) & 1 AS slot, coalesce(t.h, '') AS h FROM (SELECT subs.lang, i, unnest(range(high.deep)) AS k FROM subs, high) s LEFT JOIN tops t ON t.lvl = k AND t.i = xor(s.i >> k, 1)),
steps_up AS (SELECT r, lvl, slot, h FROM near UNION ALL SELECT r, lvl, slot, h FROM leaves l JOIN far f ON l.lang IS NOT DISTINCT FROM f.lang),
paths AS (SELECT r, string_agg(h, '' ORDER BY lvl) AS proof, list(slot || h ORDER BY lvl) AS path FROM steps_up GROUP BY r),
done AS (SELECT doc_id, leaf, subroot, (SELECT h FROM tops, high WHERE lvl = deep) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(given, coalesce(path, [])), lambda d, x: sha256(CASE WHEN x[1] = '0' THEN d || x[2:] ELSE x[2:] || d END)) AS folded_root
  FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (r))
SELECT *, folded_root = root AS verified FROM done
"""

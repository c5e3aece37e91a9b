"""A Merkle manifest of a table: a tree of digests per source, a tree over the sources' roots, and a proof for every row.

H is SHA-256 in lowercase hex over the concatenated inputs, digests as their hex text. A row's leaf is H of doc_id, source, lang, n_chars and text, each
``-`` if null, else its UTF-8 byte count, a colon and its value. In a source leaves ascend by doc_id (null first; rows of one doc_id by their leaf, so equal
rows stand together). While a level has several nodes, every FAN consecutive ones (fewer in the last run, even one) become their H. A lone leaf is its
source's subroot; the subroots, ordered by source (null first, by UTF-8 bytes), form the root in the same way.

The sums are taken over an associative monoid of sparse forests. A fragment holds unresolved nodes keyed by tree, level and index. As the number of leaves
of each tree is known, so is the arity of each run; the product of two fragments is their union, with every run that is now complete replaced by its
parent. The leaves are range-partitioned by source, doc_id and leaf, so a partition's fragment keeps only some nodes per level at its two ends, however hot a
source is. The tree reduction then merges MERGED fragments at a time, a grouped job a round, and each round's nodes are written to the shared folder,
since proofs need them and all of them together would outgrow the driver: nothing but the number of rows and of sources reaches it. For the proofs each partition rebuilds its own
part of the forest and gets the few nodes from beyond its ends by a join.

An empty table has no rows and no root. Null texts and columns are leaves like others; extra columns are ignored. Repeated rows are leaves of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import remainder
from .shared import written

FAN = 16
#: Leaves of a partition, and fragments merged at a time.
LEAVES, MERGED = 100_000, 16
#: The tree over the sources; the tree of a source is the source's rank.
TOP = -1
_NODE = "grp long, tree long, level int, at long, size long, digest binary, made boolean, open boolean"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed) as binary digests; changed is the leaf of the tampered row, null if the row isn't tampered."""
    doc_id, source, lang, n_chars, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang"), F.col("n_chars"), F.col("text").cast("string")
    changed = F.when(remainder("doc_id", 5) == 0, leaf(doc_id, source, lang, n_chars, lowered(text)))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), F.unhex(leaf(doc_id, source, lang, n_chars, text)).alias("leaf"), F.unhex(changed).alias("changed"))


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree with so many leaves."""
    return -(-size // FAN**level)


def _hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def settle(nodes: dict, sizes: dict) -> tuple[dict, dict]:
    """The fragment of these nodes, {(tree, level, index): hex digest}, and the nodes made on the way. ``sizes`` has the leaves of each tree."""
    left, made, waves = {}, {}, {False: defaultdict(lambda: defaultdict(dict)), True: defaultdict(lambda: defaultdict(dict))}
    for (tree, level, at), digest in nodes.items():
        waves[tree == TOP][level][tree, at // FAN][at] = digest
    for top in (False, True):
        level = 0
        while level <= max(waves[top], default=-1):
            for (tree, run), kids in waves[top].get(level, {}).items():
                wide = width(sizes[tree], level)
                if wide == 1 and not top:
                    made[TOP, 0, tree] = waves[True][0][TOP, tree // FAN][tree] = kids[0]
                elif wide > 1 and len(kids) == min(FAN, wide - run * FAN):
                    made[tree, level + 1, run] = waves[top][level + 1][tree, run // FAN][run] = _hash([kids[k] for k in sorted(kids)])
                else:
                    left.update({(tree, level, at): digest for at, digest in kids.items()})
            level += 1
    return left, made


def _rows(group: int, left: dict, made: dict, known: dict, sizes: dict) -> pd.DataFrame:
    """The nodes made and the open ones; ``known`` are those that an earlier round has written."""
    keys = list(made) + [k for k in left if k not in made]
    return pd.DataFrame({
        "grp": group, "tree": [k[0] for k in keys], "level": [k[1] for k in keys], "at": [k[2] for k in keys], "size": [sizes[k[0]] for k in keys],
        "digest": [bytes.fromhex((made.get(k) or left[k]).decode()) for k in keys], "made": [k not in known for k in keys], "open": [k in left for k in keys],
    })


def _local(rows: pd.DataFrame, spans: pd.DataFrame, sources: int) -> tuple[dict, dict, list]:
    """A partition's leaf nodes, the sizes of its trees, and (tree, first index, rows from, rows to) for each of its sources, rows by position."""
    nodes, sizes, parts, digests, start = {}, {TOP: sources}, [], rows["leaf"].tolist(), 0
    for tree, before, n, size in sorted(zip(spans["tree"].tolist(), spans["before"].tolist(), spans["n"].tolist(), spans["size"].tolist())):
        sizes[tree] = size
        nodes.update({(tree, 0, before + k): digests[start + k].hex().encode() for k in range(n)})
        parts.append((tree, before, start, start + n))
        start += n
    return nodes, sizes, parts


def _wanted(spans: pd.DataFrame, sources: int) -> list[tuple]:
    """The nodes that a partition's proofs need and its own fragment doesn't make: those beyond its ends, and the root."""
    mine = sorted(zip(spans["tree"].tolist(), spans["before"].tolist(), spans["n"].tolist(), spans["size"].tolist()))
    whole = [tree for tree, before, n, size in mine if n == size]
    trees = [(tree, before, before + n, before, before + n, size) for tree, before, n, size in mine if n < size]
    trees.append((TOP, mine[0][0], mine[-1][0] + 1, whole[0] if whole else 0, whole[-1] + 1 if whole else 0, sources))
    out = []
    for tree, start, end, low, high, size in trees:
        level = 0
        while (wide := width(size, level)) > 1:
            first, last = start // FAN ** (level + 1), (end - 1) // FAN ** (level + 1)
            for run in {first, last}:
                out += [(tree, level, at) for at in range(run * FAN, min(wide, run * FAN + FAN)) if not low <= at < high]
            low, high, level = -(-low // FAN), -(-high // FAN) if high == wide else high // FAN, level + 1
        if tree == TOP:
            out.append((TOP, level, 0))
    return out


class Manifest(NamedTuple):
    """``ordered``: leaves with partition and position; ``spans``: each source's part of each partition; ``nodes``: (tree, level, at, digest); ``sources``: how many."""

    ordered: DataFrame
    spans: DataFrame
    nodes: DataFrame
    sources: int

    def sources_table(self) -> DataFrame:
        """(source, n, subroot) of each source."""
        trees = self.spans.groupBy("tree").agg(F.first("source").alias("source"), F.first("size").alias("n"))
        roots = self.nodes.where((F.col("tree") == TOP) & (F.col("level") == 0)).select(F.col("at").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
        return trees.join(roots, "tree").select("source", "n", "subroot")

    def root(self) -> str | None:
        """The digest of the whole table."""
        row = self.nodes.where(F.col("tree") == TOP).orderBy(F.desc("level")).select(F.lower(F.hex("digest")).alias("root")).first()
        return row.root if row else None


def manifest(rows: DataFrame, per_part: int = LEAVES, merged: int = MERGED) -> Manifest:
    """The forest over (doc_id, source, leaf, ...) rows, see ``leaves``."""
    rows = written(rows)
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // per_part))
    order = ["source", "doc_id", "leaf", "tie"]  # equal rows are dealt by a row number, so a group of copies may span partitions
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = written(placed.drop("tie").withColumn("pos", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("pos", 33)))
    counts = ordered.groupBy("pid", "source").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("source")
    spans = counts.select(
        "pid", "source", "n", F.coalesce(F.sum("n").over(of_source.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(of_source).alias("size"), F.min("pid").over(of_source).alias("home"),
    )
    starts = spans.where("pid = home").groupBy("pid").agg(F.count("*").alias("m"))
    starts = starts.select(F.col("pid").alias("home"), (F.sum("m").over(Window.orderBy("pid")) - F.col("m")).alias("base"))  # a row a partition
    ranks = spans.where("pid = home").join(F.broadcast(starts), "home").select(F.col("source").alias("named"), (F.col("base") + F.row_number().over(Window.partitionBy("home").orderBy("source")) - 1).alias("tree"))
    spans = written(spans.join(ranks, F.col("source").eqNullSafe(F.col("named"))).select("pid", "source", "n", "before", "size", F.col("tree").cast("long").alias("tree")))
    found = spans.agg(F.count_if(F.col("before") == 0).alias("sources"), F.max("pid").alias("last")).first()
    sources, groups = found.sources, (found.last or 0) + 1

    def climb(key, rows, spans):
        if not len(rows):
            return _rows(0, {}, {}, {}, {})
        nodes, sizes, _ = _local(rows.sort_values("pos"), spans, sources)
        left, made = settle(nodes, sizes)
        return _rows(key[0], left, made, {}, sizes)

    def merge(key, rows):
        nodes = {(t, lv, at): digest.hex().encode() for t, lv, at, digest in zip(rows["tree"].tolist(), rows["level"].tolist(), rows["at"].tolist(), rows["digest"].tolist())}
        sizes = dict(zip(rows["tree"].tolist(), rows["size"].tolist())) | {TOP: sources}
        left, made = settle(nodes, sizes)
        return _rows(key[0], left, made, nodes, sizes)

    state = written(ordered.groupBy("pid").cogroup(spans.groupBy("pid")).applyInPandas(climb, _NODE))
    nodes = state
    while groups > 1:
        groups = math.ceil(groups / merged)
        state = written(state.where("open").withColumn("grp", F.floor(F.col("grp") / merged)).groupBy("grp").applyInPandas(merge, _NODE))
        nodes = nodes.unionByName(state)
    return Manifest(ordered, spans, nodes.where("made").select("tree", "level", "at", "digest"), sources)


_PROOF = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"


def proofs(m: Manifest, siblings: bool = False) -> DataFrame:
    """One row per leaf: its subroot and the root, the digest of its siblings, and the root folded from its tampered (else original) leaf with those siblings.

    With ``siblings`` their digests are listed: the run's others, level by level up to the root, left to right.
    """
    sources = m.sources
    wanted = m.spans.groupBy("pid").applyInPandas(lambda key, spans: pd.DataFrame([(key[0], *w) for w in _wanted(spans, sources)], columns=["pid", "tree", "level", "at"]), "pid long, tree long, level int, at long")
    beyond = wanted.join(m.nodes, ["tree", "level", "at"]).select("pid", "tree", "level", "at", "digest")
    nothing = F.lit(None).cast("long")
    context = m.spans.select("pid", "tree", F.lit(None).cast("int").alias("level"), nothing.alias("at"), F.lit(None).cast("binary").alias("digest"), "n", "before", "size")
    context = context.unionByName(beyond.select("*", nothing.alias("n"), nothing.alias("before"), nothing.alias("size")))

    def prove(key, rows, context):
        rows = rows.sort_values("pos")
        spans, far = context[context["level"].isna()], context[context["level"].notna()]
        nodes, sizes, parts = _local(rows, spans.astype({"n": int, "before": int, "size": int}), sources)
        known = nodes | settle(nodes, sizes)[1]
        known |= {(t, int(lv), int(at)): d.hex().encode() for t, lv, at, d in zip(far["tree"].tolist(), far["level"].tolist(), far["at"].tolist(), far["digest"].tolist())}

        def path(tree: int, level: int, at: int, top: int | None = None) -> list[tuple[bytes, bytes]]:
            """What stands left and right of a node, and of each node above it, in its tree or below level ``top``."""
            out = []
            while level != top and (wide := width(sizes[tree], level)) > 1:
                run = at // FAN
                kids = [known[tree, level, k] for k in range(run * FAN, min(wide, run * FAN + FAN))]
                out.append((b"".join(kids[: at % FAN]), b"".join(kids[at % FAN + 1 :])))
                level, at = level + 1, run
            return out

        root = next(d for (t, lv, _), d in known.items() if t == TOP and width(sources, lv) == 1)
        changed, out = rows["changed"].tolist(), []
        for tree, before, start, end in parts:
            subroot, run = known[TOP, 0, tree].decode(), None
            for k in range(start, end):
                at = before + k - start
                if run != at // FAN:
                    run = at // FAN
                    above = (path(tree, 1, run) if sizes[tree] > 1 else []) + path(TOP, 0, tree)
                    tail = b"".join(a + b for a, b in above)
                own = path(tree, 0, at, 1)
                proof = b"".join(a + b for a, b in own) + tail
                now = known[tree, 0, at] if changed[k] is None else changed[k].hex().encode()
                for a, b in own + above:
                    now = _hash([a, now, b])
                listed = [proof[p : p + 64].decode() for p in range(0, len(proof), 64)] if siblings else None
                out.append((known[tree, 0, at].decode(), subroot, root.decode(), hashlib.sha256(proof).hexdigest(), now.decode(), now == root, listed))
        made = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"], index=rows.index)
        return pd.concat([rows[["doc_id", "source"]], made], axis=1)

    rows = m.ordered.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn longs with nulls into doubles
    out = rows.groupBy("pid").cogroup(context.groupBy("pid")).applyInPandas(prove, _PROOF).withColumn("doc_id", F.col("doc_id").cast("long"))
    return out if siblings else out.drop("siblings")


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of a table of documents."""
    return proofs(manifest(leaves(docs))).drop("source")


#: CRC-32 of a text of ASCII characters, as DuckDB has none: a table of 256 entries, then a byte at a time.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c // 256)), 4294967295::BIGINT)"


def _oracle(levels: int = 7) -> str:
    """The same in SQL, a pair of subqueries a level: trees of up to FAN ** levels leaves."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    head = " || ".join(map(field, ["doc_id", "source", "lang", "n_chars"]))
    out = [CRC_TABLE, f"""d AS (SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field("low")}) AS low_leaf, {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS hit
      FROM (SELECT *, translate(text, '{upper}', '{upper.lower()}') AS low FROM documents), crc_table)""",
      "t AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM d)",
      "a0 AS (SELECT tree, ix, leaf AS digest FROM t)"]
    for kind in "ab":
        for k in range(levels):
            out.append(f"""{kind}{k + 1} AS (SELECT tree, ix // {FAN} AS ix, CASE WHEN first(wide) = 1 THEN first(digest) ELSE sha256(string_agg(digest, '' ORDER BY ix)) END AS digest
      FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS wide FROM {kind}{k}) GROUP BY tree, ix // {FAN})""")
        for k in range(levels):
            out.append(f"""s{kind}{k} AS (SELECT x.tree, x.ix, coalesce(string_agg(y.digest, '' ORDER BY y.ix) FILTER (WHERE y.ix < x.ix), '') AS l, coalesce(string_agg(y.digest, '' ORDER BY y.ix) FILTER (WHERE y.ix > x.ix), '') AS r, any_value(w.wide) > 1 AS more
      FROM {kind}{k} x JOIN {kind}{k} y ON x.tree = y.tree AND x.ix // {FAN} = y.ix // {FAN} JOIN (SELECT tree, count(*) AS wide FROM {kind}{k} GROUP BY tree) w ON w.tree = x.tree GROUP BY x.tree, x.ix)""")
        if kind == "a":
            out.append(f"b0 AS (SELECT -1 AS tree, tree AS ix, digest FROM a{levels})")
    joins, last = "", "t"
    steps = [("a", k) for k in range(levels)] + [("b", k) for k in range(levels)]
    parts = " || ".join(f"s{kind}{k}.l || s{kind}{k}.r" for kind, k in steps)
    for kind, k in steps:
        tree, at = ("t.tree", "t.ix") if kind == "a" else ("-1", "t.tree")
        joins += f" JOIN s{kind}{k} ON s{kind}{k}.tree = {tree} AND s{kind}{k}.ix = {at} // {FAN**k}"
    flat = ", ".join(f"s{kind}{k}.l AS l{kind}{k}, s{kind}{k}.r AS r{kind}{k}, s{kind}{k}.more AS m{kind}{k}" for kind, k in steps)
    out.append(f"p AS (SELECT t.doc_id, t.leaf, t.tree, CASE WHEN t.hit THEN t.low_leaf ELSE t.leaf END AS f0, sha256({parts}) AS proof_sha256, {flat} FROM t{joins})")
    last = "p"
    for n, (kind, k) in enumerate(steps):
        out.append(f"f{n + 1} AS (SELECT * EXCLUDE (f0), CASE WHEN m{kind}{k} THEN sha256(l{kind}{k} || f0 || r{kind}{k}) ELSE f0 END AS f0 FROM {last})")
        last = f"f{n + 1}"
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, a{levels}.digest AS subroot, b{levels}.digest AS root, proof_sha256, f0 AS folded_root, f0 = b{levels}.digest AS verified
FROM {last} JOIN a{levels} ON a{levels}.tree = {last}.tree CROSS JOIN b{levels}"""


ORACLE_SQL = _oracle()

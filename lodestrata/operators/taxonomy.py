"""Taxonomy trees: prefix maps, roll-ups, browsing, canonical paths, and trees of edges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators.rank import top_per
from lodestrata.functions.text import holds_label, jaccard, stem


def prefix_map(claims: DataFrame, id_col: str, path: Column, view: Column | None = None) -> DataFrame:
    """(view, id, prefix, depth, full_depth): every claim under each of its ancestors, once. path is an array of labels."""
    rows = claims.select((view if view is not None else F.lit("default")).alias("view"), F.col(id_col).alias("id"), F.filter(path, lambda s: s.isNotNull() & (s != "")).alias("s"))
    rows = rows.filter(F.size("s") > 0)
    each = rows.select("view", "id", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    return each.select("view", "id", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("prefix"), "depth", F.size("s").alias("full_depth")).distinct()


def rollup(members: DataFrame, sample: int = 100, newest: bool = False) -> DataFrame:
    """Nodes from a prefix map: view, path, level, parent, own and total counts, smallest ids. No recursion: one aggregate.

    The sample is the `sample` smallest ids, or the largest (the newest) ones; each map task cuts a node's rows to that many before the shuffle.
    """
    ordered = members.withColumn("rn", F.row_number().over(W.partitionBy("view", "prefix").orderBy(F.desc("id") if newest else "id")))
    nodes = members.groupBy("view", F.col("prefix").alias("path")).agg(
        F.max("depth").alias("level"), F.count("*").alias("total"), F.count(F.when(F.col("depth") == F.col("full_depth"), 1)).alias("own")
    )
    first = ordered.filter(F.col("rn") <= sample).groupBy("view", F.col("prefix").alias("path")).agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    return nodes.join(first, ["view", "path"]).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))


def append(nodes: DataFrame, added: DataFrame, sample: int = 100) -> DataFrame:
    """Nodes (view, path, total, sample_ids) after claims (view, path, id) came to them: totals grow, the newest `sample` ids stay.

    An id that a node's sample has already isn't counted again. Nodes that aren't there yet begin.
    """
    had = nodes.select("view", "path", F.explode("sample_ids").alias("id"))
    fresh = added.select("view", "path", "id").distinct().join(had, ["view", "path", "id"], "left_anti")
    grown = fresh.groupBy("view", "path").agg(F.count("*").alias("_n"))
    ids = top_per(had.unionByName(fresh), ["view", "path"], [F.desc("id")], sample).groupBy("view", "path").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    totals = nodes.select("view", "path", "total").join(grown, ["view", "path"], "full")
    return totals.select("view", "path", (F.coalesce("total", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total")).join(ids, ["view", "path"], "left")


def with_children(nodes: DataFrame) -> DataFrame:
    kids = nodes.groupBy("view", F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    return nodes.join(kids, ["view", "path"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def node(nodes: DataFrame, path: str) -> DataFrame:
    """The node, or for '' a virtual root that sums the top level where no root is stored."""
    if path:
        return nodes.filter(F.col("path") == path).select("view", "path", "level", "total")
    top = nodes.join(nodes.groupBy("view").agg(F.min("level").alias("level")), ["view", "level"], "left_semi")
    return top.groupBy("view").agg(F.lit("").alias("path"), F.lit(0).alias("level"), F.sum("total").alias("total"))


def children(nodes: DataFrame, parent: str, top_n: int | None = None) -> DataFrame:
    """Direct children by name, or the top_n largest of a wide node."""
    own = with_children(nodes).filter(F.col("parent") == parent).withColumn("has_children", F.col("n_children") > 0)
    return own.orderBy(F.desc("total"), "path").limit(top_n) if top_n else own.orderBy("path")


def search_children(nodes: DataFrame, parent: str, query: str, limit: int) -> DataFrame:
    return nodes.filter((F.col("parent") == parent) & F.contains(F.lower("path"), F.lit(query.lower()))).orderBy(F.desc("total"), "path").limit(limit)


def in_subtree(path: Column, root: str) -> Column:
    """Exact: underscores and hyphens of labels aren't wildcards."""
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def expand(nodes: DataFrame, root: str, depth: int) -> DataFrame:
    """Nodes up to `depth` levels below root."""
    base = len(root.split("/")) if root else 0
    inside = in_subtree(F.col("path"), root) if root else F.lit(True)
    return nodes.filter(inside & (F.col("level") <= base + depth))


def claims_at(members: DataFrame, path: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of the distinct claims below a node."""
    return members.filter(F.col("prefix") == path).select("id").distinct().orderBy("id").offset(offset).limit(limit)


def view_summary(nodes: DataFrame) -> DataFrame:
    least = nodes.groupBy("view").agg(F.min("level").alias("_l"), F.max("level").alias("depth"), F.count("*").alias("n_nodes"))
    top = nodes.join(least, "view").groupBy("view", "depth", "n_nodes").agg(F.sum(F.when(F.col("level") == F.col("_l"), F.col("total"))).alias("n_claims"))
    return top


def canonical_path(path: Column, first: dict[str, list[str]], other: str = "other") -> Column:
    """Cleaned labels, at most three: null if the first isn't canonical, `other` for an unknown second."""
    s = F.slice(F.filter(F.transform(path, lambda p: F.replace(F.replace(F.lower(F.trim(p)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))), lambda p: p != ""), 1, 3)
    out = F.lit(None).cast("array<string>")
    for l1, seconds in first.items():
        second = F.when(F.get(s, F.lit(1)).isin(*seconds), s).otherwise(F.array(F.lit(l1), F.lit(other)))
        out = F.when(F.get(s, F.lit(0)) == l1, F.when(F.size(s) == 1, s).otherwise(second)).otherwise(out)
    return out


def alias_closure(aliases: DataFrame, rounds: int = 10) -> DataFrame:
    """(old, new) with new final: aliases of aliases followed. An alias table is small; a cycle raises."""
    done = aliases.select("old", "new")
    for _ in range(rounds):
        step = aliases.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        joined = done.join(step, "new", "left")
        if joined.filter("_next IS NOT NULL").isEmpty():
            return done
        done = joined.select("old", F.coalesce("_next", "new").alias("new"))
    raise ValueError("the aliases hold a cycle")


def resolve(paths: DataFrame, path_col: str, closure: DataFrame) -> DataFrame:
    """Rewrites the longest aliased beginning of each path; adds `resolved`. Equality on prefixes, no scan."""
    s = F.split(path_col, "/")
    keyed = paths.select(path_col, F.explode(F.sequence(F.lit(1), F.size(s))).alias("k"), s.alias("s")).distinct()
    keyed = keyed.withColumn("old", F.array_join(F.slice("s", F.lit(1), F.col("k")), "/"))
    hit = keyed.join(closure, "old")
    rest = F.array_join(F.slice("s", F.col("k") + 1, F.size("s")), "/")
    best = hit.groupBy(path_col).agg(F.max(F.struct("k", F.concat_ws("/", "new", F.when(rest != "", rest)).alias("to"))).alias("m"))
    return paths.join(best, path_col, "left").withColumn("resolved", F.array_join(F.slice(F.split(F.coalesce("m.to", path_col), "/"), 1, 3), "/")).drop("m")


def by_rules(label: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The target of the first rule (part of the label, target) that holds."""
    out = F.lit(default)
    for part, target in reversed(rules):
        out = F.when(F.contains(label, F.lit(part)), target).otherwise(out)
    return out


def snap(labels: DataFrame, canonical: DataFrame, endings: tuple[str, ...] = ("reaction", "reactions", "method", "methods")) -> DataFrame:
    """(label, canonical, reason): the best canonical label: exact, ending stripped, contained, containing, Jaccard >= 0.6.

    Both are vocabularies (labels, not documents); candidates share a token or a stripped form, by equality.
    """
    bare = lambda c: F.regexp_replace(c, "_(" + "|".join(endings) + ")$", "")
    a = labels.select("label").distinct().withColumn("t", F.explode(F.array_distinct(F.concat(F.split("label", "_"), F.array(bare(F.col("label")))))))
    b = canonical.select("canonical").distinct().withColumn("t", F.explode(F.array_distinct(F.concat(F.split("canonical", "_"), F.array(bare(F.col("canonical")))))))
    pairs = a.join(b, "t").select("label", "canonical").distinct()
    j = jaccard(F.split("label", "_"), F.split("canonical", "_"))
    reason = (
        F.when(F.col("label") == F.col("canonical"), 1)
        .when((bare(F.col("label")) == F.col("canonical")) | (F.col("label") == bare(F.col("canonical"))), 2)
        .when(holds_label(F.col("canonical"), F.col("label")) & (F.length("canonical") >= 5), 3)
        .when(holds_label(F.col("label"), F.col("canonical")) & (F.length("label") >= 5), 4)
        .when(j >= 0.6, 5)
    )
    scored = pairs.withColumns({"r": reason, "j": F.round(j, 6)}).filter("r IS NOT NULL")
    best = scored.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("r", F.desc(F.length("canonical")), F.desc("j"), "canonical"))).filter("rn = 1")
    names = F.element_at(F.array(*[F.lit(x) for x in ("exact", "ending", "contains", "inside", "jaccard")]), F.col("r"))
    return best.select("label", "canonical", names.alias("reason"))


def resolve_type(raw: Column, known: list[str], aliases: dict[str, str]) -> Column:
    """A canonical type from a raw one: as it is, by alias, the part before a parenthesis, or the first part of a compound."""
    low = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in (aliases | {k: k for k in known}).items() for x in kv])
    before = F.regexp_replace(F.regexp_extract(low, r"^([^(]*)", 1), "_+$", "")
    part = F.regexp_extract(low, r"^([^/,&+]*)", 1)
    return F.coalesce(table[low], table[before], table[part])


def fan_out(nodes: DataFrame, most: int) -> DataFrame:
    """Parents with more than `most` children."""
    return nodes.groupBy("view", "parent").agg(F.count("*").alias("n_children")).filter(F.col("n_children") > most)


def node_matches(nodes: DataFrame, query_stems: list[str], weak: list[str], k: int = 10) -> DataFrame:
    """(path, score) of the nodes whose words match the query's stems: overlap and consecutive pairs over the longer side, plus 0.1 for each level.

    With two query words or more, a node whose only overlap is a weak stem is dropped.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("path"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    stems = F.transform(words, stem)
    q = F.array(*map(F.lit, query_stems))
    hit = F.array_intersect(q, stems)
    pairs = F.arrays_zip(F.slice(stems, F.lit(1), F.greatest(F.size(stems) - 1, F.lit(0))).alias("a"), F.slice(stems, F.lit(2), F.size(stems)).alias("b"))
    held = F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))
    bonus = sum((F.array_contains(held, f"{a} {b}").cast("int") for a, b in zip(query_stems, query_stems[1:], strict=False)), F.lit(0))
    score = (F.size(hit) + bonus) / F.greatest(F.lit(len(query_stems)), F.size(F.array_distinct(stems))) + 0.1 * F.size(F.split("path", "/"))
    usable = F.size(hit) > 0
    if len(query_stems) >= 2:
        usable = usable & ~((F.size(hit) == 1) & F.arrays_overlap(hit, F.array(*map(F.lit, weak or [""]))))
    return nodes.filter(usable).select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(k)


# --- trees of edges ---------------------------------------------------------------------------------


def subtree(edges: DataFrame, root: str, depth: int = 4) -> DataFrame:
    """(node, level) below root in edges (parent, child), by a recursive query of bounded depth."""
    name = f"lodestrata_edges_{uuid.uuid4().hex}"  # a view of its own, so that calls don't replace each other's
    edges.createOrReplaceTempView(name)
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE t(node, level) AS (SELECT :root, 0 UNION ALL SELECT e.child, t.level + 1 FROM t JOIN {name} e ON e.parent = t.node WHERE t.level < {int(depth)})
        SELECT node, min(level) AS level FROM t GROUP BY node""",
        args={"root": root},
    )


def ancestors(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(node, chain): every node's chain from the root; the first parent by name, cycles cut by the depth."""
    first = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(first.select(F.col("child").alias("node")), "node", "left_anti")
    out = level = roots.select("node", F.array("node").alias("chain"))
    for _ in range(depth):
        level = first.join(level.select(F.col("node").alias("parent"), "chain"), "parent").select(F.col("child").alias("node"), F.array_append("chain", F.col("child")).alias("chain"))
        out = out.union(level)
    return out


def level_violations(edges: DataFrame, ranks: DataFrame, gap: int = 2) -> DataFrame:
    """Edges whose child ranks above its parent, or `gap` or more levels below it; ranks (node, rank)."""
    p, c = ranks.select(F.col("node").alias("parent"), F.col("rank").alias("parent_rank")), ranks.select(F.col("node").alias("child"), F.col("rank").alias("child_rank"))
    both = edges.join(p, "parent").join(c, "child")
    kind = F.when(F.col("child_rank") <= F.col("parent_rank"), "inversion").when(F.col("child_rank") - F.col("parent_rank") >= gap, "gap")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL")


def merge_by_name(nodes: DataFrame) -> DataFrame:
    """(node, keep): nodes (node, name, level, leaves) of one normalised name become the shallowest, then that with most leaves."""
    w = W.partitionBy(F.lower(F.trim("name"))).orderBy("level", F.desc("leaves"), "node")
    return nodes.select("node", F.first("node").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("keep"))


def name_matches(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, name, level) of one level whose normalised names are equal, or one begins the other by whole words.

    Blocks are a level and a name's first word, by which both kinds of names agree. A name with fewer words is met by
    the beginnings of a longer one, so no block is compared pair by pair.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("name"), "[^\\p{L}\\p{N}]+", " ")), " ")
    n = nodes.select("node", "level", words.alias("w"))
    n = n.withColumn("w", F.transform("w", lambda x: F.regexp_replace(x, "(?<=[^s])s$", "")))
    own = n.select("level", F.array_join("w", " ").alias("key"), F.col("node").alias("a"))
    begins = F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))
    other = n.select("level", F.explode(begins).alias("key"), F.col("node").alias("b"))
    return own.join(other, ["level", "key"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge_matches(nodes: DataFrame) -> DataFrame:
    """(node, keep): groups that name_matches join become the node with most leaves, by name in ties; nodes (node, name, level, leaves)."""
    from lodestrata.operators.graph import components

    groups = components(name_matches(nodes))
    own = nodes.join(groups, "node")
    w = W.partitionBy("root").orderBy(F.desc("leaves"), "node").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return own.select("node", F.first("node").over(w).alias("keep"))


def merge_to_fixpoint(edges: DataFrame, nodes: DataFrame, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) after merges by name, round by round, until none is left or `rounds` are done.

    nodes (node, name, level, leaves). A merge that would close a circle (the kept node is below the other) isn't made.
    Edges are those between kept nodes, each once; kept nodes' leaves are sums.
    """
    from lodestrata.operators.graph import cut

    for _ in range(rounds):
        merged = merge_by_name(nodes).filter("node <> keep")
        below = reach(edges, merged.select("node", "keep"))
        merged = cut(merged.join(below, ["node", "keep"], "left_anti"))
        if merged.isEmpty():
            break
        every = nodes.select("node").join(merged, "node", "left").select("node", F.coalesce("keep", "node").alias("keep"))
        edges = cut(reparent(edges, every))
        sums = nodes.join(every, "node").groupBy("keep").agg(F.sum("leaves").alias("leaves"))
        nodes = cut(nodes.drop("leaves").join(sums.withColumnRenamed("keep", "node"), "node"))
    return edges, nodes


def reach(edges: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """The pairs (node, keep) of which one is above the other, within `depth` levels."""
    step = edges.select(F.col("parent").alias("at"), F.col("child").alias("_next"))
    walk = pairs.select("node", "keep", F.explode(F.array(F.struct(F.col("node").alias("at"), F.col("keep").alias("to")), F.struct(F.col("keep").alias("at"), F.col("node").alias("to")))).alias("x")).select("node", "keep", "x.*")
    out = None
    for _ in range(depth):
        walk = walk.join(step, "at").select("node", "keep", F.col("_next").alias("at"), "to").distinct()
        hit = walk.filter(F.col("at") == F.col("to")).select("node", "keep")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def settle_proposals(proposals: DataFrame, promote: int, fold: int) -> DataFrame:
    """(path, total, fate) of proposed nodes (path, parent, total): promoted with `promote` members or more, folded into the parent with `fold` or more, else dropped.

    What is folded is summed at the parent.
    """
    fate = F.when(F.col("total") >= promote, "promoted").when(F.col("total") >= fold, "folded").otherwise("dropped")
    return proposals.withColumn("fate", fate).groupBy(F.when(F.col("fate") == "folded", F.col("parent")).otherwise(F.col("path")).alias("path"), "fate").agg(F.sum("total").alias("total"))


def spread_fan_out(placed: DataFrame, most: int) -> DataFrame:
    """(label, path): labels under a path beyond `most` go to path_more2, path_more3 ... by name, so that none has more.

    placed (label, path). Moving what exceeds on, round by round, ends in the same places.
    """
    part = F.floor((F.row_number().over(W.partitionBy("path").orderBy("label")) - 1) / most) + 1
    return placed.withColumn("_part", part).withColumn("path", F.when(F.col("_part") > 1, F.concat("path", F.lit("_more"), F.col("_part").cast("string"))).otherwise(F.col("path"))).drop("_part")


def reparent(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges between kept nodes, each once, no loops."""
    m = merged.select(F.col("node").alias("parent"), F.col("keep").alias("p"))
    n = merged.select(F.col("node").alias("child"), F.col("keep").alias("c"))
    out = edges.join(m, "parent", "left").join(n, "child", "left")
    return out.select(F.coalesce("p", "parent").alias("parent"), F.coalesce("c", "child").alias("child")).filter("parent <> child").distinct()


def graft(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """base and what only other has, by keys."""
    return base.unionByName(other.join(base.select(*keys), keys, "left_anti"))


def flatten_tree(tree: DataFrame, depth: int = 6) -> DataFrame:
    """(parent, child, level) of nested structs {name, children}: one select for each level."""
    out, level = None, tree.select(F.lit("").alias("parent"), F.col("name"), F.col("children"))
    for i in range(depth):
        rows = level.select("parent", F.col("name").alias("child"), F.lit(i).alias("level"))
        out = rows if out is None else out.union(rows)
        kind = dict(level.dtypes)["children"]
        if "struct" not in kind:
            break
        level = level.select(F.col("name").alias("parent"), F.explode("children").alias("k")).select("parent", "k.*")
        if "children" not in level.columns:
            out = out.union(level.select("parent", F.col("name").alias("child"), F.lit(i + 1).alias("level")))
            break
    return out

"""Graph operators: call graphs, hierarchies, knowledge graphs, components, trees, edge placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalar as S
from auditlake.operators.ordering import first_symbols
from auditlake.plans.tables import stored, task_count

# Fixed value: lines after a class's line within which a member may stand, in the compatible containment rule.
COMPAT_SPAN = 100
#: Lines of a cell of the containment join.
CELL = 16
#: Rows of a block of a join whose keys hold many rows on both sides.
BLOCK = 1024


def call_edges(symbols: DataFrame) -> DataFrame:
    """(caller, callee, file, line), one for each call site; the calling method names the caller before the function."""
    caller = F.coalesce(F.try_element_at("metadata", F.lit("callerMethod")), F.try_element_at("metadata", F.lit("callerFunction")))
    return symbols.where("kind = 'MethodCall'").select(caller.alias("caller"), F.col("name").alias("callee"), F.col("file_path").alias("file"), F.col("start_line").alias("line")).where("caller is not null")


def call_graph(edges: DataFrame, entry: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from an entry by levels: every expanded node emits all its call sites once.

    Each level is one equi-join with the frontier; levels are written to the shared folder, so lineage stays
    short and a lost executor costs one level.
    """
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(entry.strip(),)] if entry.strip() and depth > 0 else [], "node string")
    visited, found = frontier, None
    for level in range(depth):
        step = stored(edges.join(frontier, edges["caller"] == frontier["node"]).select("caller", "callee", *[c for c in edges.columns if c not in ("caller", "callee")]).withColumn("level", F.lit(level)), "call-level")
        found = step if found is None else found.unionByName(step)
        frontier = stored(step.select(F.col("callee").alias("node")).distinct().join(visited, "node", "left_anti"), "call-frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    if found is None:
        found = edges.limit(0).withColumn("level", F.lit(0))
    nodes = spark.createDataFrame([(entry.strip(),)] if entry.strip() and depth > 0 else [], "node string").unionByName(found.select(F.col("callee").alias("node"))).distinct()
    return nodes, found


def class_hierarchy(classes: DataFrame, name: str) -> DataFrame:
    """(relation, name, file_path, depth): indexed ancestors of a class, level by level, and its direct children."""
    spark = classes.sparkSession
    known = stored(classes.where("kind = 'Class'").select("name", "file_path", "parent_classes"), "hierarchy")
    ups = known.select(F.col("name").alias("child"), F.explode("parent_classes").alias("parent"))
    frontier = spark.createDataFrame([(name,)], "node string")
    visited, found, depth = frontier, None, 0
    while True:
        depth += 1
        parents = ups.join(frontier, F.col("child") == F.col("node")).select(F.col("parent").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = stored(parents.join(known.select(F.col("name").alias("node")).distinct(), "node", "left_semi"), "hierarchy")
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        visited = visited.unionByName(frontier)
    place = known.groupBy(F.col("name").alias("node")).agg(F.max("file_path").alias("file_path"))
    children = known.where(F.array_contains("parent_classes", name)).select(F.lit("child").alias("relation"), "name", "file_path", F.lit(1).alias("depth"))
    if found is None:
        return children
    above = found.join(place, "node").select(F.lit("parent").alias("relation"), F.col("node").alias("name"), "file_path", "depth")
    return above.unionByName(children)


def class_map(symbols: DataFrame) -> DataFrame:
    """(name, file_path) of classes; of equal names the last path counts."""
    return symbols.where("kind = 'Class'").groupBy("name").agg(F.max("file_path").alias("file_path"))


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth) of a tree or DAG by repeated joins, with the shortest depth; cycles end by the visited set."""
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    frontier = stored(step.withColumn("depth", F.lit(1)), "closure")
    every = frontier
    while not frontier.isEmpty():
        up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        grown = frontier.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = stored(grown.join(every.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "closure")
        every = every.unionByName(frontier)
    return every


def agent_tree(agents: DataFrame) -> DataFrame:
    """(agent_id, root, path, depth): every agent under its root, parents first in the path."""
    up = closure(agents, "agent_id", "parent_id")
    line = up.groupBy(F.col("node").alias("agent_id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))).alias("line"))
    rows = agents.select("agent_id").join(line, "agent_id", "left")
    kind = agents.schema["agent_id"].dataType.simpleString()
    above = F.coalesce(F.transform("line", lambda x: x["ancestor"].cast(kind)), F.array().cast(f"array<{kind}>"))
    return rows.select("agent_id", F.coalesce(F.get(above, 0), F.col("agent_id")).alias("root"), F.concat(above, F.array("agent_id")).alias("path"), F.size(above).alias("depth"))


def stop_set(agents: DataFrame, agent_id) -> DataFrame:
    """An agent and all below it."""
    below = closure(agents, "agent_id", "parent_id").where(F.col("ancestor") == agent_id).select(F.col("node").alias("agent_id"))
    return agents.where(F.col("agent_id") == agent_id).select("agent_id").unionByName(below).distinct()


def tree_status(agents: DataFrame) -> DataFrame:
    """Agents by status in the subtree of every agent, itself included."""
    up = closure(agents, "agent_id", "parent_id").select(F.col("node").alias("agent_id"), F.col("ancestor").alias("top"))
    own = agents.select("agent_id", F.col("agent_id").alias("top"))
    return own.unionByName(up).join(agents.select("agent_id", "status"), "agent_id").groupBy("top", "status").agg(F.count(F.lit(1)).alias("n"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the least reachable node as the component, by alternating star contractions.

    Every step is grouped minima and equi-joins over edges, so a hub's edges spread over tasks by the join's
    skew handling; steps are logarithmic in the longest path.  A loop edge names a node that may stand alone.
    """
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "components")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "components")
        state = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 30)), F.lit(0))).first())
        if state == before:
            break
        before = state
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    lone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    return named.unionByName(lone.join(named, "node", "left_anti").withColumn("component", F.col("node")))


# Label and type of the edges of a knowledge graph.
EXTENDS = ("extends", "inheritance")
CONTAINS = ("contains", "containment")
CALLS = ("calls", "call")


def _named(label: tuple[str, str]) -> list[Column]:
    return [F.lit(label[0]).alias("label"), F.lit(label[1]).alias("type")]


def pairs_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of rows with equal keys, without the keys; other columns are named apart.

    A few keys may hold most rows, and their pairs grow with the square of them.  Rows of a key are dealt into blocks,
    blocks meet blocks, and the pairs of blocks are dealt over a fixed number of tasks, which neither a broadcast nor
    the joining of small partitions can undo: a task holds two blocks, and only then are the rows paired.
    """

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
        dealt = rows.dropna(subset=keys).withColumn(f"{side}_block", F.floor((number - 1) / BLOCK))
        return dealt.groupBy(*keys, f"{side}_block").agg(F.collect_list(F.struct(*rest)).alias(side))

    tasks = task_count(left.sparkSession)
    met = blocks(left, "_l").join(blocks(right, "_r"), keys).repartition(tasks, *keys, "_l_block", "_r_block")
    return met.select(F.explode("_l").alias("_l"), "_r").select("_l", F.explode("_r").alias("_r")).select("_l.*", "_r.*")


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    """child -> parent where a named parent is indexed."""
    kinds = F.col("kind").isin("Class", "Interface", "Struct")
    child = symbols.where(kinds).select(F.col("id").alias("source"), F.explode("parent_classes").alias("name"))
    return pairs_by_key(child, symbols.select(F.col("id").alias("target"), "name"), ["name"]).select("source", "target", *_named(EXTENDS))


def containment_edges(symbols: DataFrame, compat: bool = False) -> DataFrame:
    """class -> method or function in the same file.

    The member starts between the class's first and last line.  compat takes the older rule: the end lines are
    compared, the member ends fewer than 100 lines after the class, and its code or package names the class.
    """
    outer = symbols.where(F.col("kind").isin("Class", "Interface", "Struct")).select("file_path", F.col("id").alias("source"), F.col("name").alias("c_name"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    inner = symbols.where(F.col("kind").isin("Method", "Function")).select("file_path", F.col("id").alias("target"), F.col("start_line").alias("m_start"), F.col("end_line").alias("m_end"), "code", "package")
    # Lines are dealt into cells, so a member meets only what reaches into its own cell.
    at, first, last = ("m_end", F.col("c_end"), F.col("c_end") + COMPAT_SPAN) if compat else ("m_start", F.col("c_start"), F.col("c_end"))
    cells = F.sequence(F.floor(first / CELL), F.floor(last / CELL))
    outer = outer.where(first <= last).withColumn("cell", F.explode(cells))
    inner = inner.withColumn("cell", F.floor(F.col(at) / CELL))
    keys = ["file_path", "cell"]
    if compat:
        outer = outer.select(*keys, "source", "c_end", "c_name", F.lower("c_name").alias("c_lower"))
        inner = inner.select(*keys, "target", "m_end", F.lower("code").alias("m_lower"), F.coalesce("package", F.lit("")).alias("m_package"))
        named = F.contains("m_lower", "c_lower") | F.contains("m_package", "c_name")
        within = (F.col("m_end") > F.col("c_end")) & (F.col("m_end") < F.col("c_end") + COMPAT_SPAN)
        pairs = pairs_by_key(outer, inner, keys).where(F.when(within, named).otherwise(False))
    else:
        pairs = pairs_by_key(outer.drop("c_name"), inner.select(*keys, "target", "m_start"), keys).where(F.col("m_start").between(F.col("c_start"), F.col("c_end")))
    return pairs.select("source", "target", *_named(CONTAINS))


def site_edges(symbols: DataFrame) -> DataFrame:
    """caller symbol -> call symbol, by the caller's name; every symbol of that name counts, whatever its kind."""
    caller = F.coalesce(F.try_element_at("metadata", F.lit("callerMethod")), F.try_element_at("metadata", F.lit("callerFunction")))
    sites = symbols.where("kind = 'MethodCall'").select(F.col("id").alias("target"), caller.alias("name"))
    owners = symbols.select(F.col("id").alias("source"), "name")
    return pairs_by_key(owners, sites, ["name"]).select("source", "target", *_named(CALLS))


def textual_call_edges(symbols: DataFrame) -> DataFrame:
    """function -> symbol whose name its code calls: every suffix of an identifier before a bracket counts as a name."""
    owners = symbols.where(F.col("kind").isin("Method", "Function")).select(F.col("id").alias("source"), F.col("name").alias("own"), "code")
    names = owners.select("source", "own", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"([A-Za-z0-9_$]+)\("), 1))).alias("word"))
    suffixes = names.select("source", "own", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.length("word")))).alias("name")).distinct()
    targets = symbols.select(F.col("id").alias("target"), "name")
    return pairs_by_key(suffixes.where("own <> name").drop("own"), targets, ["name"]).select("source", "target", *_named(CALLS))


def knowledge_graph(symbols: DataFrame, limit: int = 500, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over a bounded node set; nodes are limited first, edges join what is kept.

    Edges are numbered from 0 by type, source and target in one task: `limit` bounds them too.
    """
    kept = first_symbols(symbols, limit).withColumn("id", S.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line")))
    kept = stored(kept, "knowledge")
    edges = inheritance_edges(kept).unionByName(containment_edges(kept, compat)).unionByName(site_edges(kept)).unionByName(textual_call_edges(kept))
    numbered = edges.withColumn("edge_id", F.concat(F.lit("edge_"), (F.row_number().over(Window.orderBy("type", "source", "target")) - 1).cast("string")))
    return kept.select("id", F.col("name").alias("label"), F.col("kind").alias("type")), numbered


def placed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' places and the sides to connect: horizontal where the distance across is larger."""
    s = nodes.select(F.col("id").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    t = nodes.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    flat = F.abs(dx) > F.abs(dy)
    out = F.when(flat, F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "bottom").otherwise("top"))
    into = F.when(flat, F.when(dx > 0, "left").otherwise("right")).otherwise(F.when(dy > 0, "top").otherwise("bottom"))
    return edges.join(s, "source", "left").join(t, "target", "left").withColumn("source_handle", out).withColumn("target_handle", into)


def path_tree(paths: DataFrame) -> DataFrame:
    """(path, parent, name, type, depth) of all files and the folders above them."""
    parts = F.split("path", "/")
    rows = paths.select("path", parts.alias("parts")).select("path", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    node = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/"))
    kind = F.when(F.col("depth") == F.size("parts"), "file").otherwise("folder")
    return rows.select(node.alias("path"), parent.alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), kind.alias("type"), "depth").distinct()

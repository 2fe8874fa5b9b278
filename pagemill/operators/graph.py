"""Organisation charts: levels, parents, siblings, paths and cycles of a graph of boxes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.tables import cut


def levels(nodes: DataFrame, key: list[str]) -> DataFrame:
    """``nodes`` (x0, y0, x1, y1) with ``level``: one-dimensional clusters of the vertical centres, by a running mean and 0.6 of the median height."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=(pdf.y0 + pdf.y1) / 2).sort_values(["_c", "x0", "id"])
        heights = (pdf.y1 - pdf.y0)[pdf.y1 > pdf.y0]
        reach = 0.6 * (float(heights.median()) if len(heights) else 30.0)
        out, level, total, n = [], -1, 0.0, 0
        for c in pdf["_c"]:
            if n and abs(c - total / n) <= reach:
                total, n = total + c, n + 1
            else:
                level, total, n = level + 1, float(c), 1
            out.append(level)
        return pdf.drop(columns="_c").assign(level=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.groupBy(*key).applyInPandas(fold, f"{fields}, level int")


def x_overlap(a: str, b: str) -> Column:
    """Shared width of two boxes over the narrower width, at most 1; 0 where they don't meet or one has no width."""
    shared = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    narrow = F.least(F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.col(f"{b}.x1") - F.col(f"{b}.x0"))
    return F.when((shared <= 0) | (narrow <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared.cast("double") / narrow))


def parents(nodes: DataFrame, key: list[str], k: int = 5, reach: int = 3) -> DataFrame:
    """(key, child, parent, score, place): the best ``k`` candidates among the nodes up to ``reach`` levels above.

    The score weighs the shared columns (0.4), the closeness of the centres over the page's height (0.3) and their
    alignment over 0.3 of its width (0.3), and is divided by the difference of levels; height and width of a page are those that its nodes reach.
    Equal scores keep the order of ids.
    """
    pages = nodes.groupBy(*key).agg(F.max("x1").alias("_width"), F.max("y1").alias("_height"))
    # a child asks for the levels above it, so nodes meet only those they may hang under
    a = nodes.join(pages, key).withColumn("_up", F.explode(F.array(*(F.col("level") - n for n in range(1, reach + 1))))).alias("a")
    b = nodes.alias("b")
    joined = a.join(b, [*(F.col(f"a.{x}") == F.col(f"b.{x}") for x in key), F.col("a._up") == F.col("b.level")])
    centre = lambda n, low, high: (F.col(f"{n}.{low}") + F.col(f"{n}.{high}")) / 2.0
    down = F.abs(centre("a", "y0", "y1") - centre("b", "y0", "y1")) / F.col("_height")
    aside = F.lit(1.0) - F.least(F.lit(1.0), F.abs(centre("a", "x0", "x1") - centre("b", "x0", "x1")) / (F.col("_width") * 0.3))
    score = (x_overlap("a", "b") * 0.4 + (F.lit(1.0) - down) * 0.3 + aside * 0.3) / (F.col("a.level") - F.col("b.level"))
    scored = joined.select(*(F.col(f"a.{x}").alias(x) for x in key), F.col("a.id").alias("child"), F.col("b.id").alias("parent"), F.round(score, 6).alias("score"))
    w = Window.partitionBy(*key, "child").orderBy(F.col("score").desc(), "parent")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def siblings(edges: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, left, right): neighbours under one parent, from left to right."""
    placed = edges.join(nodes.select(*key, F.col("id").alias("child"), ((F.col("x0") + F.col("x1")) / 2).alias("cx")), [*key, "child"])
    w = Window.partitionBy(*key, "parent").orderBy("cx", "child")
    return placed.withColumn("right", F.lead("child").over(w)).where("right is not null").select(*key, F.col("child").alias("left"), "right")


def paths(edges: DataFrame, names: DataFrame, key: list[str], nodes: bool = False) -> DataFrame:
    """(key, id, depth, path, cyclic, and with ``nodes`` the nodes of the walk as ``seen``): names from the root to every node by walking (child, parent) edges; a walk that meets a node again is cyclic and ends.

    Each round joins all open walks with their next edge and cuts the lineage; it ends when no walk is open, which a cycle can't delay.
    """
    step = edges.select(*key, F.col("child").alias("top"), F.col("parent").alias("next"))
    named = names.select(*key, F.col("id").alias("next"), F.col("name").alias("next_name"))
    walk = names.select(*key, "id", F.col("id").alias("top"), F.array("id").alias("seen"), F.col("name").alias("path"), F.lit(False).alias("cyclic"), F.lit(True).alias("open"))
    while True:
        moved = walk.where("open").join(step, [*key, "top"], "left").join(named, [*key, "next"], "left")
        again = F.array_contains("seen", F.col("next"))
        moved = moved.select(
            *key, "id", F.coalesce(F.when(~again, F.col("next")), F.col("top")).alias("top"), F.when(F.col("next").isNotNull() & ~again, F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"),
            F.when(F.col("next").isNotNull() & ~again, F.concat_ws(" > ", "next_name", "path")).otherwise(F.col("path")).alias("path"),
            F.coalesce(again, F.lit(False)).alias("cyclic"), (F.col("next").isNotNull() & ~F.coalesce(again, F.lit(False))).alias("open"),
        )
        walk = cut(walk.where("not open").unionByName(moved), "org-paths", walk)
        if walk.where("open").isEmpty():
            return walk.select(*key, "id", (F.size("seen") - 1).alias("depth"), "path", "cyclic", *(["seen"] if nodes else []))


def closed_subset(items: DataFrame, needs: DataFrame) -> DataFrame:
    """The greatest set of ``items`` (id) whose needs (id, needed) are all in it: items with a missing need drop out until none does."""
    left = items.select("id").distinct()
    before = left.count()
    while True:
        broken = needs.join(left.select(F.col("id").alias("needed")), "needed", "left_anti").select("id").distinct()
        left = cut(left.join(broken, "id", "left_anti"), "closed-subset", left)
        now = left.count()
        if now == before:
            return left
        before = now


def edges(nodes: DataFrame, key: list[str], sure: float = 0.7) -> DataFrame:
    """(key, child, parent, score, needs_review): the best candidate of each node; below ``sure`` it has to be looked at."""
    best = parents(nodes, key, 1)
    return best.select(*key, "child", "parent", "score", (F.col("score") < sure).alias("needs_review"))


def cycles(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, members): each cycle of (child, parent) edges once, by its sorted members, where a node has one parent.

    Nodes from which no edge goes on, or to which none leads, are in no cycle and drop out until none does; what is left are the
    cycles, which walks around them tell apart.
    """
    left = cut(edges.select(*key, "child", "parent").distinct(), "org-cycles")
    before = left.count()
    while True:
        goes_on = left.select(*key, F.col("child").alias("parent")).distinct()
        led_to = left.select(*key, F.col("parent").alias("child")).distinct()
        left = cut(left.join(goes_on, [*key, "parent"], "left_semi").join(led_to, [*key, "child"], "left_semi"), "org-cycles", left)
        now = left.count()
        if now == before:
            break
        before = now
    walks = paths(left, left.select(*key, F.col("child").alias("id"), F.col("child").cast("string").alias("name")), key, True)
    return walks.select(*key, F.array_sort("seen").alias("members")).distinct()


def levels_by_edges(nodes: DataFrame, edges: DataFrame, key: list[str], unreached: int = 99) -> DataFrame:
    """(key, id, level): breadth first from the nodes without a parent; one join for each level, until it reaches nothing new."""
    own = edges.select(*key, F.col("parent").alias("id"), F.col("child").alias("_next")).distinct()
    front = nodes.join(edges.select(*key, F.col("child").alias("id")), [*key, "id"], "left_anti").select(*key, "id").distinct().withColumn("level", F.lit(0))
    reached = cut(front, "org-levels")
    level = 0
    while True:
        level += 1
        step = reached.where(F.col("level") == level - 1).join(own, [*key, "id"]).select(*key, F.col("_next").alias("id")).distinct()
        fresh = step.join(reached, [*key, "id"], "left_anti").withColumn("level", F.lit(level))
        more = cut(reached.unionByName(fresh), "org-levels", reached)
        if more.where(F.col("level") == level).isEmpty():
            reached = more
            break
        reached = more
    return nodes.select(*key, "id").join(reached, [*key, "id"], "left").select(*key, "id", F.coalesce("level", F.lit(unreached)).alias("level"))


def validation(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_nodes, n_roots, n_edges, busiest, unknown): figures that tell a chart that was read badly: how many nodes hang under none, under the busiest one, and are of no category."""
    has_parent = edges.select(*key, F.col("child").alias("id")).distinct().withColumn("_child", F.lit(1))
    out = edges.groupBy(*key, "parent").agg(F.count("*").alias("_out")).groupBy(*key).agg(F.sum("_out").alias("n_edges"), F.max("_out").alias("_most"))
    counted = nodes.join(has_parent, [*key, "id"], "left").groupBy(*key).agg(F.count("*").alias("n_nodes"), F.sum(F.col("_child").isNull().cast("bigint")).alias("n_roots"), F.sum(F.col("category").isNull().cast("bigint")).alias("_unknown"))
    joined = counted.join(out, key, "left")
    return joined.select(*key, "n_nodes", "n_roots", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.round(F.coalesce("_most", F.lit(0)) / F.col("n_nodes"), 4).alias("busiest"), F.round(F.col("_unknown") / F.col("n_nodes"), 4).alias("unknown"))


def groups(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, category, members, confidence): the nodes of each category with the least confidence among them."""
    return nodes.where("category is not null").groupBy(*key, "category").agg(F.array_sort(F.collect_list("id")).alias("members"), F.min("confidence").alias("confidence"))


# What a unit is by its name, the first that occurs; below the last column's threshold it is unknown.
CATEGORIES = (
    ("董事會|監察人|監事會|理事會", "governance", 0.95), ("委員會|小組會議|諮詢", "committee", 0.9), ("院長|董事長|執行長|總經理|副院長|主任秘書", "management", 0.9), ("研究.*所|研究所", "department", 0.85),
    ("辦公室$", "taskforce", 0.75), ("中心$", "taskforce", 0.75), ("處$|部$", "department", 0.75), ("資料庫$|資訊庫$", "department", 0.7), ("室$", "department", 0.6),
)
# What joins two units by what they are.
RELATIONS = {
    ("governance", "governance"): "oversight", ("governance", "management"): "oversight", ("management", "governance"): "reports_to", ("management", "management"): "reports_to", ("management", "department"): "reports_to", ("management", "taskforce"): "reports_to",
    ("committee", "management"): "advisory", ("committee", "governance"): "advisory", ("department", "management"): "reports_to", ("department", "department"): "sibling", ("taskforce", "management"): "reports_to", ("taskforce", "department"): "contains", ("taskforce", "taskforce"): "sibling",
}


def category(label: Column, sure: float = 0.7) -> Column:
    """(hint, category, confidence) of a unit's name; unknown below ``sure``."""
    x = F.trim(label)
    hint, confidence = F.lit("unknown"), F.lit(0.3)
    for pattern, name, value in reversed(CATEGORIES):
        hint, confidence = F.when(x.rlike(pattern), name).otherwise(hint), F.when(x.rlike(pattern), value).otherwise(confidence)
    return F.struct(hint.alias("hint"), F.when(confidence >= sure, hint).otherwise("unknown").alias("category"), confidence.alias("confidence"))


def relation(of: Column, to: Column) -> Column:
    """What joins a unit to another by their categories; unknown for pairs that aren't listed."""
    known = F.create_map(*(F.lit(x) for (a, b), name in RELATIONS.items() for x in (f"{a}>{b}", name)))
    return F.coalesce(F.element_at(known, F.concat(of, F.lit(">"), to)), F.lit("unknown"))


def is_noise(text: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Numbers, texts of one character, and short texts in a corner of the page (coordinates to 1 or to 1000)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    scale = F.when(F.greatest(x0, y0, x1, y1) <= 1, 1.0).otherwise(1000.0)
    corner = ((y0 < scale * 0.05) | (y1 > scale * 0.95)) & ((x0 < scale * 0.1) | (x1 > scale * 0.9))
    return (F.length(t) < 2) | F.regexp_replace(t, "[-.]", "").rlike("^[0-9]+$") | (F.length(t) <= 5) & F.coalesce(corner, F.lit(False))


def indent_edges(text: str) -> list[tuple[str, str, str]]:
    """(child, parent, relation) of an indented list: the nearest entry above with less indent; a bracket that names a relation gives that one, and headings begin anew."""
    out, stack = [], []
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("#"):
            stack = []
        if not bare.startswith(("- ", "* ")):
            continue
        item = bare[2:].replace("**", "").strip()
        label = re.split("[（(]", item)[0].strip()
        if named := re.search(r"[（(](監督|諮詢|隸屬)[：:]\s*([^）)]+)[）)]", item):
            out.append((label, named[2].strip(), {"監督": "oversight", "諮詢": "advisory", "隸屬": "reports_to"}[named[1]]))
            continue
        if len(label) < 2:
            continue
        indent = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if stack:
            out.append((label, stack[-1][1], "reports_to"))
        stack.append((indent, label))
    return out


def markdown(paths: DataFrame, key: list[str]) -> DataFrame:
    """(key, markdown): the tree as an indented list, from the paths of its nodes (``path``, ``depth``)."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), F.element_at(F.split("path", " > "), -1))
    item = F.struct(F.split("path", " > ").alias("p"), line.alias("l"))
    return paths.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["l"]), "\n").alias("markdown"))

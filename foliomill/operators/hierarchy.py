"""Parent-child links to full hierarchies.

Links are cut into blocks of neighbouring ids. In each block a weighted disjoint-set forest takes
link after link: a find follows the parents to the top of a set, adds up the offsets and hangs
everything on its way directly under the top; a link whose two ends have one top closes a circle.
Only tops whose parent lies in another block go on, as links between blocks that carry offsets.
They are merged hierarchically: ``FAN`` neighbouring blocks make a block of the next level, in
which the same forest runs over the links between its parts, until one block holds all. A level
is run only while its largest block holds at most ``MERGE_ROWS`` links; links that are left (ids
without any locality, at great size) are merged by joins that double the reach of each link.
Paths are composed of the block's own segment, by indexed parent traversal, and the path of the
node the block's top hangs on.

A task holds one block at a time: rows come sorted, and paths go out in slices of ``CELLS`` ids.

Defined results
---------------
* rows with a null node id are no nodes;
* a null parent, or one that is no node of the table, makes the node a root (depth 0);
* a node on a circle of parents (also its own parent) or below one: root -1, depth -1, null path;
* repeated rows of a node: the greatest (version, parent) counts, nulls first;
* an empty table gives an empty result; columns besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.runtime import cut, release

#: Neighbouring ids that share a block (and so a task) in the local pass.
BLOCK = 1 << 16
#: Blocks that make one of the next level, and links that one may hold.
FAN, MERGE_ROWS = 64, 1 << 19
#: Ids of paths in one slice.
CELLS = 1 << 20


def latest_links(df: DataFrame, node: str, parent: str, version: str) -> DataFrame:
    """One link (node, parent) per node: the version with the latest ``version`` counts."""
    newest = F.max(F.struct(F.col(version), F.col(parent).cast("long").alias("parent")))
    return (
        df.where(F.col(node).isNotNull())
        .groupBy(F.col(node).cast("long").alias("node"))
        .agg(newest.alias("newest"))
        .select("node", F.col("newest.parent").alias("parent"))
    )


def weighted_forest(up: list[int], weight: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """(top, offset, on or below a circle) of each index; ``up`` is the index of its parent or -1, ``weight`` the link's length."""
    top, offset, round_ = list(range(len(up))), [0] * len(up), [False] * len(up)

    def find(i: int) -> tuple[int, int]:
        way = []
        while top[i] != i:
            way.append(i)
            i = top[i]
        far = 0
        for j in reversed(way):
            far = offset[j] = offset[j] + far if top[j] != i else offset[j]
            top[j] = i
        return i, far

    for i, parent in enumerate(up):
        if parent >= 0:
            root, far = find(parent)
            if root == i:
                round_[i] = True
            else:
                top[i], offset[i] = root, far + weight[i]
    for i in range(len(up)):
        find(i)
    return top, offset, [round_[t] for t in top]


def _by_block(run: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs over one block at a time of rows that come sorted by ``key``."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            at = batch[key].to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[0][key].iloc[0] != at[a]:
                    yield from run(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch.iloc[a:b])
        if held:
            yield from run(pd.concat(held, ignore_index=True))

    return over


def _positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted keys, -1 if it does not."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _block_forest(paths: bool):
    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values("node", kind="stable", ignore_index=True)
        node, parent, has = rows["node"].to_numpy(), rows["parent"].to_numpy(), rows["has"].to_numpy(dtype=bool)
        inside = np.where(has, _positions(node, parent), -1)
        up = inside.tolist()
        top, off, circle = (np.array(x) for x in weighted_forest(up, [1] * len(up)))
        out = pd.DataFrame({"node": node, "top": node[top], "off": np.where(circle, -1, off), "circle": circle})
        outer = has & (inside < 0)
        out["ext"] = pd.array(parent[top], dtype="Int64")
        out.loc[~outer[top] | circle, "ext"] = pd.NA
        if not paths:
            yield out
            return
        ids, begin, cells = node.tolist(), 0, 0
        segments: list[list[int] | None] = []
        for i, below in enumerate(circle.tolist()):
            way = None
            if not below:
                way, j = [ids[i]], up[i]
                while j >= 0:
                    way.append(ids[j])
                    j = up[j]
                way.reverse()
                cells += len(way)
            segments.append(way)
            if cells >= CELLS or i == len(ids) - 1:
                yield out.iloc[begin : i + 1].assign(segment=segments)
                begin, cells, segments = i + 1, 0, []

    return run


def resolve_forest(links: DataFrame, block: int = BLOCK, paths: bool = False, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(node, root, depth[, path]) of links (node, parent), one row per node.

    ``path`` is the array of ids from the root to the node; it is null for nodes on or below
    a circle.
    """
    schema = "node long, top long, off long, circle boolean, ext long" + (", segment array<long>" if paths else "")
    blocks = links.select(
        F.expr(f"node div {int(block)}").alias("block"),
        "node",
        F.coalesce("parent", F.lit(0).cast("long")).alias("parent"),
        F.col("parent").isNotNull().alias("has"),
    ).repartition("block").sortWithinPartitions("block")
    local = cut(blocks.mapInPandas(_by_block(_block_forest(paths), "block"), schema))

    tops = local.where("off = 0 and ext is not null and not circle")
    target = local.select(F.col("node").alias("ext"), F.col("top").alias("nxt"), F.col("off").alias("w"), F.col("circle").alias("round"), F.col("ext").isNotNull().alias("goes_on"), *([F.col("segment").alias("way")] if paths else []))
    joined = tops.select("top", "ext").join(target, "ext", "left")
    missing = F.col("nxt").isNull()
    crossing = cut(
        joined.select(
            "top",
            F.coalesce("nxt", "top").alias("nxt"),
            F.when(missing, 0).otherwise(F.col("w") + 1).alias("w"),
            F.when(F.col("round"), 2).when(missing | ~F.col("goes_on"), 1).otherwise(0).alias("state"),
            *([F.when(missing, F.array().cast("array<long>")).otherwise(F.col("way")).alias("way")] if paths else []),
        )
    )
    crossing = _double(_merge_levels(crossing, block, paths, merge_rows), paths)

    solved = crossing.select("top", "nxt", "w", "state", *(["way"] if paths else []))
    out = local.join(solved, "top", "left")
    bad = F.col("circle") | (F.coalesce("state", F.lit(1)) == 2)
    columns = [
        "node",
        F.when(bad, F.lit(-1)).otherwise(F.coalesce("nxt", "top")).cast("long").alias("root"),
        F.when(bad, F.lit(-1)).otherwise(F.col("off") + F.coalesce("w", F.lit(0))).cast("long").alias("depth"),
    ]
    if paths:
        none: Column = F.array().cast("array<long>")
        columns.append(F.when(~bad, F.concat(F.coalesce("way", none), "segment")).alias("path"))
    return out.select(columns)


def _merged_block(paths: bool):
    """Links between the parts of one block end at the first link that leaves the block, at a root or at a circle."""

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values("top", kind="stable", ignore_index=True).drop(columns="block")
        top, nxt, w, state = (rows[c].to_numpy() for c in ("top", "nxt", "w", "state"))
        up = np.where(state == 0, _positions(top, nxt), -1)
        end, far, circle = (np.array(x) for x in weighted_forest(up.tolist(), w.tolist()))
        far = far + w[end]
        if paths:
            # ways that would fill the task are left to the joins
            if int(far[~circle].sum()) > CELLS * 8:
                yield rows
                return
            ways = [[] if x is None else x for x in rows["way"]]
            done: list[list[int] | None] = [None] * len(ways)
            for i in np.argsort(np.where(circle, -1, far), kind="stable").tolist():
                if not circle[i]:
                    done[i] = list(ways[i]) if up[i] < 0 else [*done[up[i]], *ways[i]]
            rows["way"] = [[] if x is None else x for x in done]
        yield rows.assign(nxt=nxt[end], w=far, state=np.where(circle, 2, state[end]).astype("int32"))

    return run


def _merge_levels(crossing: DataFrame, block: int, paths: bool, merge_rows: int) -> DataFrame:
    """Merges links between blocks level by level, while the largest block of a level holds at most ``merge_rows`` links.

    state: 0 open (``nxt`` is the top of another block that goes on), 1 ends at the root ``nxt``, 2 on or below a circle.
    """
    schema = crossing.schema
    span = block
    while True:
        span *= FAN
        at = F.expr(f"top div {span}")
        sizes = crossing.groupBy(at.alias("block")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == 0).alias("open"))
        total = sizes.agg(F.max("n").alias("most"), F.sum("open").alias("open"), F.count("*").alias("blocks")).first()
        if not total["open"] or total["most"] > merge_rows:
            return crossing
        blocks = crossing.select(at.alias("block"), *crossing.columns).repartition("block").sortWithinPartitions("block")
        before, crossing = crossing, cut(blocks.mapInPandas(_by_block(_merged_block(paths), "block"), schema))
        release(before)
        if total["blocks"] == 1:
            return crossing


def _double(crossing: DataFrame, paths: bool) -> DataFrame:
    """Doubles the reach of every open link until each ends at a root or a circle; ``least`` is the smallest top passed, a top that passes itself is on a circle."""
    crossing = crossing.withColumn("least", F.col("nxt"))
    merged = None
    while True:
        counts = crossing.agg(
            F.count_if(F.col("state") == 0).alias("open"),
            F.count_if((F.col("state") == 0) & (F.col("least") == F.col("top"))).alias("circles"),
        ).first()
        if not counts["open"]:
            return crossing
        if counts["circles"]:
            on = crossing.where("state = 0 and least = top").select(F.col("top").alias("least"), F.lit(2).alias("mark"))
            crossing = crossing.join(on, "least", "left").withColumn("state", F.when((F.col("state") == 0) & F.col("mark").isNotNull(), 2).otherwise(F.col("state"))).drop("mark")
        far = crossing.select(
            F.col("top").alias("nxt"),
            F.col("nxt").alias("nxt2"),
            F.col("w").alias("w2"),
            F.col("least").alias("least2"),
            F.col("state").alias("state2"),
            *([F.col("way").alias("way2")] if paths else []),
        )
        is_open = F.col("state") == 0
        step = crossing.where(is_open).join(far, "nxt").select(
            "top",
            F.col("nxt2").alias("nxt"),
            (F.col("w") + F.col("w2")).alias("w"),
            F.col("state2").alias("state"),
            *([F.when(F.col("state2") < 2, F.concat("way2", "way")).otherwise(F.col("way")).alias("way")] if paths else []),
            F.least("least", "least2").alias("least"),
        )
        crossing = cut(crossing.where(~is_open).select(step.columns).unionByName(step))
        if merged is not None:
            release(merged)
        merged = crossing


def descendants(resolved: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every node above another, from ``resolve_forest(paths=True)``."""
    steps = resolved.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return steps.where("node <> descendant").select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(node, n_descendants) for every node, 0 included (also for nodes on or below a circle).

    Round k knows the descendants nearer than 2**k and the ancestor 2**k above; a node adds what the
    nodes 2**k below it know. So the rows stay as many as the nodes whatever the depth, and a node
    with very many children is summed before the shuffle.
    """
    parents = links.join(resolved.where("depth > 0").select("node"), "node", "left_semi").select("node", F.col("parent").alias("above"))
    state = cut(resolved.select("node").join(parents, "node", "left").select("node", "above", F.lit(0).cast("long").alias("n_descendants")))
    while not state.where("above is not null").isEmpty():
        add = state.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.sum(F.col("n_descendants") + 1).alias("more"))
        far = state.select(F.col("node").alias("above"), F.col("above").alias("further"))
        known = state.where("above is not null").join(far, "above").select("node", "further")
        step = state.select("node", "n_descendants").join(add, "node", "left").join(known, "node", "left")
        before, state = state, cut(step.select("node", F.col("further").alias("above"), (F.col("n_descendants") + F.coalesce("more", F.lit(0))).alias("n_descendants")))
        release(before)
    return state.select("node", "n_descendants")

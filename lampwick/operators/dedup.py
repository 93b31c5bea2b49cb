"""Removing duplicate pages by the ids that their texts hold.

Input rows: video_key, page_type, image_path, pos (input order), frame_index,
unique_ids. Results have video_key, page_type, image_path, pos, action
('kept' or 'removed') and reason.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import file_name
from ..workdir import looked_up, materialise, typed
from .ranges import beside, blocks_before, dealt, over, ranged, within

PART = ["video_key", "page_type"]
OUT = [*PART, "image_path", "pos", "action", "reason"]
DEFAULT_WINDOW = 100
#: Islands of more pages and ids than this are covered by blocks of so many pages.
LARGE_ISLAND, COVER_BLOCK = 20_000, 5_000
# The reasons.
ONLY, MIDDLE, FIRST, REPEATED = "唯一页面", "中间页面(%d选1)", "首个页面(%d选1)", "重复ID，保留中间页面"
UNCOVERED, COVERING, COVERED = "无目标ID需要覆盖", "覆盖率最小集合保留", "覆盖率最小集合移除"
NEAR, FAR = "滑动窗口去重移除", "滑动窗口去重保留"


def _first_id(df: DataFrame) -> DataFrame:
    return df.withColumn("_id", F.try_element_at("unique_ids", F.lit(1))).where(F.col("_id").isNotNull())


def _out(df: DataFrame, kept, why) -> DataFrame:
    return df.withColumns({"action": F.when(kept, "kept").otherwise("removed"), "reason": why}).select(*OUT)


def global_id_dedup(pages: DataFrame, middle: bool = True) -> DataFrame:
    """Keeps one page for each first id: the middle one by file name, or the first. Pages without ids give no row.

    Pages are numbered by ranges, so that an id with very many pages is sorted
    by many tasks; what all pages of an id need is one row, joined to them. A
    page with the path of the kept one gives no row either.
    """
    own = [*PART, "_id"]
    rows = _first_id(pages).select(*PART, "_id", "image_path", "pos").withColumn("_name", file_name(F.col("image_path")))
    rows = ranged(rows, own, [F.col("_name"), F.col("pos"), F.col("image_path")])
    order = blocks_before(own)
    blocks = rows.groupBy("_range", *own).agg(F.count("*").alias("_n"))
    blocks = blocks.select("_range", *own, F.sum("_n").over(order).alias("_end"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n_id"), F.col("_n"))
    numbered = beside(rows, blocks.select("_range", *own, (F.col("_end") - F.col("_n")).alias("_before"), F.col("_n_id").alias("_n")), ["_range", *own])
    chosen = F.col("_before") + F.col("_row") - 1 == (F.floor(F.col("_n") / 2) if middle else F.lit(0))
    numbered = numbered.withColumn("_kept", chosen)
    df = beside(numbered, numbered.where("_kept").select(*own, F.col("image_path").alias("_path")), own).where(F.col("_kept") | (F.col("image_path") != F.col("_path")))
    why = F.when(F.col("_n") == 1, ONLY).when(F.col("_kept"), F.format_string(MIDDLE if middle else FIRST, "_n")).otherwise(REPEATED)
    return _out(df, F.col("_kept"), why)


def _near(batches):
    """Adds whether a row is kept to rows that come in the order of their groups and frames; only the last kept frame is held."""
    group, last = None, None
    for batch in batches:
        keep = []
        for *key, window, frame in zip(*(batch.column(c).to_pylist() for c in (*PART, "_id", "_window", "frame_index"))):
            if (key, window) != group:
                group, last = (key, window), None
            keep.append(frame is None or frame < 0 or last is None or frame - last > window or frame == last)
            if keep[-1] and frame is not None and frame >= 0:
                last = frame
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PART, "image_path", "pos")), pa.array(keep, pa.bool_())], names=[*PART, "image_path", "pos", "_kept"])


def _followed(frames: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted frames: the place of the next frame that would be kept after each, and of the last one that the chain from it keeps here."""
    after = np.searchsorted(frames, frames + window, side="right")
    last = np.where(after < len(frames), after, np.arange(len(frames)))
    while (last[last] != last).any():
        last = last[last]
    return after, last


def _entries(frames: np.ndarray, window: int) -> np.ndarray:
    """Places where a chain can enter a block: no kept frame before the block hides more than the window's frames after its first."""
    return np.flatnonzero(np.concatenate([[True], frames[:-1] < frames[0] + window]))


def _chain_frames(nodes: DataFrame) -> DataFrame:
    """(_g, frame_index): frames that the windows keep, of groups that lie in any number of ranges.

    nodes: _g, _window, frame_index, _range; distinct frames. For each place
    where a block can be entered its task finds where the chain leaves it; the
    block entered next is the first later one that ends beyond the window. These
    links are composed by doubling, so a chain through n blocks takes
    log2(n) joins, and what the start reaches is entered: at most one place in a block.
    """
    blocks = nodes.groupBy("_g", "_range").agg(F.min("frame_index").alias("low"), F.max("frame_index").alias("high"))
    lists: dict[int, list] = {}
    for r in blocks.orderBy("_g", "_range").collect():  # a row for each range, and one more for each of the groups, which are large
        lists.setdefault(r["_g"], []).append((r["_range"], r["low"], r["high"]))

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_index")
        frames, window, g, at = part["frame_index"].to_numpy(dtype=np.int64), int(part["_window"].iloc[0]), int(part["_g"].iloc[0]), int(part["_range"].iloc[0])
        _, last = _followed(frames, window)
        own = _entries(frames, window)
        over = frames[last[own]] + window
        later = [(r, high) for r, _, high in lists[g] if r > at]
        place = np.searchsorted(np.array([h for _, h in later], dtype=np.int64), over, side="right")
        to = [later[p][0] if p < len(later) else None for p in place.tolist()]
        return pd.DataFrame({"_g": g, "_range": at, "entry": frames[own], "over": over, "to": pd.array(to, dtype="Int32")})

    found = materialise(nodes.groupBy("_g", "_range").applyInPandas(links, "_g long, _range int, entry long, over long, to int"), "links")
    asked = found.where("to IS NOT NULL").select("_g", F.col("to").alias("_range"), F.col("over").alias("v"), F.lit(None).cast("long").alias("e"), F.col("entry").alias("from"))
    there = found.select("_g", "_range", F.col("entry").alias("v"), F.col("entry").alias("e"), F.lit(None).cast("long").alias("from"))
    above = Window.partitionBy("_g", "_range").orderBy(F.desc("v"), F.asc_nulls_first("e")).rowsBetween(Window.unboundedPreceding, 0)
    links_ = asked.unionByName(there).withColumn("next", F.min("e").over(above)).where(F.col("from").isNotNull()).select("_g", F.col("from").alias("entry"), "next")
    jumps = [materialise(links_, "jumps")]
    for _ in range(max(map(len, lists.values()), default=1).bit_length() - 1):
        ahead = jumps[-1].select("_g", F.col("entry").alias("next"), F.col("next").alias("far")).hint("merge")
        jumps.append(materialise(jumps[-1].join(ahead, ["_g", "next"]).select("_g", "entry", F.col("far").alias("next")), "jumps"))
    first = nodes.groupBy("_g").agg(F.min("frame_index").alias("entry"))
    reached = materialise(first, "reached")
    for jump in reversed(jumps):
        reached = materialise(reached.unionByName(reached.join(jump.hint("merge"), ["_g", "entry"]).select("_g", F.col("next").alias("entry"))), "reached")

    def kept(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_index")
        frames = part["frame_index"].to_numpy(dtype=np.int64)
        after = np.searchsorted(frames, frames + int(part["_window"].iloc[0]), side="right")
        start, out = part["entry"].dropna(), []
        at = int(np.searchsorted(frames, int(start.iloc[0]))) if len(start) else len(frames)
        while at < len(frames):
            out.append(at)
            at = int(after[at])
        return typed(pd.DataFrame({"_g": int(part["_g"].iloc[0]), "frame_index": frames[out]}), _g="long", frame_index="long")

    marked = nodes.join(reached.withColumn("frame_index", F.col("entry")).hint("merge"), ["_g", "frame_index"], "left")
    return marked.groupBy("_g", "_range").applyInPandas(kept, "_g long, frame_index long")


def sliding_window_dedup(pages: DataFrame, window: int | Column = DEFAULT_WINDOW) -> DataFrame:
    """Drops a page if a kept page with its first id is at most ``window`` frames before it.

    Ids don't meet each other, and only the last kept frame of an id matters. An
    id is sorted by frame and streams by, one frame held; one over ranges.LARGE
    rows is dealt out by ranges of frames and goes the way of _chain_frames(),
    whatever its share of the rows. Frames without an index (-1) never conflict.
    ``window`` may be a column; pages with different windows don't meet.
    """
    window = F.lit(window) if isinstance(window, int) else window
    rows = _first_id(pages.withColumn("_window", F.when(window > 0, window).otherwise(DEFAULT_WINDOW)))
    group = [*PART, "_id", "_window"]
    rows = rows.select(*group, F.col("frame_index").cast("long").alias("frame_index"), "pos", "image_path")
    schema = T.StructType([*(rows.schema[c] for c in (*PART, "image_path", "pos")), T.StructField("_kept", T.BooleanType())])

    def streamed(df: DataFrame) -> DataFrame:
        return df.repartition(*group).sortWithinPartitions(*group, "frame_index", "pos", "image_path").mapInArrow(_near, schema)

    large = over(rows, group)
    if not large.limit(1).count():
        done = streamed(rows)
    else:
        rows, large = materialise(rows, "frames"), materialise(large.withColumn("_g", F.monotonically_increasing_id()), "large")
        hint = "broadcast" if large.count() <= 10_000 else "merge"
        hot = materialise(beside(rows, large, group, "inner", hint), "hot")
        nodes = dealt(hot.where("frame_index >= 0").select("_g", "_window", "frame_index").distinct(), ["_g"], [F.col("frame_index")])
        kept = _chain_frames(nodes).withColumn("_in", F.lit(True))
        free = F.col("frame_index").isNull() | (F.col("frame_index") < 0)
        chosen = hot.join(kept.hint("merge"), ["_g", "frame_index"], "left").select(*PART, "image_path", "pos", (free | F.col("_in").isNotNull()).alias("_kept"))
        done = streamed(beside(rows, large, group, "left_anti", hint)).unionByName(chosen)
    return _out(done, F.col("_kept"), F.when(F.col("_kept"), FAR).otherwise(NEAR))


def _islands(pages: DataFrame) -> DataFrame:
    """Pages with ``island``, ``any_id`` (of the video's type), _range and _row. Runs are counted within ranges; a table of blocks tells what came before and whether a run goes on."""
    ids = F.coalesce("unique_ids", F.array().cast("array<string>")) if "unique_ids" in pages.columns else F.array().cast("array<string>")
    by = [F.col("frame_index"), F.col("pos"), F.col("_path"), F.col("_ids")]
    path = F.col("image_path") if "image_path" in pages.columns else F.lit(None).cast("string")
    rows = ranged(pages.withColumns({"_ids": ids, "_path": path}), PART, by)
    own = within(PART).orderBy(*by)
    new = F.when(F.lag("frame_index").over(own) == F.col("frame_index") - 1, 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("frame_index", "pos")
    blocks = rows.groupBy("_range", *PART).agg(F.min(at)["frame_index"].alias("low"), F.max(at)["frame_index"].alias("high"), F.sum("_new").alias("runs"), F.max(F.size("_ids") > 0).alias("has"))
    order = blocks_before(PART)
    blocks = blocks.withColumn("on", F.when(F.lag("high").over(order) == F.col("low") - 1, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("runs") - F.col("on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_range", *PART, (before - F.col("on")).alias("_before"), F.max("has").over(Window.partitionBy(*PART)).alias("any_id"))
    return beside(rows, blocks, ["_range", *PART]).withColumn("island", F.col("_before") + F.col("_run")).drop("_new", "_run", "_before", "_path")


def coverage_islands(pages: DataFrame) -> DataFrame:
    """Adds ``island``: runs of pages, in order, whose frame index follows the one before."""
    return _islands(pages).select(*pages.columns, "island")


def greedy_cover(sets: list[set]) -> list[bool]:
    """Which sets a greedy cover takes: always one that adds most, the earliest of equals.

    What a set adds only falls, so it is counted again only when it comes up.
    """
    left = set().union(*sets) if sets else set()
    kept = [False] * len(sets)
    heap = [(-len(s), i) for i, s in enumerate(sets)]
    heapify(heap)
    while left:
        _, i = heap[0]
        own = sets[i] & left
        if -len(own) > heap[0][0]:
            heapreplace(heap, (-len(own), i))
            continue
        heappop(heap)
        kept[i] = True
        left -= own
    return kept


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _covers(islands: pd.Series) -> pd.Series:
    """greedy_cover() of each island's id lists, over Arrow batches of islands."""
    return islands.map(lambda pages: greedy_cover([set(ids) if ids is not None else set() for ids in pages]))


def block_cover(pages: dict[int, set], outside: dict) -> dict[int, set]:
    """The pages of a block that a greedy cover of the whole island takes for certain, with what each adds.

    pages: uncovered ids by place; outside: by id the best (gain, -place) of
    pages in other blocks. A page's gain only falls, so what outside pages had
    at the start is the most that they can have. A page is taken if no page
    that shares an id with it can come before it. One that must wait makes
    those wait that share an id with it and come after.
    """
    heap = [(-len(ids), at) for at, ids in pages.items()]
    heapify(heap)
    covered, waiting, taken = set(), set(), {}
    while heap:
        gain, at = heap[0]
        own = pages[at] - covered
        if not own:
            heappop(heap)
        elif len(own) < -gain:
            heapreplace(heap, (-len(own), at))
        else:
            heappop(heap)
            if own & waiting or any(outside.get(i, (0, 0)) > (len(own), -at) for i in own):
                waiting |= own
            else:
                taken[at] = own
                covered |= own
    return taken


def _large_cover(rows: DataFrame) -> DataFrame:
    """(_g, _at): pages that a greedy cover takes, from (_g, _block, _at, id), the ids of islands that no task holds.

    Each round every block takes what it can be sure of, given the best page of
    other blocks for each of its ids; what is covered goes from all. The best page
    of all is always taken, so rounds end; on a chain of pages that all
    wait for the one before, a round settles a block or more.
    """

    def local(part: pd.DataFrame) -> pd.DataFrame:
        pages: dict[int, set] = {}
        for at, i in zip(part["_at"].tolist(), part["id"].tolist()):
            pages.setdefault(at, set()).add(i)
        known = part[part["gain"].notna()].drop_duplicates("id")
        outside = dict(zip(known["id"], zip(known["gain"].astype("int64").tolist(), known["late"].astype("int64").tolist())))
        taken = [(at, i) for at, ids in block_cover(pages, outside).items() for i in ids]
        return typed(pd.DataFrame({"_g": int(part["_g"].iloc[0]), "_at": [at for at, _ in taken], "id": [i for _, i in taken]}), _g="long", _at="long", id="string")

    left, taken = materialise(rows.distinct(), "uncovered"), None
    while left.limit(1).count():
        gains = left.groupBy("_g", "_block", "_at").agg(F.count("*").alias("gain")).hint("merge")
        key = F.struct("gain", (-F.col("_at")).alias("late"))
        tops = left.join(gains, ["_g", "_block", "_at"]).groupBy("_g", "id", "_block").agg(F.max(key).alias("top"))
        place = F.row_number().over(Window.partitionBy("_g", "id").orderBy(F.desc("top"), "_block"))
        two = tops.withColumn("place", place).where("place <= 2").groupBy("_g", "id").agg(F.max(F.when(F.col("place") == 1, F.struct("_block", "top"))).alias("one"), F.max(F.when(F.col("place") == 2, F.col("top"))).alias("two"))
        other = F.when(F.col("one._block") == F.col("_block"), F.col("two")).otherwise(F.col("one.top"))
        seen = left.join(two.hint("merge"), ["_g", "id"]).select("_g", "_block", "_at", "id", other["gain"].alias("gain"), other["late"].alias("late"))
        new = materialise(seen.groupBy("_g", "_block").applyInPandas(local, "_g long, _at long, id string"), "taken")
        own = new.select("_g", "_at").distinct()
        taken = own if taken is None else taken.unionByName(own)
        left = materialise(left.join(new.select("_g", "id").distinct().hint("merge"), ["_g", "id"], "left_anti"), "uncovered")
    return taken if taken is not None else rows.select("_g", "_at").where("false")


def coverage_min_set_dedup(pages: DataFrame, large: int = LARGE_ISLAND, block: int = COVER_BLOCK) -> DataFrame:
    """Keeps, in each island, the pages of a greedy cover of its ids. Without any id in a video's type all pages go.

    An island of up to ``large`` pages and ids is one row with its pages in
    order, so that a batch of many islands goes to Python at once; those of one
    page need no cover and stay in the JVM. Larger ones are covered in rounds
    over blocks of ``block`` pages, with the same result: see _large_cover().
    """
    split = _islands(pages).select(*PART, "island", "any_id", "_range", "_row", "frame_index", "pos", "image_path", F.col("_ids").alias("ids"))
    key = [*PART, "island"]
    sizes = split.groupBy(*key).agg(F.sum(1 + F.size("ids")).alias("_size"))
    split = materialise(beside(split, sizes, key), "islands")
    page = F.struct("frame_index", "pos", "image_path", "ids")
    islands = split.where(F.col("_size") <= large).groupBy(*key).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.first("any_id").alias("any_id"))
    lone = F.size("pages") == 1
    single = islands.where(lone).withColumn("kept", F.array(F.size(F.col("pages")[0]["ids"]) > 0))
    several = islands.where(~lone).withColumn("kept", _covers(F.transform("pages", lambda p: p["ids"])))
    rows = single.unionByName(several).select(*PART, "any_id", F.explode(F.arrays_zip(F.col("pages").alias("p"), F.col("kept").alias("k"))).alias("r"))
    rows = rows.select(*PART, "any_id", "r.p.image_path", "r.p.pos", F.col("r.k").alias("kept"))
    wide = split.where(F.col("_size") > large)
    if wide.limit(1).count():
        names = materialise(wide.select(*key).distinct().withColumn("_g", F.monotonically_increasing_id()), "names")
        at, part = F.shiftleft(F.col("_range").cast("long"), 40) + F.col("_row"), F.shiftleft(F.col("_range").cast("long"), 32) + F.floor((F.col("_row") - 1) / block)
        wide = materialise(beside(wide, names, key).withColumns({"_at": at, "_block": part}), "wide")
        ids = wide.select("_g", "_block", "_at", F.explode("ids").alias("id")).withColumn("id", F.coalesce(F.concat(F.lit("v"), "id"), F.lit("n")))
        taken = _large_cover(ids).withColumn("_in", F.lit(True)).hint("merge")
        rows = rows.unionByName(wide.join(taken, ["_g", "_at"], "left").select(*PART, "any_id", "image_path", "pos", F.col("_in").isNotNull().alias("kept")))
    return _out(rows, F.col("kept"), F.when(~F.col("any_id"), UNCOVERED).when(F.col("kept"), COVERING).otherwise(COVERED))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "Global_dedup": lambda pages, window: global_id_dedup(pages),
    "SlidingWindow_dedup": sliding_window_dedup,
    "CoverageMinSet_dedup": lambda pages, window: coverage_min_set_dedup(pages),
}


def register_dedup(name: str, strategy: Callable[[DataFrame, int | Column], DataFrame]) -> None:
    STRATEGIES[name] = strategy


def dedup_dispatch(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Each page type by the strategy of its rule; types without a rule go.

    rules: page_type, dedup_strategy, dedup_rule, window_size (text, used where
    it is a number). The strategy name comes first, then the rule; any other name
    (General_dedup too) and none mean the global one. Sliding windows of all sizes
    go through one branch, which gets the size as a column.
    """
    name = F.coalesce(F.nullif(F.trim("dedup_strategy"), F.lit("")), F.nullif(F.trim("dedup_rule"), F.lit("")))
    size = F.col("window_size").try_cast("int")
    known = rules.select("page_type", F.when(name.isin(*STRATEGIES), name).otherwise("Global_dedup").alias("_how"), F.when(size > 0, size).otherwise(DEFAULT_WINDOW).alias("_window"))
    df = pages.join(looked_up(known), "page_type", "left")
    out = df.where("_how IS NULL").withColumns({"action": F.lit("removed"), "reason": F.lit("no rule")}).select(*OUT)
    for how, run in STRATEGIES.items():
        mine = df.where(F.col("_how") == how)
        if how == "SlidingWindow_dedup":
            done = run(mine.select(*pages.columns, "_window"), F.col("_window"))
        else:
            done = run(mine.select(*pages.columns), DEFAULT_WINDOW)
        out = out.unionByName(done)
    return out


def dedup_summary(pages: DataFrame, results: DataFrame) -> DataFrame:
    """total (all input pages), kept, removed and removal_rate by video and type."""
    total = pages.groupBy(*PART).agg(F.count("*").alias("total"))
    done = results.groupBy(*PART).agg(F.count_if(F.col("action") == "kept").alias("kept"), F.count_if(F.col("action") == "removed").alias("removed"))
    df = total.join(done.hint("shuffle_hash"), PART, "left").select(*PART, "total", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("removed", F.lit(0)).alias("removed"))
    return df.withColumn("removal_rate", F.col("removed") / F.col("total") * 100.0)


def dedup_overall(summary: DataFrame) -> DataFrame:
    """By video: before, removed, kept (not below 0), removal_rate."""
    df = summary.groupBy("video_key").agg(F.sum("total").alias("before"), F.sum("removed").alias("removed"))
    return df.withColumns({"kept": F.greatest(F.lit(0), F.col("before") - F.col("removed")), "removal_rate": F.coalesce(F.try_divide(F.col("removed") * 100.0, F.col("before")), F.lit(0.0))})


def union_kept(*results: DataFrame) -> DataFrame:
    """Kept paths of any number of results, once each."""
    out = results[0].where("action = 'kept'").select("video_key", "image_path")
    for r in results[1:]:
        out = out.unionByName(r.where("action = 'kept'").select("video_key", "image_path"))
    return out.distinct()


def kept_semi(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages whose path is kept: repeated pages with a kept path all stay."""
    return pages.join(results.where("action = 'kept'").select("video_key", "image_path").distinct().hint("shuffle_hash"), ["video_key", "image_path"], "left_semi")

"""Order-dependent folds of one scene: each depends on what was accepted before, so a scene is folded as a whole.

They run in parallel over scenes; a scene is one page and fits a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("rectangle", "rounded_rectangle")


def _share(a, b) -> float:
    w = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
    h = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    smaller = min(a.w * a.h, b.w * b.h)
    return w * h / smaller if w > 0 and h > 0 and smaller > 0 else 0.0


def keep_texts(rows: list, least: float = 0.65) -> list:
    """A text that covers an earlier one takes its place if it is longer, else it is dropped."""
    kept: list = []
    for r in rows:
        hit = next((i for i, k in enumerate(kept) if _share(k, r) >= least), None)
        if hit is None:
            kept.append(r)
        elif len(r.text or "") > len(kept[hit].text or ""):
            kept[hit] = r
    return kept


def keep_visuals(rows: list, least: float = 0.80) -> list:
    """A rectangle that covers an earlier one is dropped; other kinds pass."""
    kept: list = []
    for r in rows:
        if r.type in KINDS and any(k.type in KINDS and _share(k, r) >= least for k in kept):
            continue
        kept.append(r)
    return kept


def keep_panels(rows: list, most: float = 0.01) -> list:
    """A panel whose coordinates are all within ``most`` of an accepted one is dropped."""
    kept: list = []
    for r in rows:
        if not any(max(abs(r.x - k.x), abs(r.y - k.y), abs(r.w - k.w), abs(r.h - k.h)) <= most for k in kept):
            kept.append(r)
    return kept


def _scenes(batches, at: int):
    """Whole scenes from batches sorted by scene: lists of rows; a scene may go over several batches."""
    held: list = []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if held and held[0][at] != row[at]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def fold(df: DataFrame, rule, *, key: str = "scene_id", order: str = "ordinal") -> DataFrame:
    """The rows of each scene that ``rule`` keeps, taken in order: one sort by scene, then one pass over each partition."""
    columns, at = df.columns, df.columns.index(key)

    def run(batches):
        out: list = []
        for rows in _scenes(batches, at):
            out += rule(rows)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, df.schema)


def regular_run(positions: list[int]) -> list[int]:
    """The longest subset with even gaps: all within max(5, 45 %) of their upper median, which exceeds 4; three positions at least.

    Ties go to the widest span, then to the first in order of combinations. For each gap that may be the upper
    median a dynamic programme finds the longest path over admissible gaps that has it as its median: it keeps, for
    each position, number of gaps and surplus of shorter over longer gaps, the most gaps equal to the median.
    """
    pos = np.array(sorted(positions))
    found, most = [], 1
    for m, gaps in sorted(_medians(pos), key=lambda x: -x[1]):
        if gaps < most:
            break
        ends = _closes(_paths(pos, m, gaps, len(pos)))
        n = max(np.flatnonzero(ends.any(0)), default=0)
        if n > most:
            found, most = [], n
        if n == most:
            found.append((m, np.flatnonzero(ends[:, n])))
    best: tuple = ()
    for m, ends in found:
        for end in ends[::-1]:
            if best and pos[end] - pos[0] < best[0]:
                break
            back = _paths(-pos[end::-1], m, most, 1)[::-1]
            starts = np.flatnonzero(_closes(back)[:, most])
            if not best or pos[end] - pos[starts[0]] >= best[0]:
                run = _first_run(pos, back, m, int(starts[0]), most)
                best = min(best or (pos[end] - pos[starts[0]], run), (pos[end] - pos[starts[0]], run), key=lambda x: (-x[0], x[1]))
    return [pos[i].item() for i in best[1]] if best and most >= 2 else []


def _medians(pos: np.ndarray) -> list[tuple]:
    """The gaps that may be an upper median, each with the most gaps that fit with it between the first and last position."""
    out = []
    gaps = np.unique(pos[None, :] - pos[:, None])
    for m in gaps[gaps > 4]:
        low = gaps[(gaps >= 0) & (m - gaps <= max(5, 0.45 * m))].min()
        n = 1
        while n < len(pos) - 1 and (n + 1 - (n + 1) // 2) * m + (n + 1) // 2 * low <= pos[-1] - pos[0]:
            n += 1
        out.append((m, n))
    return out


def _paths(pos: np.ndarray, m, n: int, starts: int) -> np.ndarray:
    """[position, gaps, n + surplus of shorter gaps]: the most gaps equal to ``m`` on a path that ends there and begins at one of the first ``starts`` positions, negative where there is none."""
    most = np.full((len(pos), n + 1, 2 * n + 1), -30_000, np.int16)
    most[:starts, 0, n] = 0
    for k in range(1, len(pos)):
        gap = pos[k] - pos[:k]
        fits = np.abs(gap - m) <= max(5, 0.45 * m)
        for which, into, out, equal in ((gap < m, slice(1, None), slice(None, -1), 0), (gap == m, slice(None), slice(None), 1), (gap > m, slice(None, -1), slice(1, None), 0)):
            before = np.flatnonzero(fits & which)
            if len(before):
                np.maximum(most[k, 1:, into], most[before, :-1, out].max(0) + np.int16(equal), out=most[k, 1:, into])
    return most


def _closes(most: np.ndarray, equal: int = 0, surplus: int = 0) -> np.ndarray:
    """Where a path, after one with these counts, has ``m`` as its upper median: shorter gaps at most half, longer ones less than half."""
    d = np.arange(most.shape[-1]) - most.shape[-1] // 2 + surplus
    return ((most >= 0) & (most + equal >= np.maximum(d, 1 - d))).any(-1)


def _first_run(pos: np.ndarray, back: np.ndarray, m, at: int, n: int) -> list[int]:
    """Of the paths of ``n`` gaps from ``at`` the first in order of combinations."""
    run, equal, surplus = [at], 0, 0
    for left in range(n - 1, -1, -1):
        for k in range(at + 1, len(back)):
            gap = pos[k] - pos[at]
            e, d = equal + int(gap == m), surplus + int(gap < m) - int(gap > m)
            if abs(gap - m) <= max(5, 0.45 * m) and _closes(back[k, left], e, d):
                at, equal, surplus = k, e, d
                run.append(k)
                break
    return run


def regular_runs(df: DataFrame, *, key: str = "scene_id", value: str = "pos") -> DataFrame:
    """(key, pos) of each scene's most regular lines."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        out: list = []
        for rows in _scenes(batches, 0):
            out += [(rows[0][0], p) for p in regular_run([r[1] for r in rows])]
        yield pd.DataFrame(out, columns=[key, "pos"])

    return df.select(key, value).repartition(key).sortWithinPartitions(key, value).mapInPandas(run, f"{key} {kind}, pos long")


def match_media(nodes: DataFrame, media: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, id, media): each image node in order takes the unused media nearest by (size difference, hash distance)."""
    kind = dict(nodes.dtypes)[key]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pool, out = list(right.sort_values("name").itertuples()), []
        for n in left.sort_values("ordinal").itertuples():
            if not pool:
                break
            at = min(range(len(pool)), key=lambda i: (abs(pool[i].width - n.width) + abs(pool[i].height - n.height), ((pool[i].dhash ^ n.dhash) & ((1 << 64) - 1)).bit_count()))
            out.append((getattr(n, key), n.id, pool.pop(at).name))
        return pd.DataFrame(out, columns=[key, "id", "media"])

    return nodes.groupBy(key).cogroup(media.groupBy(key)).applyInPandas(run, f"{key} {kind}, id string, media string")

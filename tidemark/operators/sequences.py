"""Rules that walk a sequence in order: one clip or frame at a time, over Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches whose rows are in the order of their first column, as tables that hold groups as a whole; with the first row of each group, and the number of rows at last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(0)).run_ends.to_numpy()
        cut = int(ends[-2]) if len(ends) > 1 else 0
        # the last group may go on in the next batch
        if held and (cut or held[-1].column(0)[-1] != batch.column(0)[0]):
            yield _grouped([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield _grouped([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield _grouped(held)


def _grouped(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    return t, np.r_[0, pc.run_end_encode(t.column(0).chunk(0)).run_ends.to_numpy()]


def _floats(t: pa.Table, name: str) -> np.ndarray:
    return t[name].cast(pa.float64(), safe=False).to_numpy()


def _ordered(t: pa.Table, name: str) -> np.ndarray:
    """Numbers in the order of a column's values."""
    return np.unique(t[name].to_numpy(), return_inverse=True)[1]


def each_group(df: DataFrame, by: str, run, kind: str) -> DataFrame:
    """Tables of whole groups and their first rows through run(), many groups at a time."""
    def through(batches):
        for t, first in whole_groups(batches):
            yield from run(t, first).to_batches()

    return df.repartition(by).sortWithinPartitions(by).mapInArrow(through, kind)


def kept_rows(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, threshold: float) -> np.ndarray:
    """Rows that stay, of boxes in the order of their groups and of falling score: each round, the first that is left in every group stays, and those that overlap it by more than the threshold go."""
    left, keep = np.arange(len(group)), []
    while len(left):
        g = group[left]
        new = np.r_[True, g[1:] != g[:-1]]
        top = left[new]
        keep.append(top)
        i, rest = np.repeat(top, np.diff(np.r_[np.flatnonzero(new), len(left)]))[~new], left[~new]
        both = np.clip(np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest]), 0, None) * np.clip(np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest]), 0, None)
        union = w[i] * h[i] + w[rest] * h[rest] - both
        left = rest[~(np.divide(both, union, out=np.zeros(len(rest)), where=union > 0) > threshold)]
    return np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)


def kept_boxes(boxes: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Boxes (det, x, y, w, h, score) of one group by falling score; one that overlaps a kept one by more than the threshold goes."""
    b = boxes.sort_values(["score", "det"], ascending=[False, True], kind="stable")
    return b.iloc[kept_rows(np.zeros(len(b), np.int64), *(b[c].to_numpy(float) for c in "xywh"), threshold)]


def box_suppression(boxes: DataFrame, by: str, threshold: float) -> DataFrame:
    """The rows that kept_boxes() leaves of each group."""
    def run(t: pa.Table, first: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((_ordered(t, "det"), -_floats(t, "score"), group))
        return t.take(order[kept_rows(group, *(_floats(t, c)[order] for c in "xywh"), threshold)])

    own = boxes.select(by, "det", "x", "y", "w", "h", "score")
    return each_group(own, by, run, own.schema)


def line_numbers(texts: list[str], starts: list[float], ends: list[float], chars: int = 22, gap: float = 1.0) -> list[int]:
    """Caption line of each word: a line holds `chars` characters with its blanks, and a pause of more than `gap` ends it."""
    out, line, held = [], 0, 0
    for k, t in enumerate(texts):
        if k and (held + 1 + len(t) > chars or starts[k] - ends[k - 1] > gap):
            line, held = line + 1, len(t)
        else:
            held += len(t) + (1 if k else 0)
        out.append(line)
    return out


def caption_lines(words: DataFrame, by: str, tail: float = 0.5) -> DataFrame:
    """Lines (by, line, text, start_s, end_s) of words (by, idx, text, start_s, end_s); a line stays `tail` longer, but not into the next one."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        return p.assign(line=line_numbers(p["text"].tolist(), p["start_s"].tolist(), p["end_s"].tolist()))[[by, "idx", "line", "text", "start_s", "end_s"]]

    own = words.select(by, "idx", "text", "start_s", "end_s")
    kind = own.schema[by].dataType.simpleString()
    numbered = own.groupBy(by).applyInPandas(run, f"{by} {kind}, idx long, line long, text string, start_s double, end_s double")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    lines = numbered.groupBy(by, "line").agg(text.alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    after = F.expr(f"lead(start_s) OVER (PARTITION BY {by} ORDER BY line)")
    return lines.withColumn("end_s", F.least(F.col("end_s") + tail, after))


def accepted(times: list[float], least: float) -> list[float]:
    """Times at least `least` after the last accepted one."""
    out: list[float] = []
    for t in sorted(times):
        if not out or t - out[-1] >= least:
            out.append(t)
    return out


def onsets(events: DataFrame, by: str, least: float) -> DataFrame:
    """Onsets (by, t) with a refractory time."""
    own = events.select(by, "t")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t = accepted(p["t"].tolist(), least)
        return pd.DataFrame({by: [p[by].iloc[0]] * len(t), "t": t})

    return own.groupBy(by).applyInPandas(run, own.schema)


def aligned(logp: np.ndarray, targets: list[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """First and last frame of each target on the best path through log probabilities [frames, tokens].

    Blanks may stand between targets and must between equal ones.  On a tie a
    path stays where it is and ends on a blank.  None if there are too few frames."""
    n = len(targets)
    if not n:
        return []
    label = np.full(2 * n + 1, blank)
    label[1::2] = targets
    leap = np.zeros(2 * n + 1, bool)
    leap[3::2] = label[3::2] != label[1:-2:2]
    best = np.full(2 * n + 1, -np.inf)
    if not len(logp):
        return None
    best[:2] = logp[0, label[:2]]
    back = np.zeros((len(logp), 2 * n + 1), np.int8)
    for t in range(1, len(logp)):
        one = np.r_[-np.inf, best[:-1]]
        two = np.where(leap, np.r_[-np.inf, -np.inf, best[:-2]], -np.inf)
        step = np.where(one > best, 1, 0)
        top = np.maximum(one, best)
        back[t] = np.where(two > top, 2, step)
        best = np.maximum(top, two) + logp[t, label]
    at = 2 * n - 1 if best[2 * n - 1] > best[2 * n] else 2 * n
    if not np.isfinite(best[at]):
        return None
    first, last = [0] * n, [-1] * n
    for t in range(len(logp) - 1, -1, -1):
        if at % 2:
            first[at // 2] = t
            last[at // 2] = max(last[at // 2], t)
        at -= int(back[t, at])
    return list(zip(first, last, strict=True))


def forced_alignment(emissions: DataFrame) -> DataFrame:
    """Clips (clip, logp array<array<double>>, targets array<int>) to (clip, pos, token, first_frame, last_frame); a clip too short for its targets has no rows."""
    def run(frames):
        for p in frames:
            rows = []
            for clip, logp, targets in zip(p["clip"], p["logp"], p["targets"], strict=True):
                spans = aligned(np.array([list(r) for r in logp], float), [int(t) for t in targets]) or []
                rows += [(clip, k, int(targets[k]), a, b) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["clip", "pos", "token", "first_frame", "last_frame"])

    return emissions.select("clip", "logp", "targets").mapInPandas(run, "clip long, pos long, token long, first_frame long, last_frame long")


# Seconds below which a word is a flash, and the most that one is given.
FLASH_S, ROOM_S = 0.15, 0.5


def respread(texts: list[str], starts: list[float], ends: list[float], long: float) -> tuple[list[float], list[float]]:
    """Runs of flashes are spread by their characters over the free time before the word that follows, if there is more than they need."""
    starts, ends = list(starts), list(ends)
    flash = [b - a < FLASH_S for a, b in zip(starts, ends, strict=True)] + [False]
    first = None
    for k, short in enumerate(flash):
        if short:
            first = k if first is None else first
        elif first is not None:
            low, high = ends[first - 1] if first else 0.0, starts[k] if k < len(texts) else long
            if high - low > (k - first) * FLASH_S:
                size = [max(1, len(t)) for t in texts[first:k]]
                room = min((k - first) * ROOM_S, high - low)
                edges = high - room + room * np.r_[0, np.cumsum(size)] / sum(size)
                starts[first:k], ends[first:k] = edges[:-1].tolist(), np.minimum(edges[1:], high).tolist()
            first = None
    return starts, ends


def flash_respread(words: DataFrame, by: str, long: str) -> DataFrame:
    """Words (by, idx, text, start_s, end_s, and the clip's length) with the times of respread()."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        a, b = respread(p["text"].fillna("").tolist(), p["start_s"].tolist(), p["end_s"].tolist(), float(p[long].iloc[0]))
        return p.assign(start_s=a, end_s=b)[[by, "idx", "text", "start_s", "end_s"]]

    own = words.select(by, F.col("idx").cast("long").alias("idx"), F.col("text").cast("string").alias("text"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), long)
    return own.groupBy(by).applyInPandas(run, own.drop(long).schema)


def stable_runs(subjects: DataFrame, by: str, least: int) -> DataFrame:
    """Subjects (by, bin, subject) as runs (by, first, bins, subject): one of fewer than `least` bins goes to the run before, a short first one to the next.

    Runs are folded in order within a clip; their number, not that of bins, is what is held."""
    order = f"PARTITION BY {by} ORDER BY bin"
    new = subjects.withColumn("_new", F.expr(f"coalesce(subject <> lag(subject) OVER ({order}), true)")).withColumn("_run", F.expr(f"sum(int(_new)) OVER ({order} ROWS UNBOUNDED PRECEDING)"))
    runs = new.groupBy(by, "_run", "subject").agg(F.min("bin").alias("first"), F.count("*").alias("bins"))
    kind = "struct<subject: string, first: bigint, bins: bigint>"
    grow = lambda a, n: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["subject"].alias("subject"), F.element_at(a, -1)["first"].alias("first"), (F.element_at(a, -1)["bins"] + n).alias("bins"))))
    fold = lambda a, r: F.when((F.size(a) > 0) & ((F.element_at(a, -1)["subject"] == r["subject"]) | (r["bins"] < least)), grow(a, r["bins"])).otherwise(F.concat(a, F.array(F.struct(r["subject"].alias("subject"), r["first"].alias("first"), r["bins"].alias("bins")))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("first", "subject", "bins"))), lambda r: F.struct(r["subject"].cast("string").alias("subject"), r["first"].cast("long").alias("first"), r["bins"].alias("bins")))
    out = runs.groupBy(by).agg(F.aggregate(rows, F.expr(f"cast(array() AS array<{kind}>)"), fold).alias("r"))
    lead = (F.size("r") > 1) & (F.col("r")[0]["bins"] < least)
    joined = F.concat(F.array(F.struct(F.col("r")[1]["subject"].alias("subject"), F.col("r")[0]["first"].alias("first"), (F.col("r")[0]["bins"] + F.col("r")[1]["bins"]).alias("bins"))), F.expr("slice(r, 3, size(r))"))
    return out.select(by, F.explode(F.when(lead, joined).otherwise(F.col("r"))).alias("x")).select(by, "x.first", "x.bins", "x.subject")


def character_chunks(tokens: DataFrame, by: str, chars: int = 4) -> DataFrame:
    """Tokens (by, idx, raw, t0, t1, p) as chunks of at most `chars` characters; none is split, and a final mark closes its chunk."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        out, shut = [], True
        for raw, t0, t1, conf in p.sort_values("idx")[["raw", "t0", "t1", "p"]].itertuples(index=False):
            clean = raw.strip()
            if not clean:
                continue
            if shut or len(out[-1][0]) + len(clean) > chars:
                out.append([clean, t0, t1, conf])
            else:
                out[-1] = [out[-1][0] + clean, out[-1][1], t1, min(out[-1][3], conf)]
            shut = len(out[-1][0]) >= chars or clean[-1] in "。！？．…!?"
        return pd.DataFrame([(p[by].iloc[0], k, *x) for k, x in enumerate(out)], columns=[by, "chunk", "text", "start_s", "end_s", "confidence"])

    return tokens.groupBy(by).applyInPandas(run, f"{by} {dict(tokens.dtypes)[by]}, chunk long, text string, start_s double, end_s double, confidence double")


def track_numbers(first: np.ndarray, frame: np.ndarray, cx: np.ndarray, cy: np.ndarray, near: float) -> np.ndarray:
    """Track of each box, within its group; boxes are in the order of groups, frames and detections.

    Each round takes the next box of every group: a group's tracks stand from its first row on, as it has no more tracks than boxes."""
    n = len(frame)
    track, many = np.empty(n, np.int64), np.zeros(len(first) - 1, np.int64)
    u, v, seen = np.empty(n), np.empty(n), np.empty(n, np.int64)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    for j, count in enumerate(live):
        g = order[:count]
        row, k = first[g] + j, many[g].copy()
        own = np.flatnonzero(k)
        if len(own):
            had = k[own]
            begin = np.r_[0, np.cumsum(had)[:-1]]
            of = np.repeat(np.arange(len(own)), had)
            nth = np.arange(len(of)) - begin[of]
            at, box = first[g[own]][of] + nth, row[own][of]
            d = (cx[box] - u[at]) ** 2 + (cy[box] - v[at]) ** 2
            d = np.where((seen[at] == frame[box]) | np.isnan(d), np.inf, d)
            least = np.minimum.reduceat(d, begin)
            which = np.minimum.reduceat(np.where(d == least[of], nth, n), begin)
            k[own] = np.where((least <= near * near) & (least < np.inf), which, had)
        many[g] = np.maximum(many[g], k + 1)
        at = first[g] + k
        u[at], v[at], seen[at], track[row] = cx[row], cy[row], frame[row], k
    return track


def tracked(boxes: DataFrame, by: str, near: float) -> DataFrame:
    """Boxes (by, frame, det, x, y, w, h) with the track each belongs to: the nearest one by its last centre, within `near`, that has no box of this frame yet; else a new one.

    Frames follow one another within a clip; a clip is one group."""
    def run(t: pa.Table, first: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        frame = _ordered(t, "frame")
        order = np.lexsort((_ordered(t, "det"), frame, group))
        x, y, w, h = (_floats(t, c)[order] for c in "xywh")
        track = track_numbers(first, frame[order], x + w / 2, y + h / 2, near)
        return t.select([by, "frame", "det"]).take(order).append_column("track", pa.array(track))

    kinds = dict(boxes.dtypes)
    own = boxes.select(by, "frame", "det", "x", "y", "w", "h")
    return each_group(own, by, run, f"{by} {kinds[by]}, frame {kinds['frame']}, det {kinds['det']}, track long")

"""Crops of a source frame as columns: structs (x, y, w, h) in source pixels.

Every crop stays inside the frame and keeps its aspect.  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import layout as L

# Canvas, least edge of a crop, share of the default camera,
# growth of a face box and where the face sits in it, and what counts as a
# close and a centred face.
CANVAS_W, CANVAS_H = 1080, 1920
MIN_EDGE, CAMERA_SHARE = 16.0, 0.30
GROW_W, GROW_H, UPPER = 1.8, 2.4, 0.38
CLOSE, CENTRE = 0.28, (0.25, 0.75)


def _held(v: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, F.greatest(high, F.lit(0.0))))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def panned(c: Column, src_w: Column, src_h: Column, dx: Column, dy: Column) -> Column:
    return _box(_held(c.x + dx, src_w - c.w), _held(c.y + dy, src_h - c.h), c.w, c.h)


def zoomed(c: Column, src_w: Column, src_h: Column, factor: Column, ax: Column, ay: Column) -> Column:
    """Scaled about an anchor that keeps its place in the crop; no larger than the frame, no edge under MIN_EDGE."""
    low = F.greatest(MIN_EDGE / c.w, MIN_EDGE / c.h)
    high = F.greatest(low, F.least(src_w / c.w, src_h / c.h))
    f = F.greatest(low, F.least(high, factor))
    w, h = c.w * f, c.h * f
    return _box(_held(ax - (ax - c.x) / c.w * w, src_w - w), _held(ay - (ay - c.y) / c.h * h, src_h - h), w, h)


def reaspected(c: Column, aspect: Column, src_w: Column, src_h: Column) -> Column:
    """Another aspect (width / height) at the same height and centre, as far as the frame lets it."""
    w = F.least(c.h * aspect, src_w)
    h = F.least(F.when(c.h * aspect > src_w, src_w / aspect).otherwise(c.h), src_h)
    w = F.when(h < w / aspect, h * aspect).otherwise(w)
    return _box(_held(c.x + c.w / 2 - w / 2, src_w - w), _held(c.y + c.h / 2 - h / 2, src_h - h), w, h)


def panel_aspects(seam: Column) -> tuple[Column, Column]:
    """Aspects of the upper and lower panel of a canvas cut at a share of its height."""
    upper = F.greatest(F.lit(2.0), F.least(F.lit(CANVAS_H - 2.0), F.round(seam * CANVAS_H)))
    return CANVAS_W / upper, CANVAS_W / (CANVAS_H - upper)


def gameplay(src_w: Column, src_h: Column) -> Column:
    """The largest centred crop of the canvas' aspect."""
    return L.fitted(F.lit(0.0), F.lit(0.0), src_w, src_h, CANVAS_W / CANVAS_H)


def full_camera(cx: Column, cy: Column, src_w: Column, src_h: Column) -> Column:
    """A crop of the canvas' aspect over the whole height (or width) of the frame, around a centre."""
    w, h = src_h * (CANVAS_W / CANVAS_H), src_w / (CANVAS_W / CANVAS_H)
    tall = w <= src_w
    return _box(F.when(tall, _held(cx - w / 2, src_w - w)).otherwise(0.0), F.when(tall, 0.0).otherwise(_held(cy - h / 2, src_h - h)), F.when(tall, w).otherwise(src_w), F.when(tall, src_h).otherwise(h))


def default_camera(src_w: Column, src_h: Column, aspect: Column) -> Column:
    """The lower right corner, CAMERA_SHARE of the width."""
    w = F.least(src_w * CAMERA_SHARE, src_h * aspect)
    return _box(src_w - w, src_h - w / aspect, w, w / aspect)


def face_camera(x0: Column, y0: Column, x1: Column, y1: Column, faces: Column, src_w: Column, src_h: Column, aspect: Column) -> Column:
    """Around the union of some faces: shrunk to the aspect for one face, grown to hold all for several."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    ew, eh = F.least((x1 - x0) * GROW_W, src_w), F.least((y1 - y0) * GROW_H, src_h)
    ex, ey = _held(cx - ew / 2, src_w - ew), _held(cy - eh * UPPER, src_h - eh)
    fit_w, fit_h = F.least(ew, eh * aspect), F.least(eh, ew / aspect)
    one = _box(ex + (ew - fit_w) / 2, ey + (eh - fit_h) / 2, fit_w, fit_h)
    h = F.least(F.least(F.greatest(ew, eh * aspect), src_w) / aspect, src_h)
    w = F.least(h * aspect, src_w)
    return F.when(faces <= 1, one).otherwise(_box(_held(cx - w / 2, src_w - w), _held(cy - h * UPPER, src_h - h), w, h))


def layout(faces: Column, width: Column, cx: Column, src_w: Column) -> Column:
    """`gameplay` without a face, `full_camera` for one that is close and centred, else `stacked`."""
    close = (width / src_w >= CLOSE) & (cx / src_w).between(*CENTRE)
    return F.when(faces == 0, "gameplay").when((faces == 1) & close, "full_camera").otherwise("stacked")


def even(v: Column) -> Column:
    """A rounded edge as an even number of pixels, 2 at least."""
    return F.floor(F.greatest(F.round(v), F.lit(2.0)) / 2) * 2


def scaled_dims(src_w: Column, src_h: Column, long_edge: float) -> tuple[Column, Column]:
    """Even width and height with the longer edge at most `long_edge`."""
    w, h = F.least(src_w, F.lit(long_edge)), F.least(src_h, F.lit(long_edge))
    wide = src_w >= src_h
    return F.when(wide, even(w)).otherwise(even(h * src_w / src_h)), F.when(wide, even(w * src_h / src_w)).otherwise(even(h))


def fade(elapsed: Column, total: Column, in_s: Column, out_s: Column) -> Column:
    """Visibility at a time: the product of the ramps at both edges."""
    ramp = lambda at, over: F.when(over > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / over))).otherwise(1.0)
    return ramp(elapsed, in_s) * ramp(total - elapsed, out_s)

"""Bounding boxes and image sizes as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .scalars import half_up


def _px(pct: Column, side: Column) -> Column:
    return F.bround(pct / 100.0 * side, 0).cast("int")


def signed_round(x: Column, digits: int) -> Column:
    return F.when(x < 0, -half_up(-x, digits)).otherwise(half_up(x, digits)) + F.lit(0.0)


def box(x: Column, y: Column, w: Column, h: Column, ow: Column, oh: Column, clip: bool = True) -> dict[str, Column]:
    """A rectangle in percent of the image, cut to the frame: pixels, percentages, how far it reached out, what area was lost.

    Pixels are null where the image size is unknown (null or 0). Results: x, y, w, h (percent, unrounded), px, pct, over_px, lost, out_of_frame,
    clipped, empty_after_clip."""
    sized = F.coalesce(ow, F.lit(0)).cast("boolean") & F.coalesce(oh, F.lit(0)).cast("boolean")
    out = (x < 0) | (y < 0) | (x + w > 100.0) | (y + h > 100.0)
    over = F.when(sized, F.greatest(F.lit(0.0), -x / 100.0 * ow, -y / 100.0 * oh, (x + w - 100.0) / 100.0 * ow, (y + h - 100.0) / 100.0 * oh)).otherwise(0.0)
    lost = F.lit(0.0)
    if clip:
        nx, ny = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
        nw, nh = F.greatest(F.lit(0.0), F.least(x + w, F.lit(100.0)) - nx), F.greatest(F.lit(0.0), F.least(y + h, F.lit(100.0)) - ny)
        lost = F.when(~out, 0.0).when(w * h > 0, (1.0 - F.try_divide(nw * nh, w * h)) * 100.0).otherwise(100.0)
        empty = out & ((nw <= 0) | (nh <= 0))
        x, y, w, h = (F.when(out, n).otherwise(o) for n, o in ((nx, x), (ny, y), (nw, w), (nh, h)))
        px = F.greatest(F.lit(0), F.least(_px(x, ow), ow))
        py = F.greatest(F.lit(0), F.least(_px(y, oh), oh))
        pw, ph = F.greatest(F.lit(0), F.least(_px(w, ow), ow - px)), F.greatest(F.lit(0), F.least(_px(h, oh), oh - py))
    else:
        empty = F.lit(False)
        px, py, pw, ph = _px(x, ow), _px(y, oh), _px(w, ow), _px(h, oh)
    return {
        "x": x, "y": y, "w": w, "h": h,
        "px": F.when(sized, F.array(px, py, pw, ph)),
        "pct": F.array(*[signed_round(v, 3) for v in (x, y, w, h)]),
        "over_px": half_up(over, 1),
        "lost": signed_round(lost, 2),
        "out_of_frame": out,
        "clipped": out if clip else F.lit(False),
        "empty_after_clip": empty,
    }


def degenerate(px: Column, lost: Column, min_area_pct: float = vocab.MIN_BOX_AREA_PCT, min_side_px: int = vocab.MIN_BOX_SIDE_PX) -> Column:
    """Too little is left of the box; boxes of unknown size are not judged."""
    return F.coalesce((100.0 - lost < min_area_pct) | (F.get(px, F.lit(2)) < min_side_px) | (F.get(px, F.lit(3)) < min_side_px), F.lit(False))


def area_fraction(w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    return half_up(F.try_divide(w * h, image_w * image_h), 4)


def short_side_plan(w: Column, h: Column, side: int = vocab.SHORT_SIDE_PX) -> dict[str, Column]:
    """The smaller side becomes ``side`` if it is larger; the other keeps the aspect."""
    low = F.least(w, h)
    scale = lambda v: F.greatest(F.lit(1), F.bround(v * float(side) / low, 0).cast("int"))
    return {"w": F.when(low <= side, w).when(w <= h, F.lit(side)).otherwise(scale(w)), "h": F.when(low <= side, h).when(w <= h, scale(h)).otherwise(F.lit(side))}


def long_edge_plan(w: Column, h: Column, edge: int = vocab.LONG_EDGE_PX) -> dict[str, Column]:
    """The larger side is cut to ``edge``, aspect kept; nothing grows."""
    high = F.greatest(w, h)
    scale = lambda v: F.greatest(F.lit(1), F.bround(v * float(edge) / high, 0).cast("int"))
    return {"w": F.when(high <= edge, w).when(w >= h, F.lit(edge)).otherwise(scale(w)), "h": F.when(high <= edge, h).when(w >= h, scale(h)).otherwise(F.lit(edge))}


def guard_plan(w: Column, h: Column, edge: int = vocab.GUARD_PX) -> dict[str, Column]:
    """Before a model call: larger images shrink so that the smaller side is ``edge``; ``shrunk`` counts them."""
    low = F.least(w, h)
    s = F.lit(float(edge)) / low
    return {"w": F.when(low > edge, F.bround(w * s, 0).cast("int")).otherwise(w), "h": F.when(low > edge, F.bround(h * s, 0).cast("int")).otherwise(h), "shrunk": low > edge}

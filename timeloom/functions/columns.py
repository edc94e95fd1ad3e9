"""Column functions: text, formats, colours, easing and geometry."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Words that mark a hook, and other word lists; fixed values of the scoring rules, replaceable by callers.
HOOK_WORDS = "best big breakthrough but change secret simple start stop why how what because never always today mistake important remember truth honest actually shocking nobody everybody wrong finally reveal warning proof real failed success".split()
QUESTION_STARTERS = "who what when where why how is are do does can should could would will did have has".split()
CONNECTORS = "and but so or because then".split()
FLOATING_PRONOUNS = "he she it this that they these those".split()
STOP_WORDS = "the a an and or but of to in on for with is are was were be been it this that as at by from".split()


def clean_text(c) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def tokens(c) -> Column:
    """Lower-case tokens of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))


def first_token(c) -> Column:
    return F.regexp_extract(F.lower(c), "[a-z0-9']+", 0)


def is_question_starter(c) -> Column:
    return first_token(c).isin(QUESTION_STARTERS)


def has_floating_pronoun(c) -> Column:
    return first_token(c).isin(FLOATING_PRONOUNS)


def is_connector(c) -> Column:
    return first_token(c).isin(CONNECTORS)


def sentence_final(c) -> Column:
    return F.trim(c).rlike("[.?!]$")


def first_sentence(c) -> Column:
    return F.regexp_extract(c, "^[^.?!]*[.?!]?", 0)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it and in whatever lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def clamp(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def iou_union(a0, a1, b0, b1) -> Column:
    """Overlap over true union, the union at least 100 ms."""
    cut = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return cut / F.greatest(F.lit(100), (a1 - a0) + (b1 - b0) - cut)


def iou_hull(a0, a1, b0, b1) -> Column:
    """Overlap over the hull of both, the hull at least 100 ms."""
    cut = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return cut / F.greatest(F.lit(100), F.greatest(a1, b1) - F.least(a0, b0))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return (w * h) / F.greatest(F.lit(1), a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clock(ms: Column) -> Column:
    """``h:mm:ss.cc``"""
    cs = F.floor(ms / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def bgr(rgb: Column, alpha: Column) -> Column:
    """``#RRGGBB`` and a transparency of 0..255 as ``&HAABBGGRR``."""
    return F.concat(F.lit("&H"), F.lpad(F.hex(alpha), 2, "0"), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2))


def ease_cubic(t: Column) -> Column:
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3.0)) / 2)


def ease_sine(t: Column) -> Column:
    return -(F.cos(F.lit(math.pi) * t) - 1) / 2


def hermite(p0: Column, v0: Column, p1: Column, v1: Column, t: Column, dur: Column) -> Column:
    """The cubic through both positions with both velocities at ``t`` of 0..1."""
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * p0 + (t3 - 2 * t2 + t) * dur * v0 + (-2 * t3 + 3 * t2) * p1 + (t3 - t2) * dur * v1


def stable_choice(key: Column, n: Column) -> Column:
    """A number below ``n`` that depends on the key alone."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n)

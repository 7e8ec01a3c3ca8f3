"""Seeded noise on token order and presence. A draw is a hash of (seed, keys, place), so it is the same on every run."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..corpus import col, tokens
from ..functions.text import FIVEDOT, Cell, java_quote


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1): the first 13 hexadecimal digits of the MD5 of the seed and the parts, with ``-`` between them."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def at_least(bound: float, seed: int, *parts: Column) -> Column:
    """``draw(...) >= bound``, compared as hexadecimal digits, which are in the order of their numbers."""
    least = math.ceil(bound * (1 << 52))
    if not 0 < least < 1 << 52:
        return F.lit(least <= 0)
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])) >= F.lit(f"{least:013x}")


def drop_tokens(line: Cell, keys: Sequence[str], probability: float = 0.1, skip_line: float = 0.0, seed: int = 1) -> Column:
    """Drops tokens with a probability, but never all of a line; a skipped line stays as it is."""
    x, k = col(line), [F.col(c) for c in keys]
    # The line's part of a draw and the kept tokens are each bound once.
    once = lambda made, use: F.element_at(F.transform(F.array(made), use), 1)
    place = F.concat_ws("-", *[c.cast("string") for c in k], F.lit(""))
    kept = once(place, lambda p: F.filter(tokens(x), lambda t, i: at_least(probability, seed, F.concat(p, i.cast("string")))))
    line = once(kept, lambda t: F.when(F.size(t) == 0, x).otherwise(F.array_join(t, " ")))
    return F.when(at_least(skip_line, seed + 1, *k), line).otherwise(x)


def _by_jitter(words: Column, keys: Sequence[Column], max_dist: float, seed: int) -> Column:
    placed = F.transform(words, lambda w, i: F.struct((i + max_dist * draw(seed, *keys, i)).alias("at"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["w"]), " ")


def perturb_order(line: Cell, keys: Sequence[str], max_dist: float = 3, seed: int = 1) -> Column:
    """Sorts tokens by place + U(0, max_dist), so that none moves farther than ``max_dist``."""
    return _by_jitter(tokens(line), [F.col(c) for c in keys], max_dist, seed)


def perturb_words(line: Cell, keys: Sequence[str], max_dist: float = 3, seed: int = 1, marker: str = FIVEDOT) -> Column:
    """``perturb_order`` of whole words, of which parts with boundary markers stay together."""
    m = java_quote(marker)
    words = F.split(F.trim(col(line)), f"(?<!{m}) (?!{m})", -1)
    return _by_jitter(words, [F.col(c) for c in keys], max_dist, seed)

"""Predicates over one cell or several: True means remove. Combine them with ``~``, ``|`` and ``&``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..corpus import WHITE, col, tokens
from .languages import contractions
from .text import Cell, clean, is_name, java_quote, latin_letters


def nothing(line: Cell) -> Column:
    """Removes no line."""
    return F.lit(False)


def inverse(predicate: Column) -> Column:
    return ~predicate


def matches(line: Cell, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """A pattern is found anywhere."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return F.regexp_like(col(line), F.lit(flags + "|".join(f"(?:{p})" for p in patterns)))


def unclean(line: Cell, operation: Callable[[Column], Column] = clean) -> Column:
    """The operation would change the line."""
    return operation(col(line)) != col(line)


def by_length(line: Cell, min_tokens: int = 0, max_tokens: int = 0, min_chars: int = 0, max_chars: int = 0, max_chars_per_token: int = 0) -> Column:
    """Out of bounds, of which 0 is none. ``min_chars`` counts the stripped line, ``max_chars`` the line as it is."""
    x, out = col(line), F.lit(False)
    if min_chars:
        out = out | (F.length(F.regexp_replace(x, f"^{WHITE}|{WHITE}$", "")) < min_chars)
    if max_chars:
        out = out | (F.length(x) > max_chars)
    if min_tokens:
        out = out | (F.size(tokens(x)) < min_tokens)
    if max_tokens:
        out = out | (F.size(tokens(x)) > max_tokens)
    if max_chars_per_token:
        out = out | F.exists(tokens(x), lambda t: F.length(t) > max_chars_per_token)
    return out


def has_oov(line: Cell, vocabulary: Iterable[str]) -> Column:
    """A token is not in a small vocabulary; for a large one see ``operators.lookup.drop_oov``."""
    known = F.array(*[F.lit(w) for w in sorted(set(vocabulary))]) if vocabulary else F.array().cast("array<string>")
    return F.exists(tokens(line), lambda t: ~F.array_contains(known, t))


def foreign_chars(line: Cell, foreign: str, allow_max: int = 5) -> Column:
    """More than ``allow_max`` characters are of the set."""
    inside = "".join(dict.fromkeys(c for c in foreign if not c.isspace()))
    return F.length(col(line)) - F.length(F.translate(col(line), inside, "")) > allow_max


def length_ratio(left: Cell, right: Cell, min_ratio: float, max_ratio: float | None = None, threshold: int = 10, only_alpha: bool = False, in_tokens: bool = False) -> Column:
    """The ratio of lengths is out of [min_ratio, max_ratio or 1 / min_ratio]; short pairs stay, an empty side goes."""
    if only_alpha and in_tokens:
        raise ValueError("only_alpha and in_tokens exclude each other")
    size = (lambda c: F.size(tokens(c))) if in_tokens else (lambda c: F.length(latin_letters(c))) if only_alpha else (lambda c: F.length(col(c)))
    a, b = size(left).cast("double"), size(right).cast("double")
    ratio = F.try_divide(a, b)
    odd = (ratio < min_ratio) | (ratio > (max_ratio if max_ratio is not None else 1 / min_ratio))
    return F.when((a < threshold) & (b < threshold), False).when((a == 0) | (b == 0), True).otherwise(odd)


def long_untranslated(left: Cell, right: Cell, threshold: int = 20) -> Column:
    """Both sides have the same a-z letters, and at least ``threshold`` of them."""
    a, b = latin_letters(left), latin_letters(right)
    return (F.length(a) >= threshold) & (a == b)


def only_names(token: Cell) -> Column:
    """Removes tokens that ``letterize_names`` would not touch."""
    return ~is_name(col(token))


STRIKES = dict.fromkeys("()[];", (2, 4, 6)) | dict.fromkeys("/:", (3, 4, 6)) | dict.fromkeys("-,", (4, 6, 10))


def bureaucratic(line: Cell, threshold: int = 4, numeric: tuple[int, ...] = (4, 6, 10), marks: Mapping[str, tuple[int, ...]] = STRIKES) -> Column:
    """Many numbers, brackets and marks: every limit reached is a strike."""
    x = col(line)
    count = F.size(F.filter(tokens(x), lambda t: F.regexp_like(t, F.lit(NUMERIC))))
    total = sum(((count >= n).cast("int") for n in numeric), F.lit(0))
    for c, limits in marks.items():
        n = F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
        for limit in limits:
            total = total + (n >= limit).cast("int")
    return total >= threshold


#: A token of digits, commas, periods and hyphens only.
NUMERIC = "^[0-9.,-]+$"


def repetitive(line: Cell, min_anywhere: int = 15, min_consecutive: int = 5) -> Column:
    """A token occurs ``min_anywhere`` times, or ``min_consecutive`` times in a row."""
    t = tokens(line)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    streak = F.aggregate(t, start, step, lambda s: s["most"]) >= min_consecutive
    # Equal tokens lie together once sorted, so that a run there is a count.
    often = F.aggregate(F.array_sort(t), start, step, lambda s: s["most"]) >= min_anywhere
    return streak | (F.size(t) >= min_anywhere) & often


def single_url(line: Cell) -> Column:
    return F.regexp_like(col(line), F.lit("(?i)^https?://[^ ]*$"))


def any_url(line: Cell) -> Column:
    return F.regexp_like(col(line), F.lit("(?i)https?://[^ ]"))


def ellipsis(line: Cell) -> Column:
    return F.contains(col(line), F.lit("..."))


ACCENT_NOISE = "/¥°ÇÎÐÑÕÖØÙàáâãäçêîïòù"


def accent_noise(line: Cell) -> Column:
    """Over 40 % of at least 6 characters other than spaces are of the noise set."""
    x = F.replace(col(line), F.lit(" "), F.lit(""))
    n = F.length(x)
    return (n >= 6) & (n - F.length(F.translate(x, ACCENT_NOISE, "")) > 0.4 * n)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of any of the words, in which common beginnings are looked at once; an apostrophe may stand apart."""
    if "" in words:
        return "(?:|" + _any_of([w for w in words if w]) + ")" if any(words) else ""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    parts = [(" ?' ?" if c == "'" else c) + _any_of(tails) for c, tails in rest.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def has_contraction(line: Cell, reverse: bool = False, path: str | None = None) -> Column:
    words = sorted({b if reverse else a for a, b in contractions("en", path)})
    if not words or not all(w.replace("'", "").replace(" ", "").isalpha() for w in words):
        return matches(line, [rf"\b{w.replace(chr(39), ' ?' + chr(39) + ' ?')}\b" for w in words], ignore_case=True)
    # Most have an apostrophe, which a line must have then.
    found = [matches(line, [rf"\b{_any_of(some)}\b"], ignore_case=True) for some in ([w for w in words if "'" in w], [w for w in words if "'" not in w]) if some]
    if any("'" in w for w in words):
        found[0] = F.contains(col(line), F.lit("'")) & found[0]
    return reduce(lambda a, b: a | b, found)


def untranslated_contraction(source: Cell, target: Cell) -> Column:
    """The target has an English contraction; the source isn't looked at."""
    return has_contraction(target)


def news_crawl_urls(line: Cell, host: str = "www.iltasanomat.fi", aggressive: bool = True) -> Column:
    base = "http://" + java_quote(host)
    return matches(line, [base] if aggressive else [base + "/haku/", base + "/henkilo/"])


def rare(count: Cell, threshold: int = 0) -> Column:
    return col(count) < threshold


def levenshtein_far(distance: Cell, left: Cell, right: Cell, min_len: int = 4, ratio: float = 1 / 3) -> Column:
    """Short words must be equal; others may differ in ``ratio`` of the mean length, rounded up."""
    a, b = F.length(col(left)), F.length(col(right))
    return F.when((a < min_len) | (b < min_len), col(left) != col(right)).otherwise(col(distance) > F.ceil((a + b) / 2 * ratio))


def longest_edit(left: str, right: str) -> int:
    """Length of the longest run of insertions or of deletions in a least-cost alignment.

    Where alignments tie, the trace from the end prefers a match or replacement, then a deletion.
    """
    n, m = len(left), len(right)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, above = [i], cost[-1]
        for j in range(1, m + 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (left[i - 1] != right[j - 1])))
        cost.append(row)
    i, j, best, run, last = n, m, 0, 0, ""
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (left[i - 1] != right[j - 1]):
            kind, i, j = "", i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            kind, i = "delete", i - 1
        else:
            kind, j = "insert", j - 1
        run = 0 if not kind else run + 1 if kind == last else 1
        last, best = kind, max(best, run)
    return best


def long_edits(left: Cell, right: Cell, max_len: int = 3) -> Column:
    """A run of insertions or deletions is longer than ``max_len``; an empty side is kept."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else longest_edit(x, y) if x and y else 0 for x, y in zip(a, b)], dtype="Int32")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, IntegerType())(col(left), col(right)) > max_len


def apply(df, predicate: Column):
    """(kept, rejects). A null predicate keeps the row."""
    bad = F.coalesce(predicate, F.lit(False))
    return df.where(~bad), df.where(bad)

"""Projections of one cell: regex, character and normalisation functions. Column to Column; nulls stay null."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..corpus import col, tokens
from .languages import contractions

FIVEDOT, FOURDOT, THREEDOT = "⁙", "⁘", "⁖"
BEGIN, MIDDLE, END = "⸫", "⸬", "⸭"
Cell = str | Column


def java_quote(text: str) -> str:
    """``text`` as a literal of a Java pattern."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c in " _" else "\\" + c for c in text)


def java_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def chars(line: Cell) -> Column:
    return F.filter(F.split(col(line), ""), lambda c: c != "")


def regex_substitution(line: Cell, pairs: Iterable[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Global substitutions in order. Patterns are Java's with Unicode classes; groups are written as $1."""
    out = col(line)
    for pattern, to in pairs:
        out = F.regexp_replace(out, ("(?iuU)" if ignore_case else "(?U)") + pattern, to)
    return out


def regex_dispatch(line: Cell, cases: list[tuple[str, Callable[[Column, Callable[[int], Column]], Column]]], ignore_case: bool = False) -> Column:
    """The first pattern that matches at the start decides; its function gets the line and a getter of groups.

    A line without a match, or whose function gives null, is null: drop it with ``isNotNull``.
    """
    x = col(line)
    out = F.lit(None).cast("string")
    for pattern, make in reversed(cases):
        p = ("(?iuU)" if ignore_case else "(?U)") + r"\A(?:" + pattern + ")"
        out = F.when(F.regexp_like(x, F.lit(p)), make(x, lambda i, p=p: F.regexp_extract(x, p, i))).otherwise(out)
    return out


_PUNCTUATION = {"-": "֊־‑‒–—―⸺⸻−﹘﹣－\xad", "'": "`´", '"': "„“”‘‚’‹›ˮ«»⟪⟫《》", "/": "⁄", "_": "＿", "%": "٪", "‰": "؉"}


def normalize_punctuation(line: Cell) -> Column:
    """Dashes, quotes and a few signs to their plain forms; an apostrophe between letters stays an apostrophe.

    A dash or quote is replaced in one pass of ``translate``, doubled apostrophes (not made by quotes) by a double quote.
    """
    x = F.regexp_replace(col(line), r"(?U)(?<=\w)[‘’](?=\w)", "'")
    first = {c: to for to, group in _PUNCTUATION.items() if to in "-'\"" for c in group}
    x = F.translate(x, "".join(first), "".join(first.values()))
    x = F.replace(x, F.lit("''"), F.lit('"'))
    rest = {c: to for to, group in _PUNCTUATION.items() if to not in "-'\"" for c in group}
    return F.translate(x, "".join(rest), "".join(rest.values()))


def denormalize_punctuation(line: Cell) -> Column:
    return F.translate(col(line), "\"'", "”’")


_ACCEPTED = ("LC", "Ll", "Lo", "Lt", "Lu", "Nd", "Sc", "Sm")
_CATEGORIES = "Cc Cf Cn Co Cs Ll Lm Lo Lt Lu Mc Me Mn Nd Nl No Pc Pd Pe Pf Pi Po Ps Sc Sk Sm So Zl Zp Zs".split()
_SPARED = "\t !\"#%&'()*,-./:;?@[\\]{}§©®°‰™"


def map_chars(line: Cell, policies: Mapping[str, str] | None = None, overrides: Mapping[str, str] | None = None, maintain_alignment: bool = True) -> Column:
    """Keeps, drops or replaces characters by Unicode general category, with overrides for single characters.

    A policy is ``accept``, ``drop`` or the text to put in place. Letters, digits, currency and mathematical signs are
    accepted, spaces become a plain one, all else is dropped but for common ASCII marks and a few signs.
    """
    rules = {c: "accept" if c in _ACCEPTED else " " if c == "Zs" else "drop" for c in _CATEGORIES} | dict(policies or {})
    single = {c: c for c in _SPARED} | dict(overrides or {})
    by: dict[str, list[str]] = {}
    for c in _CATEGORIES:
        by.setdefault(rules.get(c, "drop"), []).append(rf"\p{{{c}}}")
    except_ = "".join(java_quote(c) if ord(c) > 32 else f"\\x{{{ord(c):x}}}" for c in single)
    classes = {("" if to == "drop" else to): f"[{''.join(found)}&&[^{except_}]]" for to, found in by.items() if to != "accept"}
    x = col(line)
    if all(k == v for k, v in single.items()):
        for to, group in sorted(classes.items()):  # drops first
            x = F.regexp_replace(x, group, java_replacement(to))
    else:
        table = F.create_map(*[F.lit(s) for kv in single.items() for s in kv])

        def one(c: Column) -> Column:
            out = c
            for to, group in classes.items():
                out = F.when(F.regexp_like(c, F.lit(group)), F.lit(to)).otherwise(out)
            return F.coalesce(F.element_at(table, c), out)

        x = F.array_join(F.transform(chars(x), one), "")
    return F.replace(x, F.lit("\n"), F.lit(" ")) if maintain_alignment else x


_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_LIGATURES = {ord(a): b for a, b in zip("ĲĳŉǄǅǆǇǈǉǊǋǌﬀﬁﬂﬃﬄﬅﬆ", ["IJ", "ij", "'n", "DŽ", "Dž", "dž", "LJ", "Lj", "lj", "NJ", "Nj", "nj", "ff", "fi", "fl", "ffi", "ffl", "st", "st"])}
_QUOTES = {ord(c): "'" for c in "‘’‚‛"} | {ord(c): '"' for c in "“”„‟"}
_CONTROL = {i: None for i in [*range(0, 9), 11, *range(14, 32), 127, 0xFEFF]}
_FOREIGN = re.compile("[^\x00-\x7f]+")


def _repair(match: re.Match) -> str:
    """A run of characters that is UTF-8 read as Windows-1252 or Latin-1, read anew; any other run as it is."""
    for charset in ("cp1252", "latin-1"):
        try:
            return match[0].encode(charset).decode("utf-8")
        except UnicodeError:
            continue
    return match[0]


def clean_text(text: str) -> str:
    """Repairs one text: HTML entities, terminal escapes, UTF-8 read as Windows-1252, ligatures, widths, quotes, line
    ends, lone surrogates, control characters and byte order marks; NFKC at the end."""
    text = _ANSI.sub("", html.unescape(text))
    text = _FOREIGN.sub(_repair, text)
    text = text.translate(_LIGATURES).translate(_QUOTES)
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n").replace("\x85", "\n")
    return unicodedata.normalize("NFKC", text.translate(_CONTROL).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def _over(make: Callable[[str], str | None]):
    """An Arrow-batched function of one string column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(make, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


def clean(line: Cell, maintain_alignment: bool = True) -> Column:
    """``clean_text``; a newline that it makes becomes a space with ``maintain_alignment``."""
    out = _over(clean_text)(col(line))
    return F.replace(out, F.lit("\n"), F.lit(" ")) if maintain_alignment else out


def strip_rare_chars(line: Cell, keep: Iterable[str]) -> Column:
    """Only the characters of ``keep`` (an alphabet, so a small set; see ``operators.counts.common_chars``)."""
    inside = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(keep))
    return F.regexp_replace(col(line), f"[^{inside}]" if inside else r"(?s).", "")


def is_name(token: Column) -> Column:
    """Longer than one character and starts with an upper-case letter or a digit."""
    return (F.length(token) > 1) & F.regexp_like(token, F.lit(r"\A[\p{Lu}\p{Nd}]"))


def letterize_names(line: Cell) -> Column:
    """Names and numbers as marked characters, separated by spaces; tokens with a boundary marker stay."""

    def one(t: Column) -> Column:
        c = chars(t)
        middle = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))), lambda x: F.concat(F.lit(MIDDLE), x))
        marked = F.concat(F.array(F.concat(F.lit(BEGIN), F.element_at(c, 1))), middle, F.array(F.concat(F.lit(END), F.element_at(c, -1))))
        return F.when(~F.contains(t, F.lit(FIVEDOT)) & is_name(t), F.array_join(marked, " ")).otherwise(t)

    return F.array_join(F.transform(tokens(line), one), " ")


def strip_tags(text: str) -> str:
    """Drops what is between angle brackets, which may nest and span lines; newlines stay, runs of spaces become one.

    The depth after each character is the running sum S of brackets less the least of 0 and its running minimum.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    delta = (code == 60).astype(np.int64) - (code == 62)
    s = np.cumsum(delta)
    depth = s - np.minimum(np.minimum.accumulate(s), 0) if len(s) else s
    kept = code[((depth == 0) & (delta == 0)) | (code == 10)]
    return re.sub(" +", " ", kept.tobytes().decode("utf-32-le", "surrogatepass"))


def strip_xml(text: Cell) -> Column:
    """``strip_tags`` of a whole text, of whose lines one may end inside a tag."""
    return _over(strip_tags)(col(text))


def normalize_contractions(line: Cell, lang: str = "en", reverse: bool = False, path: str | None = None) -> Column:
    """Contractions to full forms, or back with ``reverse``; the apostrophe may stand apart, case is ignored."""
    pairs = [(b, a) if reverse else (a, b) for a, b in contractions(lang, path)]
    found = [java_quote(a).replace(chr(92) + chr(39), chr(39)).replace(chr(39), " ?" + chr(39) + " ?") for a, _ in pairs]
    changed = regex_substitution(line, [(rf"\b{a}\b", java_replacement(b.replace("'", " '"))) for a, (_, b) in zip(found, pairs)], ignore_case=True)
    # One look for any of them; few lines then need the passes.
    return F.when(F.regexp_like(col(line), F.lit(rf"(?iuU)\b(?:{'|'.join(found)})\b")), changed).otherwise(col(line)) if pairs else col(line)


def split_numbers(line: Cell) -> Column:
    return F.regexp_replace(col(line), r"(?U)(\d)([-/,.])(\d)", "$1@@ $2@@ $3")


def prefix(line: Cell, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), col(line), F.lit(after))


def cut_prefix(line: Cell, sep: str = " ") -> tuple[Column, Column]:
    """(head, tail) at the first ``sep``; a line without one is an error."""
    x = col(line)
    parts = F.split(x, java_quote(sep), 2)
    checked = F.when(x.isNull() | (F.size(parts) == 2), parts).otherwise(F.raise_error(F.concat(F.lit("no separator in: "), x)))
    return F.element_at(checked, 1), F.element_at(checked, 2)


def normalize_long_sounds(line: Cell) -> Column:
    """Runs of more than three equal characters, digits too, become three."""
    return F.regexp_replace(col(line), r"(.)\1\1+", "$1$1$1")


def truncate_words(line: Cell, length: int = 5, from_start: bool = True) -> Column:
    cut = (lambda t: F.substring(t, 1, length)) if from_start else (lambda t: F.when(F.length(t) > length, F.substring(t, -length, length)).otherwise(t))
    return F.array_join(F.transform(tokens(line), cut), " ")


def undo_double_ampersand(line: Cell) -> Column:
    return F.replace(col(line), F.lit("&amp; amp ;"), F.lit("&"))


def zero_width_space(line: Cell) -> Column:
    return F.translate(col(line), "​", " ")


def leading_hyphen(line: Cell) -> Column:
    return F.regexp_replace(col(line), "^ ?- ?", "")


def space_before_url(line: Cell) -> Column:
    return F.regexp_replace(col(line), "([^ ])(https?://)", "$1 $2")


SPEAKER_NOTES = ("", "kirjallinen", "kirjalikult", "esittelijä", "rapporteur", "in writing")


def remove_language_tags(line: Cell) -> Column:
    """Speaker notes such as ``in writing. - (FR)`` at the start."""
    lead = "[ .,-]*"
    return regex_substitution(line, [(rf"\A{lead}{note} *{lead}\([A-Za-z]{{2}}\) ", "") for note in SPEAKER_NOTES])


def replace_set_id(line: Cell, setid: str) -> Column:
    return F.regexp_replace(col(line), r'^(<.*\bsetid\s*=\s*")[^"]*', "$1" + java_replacement(setid))


def lowercase(line: Cell) -> Column:
    return F.lower(col(line))


def identity(line: Cell) -> Column:
    return col(line)


def latin_letters(line: Cell) -> Column:
    """The a-z of the lower-cased line."""
    return F.regexp_replace(F.lower(col(line)), "[^a-z]", "")

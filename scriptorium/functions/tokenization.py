"""Tokenisation and segmentation of one cell."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import pandas as pd

from ..corpus import col, tokens
from .languages import nonbreaking
from .text import FIVEDOT, FOURDOT, Cell, _over, chars, java_quote, java_replacement

PUNCTUATION = "\"'()" + ".,:;!?" + "/\\-" + "%+@" + "¥£$€"


def simple_tokenize(line: Cell, punctuation: str = PUNCTUATION, marker: str = FIVEDOT) -> Column:
    """Parts punctuation from its neighbours, marking that there was no space; a repeated mark is not parted.

    A mark before a character that is neither space nor punctuation gets the marker behind; one after anything but a
    space or itself gets it in front.
    """
    every = "".join(map(java_quote, punctuation))
    behind = "|".join(f"(?<!{java_quote(c)}){java_quote(c)}(?=[^ {every}])" for c in punctuation)
    front = "|".join(f"(?<=[^ {java_quote(c)}]){java_quote(c)}" for c in punctuation)
    m = java_replacement(marker)
    here = f"(?=[{every}])"  # the alternatives are tried at marks only
    return F.regexp_replace(F.regexp_replace(col(line), f"{here}({behind})", f"$1{m} "), f"{here}({front})", f" {m}$1")


def join_markers(line: Cell, marker: str = FIVEDOT) -> Column:
    """Joins tokens at their boundary markers."""
    x = F.replace(col(line), F.lit(marker + " "), F.lit(""))
    return F.replace(F.replace(x, F.lit(" " + marker), F.lit("")), F.lit(marker), F.lit(""))


simple_detokenize = join_markers


def _alphabet(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    for name, lo, hi in (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x780), ("kana", 0x3040, 0x3100), ("han", 0x4E00, 0xA000), ("hangul", 0xAC00, 0xD7B0)):
        if lo <= o < hi:
            return name
    return "other"


def joiner_tokens(line: str, marker: str = FIVEDOT, aggressive: bool = True, alphabet_change: bool = True) -> str:
    """Splits words at every change of kind (letter, digit, mark; of alphabet too), with joiner marks on the marks.

    Conservative splitting keeps marks between two letters or digits inside of a word.
    """
    out: list[str] = []
    for word in line.split():
        kinds = []
        for i, c in enumerate(word):
            kind = "letter" if c.isalpha() or c in "̀́" else "digit" if c.isdigit() else "mark"
            if kind == "mark" and not aggressive and 0 < i < len(word) - 1 and c in "-'._,:@/" and word[i - 1].isalnum() and word[i + 1].isalnum():
                kind = "inside"
            kinds.append(kind + (_alphabet(c) if kind == "letter" and alphabet_change else ""))
        parts: list[tuple[str, bool]] = []  # text, is a mark
        for c, kind in zip(word, kinds):
            mark = kind == "mark"
            same = parts and not mark and not parts[-1][1] and (kind == last or "inside" in (kind, last) or not aggressive)
            if same:
                parts[-1] = (parts[-1][0] + c, False)
            else:
                parts.append((c, mark))
            last = kind
        for i, (text, mark) in enumerate(parts):
            before, after = i > 0, i < len(parts) - 1
            if mark:
                text = (marker if before else "") + text + (marker if after and not parts[i + 1][1] else "")
            elif before and not parts[i - 1][1]:
                text = marker + text
            out.append(text)
    return " ".join(out)


def joiner_tokenize(line: Cell, marker: str = FIVEDOT, aggressive: bool = True, alphabet_change: bool = True) -> Column:
    return _over(lambda s: joiner_tokens(s, marker, aggressive, alphabet_change))(col(line))


joiner_detokenize = join_markers


# --- rule-based tokeniser ---------------------------------------------------------------------------------------------

_SPACE = "\x1f"  # stands for a space of the original
_MARKS = ".,!?:;/@%()'\"+£$€"
_SPACES = re.compile("  +")
_BEFORE_PERIOD = re.compile(r"([^ ]+) \.")
_DOMAINS = "com org cz de fi ee ru tr".split()


class RuleTokenizer:
    """Splits punctuation, then joins again what is protected: abbreviations, numbers, dots, URLs, domains, e-mail
    addresses, the user's patterns; then applies the language's clitic rules. One text at a time."""

    def __init__(self, lang: str, extra: tuple[str, ...] = (), escape_extra: bool = True, prefixes: tuple[str, ...] | None = None):
        words = nonbreaking(lang) if prefixes is None else prefixes
        # By the token in front of the last period: only those of which it occurs are tried.
        self.words: dict[str, list[tuple[int, str, str]]] = {}
        for i, w in enumerate(words):
            apart = " " + self._split(w + ".").rstrip()
            self.words.setdefault(re.split(" +", apart)[-2], []).append((i, apart, f" {w}."))
        # (text that every match has, pattern)
        protected = [(" ", r"\d (?:[.,] \d)+"), (". .", r"\.(?: \.)+"), ("http", f"https? : / / [^{_SPACE}]*"), (" . ", r"(?:www \. |)[a-zA-Z]* \. (?:" + "|".join(_DOMAINS) + ")"), (" @ ", r"[a-z. ]* @ [a-z. ]*")]
        if lang in ("fi", "et"):
            protected.append((" . ", r"\d \. "))
        self.protected = [(has, re.compile(p)) for has, p in [*protected, *(("", re.escape(e) if escape_extra else e) for e in extra)]]
        rules = [(r"(pp|No|Art) \.(\s+\d)", r"\1.\2"), (r" ([DLO])\s+' (?=\w)", r" \1'"), (rf"({_SPACE}) ?\. (\d)", r"\1 .\2")]
        if lang == "en":
            rules += [(r"(?<=\w) '\s+([a-z]) ", r" '\1 "), (r"(?<=\w) '\s+(ve|re|ll) ", r" '\1 "), (r"(?<=\d) '\s+s ", " 's ")]
        else:
            if lang in ("fi", "et"):
                rules += [(r"(?<=\w) : ([õöäåüa-z]{1,3}) ", r" :\1 "), (r"(?<=\w) : (ista|nneksi) ", r" :\1 ")]
            rules.append((r"([A-Za-z][a-z]{2}) ' ([a-z]) ", r"\1'\2 "))
        self.rules = [(next((c for c in "':" if c in a), "."), re.compile(a), b) for a, b in rules]  # every rule is about one of these

    @staticmethod
    def _split(text: str) -> str:
        for c in _MARKS:
            text = text.replace(c, f" {c} ")
        return text

    def __call__(self, text: str) -> str:
        out = _SPACES.sub(" ", self._split(" " + text.replace(" ", f" {_SPACE} ") + " "))
        if " ." in out:
            ends = {".", *_BEFORE_PERIOD.findall(out)}
            for _, apart, whole in sorted(x for t in ends if t in self.words for x in self.words[t]):
                out = out.replace(apart, whole)
        for has, p in self.protected:
            if has in out:
                for found in sorted(set(p.findall(out)), key=len, reverse=True):
                    out = out.replace(found, found.replace(" ", ""))
        for has, p, to in self.rules:
            if has in out:
                out = p.sub(to, out)
        return _SPACES.sub(" ", out.replace(_SPACE, "")).strip()


@lru_cache(16)
def _tokenizer(lang: str, extra: tuple[str, ...], escape: bool, prefixes: tuple[str, ...] | None) -> RuleTokenizer:
    return RuleTokenizer(lang, extra, escape, prefixes)


def tokenize(line: Cell, lang: str, extra: tuple[str, ...] = (), escape_extra: bool = True, prefixes: tuple[str, ...] | None = None) -> Column:
    """``RuleTokenizer`` in Arrow batches: its replacements depend on the data, so no chain of patterns can express it."""
    return _over(lambda s: _tokenizer(lang, tuple(extra), escape_extra, prefixes)(s))(col(line))


def detokenize(line: Cell, lang: str) -> Column:
    rules = [(" +", " ")]
    if lang == "en":
        rules += [(" ('[a-z]) ", "$1 "), (" ('(?:re|ll|ve)) ", "$1 ")]
    elif lang in ("fi", "et"):
        rules += [(" (:[õöäåüa-z]{1,3}) ", "$1 "), (" (:(?:ista|nneksi)) ", "$1 "), (" ' (in|an|hun|ista|lla|lle|sin|ssa|sta|ta) ", "'$1 "), ("([tT]ark) ' ", "$1'")]
    money = r"[€£\$]"
    rules += [("s ' ", "s' "), (r"(\d) : (\d)", "$1:$2"), (r" ([])?!;:,.])(?!\w)".replace("[])", r"[\])"), "$1"), (r"([\[(@]) ", "$1"), (rf"({money}) ([-,.]*\d)", "$1$2"), (rf"(\d[,.]?) ({money})", "$1$2"), ('" ([^"]+) "', '"$1"'), (" ' ([^']+) ' ", " '$1' "), ('^ " ', ' "'), (' " $', '" '), (r' ("[,.]) ', "$1 ")]
    out = F.concat(F.lit(" "), col(line), F.lit(" "))
    for pattern, to in rules:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return F.trim(out)


def split_long_numbers(line: Cell, min_len: int = 4, size: int = 3, marker: str = FIVEDOT, from_right: bool = True) -> Column:
    """Cuts tokens of more than ``min_len`` digits (a leading ``▁`` aside) into groups of ``size``.

    Groups are counted from the right with the marker before each later group, or with ``from_right=False`` from the
    left with the marker behind each earlier one.
    """
    m = java_replacement(marker)

    def one(t: Column) -> Column:
        long = F.regexp_like(t, F.lit("^▁?[0-9]+$")) & (F.length(F.replace(t, F.lit("▁"), F.lit(""))) > min_len)
        cut = F.regexp_replace(t, rf"(?<=.)(?=(?:.{{{size}}})+$)", f" {m}") if from_right else F.regexp_replace(t, rf"(.{{{size}}})(?=.)", f"$1{m} ")
        return F.when(long, cut).otherwise(t)

    return F.array_join(F.transform(tokens(line), one), " ")


def split_hyphens(line: Cell, before: str = " ", after: str = " ") -> Column:
    return F.regexp_replace(col(line), r"(?U)(?<![\s-])-(?![\s\d-])", java_replacement(f"{before}-{after}"))


def split_hyphens_strictly(line: Cell, before: str = " ", after: str = " ") -> Column:
    return F.regexp_replace(col(line), r"(?<=\p{Alpha}{4})-(?=\p{Alpha}{4})", java_replacement(f"{before}-{after}"))


def split_all_hyphens(line: Cell, before: str = " ", after: str = " ") -> Column:
    return F.regexp_replace(col(line), r"(?U)(?<!\s)-(?!\s)", java_replacement(f"{before}-{after}"))


def split_decimal(line: Cell, before: str = " ", after: str = " ") -> Column:
    b, a = java_replacement(before), java_replacement(after)
    return F.regexp_replace(col(line), "([0-9])([.,])([0-9])", f"$1{b}$2{a}$3")


def char_segmentation(line: Cell, marker: str | None = None, space: str = FOURDOT) -> Column:
    x = col(line)
    if marker is not None:
        for text in (f" {marker} ", f"{marker} ", f" {marker}"):
            x = F.replace(x, F.lit(text), F.lit(""))
    return F.array_join(chars(F.replace(x, F.lit(" "), F.lit(space))), " ")


_LETTERS = frozenset("abcdefghijklmnopqrstuvxyzåäö")


def align_analysis(surface: str, analysis: str) -> str:
    """The surface with the analysis's boundaries: two pointers, of which a mismatch of letters gives the analysis up."""
    low, target, out = surface.lower(), analysis.lower(), []
    i = j = 0
    while i < len(surface):
        if j < len(target) and low[i] != target[j]:
            if target[j] == " ":
                out.append(" ")
                j += 1
                continue
            mine, theirs = low[i] in _LETTERS, target[j] in _LETTERS
            if mine and theirs:
                return target
            if mine:
                j += 1
                continue
            if not theirs:
                j += 1
        elif j < len(target):
            j += 1
        out.append(surface[i])
        i += 1
    return "".join(out)


def mapping_to_segmentation(line: Cell, normalize=align_analysis) -> Column:
    """Of ``surface<tab>analysis``: struct(segmentation, surface, analysis, normalised, ok); not ok is for the reject log.

    If the normalised analysis doesn't join to the surface, the segmentation is the surface.
    """
    kind = StructType([StructField(n, StringType()) for n in ("segmentation", "surface", "analysis", "normalised", "ok")])

    def one(s: str) -> tuple:
        a, _, b = s.partition("\t")
        n = normalize(a, b)
        fine = n.replace(" ", "") == a
        return (n if fine else a, a, b, n, str(fine).lower())

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) if x is not None else (None,) * 5 for x in s], columns=kind.names)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    x = F.pandas_udf(run, kind)(col(line))
    return F.struct(x["segmentation"].alias("segmentation"), x["surface"].alias("surface"), x["analysis"].alias("analysis"), x["normalised"].alias("normalised"), (x["ok"] == "true").alias("ok"))


def sentences(line: Cell) -> Column:
    """Array of the trimmed, non-empty sentences that end in ``.?!`` and a space."""
    cut = F.transform(F.split(col(line), "(?<=[.?!]) ", -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(cut, lambda s: s != "")

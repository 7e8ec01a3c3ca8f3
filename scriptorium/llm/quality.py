"""Quality rules by distribution divergence: Jensen-Shannon distances of a document to its language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty, utf8_bytes, where_kept, word_hashes

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other_lower", "other_upper", "other")
MARKS = ".,;:!?'\"()-"
MIN_SHARE, MIN_CHARS, MIN_WORDS = 0.002, 200, 50
#: A distance may reach MAX + SLACK / sqrt(n): the second part allows for the sampling noise of a short histogram.
MAX_CHAR_JS, CHAR_SLACK, MAX_WORD_JS, WORD_SLACK = 0.18, 2.0, 0.26, 1.2
#: Words as ``common.word_hashes`` finds them, for Java and RE2.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


@cache
def _class_of() -> np.ndarray:
    """Class number of every code point."""
    table = np.full(0x110000, 8, dtype=np.uint8)
    for c in range(0x110000):
        if c < 128:
            ch = chr(c)
            table[c] = 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in " \t\n\r\f\v" else 4 if ch in MARKS else 5
        elif (kind := unicodedata.category(chr(c))) in ("Ll", "Lu"):
            table[c] = 6 if kind == "Ll" else 7
    return table


def class_counts(texts: pa.Array) -> np.ndarray:
    """Rows x classes: characters of each class in each text."""
    n, k, table = len(texts), len(CLASSES), _class_of()
    out = np.zeros((n, k), dtype=np.int64)
    raw, offsets = utf8_bytes(texts)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 21), side="right")) - 1)
        part = raw[offsets[at] : offsets[to]]
        if len(part):
            lead = (part & 0xC0) != 0x80
            code = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
            row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))[lead]
            out[at:to] = np.bincount(row * k + table[code], minlength=(to - at) * k).reshape(to - at, k)
        at = to
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts to the reference counts; 0 where either is empty."""
    total = counts.sum(axis=1, keepdims=True)
    if not reference.sum():
        return np.zeros(len(counts))
    p, q = counts / np.maximum(total, 1), (reference / reference.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d / 2, 0)), 0.0)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> dict[str, dict]:
    """Per language: character-class counts, its common words and their counts, and the count of all words.

    All texts are counted. A word is common if it makes up at least ``min_share`` of the language's words, so a language
    has at most 1 / min_share of them whatever the size of the corpus; only these reach the driver.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            counts, langs = class_counts(batch.column(1)), batch.column(0).dictionary_encode()
            at = np.asarray(langs.indices)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                total[name] = total.get(name, 0) + counts[at == i].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([list(map(int, x)) for x in total.values()], pa.list_(pa.int64()))], names=["lang", "n"])

    out: dict[str, dict] = {}
    sums = rows.mapInArrow(run, "lang string, n array<bigint>").groupBy("lang").agg(*[F.sum(F.col("n")[i]).alias(c) for i, c in enumerate(CLASSES)])
    for r in sums.collect():
        out[r["lang"]] = {"classes": np.array(r[1:], dtype=np.float64), "words": [], "counts": [], "total": 0}
    words = stored(rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").count(), "words")
    totals = words.groupBy("lang").agg(F.sum("count").alias("total"))
    for r in words.join(totals, "lang").where(F.col("count") >= F.col("total") * min_share).orderBy("lang", F.desc("count"), "word").collect():
        o = out[r["lang"]]
        o["words"].append(r["word"])
        o["counts"].append(r["count"])
        o["total"] = r["total"]
    return out


Limits = tuple[int, int, float, float, float, float]
LIMITS: Limits = (MIN_CHARS, MIN_WORDS, MAX_CHAR_JS, CHAR_SLACK, MAX_WORD_JS, WORD_SLACK)


class Judge:
    """Distances of batches of texts to references that were counted before."""

    def __init__(self, refs: dict[str, dict], limits: Limits = LIMITS):
        self.refs, self.limits, self.coded = refs, limits, {}
        for name, r in refs.items():
            h = word_hashes(pa.array(r["words"], pa.string()))[0] if r["words"] else np.zeros(0, np.uint64)
            order = np.argsort(h)
            known = np.array(r["counts"], dtype=np.float64)
            self.coded[name] = (h[order], np.append(known[order], r["total"] - known.sum()) if len(h) else np.zeros(1))

    def __call__(self, texts: pa.Array, languages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(character distance, word distance, words, kept) of each row."""
        langs = languages.dictionary_encode()
        n, at = len(texts), np.asarray(langs.indices)
        chars = class_counts(texts)
        size = chars.sum(axis=1)
        char_js, word_js, n_words = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        low = pc.utf8_lower(texts)
        for lo, hi in slices(np.asarray(pc.binary_length(texts))):
            h, row, _ = word_hashes(low.slice(lo, hi - lo))
            n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(at[lo:hi] == i)
                known, ref = self.coded.get(name, (np.zeros(0, np.uint64), np.zeros(1)))
                if not len(mine):
                    continue
                k = len(known) + 1
                place = np.full(hi - lo, -1)
                place[mine] = np.arange(len(mine))
                own = place[row] >= 0
                hh = h[own]
                which = np.searchsorted(known, hh)
                hit = (which < len(known)) & (known[np.minimum(which, max(len(known) - 1, 0))] == hh) if len(known) else np.zeros(len(hh), bool)
                counts = np.bincount(place[row[own]] * k + np.where(hit, which, k - 1), minlength=len(mine) * k).reshape(-1, k)
                word_js[lo + mine] = js_distance(counts.astype(np.float64), ref)
                char_js[lo + mine] = js_distance(chars[lo + mine].astype(np.float64), self.refs[name]["classes"] if name in self.refs else np.zeros(len(CLASSES)))
        min_chars, min_words, max_char, char_slack, max_word, word_slack = self.limits
        bad = (size >= min_chars) & (char_js > max_char + char_slack / np.sqrt(np.maximum(size, 1))) | (n_words >= min_words) & (word_js > max_word + word_slack / np.sqrt(np.maximum(n_words, 1)))
        return char_js, word_js, n_words, ~bad


def _limits(given: dict[str, float]) -> Limits:
    names = ("min_chars", "min_words", "max_char_js", "char_slack", "max_word_js", "word_slack")
    if extra := set(given) - set(names):
        raise TypeError(f"unknown limits: {sorted(extra)}")
    return tuple(given.get(k, v) for k, v in zip(names, LIMITS))


def score(docs: DataFrame, refs: dict[str, dict], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """(doc_id, char_js, word_js, n_words, kept) of every row, against references that were counted before."""
    bounds = _limits(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(refs, bounds)
        for batch in batches:
            char_js, word_js, n_words, kept = judge(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(char_js), pa.array(word_js), pa.array(n_words), pa.array(kept)], names=["doc_id", "char_js", "word_js", "n_words", "kept"])

    rows = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col), text_or_empty(lang_col))
    return rows.mapInArrow(run, "doc_id long, char_js double, word_js double, n_words long, kept boolean")


def divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", good: DataFrame | None = None, **limits: float) -> DataFrame:
    """(doc_id, n_words, char_js, word_js, kept) of every document; distances are rounded to 6 places.

    A document is rejected if it has at least ``min_chars`` characters and its character classes are farther than
    ``max_char_js + char_slack / sqrt(characters)`` from those of its language, or at least ``min_words`` words and its
    common words are farther than ``max_word_js + word_slack / sqrt(words)``. Shorter ones are not judged by that rule,
    as their histograms are mostly noise. The references are counted over all of ``good``, a table with the same columns
    of texts that are known to be fine; without one over ``docs`` themselves, so that the bulk of a language judges its rest.

    * A language that ``good`` lacks has nothing to be compared with: distances are 0 and all is kept.
    * A null language is a language of its own (the empty string). A null or empty text has distances 0 and is kept.
    * Repeated rows are scored each and count each in the references. An empty table gives no rows.
    """
    scored = score(docs, references(docs if good is None else good, text_col, lang_col), id_col, text_col, lang_col, **limits)
    return scored.select("doc_id", "n_words", F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js"), "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", good: DataFrame | None = None, **limits: float) -> DataFrame:
    """The rows of ``docs`` that ``divergence`` keeps, as they are. Each is judged where it is, without a join."""
    refs, bounds, made = references(docs if good is None else good, text_col, lang_col), _limits(limits), []

    def decide(batch: pa.RecordBatch) -> np.ndarray:
        if not made:
            made.append(Judge(refs, bounds))
        return made[0](batch.column(0), batch.column(1))[3]

    return where_kept(docs, [text_or_empty(text_col), text_or_empty(lang_col)], decide)


def _js_sql(source: str) -> str:
    side = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (p + q)) ELSE 0 END"
    return f"SELECT r, sqrt(greatest(sum({side('p')} + {side('q')}) / 2, 0)) AS js FROM {source} GROUP BY r"


def _counts_sql() -> str:
    """The counts of the classes, in the order of CLASSES."""
    n = lambda c: f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))"
    lower, upper, digit, space, mark = n("[a-z]"), n("[A-Z]"), n("[0-9]"), n(r"[ \t\n\r\f\v]"), n("[-.,;:!?''\"()]")
    ascii_ = " - ".join([n(r"[\x00-\x7f]"), lower, upper, digit, space, mark])
    other_lower, other_upper = f"{n(r'\p{Ll}')} - {lower}", f"{n(r'\p{Lu}')} - {upper}"
    rest = f"length(t) - {n(r'[\x00-\x7f]')} - ({other_lower}) - ({other_upper})"
    return ", ".join([lower, upper, digit, space, mark, ascii_, other_lower, other_upper, rest])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
c AS (SELECT r, lang, length(t) AS size, unnest(range({len(CLASSES)})) AS i, unnest([{_counts_sql()}]) AS n FROM d),
cr AS (SELECT lang, i, sum(n) AS n FROM c GROUP BY ALL), ct AS (SELECT lang, sum(n) AS n FROM cr GROUP BY ALL),
cp AS (SELECT r, c.n / size AS p, cr.n / ct.n AS q FROM c JOIN cr USING (lang, i) JOIN ct USING (lang) WHERE size > 0),
cj AS ({_js_sql("cp")}),
w AS (SELECT r, lang, unnest(regexp_extract_all(lower(t), '{WORD}')) AS w FROM d),
wr AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL), wt AS (SELECT lang, sum(n) AS total FROM wr GROUP BY ALL),
common AS (SELECT lang, w, n, total FROM wr JOIN wt USING (lang) WHERE n >= total * {MIN_SHARE}),
ref AS (SELECT lang, w, n / total AS q FROM common UNION ALL
  SELECT lang, '', (any_value(wt.total) - coalesce(sum(common.n), 0)) / any_value(wt.total) FROM wt LEFT JOIN common USING (lang) GROUP BY lang),
own AS (SELECT w.r, coalesce(common.w, '') AS w, count(*) AS n FROM w LEFT JOIN common USING (lang, w) GROUP BY ALL),
nw AS (SELECT r, any_value(lang) AS lang, count(*) AS n_words FROM w GROUP BY r),
wp AS (SELECT nw.r, coalesce(own.n, 0) / n_words AS p, q FROM nw JOIN ref USING (lang) LEFT JOIN own ON own.r = nw.r AND own.w = ref.w),
wj AS ({_js_sql("wp")})
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(cj.js, 0), 6) AS char_js, round(coalesce(wj.js, 0), 6) AS word_js,
  NOT (length(t) >= {MIN_CHARS} AND coalesce(cj.js, 0) > {MAX_CHAR_JS} + {CHAR_SLACK} / sqrt(greatest(length(t), 1))
    OR coalesce(n_words, 0) >= {MIN_WORDS} AND coalesce(wj.js, 0) > {MAX_WORD_JS} + {WORD_SLACK} / sqrt(greatest(coalesce(n_words, 0), 1))) AS kept
FROM d LEFT JOIN cj USING (r) LEFT JOIN wj USING (r) LEFT JOIN nw USING (r)
"""

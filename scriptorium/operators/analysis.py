"""Analysis of translations: chrF, BLEU, lengths, repetitions, names, and their join by segment; bins for plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import tokens
from ..functions.text import is_name
from ..functions.tokenization import RuleTokenizer
from .truecase import truecase

N = 6
#: Rows of a batch that are looked at together.
SLICE_ROWS = 1 << 10
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
STATS = "hyp array<bigint>, ref array<bigint>, hit array<bigint>"


class Grams:
    """The distinct character n-grams of a text without spaces, as sorted hashes that end with n, and their counts."""

    def __init__(self, text: str, n: int = N):
        code = np.frombuffer(text.replace(" ", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.totals = np.maximum(len(code) - np.arange(n), 0)
        every, h = [], np.zeros(len(code), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, n + 1):
                h = h[: self.totals[k - 1]] * _STEP + code[k - 1 :]
                mixed = (h ^ (h >> np.uint64(31))) * _MIX
                every.append((mixed ^ (mixed >> np.uint64(29))) & ~np.uint64(15) | np.uint64(k))
        self.hashes, self.counts = np.unique(np.concatenate(every), return_counts=True)

    def common(self, other: Grams) -> np.ndarray:
        """Clipped common counts for every n."""
        _, i, j = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        hit = np.minimum(self.counts[i], other.counts[j])
        return np.bincount((self.hashes[i] & np.uint64(15)).astype(np.int64), weights=hit, minlength=len(self.totals) + 1)[1:].astype(np.int64)


def ngram_stats(hyp: str, refs: Sequence[str | Grams], n: int = N) -> tuple[list[int], list[int], list[int]]:
    """Character n-gram totals of the hypothesis and of the best reference for each n, and their common count; spaces don't count."""
    mine = Grams(hyp, n)
    best = [(-1.0, 0, 0)] * n
    for r in refs:
        theirs = r if isinstance(r, Grams) else Grams(r, n)
        for k, (hit, total, own) in enumerate(zip(mine.common(theirs).tolist(), theirs.totals.tolist(), mine.totals.tolist())):
            best[k] = max(best[k], (2 * hit / (own + total) if own + total else 0.0, total, hit))
    return mine.totals.tolist(), [b[1] for b in best], [b[2] for b in best]


def chrf(hyp: np.ndarray, ref: np.ndarray, hit: np.ndarray, beta: float) -> float:
    """F-score of the mean precision and recall over the n that occur."""
    use = (hyp > 0) | (ref > 0)
    if not use.any():
        return 0.0
    p = np.where(hyp > 0, hit / np.maximum(hyp, 1), 0)[use].mean()
    r = np.where(ref > 0, hit / np.maximum(ref, 1), 0)[use].mean()
    return float((1 + beta**2) * p * r / (beta**2 * p + r)) if p + r else 0.0


def chrf_score(hyp: str | Column, refs: str | Column, beta: float = 2.0) -> Column:
    """Sentence chrF of a text against an array of references, in Arrow batches."""

    def run(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else chrf(*map(np.array, ngram_stats(x, [z for z in y if z is not None])), beta) for x, y in zip(h, r)], dtype="float64")

    run.__annotations__ = {"h": pd.Series, "r": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(hyp, refs)


def evaluate_chrf(rows: DataFrame, hyp: str = "hyp", refs: str = "refs", betas: Sequence[float] = (2.0,)) -> DataFrame:
    """(beta, chrf, precision, recall) of a corpus: counts are added up over segments in Spark, then divided."""

    def run(batches):
        for pdf in batches:
            got = [ngram_stats(h or "", [x for x in (r if r is not None else []) if x is not None]) for h, r in zip(pdf[hyp], pdf[refs])]
            yield pd.DataFrame({"hyp": [g[0] for g in got], "ref": [g[1] for g in got], "hit": [g[2] for g in got]})

    sums = rows.select(hyp, refs).mapInPandas(run, STATS).agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("hyp", "ref", "hit") for i in range(N)])
    ratio = lambda of: sum((F.coalesce(F.try_divide(f"hit{i}", f"{of}{i}"), F.lit(0.0)) for i in range(N)), F.lit(0.0)) / N
    one = sums.select(ratio("hyp").alias("precision"), ratio("ref").alias("recall"))
    b = F.col("beta") * F.col("beta")
    score = F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0))
    return one.withColumn("beta", F.explode(F.array(*[F.lit(float(x)) for x in betas]))).select("beta", score.alias("chrf"), "precision", "recall")


def word_gram_hits(hyp: pa.ListArray, refs: Sequence[pa.ListArray], n: int = 4) -> tuple[list[int], list[int]]:
    """For every size up to n, the n-grams of all rows' outputs, and those of them that a reference has, clipped in each
    row at the most that one reference has of it."""
    lists = [hyp, *refs]
    flat = [x.flatten() for x in lists]
    words = pa.concat_arrays(flat).dictionary_encode()
    word, size, total, hit = np.asarray(words.indices).astype(np.int64), len(words.dictionary) + 1, [], []
    lengths = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in lists]
    cut = np.cumsum([len(x) for x in flat])
    # An n-gram of a row is a number: that of the row and the n-gram without its last word, then that word.
    gram = np.concatenate([np.repeat(np.arange(len(x)), x) for x in lengths]).astype(np.int64)
    left = np.concatenate([np.repeat(np.cumsum(x), x) - np.arange(x.sum()) for x in lengths])  # words from here to the end of the row
    side = np.repeat(np.arange(len(lists)), np.diff(cut, prepend=0))
    at = np.arange(len(word))
    for k in range(n):
        here = left > k
        at, gram, left, side = at[here], gram[here], left[here], side[here]
        known, gram = np.unique(gram * size + word[at + k], return_inverse=True)
        counts = [np.bincount(gram[side == i], minlength=len(known)) for i in range(len(lists))]
        total.append(int(counts[0].sum()))
        hit.append(int(np.minimum(counts[0], np.maximum.reduce(counts[1:])).sum()))
    return total, hit


def evaluate_bleu(rows: DataFrame, hyp: str = "hyp", ref: str | Sequence[str] = "ref") -> DataFrame:
    """Corpus BLEU-4 of tokenised text against one or several references: clipped n-gram counts, brevity penalty.

    An n-gram is clipped at the most that one reference has of it. The length that counts is that of the reference which
    is nearest to the output, the shorter of equally near ones. Every row is counted where it is, and only sums of
    batches are exchanged.
    """
    refs = [ref] if isinstance(ref, str) else list(ref)
    cut = rows.select(tokens(hyp).alias("h"), *[tokens(r).alias(f"r{i}") for i, r in enumerate(refs)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.size(f"r{i}") - F.size("h")).alias("d"), F.size(f"r{i}").alias("n")) for i in range(len(refs))]))["n"]
    sums = [*(f"total{n}" for n in range(4)), *(f"hit{n}" for n in range(4)), "c", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), SLICE_ROWS):
                some = batch.slice(a, SLICE_ROWS)
                total, hit = word_gram_hits(some.column(2), some.columns[3:])
                sizes = [pc.sum(some.column(i)).as_py() or 0 for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*total, *hit, *sizes)], names=sums)

    each = cut.select(F.size("h").alias("c"), nearest.alias("n"), "h", *[f"r{i}" for i in range(len(refs))])
    all_ = each.mapInArrow(run, ", ".join(f"{x} long" for x in sums)).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums])
    every = reduce(lambda x, y: x & y, [F.col(f"hit{n}") > 0 for n in range(4)])
    precision = F.when(every, F.exp(sum((F.log(F.try_divide(f"hit{n}", f"total{n}")) for n in range(4)), F.lit(0.0)) / 4)).otherwise(0.0)
    penalty = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide("r", "c")))
    return all_.select((100 * precision * F.coalesce(penalty, F.lit(0.0))).alias("bleu"))


def length_words(line: str | Column) -> Column:
    """Words between single spaces."""
    return F.size(F.split(F.col(line) if isinstance(line, str) else line, " ", -1))


def repeats(line: str | Column) -> Column:
    """struct(anywhere, consecutive) of repeated tokens that have one of a-z or 0-9."""
    t = F.filter(tokens(line), lambda x: F.regexp_like(x, F.lit("[a-z0-9]")))
    n = F.size(t)
    pairs = F.size(F.filter(F.arrays_zip(F.slice(t, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(t, 2, F.greatest(n - 1, F.lit(0))).alias("b")), lambda x: x["a"] == x["b"]))
    return F.struct((n - F.size(F.array_distinct(t))).alias("anywhere"), F.when(n > 1, pairs).otherwise(0).alias("consecutive"))


def lettered_names(line: str | Column) -> Column:
    return F.size(F.filter(tokens(line), is_name))


def join_segments(source: DataFrame, baseline: DataFrame, system: DataFrame, refs: Sequence[DataFrame]) -> DataFrame:
    """(docid, segid, src, bl, sys, refs) of segment tables (docid, segid, text); a segment needs source, both outputs and a reference."""
    key = ["docid", "segid"]
    named = lambda d, n: d.select(*key, F.col("text").alias(n))
    every = refs[0].select(*key, F.lit(0).alias("i"), "text")
    for i, r in enumerate(refs[1:], 1):
        every = every.unionByName(r.select(*key, F.lit(i).alias("i"), "text"))
    gathered = every.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("refs"))
    return named(source, "src").join(named(baseline, "bl"), key).join(named(system, "sys"), key).join(gathered, key)


def analyze_lengths(rows: DataFrame) -> DataFrame:
    out = {f"{c}_len_{unit}": f(F.col(c)) for c in ("src", "bl", "sys") for unit, f in (("chars", F.length), ("words", length_words))}
    out |= {"ref_len_chars": F.array_max(F.transform("refs", F.length)), "ref_len_words": F.array_max(F.transform("refs", length_words))}
    return rows.withColumns(out)


def _repeat_count(kind: str):
    return lambda text: repeats(text)[kind]


def analyze_repetitions(rows: DataFrame) -> DataFrame:
    out = {f"{c}_reps_{short}": repeats(c)[kind] for c in ("bl", "sys") for short, kind in (("anywhere", "anywhere"), ("conseq", "consecutive"))}
    out |= {f"ref_reps_{short}": F.array_max(F.transform("refs", _repeat_count(kind))) for short, kind in (("anywhere", "anywhere"), ("conseq", "consecutive"))}
    return rows.withColumns(out)


def analyze_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lnames", lettered_names("src"))


def analyze_chrf(rows: DataFrame) -> DataFrame:
    """Adds chrF1 and chrF2 of both outputs and their differences. A segment's references are cut into n-grams once."""
    names = [f"{c}_chrF{b}" for c in ("bl", "sys") for b in (1, 2)]

    def run(bl: pd.Series, sys: pd.Series, refs: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, r in zip(bl, sys, refs):
            known = None if r is None else [Grams(x) for x in r if x is not None]
            stats = [None if x is None or known is None else [np.array(y) for y in ngram_stats(x, known)] for x in (a, b)]
            out.append([None if s is None else chrf(*s, beta) for s in stats for beta in (1.0, 2.0)])
        return pd.DataFrame(out, columns=names, dtype="float64")

    run.__annotations__ = {"bl": pd.Series, "sys": pd.Series, "refs": pd.Series, "return": pd.DataFrame}
    scored = rows.withColumn("__s", F.pandas_udf(run, ", ".join(f"{n} double" for n in names))("bl", "sys", "refs"))
    out = scored.select(*rows.columns, *[F.col(f"__s.{n}").alias(n) for n in names])
    return out.withColumns({f"delta_chrF{b}": F.col(f"sys_chrF{b}") - F.col(f"bl_chrF{b}") for b in (1, 2)})


def with_bleu(rows: DataFrame, baseline: DataFrame, system: DataFrame) -> DataFrame:
    """Joins the BLEU listings and adds ``delta_bleu``, and ``delta_prod`` if chrF was analysed."""
    key = ["docid", "segid"]
    out = rows.join(baseline.select(*key, F.col("bleu").alias("bl_bleu")), key).join(system.select(*key, F.col("bleu").alias("sys_bleu")), key)
    out = out.withColumn("delta_bleu", F.col("sys_bleu") - F.col("bl_bleu"))
    return out.withColumn("delta_prod", F.col("delta_chrF1") * F.col("delta_bleu")) if "delta_chrF1" in out.columns else out


def retokenize(rows: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Tokenises the source in its language, and outputs and references in the target's; a few rows of a batch at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, target = RuleTokenizer(source_lang), RuleTokenizer(target_lang)
        each = lambda make, texts: None if texts is None else [None if t is None else make(t) for t in texts]
        for batch in batches:
            for a in range(0, len(batch), SLICE_ROWS):
                out = {n: c for n, c in zip(names, batch.slice(a, SLICE_ROWS).columns)}
                for n, make in (("src", source), ("bl", target), ("sys", target)):
                    out[n] = pa.array(each(make, out[n].to_pylist()), out[n].type)
                out["refs"] = pa.array([each(target, r) for r in out["refs"].to_pylist()], out["refs"].type)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return rows.mapInArrow(run, rows.schema)


def retruecase(rows: DataFrame, source_model: DataFrame | None, target_model: DataFrame | None) -> DataFrame:
    """Truecases the source by one model, and outputs and references by the other; None leaves them as they are."""
    key, out = ["docid", "segid"], rows
    for column, model in (("src", source_model), ("bl", target_model), ("sys", target_model)):
        if model is not None:
            out = out.drop(column).join(truecase(rows.select(*key, column), model, key, column), key)
    if target_model is not None:
        each = rows.select(*key, F.posexplode("refs").alias("i", "text"))
        cased = truecase(each, target_model, [*key, "i"], "text").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("refs"))
        out = out.drop("refs").join(cased, key)
    return out.select(*rows.columns)


def sorted_report(rows: DataFrame, by: str) -> DataFrame:
    """The segments in ascending order of a measure."""
    return rows.orderBy(by, "docid", "segid")


def quantize(df: DataFrame, field: str, bins: int = 15, name: str = "bin") -> DataFrame:
    """Adds the number (from 1) of the equal-width bin between the least value and the greatest plus 0.1, of ``bins`` edges."""
    ends = df.agg(F.min(field).alias("__lo"), (F.max(field) + 0.1).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / (bins - 1)
    return df.crossJoin(ends).withColumn(name, F.floor((F.col(field) - F.col("__lo")) / width).cast("long") + 1).drop("__lo", "__hi")


def melt(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wide to long: (x, translation, value) of ``bl_y`` and ``sys_y``."""
    return df.unpivot([x], [f"bl_{y}", f"sys_{y}"], "translation", "value")


def average_line(df: DataFrame, x: str, y: str, bins: int = 15) -> DataFrame:
    """Mean of both measures for each bin of x."""
    return quantize(df, x, bins).groupBy("bin").agg(F.avg(f"bl_{y}").alias(f"bl_{y}"), F.avg(f"sys_{y}").alias(f"sys_{y}"))

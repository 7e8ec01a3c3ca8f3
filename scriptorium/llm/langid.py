"""Language of every word by a linear-chain conditional random field, for code-switched text.

A word's emission is a sum of learned weights of its affixes, character n-grams and lexicon memberships; transitions
between the languages of neighbouring words are learned too. Labels are the most probable ones of each word under
forward-backward. A text is one chain, whatever its length: forward-backward runs over blocks of the chain side by side
and joins them through the products of their transition matrices, which is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, slices, utf8_bytes, where_kept, words_in

#: Bound of the training sample: labelled texts a language. Every language that has labelled texts is fitted.
SAMPLE_TEXTS = 300
#: Words of a training segment, segments of a training chain, and chains: at least, and for each language.
SEGMENT, SEGMENTS, CHAINS, CHAINS_EACH, EPOCHS = (4, 40), (1, 4), 2000, 30, 30
HASH_BITS, LEXICON_TEXTS = 18, 3
MIN_WORDS, MIN_SHARE, MIN_CONFIDENCE = 20, 0.25, 0.6
RESULT = "doc_id long, declared string, language string, n_words long, share double, confidence double, n_switches long, spans array<struct<start:int,n:int,lang:string>>, kept boolean"
_SEED = 20240601


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed features x languages
    lexicon: tuple[np.ndarray, np.ndarray]  # sorted word hashes, and for each the languages that have it as bits of words of 64
    transition: np.ndarray  # log potentials
    start: np.ndarray


# --- features ---------------------------------------------------------------------------------------------------------


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word) of the words raw[starts:ends].

    Features are the bigrams and trigrams of the bytes of the word between two edge marks, its prefixes and suffixes of
    up to 5 bytes, the languages whose lexicon has it (``bits``), and that none has it.
    """
    n, size = len(starts), ends - starts + 2
    first = np.append(0, np.cumsum(size))
    own = np.repeat(np.arange(n), size)
    inner = np.arange(first[-1]) - first[own]
    edge = (inner == 0) | (inner == size[own] - 1)
    text = np.empty(first[-1] + 8, dtype=np.uint64)
    text[: first[-1]] = np.where(edge, np.where(inner == 0, 1, 2), raw[np.clip(starts[own] + inner - 1, 0, len(raw) - 1)])
    text[first[-1] :] = 0
    rest = size[own] - inner
    words, codes = [], []
    packed = text[: first[-1]].copy()
    for k in range(2, 7):
        packed = packed | (text[k - 1 : first[-1] + k - 1] << np.uint64(8 * (k - 1)))
        use = rest >= k
        if k > 3:  # affixes only
            use &= (inner == 0) | (rest == k)
        words.append(own[use])
        codes.append(packed[use] * np.uint64(8) + np.uint64(k - 2))
    for i in range(n_languages):
        has = np.flatnonzero((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
        words.append(has)
        codes.append(np.full(len(has), 7 + 8 * (i + 1), dtype=np.uint64))
    none = np.flatnonzero(~bits.any(axis=1))
    words.append(none)
    codes.append(np.full(len(none), 7, dtype=np.uint64))
    word, code = np.concatenate(words), np.concatenate(codes)
    order = np.argsort(word, kind="stable")
    at = (mix64(code[order]) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    return at, np.searchsorted(word[order], np.arange(n))


def _lexicon_bits(h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, bits = lexicon
    if not len(known):
        return np.zeros((len(h), bits.shape[1]), np.uint64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where((known[at] == h)[:, None], bits[at], np.uint64(0))


# --- forward-backward -------------------------------------------------------------------------------------------------


def forward_backward(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(posteriors, expected transitions) of chains laid end to end; ``first`` marks their first words.

    e: words x labels, emission potentials; transition, start: potentials too.
    """
    n, k = e.shape
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    fill = blocks * length - n
    e = np.concatenate([e, np.ones((fill, k))]).reshape(blocks, length, k).transpose(1, 0, 2).copy()
    new = np.concatenate([first, np.ones(fill, bool)]).reshape(blocks, length).T.copy()
    any_new = new.any(axis=1)
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(length):
        step = (product.reshape(-1, k) @ transition).reshape(blocks, k, k)
        if any_new[t]:
            step[new[t]] = product[new[t]].sum(axis=2, keepdims=True) * start
        product = step * e[t][:, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    before, after = np.empty((blocks + 1, k)), np.empty((blocks + 1, k))
    before[0], after[blocks] = 1 / k, 1
    for b in range(blocks):
        v = before[b] @ product[b]
        before[b + 1] = v / v.sum()
    for b in range(blocks - 1, -1, -1):
        v = product[b] @ after[b + 1]
        after[b] = v / v.max()
    alpha, ahead = before[:blocks], np.empty_like(e)
    for t in range(length):
        step = alpha @ transition
        if any_new[t]:
            step[new[t]] = start
        alpha = step * e[t]
        alpha /= alpha.sum(axis=1, keepdims=True)
        ahead[t] = alpha
    beta, out = after[1:], np.empty_like(e)
    expected = np.zeros((k, k)) if pairs else None
    for t in range(length - 1, -1, -1):
        g = ahead[t] * beta
        out[t] = g / g.sum(axis=1, keepdims=True)
        w = e[t] * beta
        if pairs:
            prior = ahead[t - 1] if t else before[:blocks]
            joint = prior[:, :, None] * transition * w[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[~new[t]].sum(axis=0)
        step = w @ transition.T
        if any_new[t]:
            step[new[t]] = (w[new[t]] @ start)[:, None]
        beta = step / step.max(axis=1, keepdims=True)
    return out.transpose(1, 0, 2).reshape(-1, k)[:n], expected


# --- training ---------------------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> DataFrame | None:
    """(lang, h, text): at most ``texts`` different texts of each language, those of the least hashes of about twice as many
    that are drawn by the hash; None without any language. Copies of a text are one."""
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    h = F.xxhash64(text, F.lit(_SEED))
    named = docs.where(text.isNotNull() & (F.trim(lang) != "")).select(lang.alias("lang"), h.alias("h"), text.alias("text"))
    top = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not top:
        return None
    rate = F.create_map(*[x for r in top for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * texts / max(r["n"], 1))))])
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # Copies are dropped before they are exchanged, so a text that fills a third of the table is a row a task.
    once = named.where(draw < F.coalesce(rate[F.col("lang")], F.lit(0.0))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("r", first).where(F.col("r") <= texts).drop("r")


def fit(sample: dict[str, list[str]], chains: int = CHAINS, epochs: int = EPOCHS, seed: int = _SEED) -> Model:
    """Trains on chains that are spliced from segments of the sampled texts, so that switches are seen and learned."""
    languages, rng = sorted(sample), np.random.default_rng(seed)
    k = len(languages)
    hashes, spans, raws, base = [], [], [], 0
    by_lang: list[list[tuple[int, int]]] = [[] for _ in languages]  # word ranges of texts
    seen: dict[int, int] = {}  # any number of bits
    n = 0
    for i, lang in enumerate(languages):
        raw, offsets = utf8_bytes(pc.utf8_lower(pa.array(sample[lang], pa.large_string())))
        h, row, s, e = words_in(raw, offsets)
        cuts = np.searchsorted(row, np.arange(len(sample[lang]) + 1))
        by_lang[i] = [(n + a, n + b) for a, b in zip(cuts, cuts[1:]) if b > a]
        both = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1)[0]
        word, texts = np.unique(both, return_counts=True)
        for w in word[texts >= LEXICON_TEXTS].tolist():
            seen[w] = seen.get(w, 0) | 1 << i
        hashes.append(h)
        spans.append(np.stack([s + base, e + base]))
        raws.append(raw)
        base += len(raw)
        n += len(h)
    known = np.array(sorted(seen), dtype=np.uint64)
    parts = max(1, -(-k // 64))
    lexicon = (known, np.array([[seen[int(w)] >> 64 * j & (1 << 64) - 1 for j in range(parts)] for w in known], dtype=np.uint64).reshape(-1, parts))
    empty = Model(languages, np.zeros((1 << HASH_BITS, max(k, 1))), lexicon, np.zeros((max(k, 1),) * 2), np.zeros(max(k, 1)))
    usable = [i for i in range(k) if by_lang[i]]
    if k < 2 or len(usable) < 2:
        return empty
    h, span, raw = np.concatenate(hashes), np.concatenate(spans, axis=1), np.concatenate(raws)
    words, labels, first = [], [], []
    for _ in range(chains):
        for j in range(int(rng.integers(SEGMENTS[0], SEGMENTS[1] + 1))):
            i = usable[int(rng.integers(len(usable)))]
            a, b = by_lang[i][int(rng.integers(len(by_lang[i])))]
            size = min(b - a, int(rng.integers(SEGMENT[0], SEGMENT[1] + 1)))
            at0 = int(rng.integers(a, b - size + 1))
            words.append(np.arange(at0, at0 + size))
            labels.append(np.full(size, i))
            first.append(np.arange(size) == (0 if j == 0 else -1))
    place, y, new = np.concatenate(words), np.concatenate(labels), np.concatenate(first)
    # Only words that a chain uses get features.
    unique, at, w = np.unique(h[place], return_index=True, return_inverse=True)
    at = place[at]
    feats, firsts = features(raw, span[0][at], span[1][at], _lexicon_bits(unique, lexicon), k)
    of_word = np.repeat(np.arange(len(unique)), np.diff(np.append(firsts, len(feats))))
    used, feats = np.unique(feats, return_inverse=True)  # the others keep a weight of 0
    observed = np.zeros((k, k))
    inside = np.flatnonzero(~new)
    np.add.at(observed, (y[inside - 1], y[inside]), 1)
    initial = np.bincount(y[new], minlength=k).astype(float)
    params = [np.zeros((len(used), k)), empty.transition, empty.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = np.eye(k)[y]
    for epoch in range(1, epochs + 1):
        emission = np.add.reduceat(params[0][feats], firsts, axis=0)
        z = emission[w]
        post, pairs = forward_backward(np.exp(z - z.max(axis=1, keepdims=True)), new, np.exp(params[1]), np.exp(params[2]), pairs=True)
        by_word = np.stack([np.bincount(w, weights=d, minlength=len(unique)) for d in (target - post).T], axis=1)
        g0 = np.stack([np.bincount(feats, weights=by_word[of_word, j], minlength=len(used)) for j in range(k)], axis=1)
        grads = [g0 / len(w) - 1e-6 * params[0], (observed - pairs) / len(w) - 1e-6 * params[1], (initial - post[new].sum(axis=0)) / len(w) - 1e-6 * params[2]]
        for p, g, (m, v) in zip(params, grads, moments):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    weights = np.zeros((1 << HASH_BITS, k), np.float32)
    weights[used] = params[0]
    return Model(languages, weights, lexicon, params[1], params[2])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> Model:
    """Fits the model in one task, as the sample is bounded; only the model reaches the driver."""
    sample = labelled_sample(docs, text_col, lang_col, texts)
    if sample is None:
        return fit({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[int, str]]] = {}
        for batch in batches:
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(lang, []).append((h, text))
        model = fit({k: [t for _, t in sorted(v)] for k, v in found.items()}, max(CHAINS, CHAINS_EACH * len(found)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])


# --- labelling --------------------------------------------------------------------------------------------------------


class Tagger:
    """Labels Arrow columns of texts. Emissions of words are remembered, as a word has the same ones everywhere."""

    MOST = 1 << 20

    def __init__(self, model: Model):
        self.model, k = model, len(model.weights[0])
        self.transition, self.start = np.exp(model.transition), np.exp(model.start)
        # Of more than 4 languages, fewer words are held and labelled at a time, so that memory stays the same.
        self.most, self.bytes = self.MOST * 4 // max(k, 4), (1 << 22) * 4 // max(k, 4)
        self.place = {x: i for i, x in enumerate(model.languages)}
        self.known, self.emission = np.zeros(0, np.uint64), np.zeros((0, k))

    def _emissions(self, unique: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, unique)
        hit = np.zeros(len(unique), bool)
        if len(self.known):
            hit = self.known[np.minimum(at, len(self.known) - 1)] == unique
        out = np.empty((len(unique), self.emission.shape[1]))
        out[hit] = self.emission[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            feats, firsts = features(raw, starts[miss], ends[miss], _lexicon_bits(unique[miss], self.model.lexicon), len(self.model.languages))
            z = np.add.reduceat(self.model.weights[feats], firsts, axis=0)
            out[miss] = np.exp(z - z.max(axis=1, keepdims=True))
            if len(self.known) + len(miss) > self.most:
                self.known, self.emission = unique, out
            else:
                self.known, self.emission = np.insert(self.known, at[miss], unique[miss]), np.insert(self.emission, at[miss], out[miss], axis=0)
        return out

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, label, posterior of the label) of every word."""
        raw, offsets = utf8_bytes(pc.utf8_lower(texts))
        h, row, starts, ends = words_in(raw, offsets)
        if not len(h):
            return row, np.zeros(0, np.int64), np.zeros(0)
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        e = self._emissions(unique, raw, starts[at], ends[at])[inverse]
        first = np.append(True, row[1:] != row[:-1])
        post, _ = forward_backward(e, first, self.transition, self.start)
        label = post.argmax(axis=1)
        return row, label, post[np.arange(len(label)), label]


def _judge(tagger: Tagger, texts: pa.Array, declared: pa.Array, limits: tuple[int, float, float]) -> dict:
    """Figures of each row and the word labels."""
    names = tagger.model.languages
    n, k = len(texts), max(len(names), 1)
    row, label, sure = tagger.tag(texts)
    counts = np.bincount(row * k + label, minlength=n * k).reshape(n, k)
    words = counts.sum(axis=1)
    own = np.array([tagger.place.get(x, -1) for x in declared.to_pylist()], dtype=np.int64)
    best = counts.argmax(axis=1)
    judged = np.where(own >= 0, own, best)
    share = counts[np.arange(n), judged] / np.maximum(words, 1)
    confidence = np.bincount(row, weights=sure, minlength=n) / np.maximum(words, 1)
    least, min_share, min_confidence = limits
    bad = (words >= least) & ((share < min_share) | (confidence < min_confidence)) if len(names) > 1 else np.zeros(n, bool)
    return {"row": row, "label": label, "words": words, "best": best, "share": share, "confidence": confidence, "kept": ~bad}


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per document: its main language, the share of words in its declared language, and the spans of languages.

    ``spans`` has the runs of words of one language as (first word, words, language); together they cover all words.
    ``share`` is that of the declared language, or of the main one where none is declared or the model doesn't know it.
    A document of at least ``min_words`` words is rejected if ``share`` is below ``min_share`` or the mean posterior of
    its words' labels is below ``min_confidence``.

    * A null, empty or wordless text has no language and no spans, shares of 0, and is kept.
    * Of equal counts the language first in the alphabet is the main one. Repeated rows are each labelled.
    * With fewer than two languages in the table there is nothing to tell apart: all is kept. An empty table gives no rows.
    * Further columns are not used, whatever their names.
    """
    model = model or train(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: hashed features and a sampled lexicon
    limits = (min_words, min_share, min_confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        names = pa.array([*shared.value.languages, None][: max(len(shared.value.languages), 1)], pa.string())
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)))
            for a, b in slices(sizes, tagger.bytes):
                part = batch.slice(a, b - a)
                got = _judge(tagger, part.column(1), part.column(2), limits)
                n, row, label = len(part), got["row"], got["label"]
                turn = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1]))) if len(row) else np.zeros(0, np.int64)
                starts_of_rows = np.searchsorted(row, np.arange(n))
                runs = np.bincount(row[turn], minlength=n)
                size = np.diff(np.append(turn, len(row)))
                spans = pa.StructArray.from_arrays([pa.array((turn - starts_of_rows[row[turn]]).astype(np.int32)), pa.array(size.astype(np.int32)), names.take(pa.array(label[turn]))], names=["start", "n", "lang"])
                language = names.take(pa.array(np.where(got["words"] > 0, got["best"], 0))) if n else names.slice(0, 0)
                language = pc.if_else(pa.array(got["words"] > 0), language, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), language, pa.array(got["words"].astype(np.int64)), pa.array(np.round(got["share"], 6)), pa.array(np.round(got["confidence"], 6)), pa.array(np.maximum(runs - 1, 0).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)).astype(np.int32)), spans), pa.array(got["kept"])],
                    names=["doc_id", "declared", "language", "n_words", "share", "confidence", "n_switches", "spans", "kept"],
                )

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Model | None = None, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, as they are. Cases as there."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col, lang_col))
    limits, made = (min_words, min_share, min_confidence), []

    def decide(batch: pa.RecordBatch) -> np.ndarray:
        if not made:
            made.append(Tagger(shared.value))
        sizes = np.asarray(pc.binary_length(batch.column(0)))
        parts = [_judge(made[0], batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), limits)["kept"] for a, b in slices(sizes, made[0].bytes)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    return where_kept(docs, [F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(lang_col).cast("string")], decide)

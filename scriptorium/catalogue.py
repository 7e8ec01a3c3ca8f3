"""Registered queries over the driver's tables, and the SQL that DuckDB runs to check them.

Every query runs over whole tables. Lines are the documents' texts cut at newlines, in the order of (doc_id, line_no);
parallel columns are neighbouring turns of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import lines_of, tokens, with_position
from .functions import filters as P
from .functions import text as X
from .functions.languages import contractions
from .functions import tokenization as K
from .operators import analysis, blocks, bpe, counts, dedup, lookup, morph, noise, order, pipes, profile, sgm, tabular, truecase
from .plans import recipe
from .sources import files
from .storage import expire, fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["doc_id", "line_no"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def L(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(table(spark, sf, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.col("text").alias("line"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, c0, c1): a turn and the next one."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("c1"))
    return c.withColumnRenamed("text", "c0").join(nxt, ["conv_id", "turn"])


def morphs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pos, line): the benchmark's tokens as a table of surface, lemma, base and tags; an empty row ends a text."""
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.concat(tokens("text"), F.array(F.lit("")))).alias("pos", "t"))
    low = F.lower("t")
    tags = F.concat(F.lit("[POS="), F.substring(low, 1, 1), F.lit("]|[X=1]|[NUM="), F.length("t").cast("string"), F.lit("]"))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("t") == "", "").otherwise(F.concat_ws("\t", F.col("t"), low, F.concat(low, F.lit("-"), low), tags)).alias("line"))


L_SQL = "(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
T_SQL = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
TOK = T_SQL.format("line")
B_SQL = "(SELECT item_id AS doc_id, CAST(0 AS BIGINT) AS line_no, text AS line FROM benchmark)"
PAIRS_SQL = "(SELECT a.conv_id, a.turn, a.text AS c0, b.text AS c1 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
COUNTS_SQL = f"(SELECT word, count(*) AS count FROM (SELECT unnest({TOK}) AS word FROM {L_SQL}) GROUP BY word)"
MORPH_SQL = rf"""(SELECT doc_id, pos, t, CASE WHEN t = '' THEN '' ELSE concat_ws(chr(9), t, lower(t), lower(t) || '-' || lower(t), '[POS=' || lower(substring(t, 1, 1)) || ']|[X=1]|[NUM=' || length(t) || ']') END AS line
 FROM (SELECT item_id AS doc_id, CAST(generate_subscripts(ts, 1) - 1 AS BIGINT) AS pos, unnest(ts) AS t FROM (SELECT item_id, list_append({T_SQL.format('text')}, '') AS ts FROM benchmark)))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- cells: name, function, SQL over ``line`` -------------------------------------------------------------------------


WORDLIKE = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by_char(case: str, source: str = L_SQL) -> str:
    """A line anew from its characters: ``case`` has the character c, its place i from 1, and all of them, cs."""
    cs = f"(SELECT doc_id, line_no, line, list_filter(string_split(line, ''), lambda y: y <> '') AS cs FROM {source})"
    return f"SELECT doc_id, line_no, coalesce(array_to_string(list_transform(cs, lambda c, i: {case}), ''), '') AS line FROM {cs}"


def _punctuation_sql() -> str:
    out = "line"
    for _ in range(2):  # neighbours share a letter
        out = f"regexp_replace({out}, '({WORDLIKE})[‘’]({WORDLIKE})', '\\1''\\2', 'g')"
    for some in ("-'\"", "/_%‰"):
        pairs = {c: to for to, group in X._PUNCTUATION.items() if to in some for c in group}
        out = f"translate({out}, {quoted(''.join(pairs))}, {quoted(''.join(pairs.values()))})"
        if some[0] == "-":
            out = f"replace({out}, {quoted(chr(39) * 2)}, {quoted(chr(34))})"
    return out


def _map_chars_sql() -> str:
    spared = "".join(c if c.isalnum() or ord(c) > 127 or c in " _\t" else "\\" + c for c in X._SPARED)
    kept = r"\p{Ll}\p{Lo}\p{Lt}\p{Lu}\p{Nd}\p{Sc}\p{Sm}" + spared.replace("'", "''")
    return f"regexp_replace(regexp_replace(line, '\\p{{Zs}}', ' ', 'g'), '[^{kept}]', '', 'g')"


def _contraction_patterns(reverse: bool) -> list[tuple[str, str]]:
    pairs = [(b, a) if reverse else (a, b) for a, b in contractions("en")]
    return [(a.replace("'", " ?' ?"), b) for a, b in pairs]


def _contractions_sql(reverse: bool) -> str:
    out = "line"
    for a, b in _contraction_patterns(reverse):
        out = f"regexp_replace({out}, {quoted(f'(?i){chr(92)}b{a}{chr(92)}b')}, {quoted(b.replace(chr(39), ' ' + chr(39)))}, 'g')"
    return out


def _simple_tokenize_sql(last: str = "line") -> str:
    marks = quoted(K.PUNCTUATION)
    one = _by_char(f"CASE WHEN contains({marks}, c) AND coalesce(cs[i - 1], '') <> c AND cs[i + 1] IS NOT NULL AND NOT contains({marks} || ' ', cs[i + 1]) THEN c || '⁙ ' ELSE c END")
    two = _by_char(f"CASE WHEN contains({marks}, c) AND i > 1 AND cs[i - 1] NOT IN (' ', c) THEN ' ⁙' || c ELSE c END", f"({one})")
    return f"SELECT doc_id, line_no, {last} AS line FROM ({two})"


_LETTERED = "'⸫' || t[1] || coalesce(' ' || nullif(array_to_string(list_transform(range(2, length(t)), lambda k: '⸬' || t[k]), ' '), ''), '') || ' ⸭' || t[length(t)]"
_SPLIT_NUMBER = "array_to_string(list_transform(range(1, length(t) + 1), lambda k: CASE WHEN k > 1 AND (length(t) - k + 1) % 3 = 0 THEN ' ⁙' ELSE '' END || t[k]), '')"
_APART = r"NOT regexp_matches(coalesce(cs[i {0} 1], 'x'), '[\s\p{{Z}}{1}]')"
_EACH = f"(SELECT doc_id, line_no, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT doc_id, line_no, {TOK} AS ts FROM {L_SQL}))"
#: Tokens with w: has a word character; first: no token before it in its sentence has one.
_EVENTS = f"(SELECT *, coalesce(sum(r::INT) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT *, regexp_matches(t, '{WORDLIKE}') AS w, regexp_matches(t, '^[.!?:]$') AS r FROM {_EACH}))"
_STARTS = f"(SELECT *, coalesce(sum(w::INT) OVER (PARTITION BY doc_id, line_no, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first FROM {_EVENTS})"


def _joined(source: str, word: str, where: str = "true", otherwise: str = "''", order: str = "i") -> str:
    """Lines of the words of ``source`` in order; ``otherwise`` for lines without any."""
    return f"SELECT l.doc_id, l.line_no, coalesce(m.line, {otherwise}) AS line FROM {L_SQL} l LEFT JOIN (SELECT doc_id, line_no, string_agg({word}, ' ' ORDER BY {order}) AS line FROM {source} WHERE {where} GROUP BY 1, 2) m USING (doc_id, line_no)"


def _draw_sql(i: str) -> str:
    return f"(('0x' || substring(md5(concat_ws('-', '1', doc_id, line_no, {i})), 1, 13))::BIGINT / 4503599627370496.0)"


_SPACED = f"(SELECT doc_id, line_no, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT doc_id, line_no, string_split(trim(line), ' ') AS ts FROM {L_SQL}))"


def _dirty(line: Column) -> Column:
    """Entities and a ligature put into a line."""
    return F.replace(F.replace(line, F.lit(" and "), F.lit(" &amp; ")), F.lit("fi"), F.lit("ﬁ"))


def _notes_sql() -> str:
    out = "line"
    for note in X.SPEAKER_NOTES:
        out = rf"regexp_replace({out}, '^[ .,-]*{note} *[ .,-]*\([A-Za-z]{{2}}\) ', '')"
    return out


CELLS: list[tuple[str, Callable[[Column], Column], str | None]] = [
    ("denormalize_punctuation", X.denormalize_punctuation, "translate(line, '\"''', '”’')"),
    ("normalize_punctuation", X.normalize_punctuation, _punctuation_sql()),
    ("map_chars", X.map_chars, _map_chars_sql()),
    ("clean", lambda c: X.clean(_dirty(c)), "replace(line, ' and ', ' & ')"),
    ("letterize_names", X.letterize_names, f"coalesce(array_to_string(list_transform({TOK}, lambda t: CASE WHEN NOT contains(t, '⁙') AND length(t) > 1 AND regexp_matches(t, '^[\\p{{Lu}}\\p{{Nd}}]') THEN {_LETTERED} ELSE t END), ' '), '')"),
    ("normalize_contractions", X.normalize_contractions, _contractions_sql(False)),
    ("normalize_contractions_reverse", lambda c: X.normalize_contractions(c, reverse=True), _contractions_sql(True)),
    ("normalize_long_sounds", X.normalize_long_sounds, _by_char("CASE WHEN i > 3 AND c = cs[i - 1] AND c = cs[i - 2] AND c = cs[i - 3] THEN '' ELSE c END")),
    ("split_numbers", X.split_numbers, r"regexp_replace(line, '(\d)([-/,.])(\d)', '\1@@ \2@@ \3', 'g')"),
    ("prefix", lambda c: X.prefix(c, "<s> ", " </s>"), "'<s> ' || line || ' </s>'"),
    ("truncate_words", X.truncate_words, f"array_to_string(list_transform({TOK}, lambda y: y[1:5]), ' ')"),
    ("truncate_words_suffix", lambda c: X.truncate_words(c, 4, False), f"array_to_string(list_transform({TOK}, lambda y: right(y, 4)), ' ')"),
    ("undo_double_ampersand", X.undo_double_ampersand, "replace(line, '&amp; amp ;', '&')"),
    ("zero_width_space", X.zero_width_space, "replace(line, chr(8203), ' ')"),
    ("leading_hyphen", X.leading_hyphen, "regexp_replace(line, '^ ?- ?', '')"),
    ("space_before_url", X.space_before_url, r"regexp_replace(line, '([^ ])(https?://)', '\1 \2', 'g')"),
    ("remove_language_tags", X.remove_language_tags, _notes_sql()),
    ("lowercase", X.lowercase, "lower(line)"),
    ("identity", X.identity, "line"),
    ("regex_substitution", lambda c: X.regex_substitution(c, [("[aeiou]+", "_"), ("th_", "<$0>")]), r"regexp_replace(regexp_replace(line, '[aeiou]+', '_', 'g'), '(th_)', '<\1>', 'g')"),
    ("regex_dispatch", lambda c: F.coalesce(X.regex_dispatch(c, [("([A-Z])(.*)", lambda x, g: F.concat(g(2), g(1))), ("[0-9]", lambda x, g: F.lit("number"))]), F.lit("<dropped>")), r"CASE WHEN regexp_matches(line, '^[A-Z]') THEN regexp_extract(line, '^([A-Z])(.*)', 2) || regexp_extract(line, '^([A-Z])', 1) WHEN regexp_matches(line, '^[0-9]') THEN 'number' ELSE '<dropped>' END"),
    ("simple_tokenize", K.simple_tokenize, _simple_tokenize_sql()),
    ("simple_tokenize_round_trip", lambda c: K.simple_detokenize(K.simple_tokenize(c)), _simple_tokenize_sql("replace(replace(replace(line, '⁙ ', ''), ' ⁙', ''), '⁙', '')")),
    ("simple_detokenize", lambda c: K.simple_detokenize(F.replace(c, F.lit(", "), F.lit(" ⁙, "))), "replace(replace(replace(replace(line, ', ', ' ⁙, '), '⁙ ', ''), ' ⁙', ''), '⁙', '')"),
    ("joiner_tokenize", K.joiner_tokenize, None),
    ("joiner_detokenize", lambda c: K.joiner_detokenize(F.replace(c, F.lit("."), F.lit(" ⁙."))), "replace(replace(replace(replace(line, '.', ' ⁙.'), '⁙ ', ''), ' ⁙', ''), '⁙', '')"),
    ("tokenize_en", lambda c: K.tokenize(c, "en"), None),
    ("tokenize_fi", lambda c: K.tokenize(c, "fi"), None),
    ("detokenize", lambda c: K.detokenize(c, "en"), None),
    ("split_long_numbers", K.split_long_numbers, f"coalesce(array_to_string(list_transform({TOK}, lambda t: CASE WHEN regexp_matches(t, '^▁?[0-9]+$') AND length(replace(t, '▁', '')) > 4 THEN {_SPLIT_NUMBER} ELSE t END), ' '), '')"),
    ("split_hyphens", K.split_hyphens, _by_char(f"CASE WHEN c = '-' AND {_APART.format('-', '-')} AND {_APART.format('+', chr(92) + 'p{Nd}-')} THEN ' - ' ELSE c END")),
    ("split_hyphens_strictly", K.split_hyphens_strictly, _by_char("CASE WHEN c = '-' AND i > 4 AND regexp_matches(array_to_string(cs[i - 4:i - 1], ''), '^[A-Za-z]{4}$') AND regexp_matches(array_to_string(cs[i + 1:i + 4], ''), '^[A-Za-z]{4}$') THEN ' - ' ELSE c END")),
    ("split_all_hyphens", K.split_all_hyphens, _by_char(f"CASE WHEN c = '-' AND {_APART.format('-', '')} AND {_APART.format('+', '')} THEN ' - ' ELSE c END")),
    ("split_decimal", K.split_decimal, r"regexp_replace(line, '([0-9])([.,])([0-9])', '\1 \2 \3', 'g')"),
    ("char_segmentation", K.char_segmentation, "array_to_string(list_filter(string_split(replace(line, ' ', '⁘'), ''), lambda y: y <> ''), ' ')"),
    ("detruecase", truecase.detruecase, _joined(_STARTS, "CASE WHEN first AND w THEN upper(t[1]) || t[2:] ELSE t END")),
    ("drop_tokens", lambda c: noise.drop_tokens(c, KEY), _joined(_EACH, "t", f"{_draw_sql('i - 1')} >= 0.1", "l.line")),
    ("perturb_order", lambda c: noise.perturb_order(c, KEY), _joined(_EACH, "t", order=f"i - 1 + 3 * {_draw_sql('i - 1')}, t")),
    ("perturb_words", lambda c: noise.perturb_words(c, KEY), _joined(_SPACED, "t", order=f"i - 1 + 3 * {_draw_sql('i - 1')}, t")),
]


def _add_cell(name: str, f: Callable[[Column], Column], sql: str | None) -> None:
    whole = sql if not sql or sql.startswith("SELECT") else f"SELECT doc_id, line_no, {sql} AS line FROM {L_SQL}"
    query(name, whole)(lambda s, d: L(s, d).select(*KEY, f(F.col("line")).alias("line")))


for _name, _f, _sql in CELLS:
    _add_cell(_name, _f, _sql)


# --- filters: name, predicate, SQL predicate (true removes) -----------------------------------------------------------


def _strikes_sql() -> str:
    numeric = f"len(list_filter({TOK}, lambda y: regexp_matches(y, '^[0-9.,-]+$')))"
    parts = [f"CAST({numeric} >= {n} AS INT)" for n in (4, 6, 10)]
    for c, limits in P.STRIKES.items():
        parts += [f"CAST(length(line) - length(replace(line, '{c}', '')) >= {n} AS INT)" for n in limits]
    return f"({' + '.join(parts)}) >= 4"


FILTERS: list[tuple[str, Callable[[Column], Column], str | None]] = [
    ("filter_nothing", P.nothing, "false"),
    ("filter_inverse", lambda c: P.inverse(P.ellipsis(c)), "NOT contains(line, '...')"),
    ("filter_regex", lambda c: P.matches(c, ["[0-9]{3}", "license"], True), "regexp_matches(line, '(?i)[0-9]{3}|license')"),
    ("filter_by_length", lambda c: P.by_length(c, 3, 40, 10, 300, 20), f"length(trim(line)) < 10 OR length(line) > 300 OR len({TOK}) < 3 OR len({TOK}) > 40 OR len(list_filter({TOK}, lambda y: length(y) > 20)) > 0"),
    ("filter_foreign_chars", lambda c: P.foreign_chars(c, "éèêçñüß ö", 5), "length(line) - length(translate(line, 'éèêçñüßö', '')) > 5"),
    ("filter_bureaucratic", P.bureaucratic, _strikes_sql()),
    ("filter_repetitive", lambda c: P.repetitive(c, 8, 3), f"len(list_filter(range(1, len({TOK}) - 1), lambda i: ({TOK})[i] = ({TOK})[i + 1] AND ({TOK})[i] = ({TOK})[i + 2])) > 0 OR coalesce(list_max(map_values(list_histogram({TOK}))), 0) >= 8"),
    ("filter_single_url", P.single_url, "regexp_matches(line, '(?i)^https?://[^ ]*$')"),
    ("filter_any_url", P.any_url, "regexp_matches(line, '(?i)https?://[^ ]')"),
    ("filter_ellipsis", P.ellipsis, "contains(line, '...')"),
    ("filter_accent_noise", P.accent_noise, f"length(replace(line, ' ', '')) >= 6 AND length(replace(line, ' ', '')) - length(translate(replace(line, ' ', ''), '{P.ACCENT_NOISE}', '')) > 0.4 * length(replace(line, ' ', ''))"),
    ("filter_news_crawl_urls", P.news_crawl_urls, r"regexp_matches(line, 'http://www\.iltasanomat\.fi')"),
]


def _add_filter(name: str, p: Callable[[Column], Column], sql: str | None) -> None:
    query(name, f"SELECT doc_id, line_no, line FROM {L_SQL} WHERE NOT ({sql})" if sql else None)(lambda s, d: P.apply(L(s, d), p(F.col("line")))[0])


for _name, _f, _sql in FILTERS:
    _add_filter(_name, _f, _sql)


_SHORT = f"replace(line, 'the ', 'don''t ')"
_ANY_SHORT = quoted("(?i)" + "|".join(rf"\b{a}\b" for a, _ in _contraction_patterns(False)))


@query("filter_contractions", f"SELECT doc_id, line_no, {_SHORT} AS line FROM {L_SQL} WHERE NOT regexp_matches({_SHORT}, {_ANY_SHORT})")
def _(s, d):
    return P.apply(L(s, d).withColumn("line", F.replace("line", F.lit("the "), F.lit("don't "))), P.has_contraction("line"))[0]


@query("filter_unclean", f"SELECT doc_id, line_no, line FROM {L_SQL} WHERE NOT (contains(line, ' and ') OR contains(line, 'fi'))")
def _(s, d):
    return P.apply(L(s, d).withColumn("line", _dirty(F.col("line"))), P.unclean("line"))[0]


query("filter_only_names", f"SELECT word, count FROM {COUNTS_SQL} WHERE length(word) > 1 AND regexp_matches(word, '^[\\p{{Lu}}\\p{{Nd}}]')")(lambda s, d: counts.filter_counts(counts.count_tokens(L(s, d)), P.only_names))


@query("mono_filter_rejects", f"SELECT doc_id, line_no, line FROM {L_SQL} WHERE contains(line, '...')")
def _(s, d):
    return pipes.pipe(pipes.remove(P.ellipsis, log="rejects"))(L(s, d)).side["rejects"]


PARALLEL = {
    "parallel_filter": (lambda c0, c1: P.by_length(c0, max_tokens=60) | P.any_url(c1), f"len({T_SQL.format('c0')}) > 60 OR regexp_matches(c1, '(?i)https?://[^ ]')"),
    "length_ratio": (lambda c0, c1: P.length_ratio(c0, c1, 0.5), "CASE WHEN length(c0) < 10 AND length(c1) < 10 THEN false WHEN length(c0) = 0 OR length(c1) = 0 THEN true ELSE length(c0) / length(c1) < 0.5 OR length(c0) / length(c1) > 2 END"),
    "length_ratio_tokens": (lambda c0, c1: P.length_ratio(c0, c1, 0.4, 3, 5, in_tokens=True), f"CASE WHEN len({T_SQL.format('c0')}) < 5 AND len({T_SQL.format('c1')}) < 5 THEN false WHEN len({T_SQL.format('c0')}) = 0 OR len({T_SQL.format('c1')}) = 0 THEN true ELSE len({T_SQL.format('c0')}) / len({T_SQL.format('c1')}) < 0.4 OR len({T_SQL.format('c0')}) / len({T_SQL.format('c1')}) > 3 END"),
    "length_ratio_alpha": (lambda c0, c1: P.length_ratio(c0, c1, 0.5, only_alpha=True), "CASE WHEN length(regexp_replace(lower(c0), '[^a-z]', '', 'g')) < 10 AND length(regexp_replace(lower(c1), '[^a-z]', '', 'g')) < 10 THEN false WHEN length(regexp_replace(lower(c0), '[^a-z]', '', 'g')) = 0 OR length(regexp_replace(lower(c1), '[^a-z]', '', 'g')) = 0 THEN true ELSE length(regexp_replace(lower(c0), '[^a-z]', '', 'g')) / length(regexp_replace(lower(c1), '[^a-z]', '', 'g')) NOT BETWEEN 0.5 AND 2 END"),
    "long_untranslated": (lambda c0, c1: P.long_untranslated(c0, F.concat(c0, F.lit("..."))) & (F.length(c1) > 0), "length(regexp_replace(lower(c0), '[^a-z]', '', 'g')) >= 20 AND length(c1) > 0"),
}


def _add_parallel(name: str, p: Callable[[Column, Column], Column], sql: str) -> None:
    query(name, f"SELECT conv_id, turn, c0, c1 FROM {PAIRS_SQL} WHERE NOT ({sql})")(lambda s, d: P.apply(pairs(s, d), p(F.col("c0"), F.col("c1")))[0])


for _name, (_f, _sql) in PARALLEL.items():
    _add_parallel(_name, _f, _sql)


@query("untranslated_contractions", f"SELECT * FROM (SELECT conv_id, turn, c0, {_SHORT.replace('line', 'c1')} AS c1 FROM {PAIRS_SQL}) WHERE NOT regexp_matches(c1, {_ANY_SHORT})")
def _(s, d):
    return P.apply(pairs(s, d).withColumn("c1", F.replace("c1", F.lit("the "), F.lit("don't "))), P.untranslated_contraction("c0", "c1"))[0]


@query("per_column", f"SELECT conv_id, turn, lower(c0) AS c0, c1 FROM {PAIRS_SQL}")
def _(s, d):
    return pipes.pipe(pipes.per_column([X.lowercase, None], ["c0", "c1"]))(pairs(s, d)).main


@query("for_each", f"SELECT conv_id, turn, lower(c0) AS c0, lower(c1) AS c1 FROM {PAIRS_SQL}")
def _(s, d):
    return pipes.pipe(pipes.for_each(X.lowercase, ["c0", "c1"]))(pairs(s, d)).main


@query("tee", f"SELECT doc_id, line_no, lower(line) AS line FROM {L_SQL}")
def _(s, d):
    return pipes.pipe(pipes.cell(X.lowercase), pipes.tee("seen"), pipes.remove(P.ellipsis))(L(s, d)).side["seen"]


@query("mono_pipe", f"SELECT doc_id, line_no, regexp_replace(lower(line), '^ ?- ?', '') AS line FROM {L_SQL} WHERE NOT regexp_matches(line, '(?i)https?://[^ ]')")
def _(s, d):
    return pipes.mono_pipe([pipes.remove(P.any_url), pipes.cell(X.lowercase), pipes.cell(X.leading_hyphen)], [L(s, d)]).main


@query("dead_end_pipe", f"SELECT word, count FROM {COUNTS_SQL}")
def _(s, d):
    return pipes.dead_end_pipe([pipes.dead_end("counts", counts.count_tokens)], [L(s, d)])["counts"]


@query("newlines_introduced", "SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS part, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def _(s, d):
    return pipes.split_newlines(table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("strip_xml", """WITH c AS (SELECT page_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS ch FROM (SELECT page_id, string_split(html, '') AS cs FROM pages)),
 s AS (SELECT *, CASE ch WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END AS d FROM c), t AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS n FROM s),
 u AS (SELECT *, n - least(min(n) OVER (PARTITION BY page_id ORDER BY i), 0) AS depth FROM t)
 SELECT page_id, regexp_replace(coalesce(string_agg(ch, '' ORDER BY i) FILTER (WHERE depth = 0 AND d = 0 OR ch = chr(10)), ''), ' +', ' ', 'g') AS html FROM u GROUP BY page_id""")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.strip_xml("html").alias("html"))


@query("replace_set_id", "SELECT doc_id, '<srcset setid=\"new\" n=\"' || n_chars || '\">' AS line FROM documents")
def _(s, d):
    made = table(s, d, "documents").select("doc_id", F.concat(F.lit('<srcset setid="'), F.col("source"), F.lit('" n="'), F.col("n_chars").cast("string"), F.lit('">')).alias("line"))
    return sgm.replace_set_id(made, "new")


@query("cut_prefix", "SELECT item_id, split_part('id' || item_id || ' ' || text, ' ', 1) AS prefix, text AS tail FROM benchmark")
def _(s, d):
    rows = table(s, d, "benchmark").select("item_id", F.concat(F.lit("id"), F.col("item_id").cast("string"), F.lit(" "), F.col("text")).alias("line"))
    head, tail = X.cut_prefix("line")
    return rows.select("item_id", head.alias("prefix"), tail.alias("tail"))


@query("strip_rare_chars", f"""WITH l AS (SELECT * FROM {L_SQL}), c AS (SELECT list(ch) AS ks FROM (SELECT ch FROM (SELECT unnest(string_split(line, '')) AS ch FROM l) GROUP BY ch HAVING count(*) >= 200))
 SELECT doc_id, line_no, array_to_string(list_filter(string_split(line, ''), lambda y: list_contains(ks, y)), '') AS line FROM l, c""")
def _(s, d):
    keep = counts.common_chars(counts.count_chars(L(s, d)), 200)
    return L(s, d).select(*KEY, X.strip_rare_chars("line", keep).alias("line"))


# --- counts -----------------------------------------------------------------------------------------------------------

query("count_tokens", f"SELECT word, count FROM {COUNTS_SQL}")(lambda s, d: counts.sort_counts(counts.count_tokens(L(s, d))))
query("count_chars", f"SELECT word, count(*) AS count FROM (SELECT unnest(string_split(line, '')) AS word FROM {L_SQL}) WHERE word <> '' GROUP BY word")(lambda s, d: counts.count_chars(L(s, d)))
query("scale_counts", f"SELECT word, CAST(ceil(count * 1.5) AS BIGINT) AS count FROM {COUNTS_SQL}")(lambda s, d: counts.scale_counts(counts.count_tokens(L(s, d)), 1.5))
query("dampen_counts", f"SELECT word, CAST(round(log2(count + 1)) AS BIGINT) AS count FROM {COUNTS_SQL}")(lambda s, d: counts.dampen_counts(counts.count_tokens(L(s, d))))
query("threshold_counts", f"SELECT word, count FROM {COUNTS_SQL} WHERE count >= 5")(lambda s, d: counts.threshold_counts(counts.count_tokens(L(s, d)), 5))
query("filter_counts", f"SELECT word, count FROM {COUNTS_SQL} WHERE NOT regexp_matches(word, '[0-9]')")(lambda s, d: counts.filter_counts(counts.count_tokens(L(s, d)), lambda w: P.matches(w, ["[0-9]"])))
query("remove_counts", f"SELECT word FROM {COUNTS_SQL}")(lambda s, d: counts.remove_counts(counts.count_tokens(L(s, d))))
query("reverse_counts", f"SELECT word, count FROM {COUNTS_SQL}")(lambda s, d: counts.reverse_counts(counts.count_tokens(L(s, d))))
query("combine_wordlists", f"SELECT word FROM {COUNTS_SQL} UNION SELECT unnest({T_SQL.format('text')}) FROM benchmark")(lambda s, d: counts.combine_wordlists([counts.count_tokens(L(s, d)), counts.count_tokens(benchmark(s, d))]))


def _by_language(s: SparkSession, d: str) -> list[DataFrame]:
    """A count table of each language of the corpus."""
    t = table(s, d, "documents")
    langs = [r["lang"] for r in t.select("lang").distinct().orderBy("lang").collect()]
    return [counts.count_tokens(lines_of(t.where(F.col("lang").eqNullSafe(x)))) for x in langs]


_LANG_COUNTS = f"(SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({T_SQL.format('text')}) AS word FROM documents) GROUP BY lang, word)"
query("combine_counts", f"SELECT word, CAST(sum(n) AS BIGINT) AS count FROM {_LANG_COUNTS} WHERE n >= 2 GROUP BY word")(lambda s, d: counts.combine_counts(_by_language(s, d), threshold=2))
query("combine_counts_balance", f"WITH c AS (SELECT * FROM {_LANG_COUNTS}), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), m AS (SELECT max(total) AS m FROM t) SELECT word, CAST(sum(CASE WHEN total = m THEN n ELSE trunc(n * (m::DOUBLE / total)) END) AS BIGINT) AS count FROM c JOIN t USING (lang), m GROUP BY word")(lambda s, d: counts.combine_counts(_by_language(s, d), balance=True))


@query("segment_counts", f"SELECT part AS word, CAST(sum(count) AS BIGINT) AS count FROM (SELECT unnest(CASE WHEN length(word) > 6 THEN [word[1:3], word[4:]] ELSE [word] END) AS part, count FROM {COUNTS_SQL}) GROUP BY part")
def _(s, d):
    c = counts.count_tokens(L(s, d))
    cut = c.where(F.length("word") > 6).select(F.col("word").alias("surface"), F.array(F.substring("word", 1, 3), F.substring("word", 4, 1 << 30)).alias("parts"))
    return counts.segment_counts(c, cut)


@query("tf_idf", f"WITH t AS (SELECT doc_id, unnest({TOK}) AS word FROM {L_SQL}), n AS (SELECT count(*) AS docs FROM documents) SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df, round(ln(1 + count(*)) * ln(any_value(docs) / (1 + count(DISTINCT doc_id))), 6) AS weight FROM t, n GROUP BY word")
def _(s, d):
    return counts.tf_idf(L(s, d)).withColumn("weight", F.round("weight", 6))


@query("word_pairs", f"""WITH p AS (SELECT {T_SQL.format('c0')} AS a, {T_SQL.format('c1')} AS b FROM {PAIRS_SQL}), e AS (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM p)
 SELECT a[i] AS src, b[i] AS trg, count(*) AS count FROM e GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(s, d):
    p = pairs(s, d)
    n = F.least(F.size(tokens("c0")), F.size(tokens("c1")))
    links = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws("-", i.cast("string"), i.cast("string"))), " ")).otherwise("")
    return counts.word_pairs(p.withColumn("alignment", links), ["conv_id", "turn"], src="c0", trg="c1")


# --- order ------------------------------------------------------------------------------------------------------------

D = ["doc_id"]
_DOCS = "(SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "n_chars")


for _name, _make, _where in [
    ("head", lambda x: order.head(x, 100, D), "i < 100"),
    ("skip", lambda x: order.skip(x, 100, D), "i >= 100"),
    ("slice", lambda x: order.slice_rows(x, 50, 150, D), "i >= 50 AND i < 150"),
    ("last", lambda x: order.last(x, 70, D), "i >= n - 70"),
    ("head_tee", lambda x: order.head_tee(x, 30, D)[1], "i < 30"),
    ("slice_tee", lambda x: order.slice_tee(x, 10, 40, D)[1], "i >= 10 AND i < 40"),
    ("skip_tee", lambda x: order.skip_tee(x, 90, D)[1], "i >= 90"),
    ("round_robin", lambda x: order.round_robin(x, 2, 7, D), "i % 7 = 2"),
]:
    query(_name, f"SELECT doc_id, lang, n_chars FROM {_DOCS} WHERE {_where}")(lambda s, d, f=_make: f(docs(s, d)))

query("chunk_split", f"SELECT doc_id, lang, n_chars, i // 64 AS chunk FROM {_DOCS}")(lambda s, d: order.chunk_split(docs(s, d), 64, D))
query("upsample", "SELECT doc_id, lang, n_chars, CAST(copy AS INT) AS copy FROM documents, range(3) t(copy)")(lambda s, d: order.upsample(docs(s, d), 3))
query("sort_by_length", f"SELECT doc_id, line_no, line, row_number() OVER (ORDER BY length(line), doc_id, line_no) - 1 AS position FROM {L_SQL}")(lambda s, d: order.sort_by_length(L(s, d), KEY))
query("sort_reverse", "SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents")(lambda s, d: order.sort_rows(docs(s, d), F.col("n_chars"), D, reverse=True))
query("reversed_rows", "SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id DESC) - 1 AS position FROM documents")(lambda s, d: with_position(order.reversed_rows(docs(s, d).withColumn("back", -F.col("doc_id")), D), ["back"]).drop("back"))
query("line_numbers", f"SELECT doc_id, line_no, (row_number() OVER (ORDER BY doc_id, line_no) + 9) || ' ' || line AS line FROM {L_SQL}")(lambda s, d: order.line_numbers(L(s, d), KEY, 10))
query("line_count", f"SELECT count(*) AS n FROM {L_SQL}")(lambda s, d: L(s, d).agg(F.count(F.lit(1)).alias("n")))
query("concatenate", f"SELECT doc_id, line_no, line, 0 AS file_idx FROM {L_SQL} UNION ALL SELECT doc_id, line_no, line, 1 FROM {B_SQL}")(lambda s, d: order.concatenate([L(s, d), benchmark(s, d)]))
_MIXED = "(SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY md5('1-' || doc_id), doc_id) - 1 AS position FROM documents)"
query("shuffle", f"SELECT * FROM {_MIXED}")(lambda s, d: order.shuffle(docs(s, d), D))


def _parts_of(split: dict[str, DataFrame]) -> DataFrame:
    dev, test, train = (rows.withColumn("part", F.lit(name)) for name, rows in split.items())
    return dev.unionByName(test).unionByName(train)


_PART = "CASE WHEN position < 50 THEN 'dev' WHEN position < 80 THEN 'test' ELSE 'train' END AS part"
query("split_dataset", f"SELECT *, {_PART} FROM {_MIXED}")(lambda s, d: _parts_of(order.split_dataset(docs(s, d), D, 50, 30)))


@query("split_dataset_para", f"SELECT *, {_PART}, 0 AS side FROM {_MIXED} UNION ALL SELECT doc_id, upper(lang), -n_chars, position, {_PART}, 1 FROM {_MIXED}")
def _(s, d):
    one, two = order.split_dataset_para([docs(s, d), docs(s, d).select("doc_id", F.upper("lang").alias("lang"), (-F.col("n_chars")).alias("n_chars"))], D, 50, 30)
    return _parts_of(one).withColumn("side", F.lit(0)).unionByName(_parts_of(two).withColumn("side", F.lit(1)))


@query("de_round_robin", """WITH u AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY f ORDER BY doc_id) - 1) AS i, 2 - f AS m, f FROM (SELECT *, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS f FROM documents))
 SELECT doc_id, lang, row_number() OVER (ORDER BY i // m, f, i % m) - 1 AS position FROM u""")
def _(s, d):
    x = docs(s, d).drop("n_chars")
    return order.de_round_robin([x.where("lang = 'en'"), x.where("NOT lang <=> 'en'")], D, [2, 1])


@query("safe_zip", f"SELECT doc_id, line_no, line AS c0, lower(line) AS c1 FROM {L_SQL}")
def _(s, d):
    return order.safe_zip([L(s, d), L(s, d).withColumn("line", F.lower("line"))], KEY)


@query("filter_mask", f"SELECT doc_id, line_no, contains(line, '...') AS remove FROM {L_SQL}")
def _(s, d):
    return order.filter_mask(L(s, d), P.ellipsis("line"), KEY)


def _masks(s: SparkSession, d: str) -> list[DataFrame]:
    labels = table(s, d, "labels")
    return [labels.select("doc_id", (F.col("toxic") == 1).alias("remove")), labels.select("doc_id", (F.col("quality") == 0).alias("remove"))]


query("combine_masks", "SELECT doc_id, bool_or(toxic = 1 OR quality = 0) AS remove FROM labels GROUP BY doc_id")(lambda s, d: order.combine_masks(_masks(s, d), D))
query("apply_mask", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)")(lambda s, d: order.apply_mask(docs(s, d), _masks(s, d), D)[0])
query("apply_mask_rejects", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)")(lambda s, d: order.apply_mask(docs(s, d), _masks(s, d), D)[1])


def _scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", (F.col("n_chars") % 97).cast("double").alias("score"))


query("score_threshold", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars % 97 <= 40")(lambda s, d: order.filter_by_score(docs(s, d), _scores(s, d), D, threshold=40)[0])
query("score_keep", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars % 97, doc_id LIMIT 90")(lambda s, d: order.filter_by_score(docs(s, d), _scores(s, d), D, keep=90)[0])

# --- de-duplication ---------------------------------------------------------------------------------------------------

_KEPT = "SELECT *, {p} AND row_number() OVER (PARTITION BY {p}, substring({c}, 1, 30) ORDER BY {o}) > 1 AS gone FROM (SELECT *, count(*) OVER (PARTITION BY {c}) > 1 AS {p} FROM {t})"
query("deduplicate", f"SELECT doc_id, line_no, line FROM ({_KEPT.format(p='p', c='line', o='doc_id, line_no', t=L_SQL)}) WHERE NOT gone")(lambda s, d: dedup.deduplicate(L(s, d), KEY))


@query("deduplicate_parallel", f"""WITH z AS (SELECT *, count(*) OVER (PARTITION BY c0) > 1 AS p, count(*) OVER (PARTITION BY c1) > 1 AS q FROM {PAIRS_SQL}),
 a AS (SELECT * FROM (SELECT *, p AND row_number() OVER (PARTITION BY p, substring(c0, 1, 30) ORDER BY conv_id, turn) > 1 AS gone FROM z) WHERE NOT gone)
 SELECT conv_id, turn, c0, c1 FROM (SELECT conv_id, turn, c0, c1, q AND row_number() OVER (PARTITION BY q, substring(c1, 1, 30) ORDER BY conv_id, turn) > 1 AS gone FROM a) WHERE NOT gone""")
def _(s, d):
    return dedup.deduplicate(pairs(s, d), ["conv_id", "turn"], ["c0", "c1"])


# --- lookups ----------------------------------------------------------------------------------------------------------


def _lexicon(s: SparkSession, d: str) -> DataFrame:
    return counts.count_tokens(benchmark(s, d)).select(F.col("word").alias("src"), F.concat(F.lit("<"), F.col("word"), F.lit(">")).alias("trg"))


_KNOWN = f"(SELECT DISTINCT unnest({T_SQL.format('text')}) AS word FROM benchmark)"


def _again(word: str, known: str = _KNOWN) -> str:
    return f"""WITH m AS (SELECT doc_id, line_no, string_agg({word}, ' ' ORDER BY i) AS line FROM {_EACH} e LEFT JOIN {known} k ON e.t = k.word GROUP BY 1, 2)
 SELECT l.doc_id, l.line_no, coalesce(m.line, '') AS line FROM {L_SQL} l LEFT JOIN m USING (doc_id, line_no)"""


query("apply_mapping", _again("CASE WHEN k.word IS NULL THEN t ELSE '<' || t || '>' END"))(lambda s, d: lookup.map_tokens(L(s, d), _lexicon(s, d), KEY))
query("mapping_log", f"SELECT word, count FROM {COUNTS_SQL} c ANTI JOIN {_KNOWN} k USING (word)")(lambda s, d: lookup.unmapped(L(s, d), _lexicon(s, d)))


def _segments(s: SparkSession, d: str) -> DataFrame:
    words = counts.count_tokens(benchmark(s, d)).where(F.length("word") > 3).select(F.concat(F.substring("word", 1, 2), F.lit(" "), F.substring("word", 3, 1 << 30)).alias("line"))
    return lookup.segmentation_map(words, ["line"])


query("apply_segmentation", _again("CASE WHEN k.word IS NULL OR length(t) <= 3 THEN t ELSE t[1:2] || '⁙ ' || t[3:] END"))(lambda s, d: lookup.apply_segmentation(L(s, d), _segments(s, d), KEY))


@query("missing_segmentations", f"SELECT word, arg_min(doc_id, (doc_id, line_no, i)) AS doc_id FROM (SELECT doc_id, line_no, i, t AS word FROM {_EACH}) ANTI JOIN (SELECT word FROM {_KNOWN} WHERE length(word) > 3) USING (word) GROUP BY word")
def _(s, d):
    words = L(s, d).select(*KEY, F.posexplode(tokens("line")).alias("i", "word"))
    return lookup.missing_segmentations(words, _segments(s, d), [*KEY, "i"]).select("word", "doc_id")


@query("override_segmentation", f"SELECT word AS src, CASE WHEN length(word) > 5 THEN word[1:4] || ' ' || word[5:] ELSE word[1:2] || ' ' || word[3:] END AS line FROM {_KNOWN} WHERE length(word) > 3")
def _(s, d):
    words = counts.count_tokens(benchmark(s, d))
    cut = lambda n: words.where(F.length("word") > n + 1).select("word", F.concat(F.substring("word", 1, n), F.lit(" "), F.substring("word", n + 1, 1 << 30)).alias("line"))
    return lookup.override_segmentation(cut(2), cut(4), ["word"])


@query("drop_oov", f"SELECT doc_id, line_no, line FROM {L_SQL} ANTI JOIN (SELECT doc_id, line_no FROM {_EACH} ANTI JOIN {_KNOWN} k ON t = k.word) USING (doc_id, line_no)")
def _(s, d):
    return lookup.drop_oov(L(s, d), counts.count_tokens(benchmark(s, d)), KEY)[0]


@query("cluster_examples", f"SELECT word AS src, min(word) OVER (PARTITION BY length(word)) AS trg FROM {_KNOWN}")
def _(s, d):
    words = counts.count_tokens(benchmark(s, d)).select("word", F.length("word").alias("cluster"))
    return lookup.cluster_examples(words, ["word"])


@query("add_lookup_feature", f"SELECT doc_id, line_no, string_agg(t || '￨' || CASE WHEN length(t) > 3 THEN length(t)::VARCHAR ELSE '<UNK>' END, ' ' ORDER BY i) AS line FROM (SELECT item_id AS doc_id, CAST(0 AS BIGINT) AS line_no, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT item_id, {T_SQL.format('text')} AS ts FROM benchmark)) GROUP BY 1, 2")
def _(s, d):
    feats = counts.count_tokens(benchmark(s, d)).where(F.length("word") > 3).select(F.col("word").alias("src"), F.length("word").cast("string").alias("trg"))
    return lookup.add_lookup_feature(benchmark(s, d), feats, KEY)


@query("triangulate", """WITH a AS (SELECT regexp_replace(lower(text), '[^a-z]', '', 'g') AS k, arg_max(role, conv_id * 1000 + turn) AS a FROM conversations GROUP BY 1)
 SELECT conv_id * 1000 + turn AS line_no, text AS pivot, a, role AS b FROM conversations JOIN a ON regexp_replace(lower(text), '[^a-z]', '', 'g') = k""")
def _(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("pivot"), F.col("role").alias("text"))
    return lookup.triangulate(c, c.select("line_no", "pivot", "text"))


@query("lexical_match_score", f"""WITH p AS (SELECT conv_id, turn, list_transform({T_SQL.format('c0')}, lambda y: y[1:5]) AS s, list_transform({T_SQL.format('c1')}, lambda y: y[1:5]) AS t FROM {PAIRS_SQL})
 SELECT conv_id, turn, round(-(len(list_filter(s, lambda y: list_contains(t, y) OR (y = 'the' AND list_contains(t, 'and')))) + len(list_filter(t, lambda y: list_contains(s, y) OR (y = 'and' AND list_contains(s, 'the'))))) / (len(s) + len(t)), 6) AS score FROM p""")
def _(s, d):
    links = s.createDataFrame([("the", "and")], "src string, trg string")
    return lookup.lexical_match_score(pairs(s, d), links, ["conv_id", "turn"], "c0", "c1").withColumn("score", F.round("score", 6))


_DIST = "(SELECT a.p_partkey, a.p_brand AS l, b.p_brand AS r, levenshtein(a.p_brand, b.p_brand) AS dist FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def distances(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("l"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("l").alias("r")), "p_partkey").withColumn("dist", F.levenshtein("l", "r").cast("long"))


query("levenshtein", f"SELECT p_partkey, l, r, CAST(dist AS BIGINT) AS dist FROM {_DIST}")(lambda s, d: distances(s, d))
query("levenshtein_filter", f"SELECT p_partkey, l, r, CAST(dist AS BIGINT) AS dist FROM {_DIST} WHERE NOT CASE WHEN length(l) < 4 OR length(r) < 4 THEN l <> r ELSE dist > ceil((length(l) + length(r)) / 2 / 9) END")(lambda s, d: P.apply(distances(s, d), P.levenshtein_far("dist", "l", "r", ratio=1 / 9))[0])
query("levenshtein_long_edits")(lambda s, d: P.apply(distances(s, d), P.long_edits("l", "r", 1))[0])

# --- tables -----------------------------------------------------------------------------------------------------------


@query("paste_columns", "SELECT n_nationkey, n_name || chr(9) || n_regionkey AS line FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    return tabular.paste_columns([n.select("n_nationkey", F.col("n_name").alias("line")), n.select("n_nationkey", F.col("n_regionkey").cast("string").alias("line"))], ["n_nationkey"])


@query("split_columns", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def _(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.concat_ws("\t", "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return tabular.split_columns(n, ["name", "region"]).drop("line")


_ROW = "concat_ws(chr(9), {}, {}, {}, {})"
_TAGS = "'[POS=' || lower(substring(t, 1, 1)) || ']|[X=1]|[NUM=' || length(t) || ']'"
query("single_surface_column", f"SELECT doc_id, line_no, CAST(pos AS INT) AS part, t AS line FROM (SELECT doc_id, CAST(0 AS BIGINT) AS line_no, pos, t FROM {MORPH_SQL})")(lambda s, d: blocks.single_surface_column(benchmark(s, d)))
query("join_vertical", f"SELECT item_id AS doc_id, CAST(0 AS BIGINT) AS block, array_to_string({T_SQL.format('text')}, ' ') AS line FROM benchmark")(lambda s, d: blocks.join_vertical(blocks.single_surface_column(benchmark(s, d)), D, ["part"]))
query("extract_column", f"SELECT item_id AS doc_id, CAST(0 AS BIGINT) AS block, array_to_string(list_transform({T_SQL.format('text')}, lambda y: lower(y)), ' ') AS line FROM benchmark")(lambda s, d: blocks.extract_column(morphs(s, d), 1, D, ["pos"]))
query("segment_sentences", f"""SELECT doc_id, line_no, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS part, unnest(ss) AS line FROM (SELECT doc_id, line_no, list_filter(list_transform(string_split(regexp_replace(line, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS ss FROM {L_SQL})""")(lambda s, d: blocks.segment_sentences(L(s, d)))
query("join_sentences")(lambda s, d: blocks.join_sentences(L(s, d), "doc_id", "line_no"))
query("modify_lemmas", f"SELECT doc_id, pos, CASE WHEN t = '' THEN '' WHEN regexp_matches(lower(t), '^[a-z.]+$') AND NOT regexp_matches(t, '[.].') THEN 'ok' ELSE 'other' END AS line FROM {MORPH_SQL}")(lambda s, d: morph.modify_lemmas(morphs(s, d)).select("doc_id", "pos", F.when(F.col("line") == "", "").when(F.regexp_like(F.lower(F.split("line", "\t")[0]), F.lit("^[a-z.]+$")) & ~F.regexp_like(F.split("line", "\t")[0], F.lit("[.].")), F.lit("ok")).otherwise("other").alias("line")))
query("modify_lemmas_table")(lambda s, d: morph.modify_lemmas(morphs(s, d)))
query("filter_tags", f"SELECT doc_id, pos, CASE WHEN t = '' THEN '' ELSE {_ROW.format('t', 'lower(t)', chr(108) + 'ower(t) || ' + chr(39) + '-' + chr(39) + ' || lower(t)', chr(39) + '[NUM=' + chr(39) + ' || length(t) || ' + chr(39) + ']|[POS=' + chr(39) + ' || lower(substring(t, 1, 1)) || ' + chr(39) + ']' + chr(39))} END AS line FROM {MORPH_SQL}")(lambda s, d: morph.filter_tags(morphs(s, d), keep=("NUM", "CASE", "POS")))
query("map_column", f"SELECT doc_id, pos, CASE WHEN t = '' THEN '' ELSE {_ROW.format('t', 'CASE WHEN length(t) > 4 THEN lower(t) || chr(33) ELSE chr(63) END', 'lower(t) || chr(45) || lower(t)', _TAGS)} END AS line FROM {MORPH_SQL}")(lambda s, d: morph.map_column(morphs(s, d), counts.count_tokens(benchmark(s, d)).where(F.length("word") > 4).select(F.lower("word").alias("src"), F.concat(F.lower("word"), F.lit("!")).alias("trg")).distinct(), 1, unk="?"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    words = counts.count_tokens(benchmark(s, d)).where(F.length("word") > 4).select("word", F.concat(F.substring("word", 1, 2), F.lit("@@ "), F.substring("word", 3, 1 << 30)).alias("line"))
    return morph.part_map(words, ["word"])


query("segment_column", f"""SELECT doc_id, pos, CAST(j AS INT) AS part, CASE WHEN t = '' THEN '' ELSE concat_ws(chr(9), ps[j + 1], lower(t), lower(t) || '-' || lower(t), {_TAGS}, CASE WHEN len(ps) = 1 THEN 'S' WHEN j = 0 THEN 'B' ELSE 'E' END) END AS line
 FROM (SELECT *, unnest(range(len(ps))) AS j FROM (SELECT *, CASE WHEN length(t) > 4 THEN [t[1:2] || '@@', t[3:]] ELSE [t] END AS ps FROM {MORPH_SQL}))""")(lambda s, d: morph.segment_column(morphs(s, d), _parts(s, d), 0))
query("interleave", f"SELECT doc_id, CAST(0 AS BIGINT) AS block, string_agg('%%' || lower(t) || ' ' || CASE WHEN length(t) > 4 THEN t[1:2] || '@@ ' || t[3:] ELSE t END, ' ' ORDER BY pos) AS line FROM {MORPH_SQL} WHERE t <> '' GROUP BY doc_id")(lambda s, d: morph.interleave(morphs(s, d), D, ["pos"], keep=(1, 0), parts=_parts(s, d)))
query("interleave_no_seg", f"SELECT doc_id, CAST(0 AS BIGINT) AS block, string_agg(lower(t) || ' ' || t, ' ' ORDER BY pos) AS line FROM {MORPH_SQL} WHERE t <> '' GROUP BY doc_id")(lambda s, d: morph.interleave(morphs(s, d), D, ["pos"], keep=(1, 0), surface=None, aux_marker=""))
query("only_first_subword", f"SELECT doc_id, pos, line FROM (SELECT *, coalesce(contains(lag(t) OVER w, 'th'), false) AS gone FROM {MORPH_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE NOT gone OR t = ''")(lambda s, d: morph.only_first_subword(morphs(s, d), 0, D, ["pos"], marker="th"))
query("only_first_proper_or_num", f"SELECT doc_id, pos, line FROM (SELECT *, lag(t) OVER w AS p FROM {MORPH_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE NOT coalesce(t IN ('the', 'of') AND p = t, false)")(lambda s, d: morph.only_first_proper_or_num(morphs(s, d), 0, D, ["pos"], lemmas=("the", "of")))


@query("segment_surface_and_lemma", f"""SELECT doc_id, pos, CAST(j AS INT) AS part, CASE WHEN t = '' THEN '' ELSE concat_ws(chr(9), ms[j + 1], ps[j + 1], lower(t) || '-' || lower(t), {_TAGS}, CASE WHEN len(ms) = 1 THEN 'S' WHEN j = 0 THEN 'B' ELSE 'E' END) END AS line
 FROM (SELECT *, unnest(range(len(ms))) AS j FROM (SELECT *, CASE WHEN length(t) > 4 THEN [t[1:2], t[3:]] ELSE [t] END AS ms, CASE WHEN length(t) > 4 THEN [lower(t)[1:2], lower(t)[3:]] ELSE [lower(t)] END AS ps FROM {MORPH_SQL}))""")
def _(s, d):
    w = F.col("word")
    cut = lambda x: F.array(F.substring(x, 1, 2), F.substring(x, 3, 1 << 30))
    mapping = counts.count_tokens(benchmark(s, d)).where(F.length("word") > 4).select(w.alias("surf"), F.lower(w).alias("lemma"), cut(w).alias("morphs"), cut(F.lower(w)).alias("parts"))
    return morph.segment_surface_and_lemma(morphs(s, d), mapping, 0, 1)


@query("split_lemmas")
def _(s, d):
    rows = counts.sort_counts(counts.count_tokens(benchmark(s, d))).collect()  # a vocabulary
    return s.createDataFrame(morph.split_lemmas([(r["word"], r["count"]) for r in rows]), "lemma string, parts array<string>")


@query("mapping_to_segmentation", f"SELECT word, word AS segmentation, true AS ok FROM {_KNOWN}")
def _(s, d):
    words = counts.count_tokens(benchmark(s, d))
    x = words.select("word", K.mapping_to_segmentation(F.concat_ws("\t", "word", F.lower("word"))).alias("x"))
    return x.select("word", "x.segmentation", "x.ok")


# --- truecasing, sub-words --------------------------------------------------------------------------------------------


_MODEL_SQL = f"""SELECT word, t AS best, n / total > 0.6 AS sure FROM (SELECT lower(t) AS word, t, n, sum(n) OVER (PARTITION BY lower(t)) AS total, row_number() OVER (PARTITION BY lower(t) ORDER BY n DESC, seen) AS rank
 FROM (SELECT t, count(*) AS n, min(struct_pack(d := doc_id, l := line_no, i := i)) AS seen FROM {_STARTS} WHERE NOT first GROUP BY t)) WHERE rank = 1 AND total >= 2"""
_CASED = "sum((t <> lower(t))::INT)"
_WHOLE = f"(SELECT doc_id, line_no, coalesce({_CASED} = 0 OR {_CASED} / nullif(sum(w::INT), 0) > 0.5, true) AS every FROM {_STARTS} GROUP BY 1, 2)"


@query("train_truecaser", _MODEL_SQL)
def _(s, d):
    return truecase.train_truecaser(L(s, d), KEY)


@query("truecase", _joined(f"(SELECT s.*, every, best, sure FROM {_STARTS} s JOIN {_WHOLE} USING (doc_id, line_no) LEFT JOIN ({_MODEL_SQL}) m ON m.word = lower(s.t))", "CASE WHEN sure AND (every OR first) THEN best ELSE t END"))
def _(s, d):
    return truecase.truecase(L(s, d), truecase.train_truecaser(L(s, d), KEY), KEY)


@query("bpe_pair_counts", f"SELECT l AS left, r AS right, CAST(sum(count) AS BIGINT) AS count FROM (SELECT count, ss[i] AS l, ss[i + 1] AS r FROM (SELECT count, ss, unnest(range(1, len(ss))) AS i FROM (SELECT count, list_append(string_split(word, ''), '</w>') AS ss FROM {COUNTS_SQL}))) GROUP BY 1, 2")
def _(s, d):
    return bpe.pair_counts(counts.count_tokens(L(s, d)))


@query("learn_bpe")
def _(s, d):
    merges = bpe.learn_bpe(counts.count_tokens(L(s, d)))
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


@query("apply_bpe")
def _(s, d):
    merges = bpe.learn_bpe(counts.count_tokens(L(s, d)))
    return L(s, d).select(*KEY, bpe.apply_bpe("line", merges).alias("line"))


# --- evaluation and profile -------------------------------------------------------------------------------------------


@query("read_sgm", "SELECT doc_id, 'sys' AS sysid, 'd' || item_id AS docid, '1' AS segid, text FROM (SELECT *, item_id AS doc_id FROM benchmark)")
def _(s, d):
    wrapped = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit('<doc sysid="sys" docid="d'), F.col("item_id").cast("string"), F.lit('">')), F.concat(F.lit('<seg id="1">'), F.col("text"), F.lit("</seg>")), F.lit("</doc>"))).alias("at", "line"))
    return sgm.read_sgm(wrapped, D, ["at"]).drop("at")


@query("read_bleu", "SELECT 'base' AS sysid, 'd' || item_id AS docid, CAST(item_id AS VARCHAR) AS segid, item_id / 1000 AS bleu FROM benchmark")
def _(s, d):
    i = F.col("item_id").cast("string")
    made = table(s, d, "benchmark").select(F.concat(F.lit("BLEU score using 4-grams = "), (F.col("item_id") / 1000).cast("string"), F.lit(' for system "base" on segment '), i, F.lit(' of document "d'), i, F.lit('" (9 words)')).alias("line"))
    return sgm.read_bleu(made)


@query("wrap_in_xml", "SELECT line FROM (SELECT unnest(['<seg id=\"' || row_number() OVER (ORDER BY item_id) || '\">' || text || '</seg>']) AS line FROM benchmark UNION ALL SELECT unnest(['<srcset setid=\"t\" srclang=\"en\" trglang=\"fr\">', '<doc sysid=\"s\" docid=\"dummy\">', '<p>', '</p>', '</doc>', '</srcset>']))")
def _(s, d):
    return sgm.wrap_in_xml(benchmark(s, d).withColumnRenamed("doc_id", "n"), "n", "src", "t", "s", "en", "fr").select("line")


@query("merge_refs", "SELECT 0 AS ref, 'd' AS docid, CAST(item_id AS VARCHAR) AS segid, text FROM benchmark UNION ALL SELECT 1, 'd', CAST(item_id AS VARCHAR), lower(text) FROM benchmark")
def _(s, d):
    b = table(s, d, "benchmark").select(F.lit("d").alias("docid"), F.col("item_id").cast("string").alias("segid"), "text", F.col("item_id").alias("line_no"))
    return sgm.merge_refs([b, b.withColumn("text", F.lower("text"))]).select("ref", "docid", "segid", "text")


def segments(s: SparkSession, d: str) -> DataFrame:
    p = pairs(s, d)
    one = lambda c: p.select(F.col("conv_id").alias("docid"), F.col("turn").alias("segid"), c.alias("text"))
    return analysis.join_segments(one(F.col("c0")), one(F.col("c1")), one(F.lower("c1")), [one(F.col("c1")), one(F.concat("c0", F.lit("!")))])


_W = "len(string_split({}, ' '))"
query("analyze_translations", f"SELECT conv_id AS docid, turn AS segid, c0 AS src, c1 AS bl, lower(c1) AS sys, c1 || '|' || c0 || '!' AS refs FROM {PAIRS_SQL}")(lambda s, d: segments(s, d).withColumn("refs", F.array_join("refs", "|")))
query("analyze_lengths", f"SELECT conv_id AS docid, turn AS segid, length(c0) AS src_len_chars, {_W.format('c0')} AS src_len_words, length(c1) AS bl_len_chars, {_W.format('c1')} AS bl_len_words, greatest(length(c0) + 1, length(c1)) AS ref_len_chars, greatest({_W.format('c0')}, {_W.format('c1')}) AS ref_len_words FROM {PAIRS_SQL}")(lambda s, d: analysis.analyze_lengths(segments(s, d)).select("docid", "segid", *[F.col(f"{c}_len_{u}").cast("long").alias(f"{c}_len_{u}") for c in ("src", "bl", "ref") for u in ("chars", "words")]))
_RT = f"list_filter({T_SQL.format('c1')}, lambda y: regexp_matches(y, '[a-z0-9]'))"
query("analyze_repetitions", f"SELECT conv_id AS docid, turn AS segid, CAST(len({_RT}) - len(list_distinct({_RT})) AS BIGINT) AS anywhere, CAST(len(list_filter(range(1, len({_RT})), lambda i: ({_RT})[i] = ({_RT})[i + 1])) AS BIGINT) AS consecutive FROM {PAIRS_SQL}")(lambda s, d: analysis.analyze_repetitions(segments(s, d)).select("docid", "segid", F.col("bl_reps_anywhere").cast("long").alias("anywhere"), F.col("bl_reps_conseq").cast("long").alias("consecutive")))
query("analyze_names", f"SELECT conv_id AS docid, turn AS segid, CAST(len(list_filter({T_SQL.format('c0')}, lambda y: length(y) > 1 AND regexp_matches(y, '^[\\p{{Lu}}\\p{{Nd}}]'))) AS BIGINT) AS lnames FROM {PAIRS_SQL}")(lambda s, d: analysis.analyze_names(segments(s, d)).select("docid", "segid", F.col("lnames").cast("long").alias("lnames")))
query("retokenize")(lambda s, d: analysis.retokenize(segments(s, d), "en", "en"))


@query("retruecase")
def _(s, d):
    p = pairs(s, d)
    model = truecase.train_truecaser(p.withColumnRenamed("c0", "line"), ["conv_id", "turn"])
    return analysis.retruecase(segments(s, d), model, model)


#: (docid, segid, k, n, hyp, ref, hit): of both outputs, the n-gram totals, and those of the better reference for each n.
_CHRF = f"""x AS (SELECT docid, segid, k, replace(x, ' ', '') AS x FROM (SELECT conv_id AS docid, turn AS segid, unnest(['bl', 'sys', 'r0', 'r1']) AS k, unnest([c1, lower(c1), c1, c0 || '!']) AS x FROM {PAIRS_SQL})),
 t AS (SELECT docid, segid, k, n, greatest(length(x) - n + 1, 0) AS total, x FROM x, range(1, 7) r(n)),
 g AS (SELECT docid, segid, k, n, x[i:i + n - 1] AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, total + 1)) AS i FROM t) GROUP BY ALL),
 h AS (SELECT a.docid, a.segid, a.k, b.k AS r, a.n, sum(least(a.c, b.c)) AS hit FROM g a JOIN g b USING (docid, segid, n, gram) WHERE a.k IN ('bl', 'sys') AND b.k IN ('r0', 'r1') GROUP BY ALL),
 f AS (SELECT a.docid, a.segid, a.k, a.n, a.total AS hyp, b.total AS ref, coalesce(h.hit, 0) AS hit, CASE WHEN a.total + b.total > 0 THEN 2 * coalesce(h.hit, 0) / (a.total + b.total) ELSE 0 END AS f
  FROM t a JOIN t b USING (docid, segid, n) LEFT JOIN h ON h.docid = a.docid AND h.segid = a.segid AND h.k = a.k AND h.r = b.k AND h.n = a.n WHERE a.k IN ('bl', 'sys') AND b.k IN ('r0', 'r1')),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docid, segid, k, n ORDER BY f DESC, ref DESC, hit DESC) AS rank FROM f) WHERE rank = 1)"""
_PR = "SELECT docid, segid, k, avg(CASE WHEN hyp > 0 THEN hit / hyp ELSE 0 END) AS p, avg(CASE WHEN ref > 0 THEN hit / ref ELSE 0 END) AS r FROM s WHERE hyp > 0 OR ref > 0 GROUP BY ALL"
_F = "CASE WHEN p + r > 0 THEN (1 + {0}) * p * r / ({0} * p + r) ELSE 0 END"
_BOTH = ", ".join(f"coalesce(max(f{b}) FILTER (WHERE k = '{k}'), 0) AS {k}{b}" for k in ("bl", "sys") for b in (1, 2))
_NAMES = ", ".join([f"round({k}{b}, 6) AS {k}_chrF{b}" for k in ("bl", "sys") for b in (1, 2)] + [f"round(sys{b} - bl{b}, 6) AS delta_chrF{b}" for b in (1, 2)])


@query("analyze_chrf", f"WITH {_CHRF}, q AS ({_PR}), w AS (SELECT docid, segid, k, {_F.format(1)} AS f1, {_F.format(4)} AS f2 FROM q), z AS (SELECT docid, segid, {_BOTH} FROM w GROUP BY ALL) SELECT docid, segid, {_NAMES} FROM (SELECT conv_id AS docid, turn AS segid, 0 AS o FROM {PAIRS_SQL}) JOIN z USING (docid, segid)")
def _(s, d):
    out = analysis.analyze_chrf(segments(s, d))
    return out.select("docid", "segid", *[F.round(c, 6).alias(c) for c in out.columns if "chrF" in c])


@query("evaluate_chrf", f"WITH {_CHRF}, m AS (SELECT n, sum(hyp) AS hyp, sum(ref) AS ref, sum(hit) AS hit FROM s WHERE k = 'sys' GROUP BY n), q AS (SELECT sum(CASE WHEN hyp > 0 THEN hit / hyp ELSE 0 END) / 6 AS p, sum(CASE WHEN ref > 0 THEN hit / ref ELSE 0 END) / 6 AS r FROM m) SELECT beta, round((1 + beta * beta) * p * r / (beta * beta * p + r), 6) AS chrf, round(p, 6) AS precision, round(r, 6) AS recall FROM q, (SELECT unnest([1.0::DOUBLE, 2.0]) AS beta)")
def _(s, d):
    return analysis.evaluate_chrf(segments(s, d), "sys", "refs", (1.0, 2.0)).select("beta", *[F.round(c, 6).alias(c) for c in ("chrf", "precision", "recall")])


def _bleu_sql(refs: dict[str, str]) -> str:
    grams = lambda c: f"SELECT id, n, array_to_string({c}[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM e, range(1, 5) r(n)) GROUP BY ALL"
    cut = ", ".join(f"{T_SQL.format(x)} AS {c}" for c, x in refs.items())
    every = " UNION ALL ".join(grams(c) for c in refs)
    near = "list_min([" + ", ".join(f"struct_pack(d := abs(len({c}) - len(h)), n := len({c}))" for c in refs) + "])"
    return f"""WITH e AS (SELECT row_number() OVER () AS id, {T_SQL.format('c0')} AS h, {cut} FROM {PAIRS_SQL}), hg AS ({grams('h')}), rg AS (SELECT id, n, g, max(c) AS c FROM ({every}) GROUP BY ALL),
 s AS (SELECT hg.n, sum(hg.c) AS total, sum(least(hg.c, coalesce(rg.c, 0))) AS hit FROM hg LEFT JOIN rg USING (id, n, g) GROUP BY hg.n),
 z AS (SELECT sum(len(h)) AS c, sum({near}.n) AS r FROM e)
 SELECT round(100 * CASE WHEN count(*) = 4 AND min(hit) > 0 THEN exp(sum(ln(CASE WHEN hit > 0 THEN hit / total END)) / 4) ELSE 0 END * any_value(CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END), 6) AS bleu FROM s, z"""


@query("evaluate_bleu", _bleu_sql({"r0": "lower(c0) || ' ' || c1"}))
def _(s, d):
    return analysis.evaluate_bleu(pairs(s, d).withColumn("r", F.concat_ws(" ", F.lower("c0"), "c1")), "c0", "r").select(F.round("bleu", 6).alias("bleu"))


@query("evaluate_multi_bleu", _bleu_sql({"r0": "c1", "r1": "lower(c0) || ' ' || c1"}))
def _(s, d):
    return analysis.evaluate_bleu(pairs(s, d).withColumn("r", F.concat_ws(" ", F.lower("c0"), "c1")), "c0", ["c1", "r"]).select(F.round("bleu", 6).alias("bleu"))


def _measures(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") % 10).cast("double").alias("bl_m"), (F.col("doc_id") % 7).cast("double").alias("sys_m"))


_BIN = "SELECT doc_id, CAST(floor((n_chars - lo) / ((hi + 0.1 - lo) / 14)) AS BIGINT) + 1 AS bin FROM documents, (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents)"
query("quantize", _BIN)(lambda s, d: analysis.quantize(_measures(s, d), "x").select("doc_id", "bin"))
query("melt", "SELECT n_chars::DOUBLE AS x, 'bl_m' AS translation, (doc_id % 10)::DOUBLE AS value FROM documents UNION ALL SELECT n_chars::DOUBLE, 'sys_m', (doc_id % 7)::DOUBLE FROM documents")(lambda s, d: analysis.melt(_measures(s, d).drop("doc_id"), "x", "m"))
query("average_line", f"SELECT bin, round(avg(doc_id % 10), 6) AS bl_m, round(avg(doc_id % 7), 6) AS sys_m FROM ({_BIN}) GROUP BY bin")(lambda s, d: analysis.average_line(_measures(s, d), "x", "m").select("bin", F.round("bl_m", 6).alias("bl_m"), F.round("sys_m", 6).alias("sys_m")))


def _source_lines(s: SparkSession, d: str) -> DataFrame:
    return lines_of(table(s, d, "documents").select("source", "text"), "source")


_HITS = "len(regexp_extract_all(line, '{}'))"
#: Patterns that look around in the engine, for RE2.
_AROUND = {"boundary": {"comp": (r"\S@ ",), "plus": (r" \+\S", r"\+ \S"), "5dot": (r" ⁙\S", r"⁙ \S"), "none": (f"{WORDLIKE} {WORDLIKE}",)}}


def _hits_sql(heading: str, label: str, patterns: tuple[str, ...]) -> str:
    if (heading, label) == ("numbers", "raw"):
        return r"len(list_filter(string_split_regex(line, '\s')[2:-2], lambda y: regexp_matches(y, '^[0-9]+$')))"
    return " + ".join(_HITS.format(p.replace("'", "''")) for p in _AROUND.get(heading, {}).get(label, patterns))


_LABELS = r"""SELECT source, 'case' AS heading, CASE WHEN regexp_matches(line, '^\p{Lu}') THEN 'U' WHEN regexp_matches(line, '^\p{Ll}') THEN 'L' WHEN regexp_matches(line, '^\p{Nd}') THEN 'N' ELSE '?' END AS label FROM l
 UNION ALL SELECT source, 'columns', CASE WHEN contains(line, chr(31)) THEN len(string_split(line, chr(31))) || 'u' WHEN contains(line, chr(9)) THEN len(string_split(line, chr(9))) || 't' WHEN contains(line, '|||') THEN len(string_split(line, '|||')) || 'p' ELSE 'no' END FROM l
 UNION ALL SELECT source, 'hyphens', regexp_replace(h[1] || h[3], '\s', ' ', 'g') FROM (SELECT source, unnest(regexp_extract_all(line, '.-.')) AS h FROM l)
 UNION ALL SELECT source, 'periods', regexp_replace(h[1], '\s', ' ', 'g') FROM (SELECT source, unnest(regexp_extract_all(line, '.\.')) AS h FROM l)"""
_FLAT = ", ".join(f"struct_pack(heading := '{h}', label := '{lab}', n := {_hits_sql(h, lab, ps)})" for h, labels in profile.PATTERNS.items() for lab, ps in labels.items())
_PROFILE = f"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), x AS ({_LABELS}),
 p AS (SELECT source, x.heading AS heading, x.label AS label, sum(x.n) AS count FROM (SELECT source, unnest([{_FLAT}]) AS x FROM l) GROUP BY ALL),
 c AS (SELECT source, heading, label, count(*) AS count FROM x GROUP BY ALL UNION ALL SELECT * FROM p),
 r AS (SELECT *, sum(count) OVER (PARTITION BY source, heading) AS total, row_number() OVER (PARTITION BY source, heading ORDER BY count DESC, label) AS rank FROM c),
 best AS (SELECT source, heading, label, CAST(count AS BIGINT) AS count, count / total AS share FROM r WHERE rank = 1 AND total > 0)"""
query("corpus_profile", f"{_PROFILE} SELECT source, heading, label, count, round(share, 6) AS share FROM best")(lambda s, d: profile.profile(_source_lines(s, d), ["source"]).withColumn("share", F.round("share", 6)))
_CELL = "label || ' ' || CASE WHEN count < 10 THEN count::VARCHAR WHEN count < 100 THEN 'd' WHEN count < 1000 THEN 'h' WHEN count < 10000 THEN 'k' ELSE '!' END || ' ' || CASE WHEN floor(share * 100) = 100 THEN 'all' ELSE lpad(CAST(floor(share * 100) AS BIGINT)::VARCHAR, 2, ' ') || '%' END"
_WIDE = ", ".join(f"coalesce(max({_CELL}) FILTER (WHERE heading = '{h}'), '-') AS {h}" for h in ("case", *profile.PATTERNS, "hyphens", "periods", "columns")).replace("AS case", 'AS "case"')
query("profile_table", f"{_PROFILE}, z AS (SELECT source, count(*) AS line_count, lpad(max(len({TOK}))::VARCHAR, greatest(2, length(max(len({TOK}))::VARCHAR))::INT, ' ') || '/' || max(length(line)) AS sizes FROM l GROUP BY source), w AS (SELECT source, {_WIDE} FROM best GROUP BY source) SELECT * FROM z JOIN w USING (source)")(lambda s, d: profile.profile_table(_source_lines(s, d), ["source"]))
query("profile_patterns", f"SELECT source, count(*) AS line_count, max(len({TOK})) AS max_tokens, max(length(line)) AS max_chars, CAST(sum({_HITS.format('<[^>]*>')}) AS BIGINT) AS xml_tag, CAST(sum({_HITS.format('[&<](?:unk|UNK)[;>]')}) AS BIGINT) AS unk_unk, CAST(sum({_HITS.format('&quot;|&apos;|&#124;')}) AS BIGINT) AS escaping_escaped FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")(lambda s, d: profile.pattern_counts(_source_lines(s, d), ["source"]).select("source", "line_count", "max_tokens", "max_chars", "xml_tag", "unk_unk", "escaping_escaped"))
query("profile_labels", f"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), x AS ({_LABELS})
 SELECT source, heading, label, count(*) AS count FROM x GROUP BY ALL""")(lambda s, d: profile.label_counts(_source_lines(s, d), ["source"]))


# --- files and recipes ------------------------------------------------------------------------------------------------


_BENCHMARK_LINES = "(SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)"


def _written(s: SparkSession, df: DataFrame, suffix: str = "") -> str:
    """A line file of the shared folder, which goes with the application."""
    path = fresh_path(s, "lines") + suffix
    files.write_lines(df, path, KEY)
    expire(s, path)
    return path


for _name, _suffix in (("read_lines", ""), ("read_lines_gzip", ".gz"), ("read_lines_bzip2", ".bz2")):
    query(_name, f"SELECT line FROM {L_SQL}")(lambda s, d, suffix=_suffix: files.read_lines(s, _written(s, L(s, d), suffix)).select("line"))

query("concatenate_files", f"SELECT 0 AS file_idx, line FROM {L_SQL} UNION ALL SELECT 1, line FROM {_BENCHMARK_LINES}")(lambda s, d: files.concatenate_files(s, [_written(s, L(s, d), ".gz"), _written(s, benchmark(s, d))]).select("file_idx", "line"))
query("external_linecount", f"SELECT count(*) AS n FROM {L_SQL}")(lambda s, d: s.range(1).select(F.lit(files.line_count(s, _written(s, L(s, d)))).cast("long").alias("n")))


@query("copy_file", f"SELECT line FROM {_BENCHMARK_LINES}")
def _(s, d):
    source = _written(s, benchmark(s, d), ".gz")
    target = source.replace(".gz", "-copy.gz")
    files.copy(s, source, target)
    expire(s, target)
    return files.read_lines(s, target).select("line")


@query("reencode", f"SELECT doc_id, line_no, regexp_replace(line, '[^\\x00-\\xff]', '?', 'g') AS line FROM {L_SQL}")
def _(s, d):
    return L(s, d).select(*KEY, files.reencode(F.encode("line", "ISO-8859-1"), "iso-8859-1").alias("line"))


@query("loop_files", f"SELECT doc_id AS file, line FROM {L_SQL} WHERE doc_id % 3 = 2")
def _(s, d):
    """Numbered files, of which the one with the greatest number is read."""
    template = fresh_path(s, "loop") + ".{_loop_index}"
    for i in range(3):
        path = files.loop_path(template, i)
        files.write_lines(L(s, d).where(F.col("doc_id") % 3 == i).withColumn("line", F.concat_ws("\t", "doc_id", "line")), path, KEY)
        expire(s, path)
    last = files.highest(s, template)
    cut = F.split("line", "\t", 2)
    return files.read_lines(s, files.loop_path(template, last)).select(cut[0].cast("long").alias("file"), cut[1].alias("line"))


@query("indirect_file", f"SELECT line FROM {_BENCHMARK_LINES}")
def _(s, d):
    named = _written(s, benchmark(s, d))
    pointer = _written(s, s.range(1).select(F.lit(0).alias("doc_id"), F.lit(0).alias("line_no"), F.lit(named).alias("line")))
    return files.read_lines(s, files.indirect(s, pointer)).select("line")


def _recipe(s: SparkSession, d: str) -> tuple[recipe.Recipe, recipe.Target]:
    r = recipe.Recipe(s)
    corpus = r.add_input("corpus", "lines", df=L(s, d))
    path = fresh_path(s, "recipe")
    (low,) = r.add_step([corpus], [r.add_output("corpus", "lower", path)], lambda x: x.withColumn("line", X.lowercase("line")))
    (counted,) = r.add_step([low], [r.add_output("corpus", "counts", wanted=True)], counts.count_tokens)
    return r, counted


query("recipe_make", f"SELECT lower(word) AS word, CAST(sum(count) AS BIGINT) AS count FROM {COUNTS_SQL} GROUP BY 1")(lambda s, d: (lambda r: r[0].make()[r[1]])(_recipe(s, d)))
query("recipe_status", "SELECT * FROM (VALUES ('available', 'corpus:lower', 'corpus:lines'), ('waiting', 'corpus:counts', 'corpus:lower')) t(status, outputs, inputs)")(lambda s, d: s.createDataFrame([(x.status, *x.outputs, *x.inputs) for x in _recipe(s, d)[0].status()], "status string, outputs string, inputs string"))
query("pipe_through_program", f"SELECT doc_id, line_no, translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS line FROM {L_SQL}")(lambda s, d: recipe.pipe_lines(L(s, d), "tr a-z A-Z"))
query("choose_model", "SELECT arg_min(lang, (score, lang)) AS model, min(score) AS score FROM (SELECT lang, avg(n_chars) AS score FROM documents GROUP BY lang)")(lambda s, d: recipe.choose_model(table(s, d, "documents").groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("score"))))


@query("train_lexical_match", f"""WITH p AS (SELECT list_transform({T_SQL.format('c0')}, lambda y: y[1:5]) AS a, list_transform({T_SQL.format('c1')}, lambda y: y[1:5]) AS b FROM {PAIRS_SQL}), e AS (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM p)
 SELECT a[i] AS src, b[i] AS trg, count(*) AS count FROM e GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(s, d):
    """With an aligner that links words at the same place."""

    def align(rows: DataFrame) -> DataFrame:
        n = F.least(F.size(tokens("c0")), F.size(tokens("c1")))
        links = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws("-", i.cast("string"), i.cast("string"))), " ")
        return rows.withColumn("alignment", F.when(n > 0, links).otherwise(""))

    return lookup.train_lexical_match(pairs(s, d), ["conv_id", "turn"], align, "c0", "c1")

"""Cell functions and predicates on small literals: empty, null and non-ASCII lines, repeats."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import filters as P
from scriptorium.functions import text as X
from scriptorium.functions import tokenization as K
from scriptorium.functions.languages import contractions
from scriptorium.operators import noise

CASES = [
    (X.normalize_punctuation, ["a–b ‘c’ it’s «x» ''q'' ½⁄ ", "", None], ['a-b "c" it\'s "x" "q" ½/ ', "", None]),
    (X.denormalize_punctuation, ["\"a\" it's"], ["”a” it’s"]),
    (X.map_chars, ["a\x07b\tc – ½ é™ x² €5 _", "−"], ["ab\tc   é™ x €5 ", "−"]),
    (lambda c: X.map_chars(c, {"Pd": "-"}, {"½": "1/2", "é": ""}), ["½ – é"], ["1/2 - "]),
    (X.letterize_names, ["Anna a B 12 x⁙Y"], ["⸫A ⸬n ⸬n ⸭a a B ⸫1 ⸭2 x⁙Y"]),
    (X.normalize_contractions, ["I'm sure you ' ll DON'T", "none"], ["I am sure you will do not", "none"]),
    (X.split_numbers, ["1.2.3 4/5"], ["1@@ .@@ 2.3 4@@ /@@ 5"]),
    (lambda c: X.prefix(c, "<", ">"), ["a", ""], ["<a>", "<>"]),
    (X.normalize_long_sounds, ["aaaa bbb 11111"], ["aaa bbb 111"]),
    (X.truncate_words, ["abcdefg  äöåäöå x", ""], ["abcde äöåäö x", ""]),
    (lambda c: X.truncate_words(c, 3, False), ["abcdefg xy"], ["efg xy"]),
    (X.undo_double_ampersand, ["a &amp; amp ; b"], ["a & b"]),
    (X.zero_width_space, ["a​b"], ["a b"]),
    (X.leading_hyphen, [" - hi", "-x", "x-"], ["hi", "x", "x-"]),
    (X.space_before_url, ["seehttp://x y", "http://x"], ["see http://x y", "http://x"]),
    (X.remove_language_tags, ["(FR) Hello", "in writing. - (EN) Yes", "a (FR) b", "- rapporteur (DE) x"], ["Hello", "Yes", "a (FR) b", "x"]),
    (X.lowercase, ["ÅB İ"], ["åb i̇"]),
    (lambda c: X.regex_substitution(c, [("b", "$0$0"), ("BB", "-")], True), ["abB"], ["a--"]),
    (lambda c: X.strip_rare_chars(c, "ab "), ["abc b"], ["ab b"]),
    (X.strip_xml, ["a <b>c</b>  d", "x <y <z> w> v", "p > q < r\ns> t"], ["a c d", "x v", "p q \n t"]),
    (X.clean, ["&lt;b&gt; cafÃ© ﬁn", "“q”\r\nx", None], ["<b> café fin", '"q" x', None]),
    (K.simple_tokenize, ['Hi, "you"...', "3.5 (a)", "", None], ['Hi ⁙, "⁙ you ⁙" ⁙...', "3 ⁙.⁙ 5 (⁙ a ⁙)", "", None]),
    (K.simple_detokenize, ['Hi ⁙, "⁙ you ⁙"...'], ['Hi, "you"...']),
    (K.split_long_numbers, ["1234 12345 ▁1234567 a12345", ""], ["1234 12 ⁙345 ▁1 ⁙234 ⁙567 a12345", ""]),
    (lambda c: K.split_long_numbers(c, from_right=False), ["12345"], ["123⁙ 45"]),
    (K.split_hyphens, ["a-b -c d- e-5 --"], ["a - b -c d- e-5 --"]),
    (K.split_hyphens_strictly, ["abcd-efgh abc-defg"], ["abcd - efgh abc-defg"]),
    (K.split_all_hyphens, ["a-5 -b"], ["a - 5 -b"]),
    (K.split_decimal, ["1,5 a.b"], ["1 , 5 a.b"]),
    (K.char_segmentation, ["ab c", ""], ["a b ⁘ c", ""]),
    (lambda c: K.char_segmentation(c, "⁙"), ["a⁙ b c"], ["a b ⁘ c"]),
    (lambda c: K.tokenize(c, "en"), ["Mr. Smith's 3.14 (see http://a.b/c) it's e.g. 1990's", "a,b !", None], ["Mr. Smith 's 3.14 ( see http://a.b/c) it 's e . g . 1990 's", "a , b !", None]),
    (lambda c: K.detokenize(c, "en"), ["Hello , world ! it 's $ 5"], ["Hello, world! it's $5"]),
    (K.joiner_tokenize, ["It's 3pm."], ["It ⁙'⁙ s 3 ⁙pm ⁙."]),
    (K.sentences, ["A b. C d? e! ", ""], [["A b.", "C d?", "e!"], []]),
]


@pytest.mark.parametrize("f, given_, expected", CASES, ids=range(len(CASES)))
def test_cells(cells, f, given_, expected):
    assert cells(f, given_) == expected


FILTERS = [
    (P.nothing, ["", "x"], [False, False]),
    (lambda c: P.matches(c, [r"\d+", "q$"]), ["a1", "q", "b"], [True, True, False]),
    (lambda c: P.by_length(c, min_tokens=2, max_chars=8, min_chars=3, max_chars_per_token=5), ["a b", "a", "aaa bbbbbb", "a  b  c ", "aaaaaa b"], [False, True, True, False, True]),
    (lambda c: P.has_oov(c, ["a", "b"]), ["a b", "a c", ""], [False, True, False]),
    (lambda c: P.foreign_chars(c, "жю", 2), ["жюж", "жю", "abc"], [True, False, False]),
    (P.only_names, ["Anna", "x", "12", "A"], [False, True, False, True]),
    (P.bureaucratic, ["(a) [b] (c) [d] ;;", "plain text"], [True, False]),
    (P.repetitive, [" ".join("aaaaa"), "a b a b a b", " ".join("a b".split() * 15), ""], [True, False, True, False]),
    (P.single_url, ["HTTP://x.y", "see http://x"], [True, False]),
    (P.any_url, ["see http://x", "http:// "], [True, False]),
    (P.ellipsis, ["a...", "a.."], [True, False]),
    (P.accent_noise, ["àáâãäê", "àáâ", "abcdef à"], [True, False, False]),
    (P.has_contraction, ["I don ' t", "cannot"], [True, False]),
    (P.news_crawl_urls, ["http://www.iltasanomat.fi/x", "http://x"], [True, False]),
    (P.unclean, ["ok", "ﬁ"], [False, True]),
]


@pytest.mark.parametrize("f, given_, expected", FILTERS, ids=range(len(FILTERS)))
def test_filters(cells, f, given_, expected):
    assert cells(f, given_) == expected


def test_pair_filters(spark):
    rows = [("abcdefghijkl", "abc"), ("ab", "a"), ("", "abcdefghijklm"), ("same words that are long enough", "Same words, that are long enough!"), ("equal len 12", "lqual ben 34")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(P.length_ratio("a", "b", 0.5).alias("r"), P.long_untranslated("a", "b").alias("u")).collect()
    assert [r["r"] for r in got] == [True, False, True, False, False]
    assert [r["u"] for r in got] == [False, False, False, True, False]


def test_levenshtein_filters(spark):
    df = spark.createDataFrame([(1, "abc", "abd"), (1, "abcd", "abce"), (3, "abcdef", "uvwdef"), (5, "abc", "abcdefgh")], "d int, l string, r string")
    assert [r[0] for r in df.select(P.levenshtein_far("d", "l", "r")).collect()] == [True, False, True, True]
    assert [P.longest_edit(a, b) for a, b in (("abc", "abcdefgh"), ("abcdef", "uvwdef"), ("aXXXXb", "ab"))] == [5, 0, 4]


def _repetitive(line, anywhere, consecutive):
    t = line.split()
    runs = any(len(set(t[i : i + consecutive])) == 1 for i in range(len(t) - consecutive + 1))
    return runs or any(t.count(x) >= anywhere for x in set(t))


def test_repetitive_against_a_loop(cells):
    rng = random.Random(3)
    rows = [" ".join(rng.choice("ab cd e".split()) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    assert cells(lambda c: P.repetitive(c, 5, 3), rows) == [_repetitive(r, 5, 3) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>ab \n", max_size=40))
def test_strip_tags_against_a_loop(text):
    inside, out = 0, []
    for c in text:
        if c in "<>":
            inside = inside + 1 if c == "<" else max(inside - 1, 0)
        elif c == "\n" or not inside:
            out.append(c)
    assert X.strip_tags(text) == re.sub(" +", " ", "".join(out))


def test_dispatch_and_prefix(spark, cells):
    f = lambda c: X.regex_dispatch(c, [("a(b)", lambda x, g: F.concat(g(1), x)), ("x", lambda x, g: F.lit(None))])
    assert cells(f, ["abc", "xab", "zab"]) == ["babc", None, None]
    df = spark.createDataFrame([("h t u",)], "line string")
    assert tuple(df.select(*X.cut_prefix("line")).first()) == ("h", "t u")
    with pytest.raises(Exception, match="no separator"):
        spark.createDataFrame([("x",)], "line string").select(*X.cut_prefix("line")).collect()


def test_segmentation_of_analyses(cells):
    got = cells(K.mapping_to_segmentation, ["Talossa\ttalo ssa", "muut\tmuu n", "ab\ta# b"])
    assert [(g["segmentation"], g["ok"]) for g in got] == [("Talo ssa", True), ("muut", False), ("a b", True)]


def test_contractions_share_beginnings(cells):
    words = [a for a, _ in contractions("en")]
    pattern = P._any_of(words)
    assert len(re.findall("ould", pattern)) < sum("ould" in w for w in words)
    tries = [f"{x}{w.replace(chr(39), gap)}{y}" for w in words for gap in ("'", " ' ", "") for x in ("", "x", "- ") for y in ("", "s", ".")] + ["", "'", "can", "GONNA go", "İt's"]
    plain = "(?iuU)" + "|".join(rf"(?:\b{w.replace(chr(39), ' ?' + chr(39) + ' ?')}\b)" for w in words)
    assert cells(P.has_contraction, tries) == cells(lambda c: F.regexp_like(c, F.lit(plain)), tries)
    assert cells(lambda c: P.has_contraction(c, reverse=True), ["he is", "heis", "cannot", "x"]) == [True, False, True, False]


def test_draws_are_compared_as_hexadecimals(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("k"))
    for p in (-1.0, 0.0, 1e-20, 0.1, 0.5, 0.999, 1.0, 2.0):
        both = rows.select(noise.at_least(p, 1, F.col("k"), F.col("id")).alias("a"), (noise.draw(1, F.col("k"), F.col("id")) >= p).alias("b"))
        assert both.where("NOT a <=> b").count() == 0

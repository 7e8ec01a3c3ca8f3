"""Operators over ordered tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium import corpus
from scriptorium.functions import filters as P
from scriptorium.functions import text as X
from scriptorium.operators import analysis, blocks, bpe, counts, dedup, lookup, morph, noise, order, pipes, profile, sgm, tabular, truecase
from scriptorium.storage import stored

O = ["line_no"]


def texts(df, *by):
    return [r["line"] for r in df.orderBy(*(by or O)).collect()]


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lines_and_tokens(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert table(corpus.lines_of(df), "doc_id", "line_no", "line") == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, "")]
    one = spark.createDataFrame([(" a\x1fb c  ",)], "line string")
    assert one.select(corpus.tokens("line")).first()[0] == " a\x1fb c  ".split()


def test_positions_in_ranges(spark):
    df = spark.range(500, numPartitions=4).select((F.col("id") % 7).alias("a"), "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    placed = table(corpus.with_position(df, ["a", "id"]), "position", "a", "id")
    assert placed == [(p, *x) for p, x in enumerate(sorted((i % 7, i) for i in range(500)))]
    again = table(corpus.with_position(df, ["n", "id"], "at", 10), "at", "n", "id")
    assert [x[0] for x in again] == list(range(10, 510)) and [x[1] for x in again[:100]] == [None] * 100
    assert corpus.with_position(df.limit(0), ["id"]).count() == 0


def test_detruecase_of_letters_without_an_upper_case_of_one(lines):
    assert texts(lines(["ßa ßb . ß", "ﬁn x", "éa", "ᾳ"]).select("line_no", truecase.detruecase("line").alias("line"))) == ["ẞa ßb . ẞ", "ﬁn x", "Éa", "ᾼ"]


def test_bleu_exchanges_sums_only(spark):
    rows = spark.createDataFrame([("a b a b a c", "a b a b", "a c x a b a"), ("a b c d", "a b c d", "b"), ("a b c d", "a b c d", "b"), ("", "x", ""), ("a a a", "a a", "a")], "h string, r string, q string")
    total, hit = [0] * 4, [0] * 4
    for h, *refs in map(tuple, rows.collect()):
        for n in range(1, 5):
            grams = lambda t: Counter(zip(*[t.split()[i:] for i in range(n)]))  # noqa: B023, E731
            mine, theirs = grams(h), grams(refs[0]) | grams(refs[1])
            total[n - 1] += sum(mine.values())
            hit[n - 1] += sum((mine & theirs).values())
    # The outputs have 17 words, the nearest references 16.
    want = 100 * math.exp(sum(math.log(a / b) for a, b in zip(hit, total)) / 4) * 1.0
    made = analysis.evaluate_bleu(rows, "h", ["r", "q"])
    assert made.first()["bleu"] == pytest.approx(want)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 and "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_retokenize_in_slices(spark, monkeypatch):
    text = "Mr. X pays 3.5 $, it's . . fine."
    rows = spark.createDataFrame([(i, None if i == 2 else text, text, "a.b", [text, None] if i != 1 else None) for i in range(5)], "docid long, src string, bl string, sys string, refs array<string>").coalesce(1)
    monkeypatch.setattr(analysis, "SLICE_ROWS", 2)
    made = analysis.retokenize(rows, "en", "en")
    # No column goes to the worker in batches of its own.
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString() and made.schema == rows.schema
    out, make = made.orderBy("docid").collect(), analysis.RuleTokenizer("en")
    assert [r["src"] for r in out] == [make(text)] * 2 + [None] + [make(text)] * 2
    assert [r["refs"] for r in out][:2] == [[make(text), None], None] and {(r["bl"], r["sys"]) for r in out} == {(make(text), make("a.b"))}


def test_mapping_moves_different_tokens_of_blocks(spark):
    rows = [(i, None if i == 3 else f"a b{i % 3} a  c", i * 1.5) for i in range(30)] + [(30, "", 1.0), (4, "c c", 2.0)]
    x = spark.createDataFrame(rows, "line_no long, line string, n double")
    mapping = spark.createDataFrame([("a", "A B"), ("b1", "é")], "src string, trg string")
    want = sorted((i, " ".join({"a": "A B", "b1": "é"}.get(t, t) for t in (line or "").split()), n) for i, line, n in rows)
    for size in (1, 7, 1 << 19):
        made = lookup.map_tokens(x, mapping, O, block_tokens=size)
        assert table(made, "line_no", "line", "n") == want and made.columns == x.columns
    narrow = lookup.map_tokens(x.select("line", "line_no"), mapping, O)
    assert narrow.columns == ["line_no", "line"] and table(narrow, "line_no", "line") == [w[:2] for w in want]
    assert lookup.map_tokens(x.limit(0), mapping, O).count() == 0


def test_sentences_joined_in_a_stream_of_groups(spark):
    texts_ = {g: [f"{'A' if i % 4 == 0 else 'b'} c{g or 0} d{'.' if i % 5 == 0 else ''}" if (i + (g or 0)) % 7 else None for i in range(1 + (g or 0) % 9)] for g in [*range(60), None]}
    rows = [(g, i, t) for g, ts in texts_.items() for i, t in enumerate(ts)]
    x = spark.createDataFrame(sorted(rows, key=lambda r: hash(r) % 97), "g int, i int, line string")
    made = blocks.join_sentences(x, "g", "i")
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = [(g, i, t) for g, ts in texts_.items() for i, t in enumerate(blocks.join_lines([t or "" for t in ts]))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, made.select("g", "part", "line").collect()), key=key) == sorted(want, key=key)
    assert blocks.join_sentences(x.limit(0), "g", "i").count() == 0


def test_merges_against_recounting(spark, monkeypatch):
    vocabulary = [("aaaa", 3), ("aaaaa", 2), ("abab", 4), ("babaa", 4), ("cabab", 1), ("éa", 2), ("b", 9)]
    words, merges = {tuple(w) + (bpe.END,): n for w, n in vocabulary}, []
    while True:
        found = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):
                found[p] = found.get(p, 0) + n
        if not found or max(found.values()) < 2:
            break
        merges.append(max(found, key=lambda p: (found[p], p)))
        words = {bpe.merge_word(w, merges[-1]): n for w, n in words.items()}
    for held in (1, 5, 1 << 24):
        learner = bpe.Learner(held=held)
        learner.add(*zip(*vocabulary))
        assert learner.learn() == merges
    counted = spark.createDataFrame(vocabulary, "word string, count long")
    monkeypatch.setattr(type(counted), "toLocalIterator", lambda *_: pytest.fail("words on the driver"))
    assert bpe.learn_bpe(counted) == merges


def test_merges_are_not_hashed_for_every_text(lines):
    segment = bpe._segmenter(bpe._Named("ab", [("a", "b")]), "@@")  # a list has no hash
    assert segment("abc b") == "ab@@ c b" and bpe._segmenter(bpe._Named("ab", []), "@@") is segment
    assert texts(lines(["abc"]).select("line_no", bpe.apply_bpe("line", [("a", "b")]).alias("line"))) == ["ab@@ c"]


def test_stored_tables_replace_each_other(spark):
    one = stored(spark.range(5).toDF("x"), "t")
    two = stored(one.selectExpr("x + 1 AS x"), "t", one)
    assert [r["x"] for r in two.orderBy("x").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="(?i)not.*exist|FILE"):
        spark.read.parquet(one._stored_at)


def test_slices(lines):
    x = lines("abcdefg")
    assert texts(order.head(x, 2, O)) == ["a", "b"]
    assert texts(order.skip(x, 5, O)) == ["f", "g"]
    assert texts(order.slice_rows(x, 2, 4, O)) == ["c", "d"]
    assert texts(order.last(x, 2, O)) == ["f", "g"]
    assert texts(order.round_robin(x, 1, 3, O)) == ["b", "e"]
    assert texts(order.line_numbers(x, O, 5)) == [f"{i + 5} {c}" for i, c in enumerate("abcdefg")]
    assert [r["chunk"] for r in order.chunk_split(x, 3, O).orderBy("line_no").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert texts(order.upsample(x, 2), "line_no", "copy") == list("aabbccddeeffgg")
    assert order.upsample(x, 0).count() == 0
    assert order.head(x, 0, O).count() == 0


def test_interleaving_and_sorting(lines):
    mixed = order.de_round_robin([lines("abcde"), lines("xy")], O, [2, 1])
    assert texts(mixed, "position") == ["a", "b", "x", "c", "d", "y", "e"]
    s = lines(["bb", "a", "cc", "", "d"])
    assert texts(order.sort_by_length(s, O), "position") == ["", "a", "d", "bb", "cc"]
    assert texts(order.sort_by_length(s, O, reverse=True), "position") == ["bb", "cc", "a", "d", ""]
    parts = order.split_dataset(lines("abcdefgh"), O, 2, 3, 2)
    assert {k: v.count() for k, v in parts.items()} == {"dev": 2, "test": 3, "train": 2}
    assert sorted(texts(order.shuffle(s, O), "position")) == sorted(["bb", "a", "cc", "", "d"])


def test_zip_is_strict(lines):
    assert [tuple(r) for r in order.safe_zip([lines("ab"), lines("xy")], O).orderBy("line_no").collect()] == [(0, "a", "x"), (1, "b", "y")]
    with pytest.raises(Exception, match="not aligned"):
        order.safe_zip([lines("ab"), lines("x")], O).collect()
    assert texts(tabular.paste_columns([lines("ab"), lines("xy")], O)) == ["a\tx", "b\ty"]
    assert [tuple(r) for r in tabular.split_columns(lines(["a\tb", "\t"]), ["p", "q"]).orderBy("line_no").select("p", "q").collect()] == [("a", "b"), ("", "")]
    with pytest.raises(Exception, match="not 2 columns"):
        tabular.split_columns(lines(["a"]), ["p", "q"]).collect()


def test_masks_and_scores(spark, lines):
    x = lines(["a...", "b", "c"])
    m1, m2 = order.filter_mask(x, P.ellipsis("line"), O), order.filter_mask(x, F.col("line") == "c", O)
    kept, gone = order.apply_mask(x, [m1, m2], O)
    assert texts(kept) == ["b"] and texts(gone) == ["a...", "c"]
    scores = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 2.0)], "line_no long, score double")
    assert texts(order.filter_by_score(x, scores, O, keep=2)[0]) == ["b", "c"]
    kept, gone = order.filter_by_score(x, scores, O, threshold=2.0)
    assert texts(kept) == ["b", "c"] and texts(gone) == ["a..."]


def test_pipe_side_outputs(lines):
    run = pipes.pipe(pipes.cell(X.lowercase), pipes.tee("copy"), pipes.remove(P.ellipsis, "rejects"), pipes.dead_end("counts", counts.count_tokens))
    got = run(lines(["A...", "B b"]))
    assert texts(got.main) == ["b b"] and texts(got.side["rejects"]) == ["a..."] and texts(got.side["copy"]) == ["a...", "b b"]
    assert table(got.side["counts"], "word", "count") == [("b", 2)]
    both = pipes.parallel_pipe([pipes.per_column([X.lowercase, None], ["c0", "c1"]), pipes.remove_parallel({"c1": P.ellipsis}, "log")], [lines("AB"), lines(["x", "y..."])])
    assert table(both.main, "c0", "c1") == [("a", "x")] and table(both.side["log"], "reject") == [("b ||| y...",)]
    with pytest.raises(ValueError):
        pipes.mono_pipe([], [lines("a"), lines("b")])


def _dedup(rows, columns, cut=30):
    """The loop that the operator stands for."""
    many = [{x for x in col if col.count(x) > 1} for col in zip(*rows)] if rows else []
    seen = [set() for _ in range(columns)]
    out = []
    for row in rows:
        for k in range(columns):
            if row[k] in many[k]:
                p = row[k][:cut]
                if p in seen[k]:
                    break
                seen[k].add(p)
        else:
            out.append(row)
    return out


def test_deduplicate(spark):
    import random

    rng = random.Random(5)
    for columns in (1, 2):
        rows = [tuple(rng.choice(["x" * 30 + "1", "x" * 30 + "2", "a", "b", "c", ""]) + rng.choice(["", "q"]) for _ in range(columns)) for _ in range(60)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_no long, " + ", ".join(f"c{i} string" for i in range(columns)))
        got = dedup.deduplicate(df, O, [f"c{i}" for i in range(columns)]).orderBy("line_no").collect()
        assert [tuple(r)[1:] if tuple(r)[0] is not None else None for r in [tuple(g[c] for c in df.columns) for g in got]] == _dedup(rows, columns)


def test_counts(spark, lines):
    c = counts.count_tokens(lines(["a b a", "", "é b"]))
    assert [tuple(r) for r in counts.sort_counts(c).collect()] == [("a", 2), ("b", 2), ("é", 1)]
    assert table(counts.count_chars(lines(["ab a"])), "word", "count") == [(" ", 1), ("a", 2), ("b", 1)]
    assert table(counts.scale_counts(c, 1.5), "count", "word") == [(2, "é"), (3, "a"), (3, "b")]
    other = spark.createDataFrame([("a", 10), ("z", 2)], "word string, count long")
    assert table(counts.combine_counts([c, other], threshold=2), "word", "count") == [("a", 12), ("b", 2), ("z", 2)]
    assert table(counts.combine_counts([c, other], balance=True), "word", "count") == [("a", 14), ("b", 4), ("z", 2), ("é", 2)]
    assert table(counts.dampen_counts(other), "word", "count") == [("a", 3), ("z", 2)]
    seg = spark.createDataFrame([("a", ["x", "y"])], "surface string, parts array<string>")
    assert table(counts.segment_counts(other, seg), "word", "count") == [("x", 10), ("y", 10), ("z", 2)]


def test_tf_idf_runs(spark):
    df = spark.createDataFrame([(0, 1, "a b"), (1, 2, "a"), (2, 1, "a")], "line_no long, doc_id long, line string")
    got = {r["word"]: (r["tf"], r["df"], r["weight"]) for r in counts.tf_idf(df, order=O).collect()}
    assert got["a"][:2] == (3, 3) and math.isclose(got["a"][2], math.log(4) * math.log(3 / 4))
    assert {r["word"]: r["df"] for r in counts.tf_idf(df).collect()} == {"a": 2, "b": 1}


def test_word_pairs(spark):
    df = spark.createDataFrame([(0, "0-0 1-1", "a b", "x y"), (1, "0-0 1-0", "a b", "x z"), (2, "0-0", "b", "x")], "line_no long, alignment string, src string, trg string")
    assert [tuple(r) for r in counts.word_pairs(df, O).collect()] == [("a", "x", 2), ("b", "x", 2)]
    assert [tuple(r)[:2] for r in counts.word_pairs(df, O, min_freq=1, at_most=1).collect()] == [("a", "x")]
    with pytest.raises(Exception, match="out of range"):
        counts.word_pairs(df.withColumn("alignment", F.lit("5-0")), O).collect()


def test_lookups(spark, lines):
    m = spark.createDataFrame([("a", "A"), ("b", "B B")], "src string, trg string")
    x = lines(["a c b", "", "c c"])
    assert texts(lookup.map_tokens(x, m, O)) == ["A c B B", "", "c c"]
    assert table(lookup.unmapped(x, m), "word", "count") == [("c", 3)]
    seg = lookup.segmentation_map(lines(["ka la", "ta lo ssa", "kal a"]), O)
    assert table(seg, "src", "trg") == [("kala", "kal⁙ a"), ("talossa", "ta⁙ lo⁙ ssa")]
    assert texts(lookup.apply_segmentation(lines(["kala ⁙talossa⁙ x"]), seg, O)) == ["kal⁙ a ⁙ta⁙ lo⁙ ssa⁙ x"]
    words = spark.createDataFrame([(0, "x"), (1, "kala"), (2, "y"), (3, "x")], "line_no long, word string")
    assert [r["word"] for r in lookup.missing_segmentations(words, seg, O).collect()] == ["x", "y"]
    over = lookup.override_segmentation(lines(["ka la", "k ala", "a b"]), lines(["kal a", "kala"]), O)
    assert table(over, "src", "line") == [("ab", "a b"), ("kala", "kala")]
    kept, gone = lookup.drop_oov(x, spark.createDataFrame([("a",), ("b",), ("c",)], "word string"), O)
    assert kept.count() == 3 and gone.count() == 0
    feats = spark.createDataFrame([("ab", "N")], "src string, trg string")
    assert texts(lookup.add_lookup_feature(lines(["a@@b x"]), feats, O)) == ["a@@b￨N x￨<UNK>"]
    clusters = spark.createDataFrame([(0, "u", 1), (1, "v", 1), (2, "w", 2)], "line_no long, word string, cluster long")
    assert table(lookup.cluster_examples(clusters, O), "src", "trg") == [("u", "u"), ("v", "u"), ("w", "w")]


def test_triangulate_and_score(spark):
    a = spark.createDataFrame([(0, "The cat", "x"), (1, "the cat!", "y")], "line_no long, pivot string, text string")
    b = spark.createDataFrame([(0, "THE CAT", "u"), (1, "dog", "v")], "line_no long, pivot string, text string")
    assert table(lookup.triangulate(a, b), "line_no", "a", "b") == [(0, "y", "u")]
    rows = spark.createDataFrame([(0, "cat dog", "cat hund"), (1, "", "")], "line_no long, src string, trg string")
    pairs = spark.createDataFrame([("dog", "hund")], "src string, trg string")
    assert table(lookup.lexical_match_score(rows, pairs, O), "line_no", "score") == [(0, -1.0), (1, None)]


def test_truecasing(lines):
    corpus_ = lines([". I i am I", "x The Cat", "y the Cat . Next the", ""])
    model = truecase.train_truecaser(corpus_, O)
    assert table(model, "word", "best", "sure") == [("cat", "Cat", True), ("i", "i", False), ("the", "the", True)]
    assert texts(truecase.truecase(lines(["The cat saw THE cat", "the cat", "A CAT THE", ""]), model, O)) == ["the cat saw THE cat", "the Cat", "A Cat the", ""]


def test_detruecase(cells):
    assert cells(truecase.detruecase, ["- éa b . c ? ! d", ""]) == ["- Éa b . C ? ! D", ""]


def test_blocks(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b ", "", "", "c"])], "g long, line_no long, line string")
    assert [tuple(r) for r in blocks.join_vertical(df, ["g"], O).orderBy("block").select("block", "line").collect()] == [(0, "a b"), (1, ""), (2, "c")]
    tabbed = df.withColumn("line", F.when(F.col("line") != "", F.concat_ws("\t", "line", F.upper("line"))).otherwise(""))
    assert [r["line"] for r in blocks.extract_column(tabbed, 1, ["g"], O).orderBy("block").collect()] == ["A B ", "C"]
    assert texts(blocks.single_surface_column(df.where("line_no < 2")), "line_no", "part") == ["a", "", "b", ""]
    assert blocks.join_lines(["Ab c", "d e.", "", "f g", "H i", "x", "j k"]) == ["Ab c ▁d e.", "", "f g", "H i", "x", "j k"]
    joined = blocks.join_sentences(spark.createDataFrame([(1, 0, "Ab c"), (1, 1, "d e."), (2, 0, "x y")], "g long, line_no long, line string"), "g", "line_no")
    assert texts(joined, "g", "part") == ["Ab c ▁d e.", "x y"]


def test_morphology(spark):
    rows = ["Koira-1\tx\t--koira-talooo1\t[POS=N]|[CASE=X]|[POS=M]", "5,0\tx\t5,0\t[PROPER=PROPER]", "", "...\tx\t....\t[NUM=S]"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)], "g long, line_no long, line string")
    assert [r.split("\t")[2] if r else "" for r in texts(morph.modify_lemmas(df))] == ["taloo", "<PROPER>", "", ".."]
    assert [r.split("\t")[3] if r else "" for r in texts(morph.filter_tags(df, keep=("CASE", "POS", "NUM")))] == ["[CASE=X]|[POS=M]", "", "", "[NUM=S]"]
    m = spark.createDataFrame([("x", "y")], "src string, trg string")
    assert [r.split("\t")[1] if r else "" for r in texts(morph.map_column(df, m, 1))] == ["y", "y", "", "y"]
    parts = spark.createDataFrame([("ab", ["a@@", "b"])], "src string, parts array<string>")
    t = spark.createDataFrame([(1, 0, "ab\tT"), (1, 1, "c\tU"), (1, 2, "")], "g long, line_no long, line string")
    assert texts(morph.segment_column(t, parts, 0, replace=(1, "-")), "line_no", "part") == ["a@@\t-\tB", "b\tT\tE", "c\tU\tS", ""]
    assert texts(morph.interleave(t, ["g"], O, keep=(1, 0), parts=parts), "block") == ["%%T a@@ b %%U c"]
    sub = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a@@", "b", "", "c"])], "g long, line_no long, line string")
    assert texts(morph.only_first_subword(sub, 0, ["g"], O)) == ["a@@", "", "c"]
    num = spark.createDataFrame([(1, i, x) for i, x in enumerate(["<NUM>", "<NUM>", "<PROPER>", "", "<PROPER>", "q", "q"])], "g long, line_no long, line string")
    assert texts(morph.only_first_proper_or_num(num, 0, ["g"], O)) == ["<NUM>", "<PROPER>", "", "<PROPER>", "q", "q"]
    both = spark.createDataFrame([("ab", "T", ["a", "b"], ["t", "u"])], "surf string, lemma string, morphs array<string>, parts array<string>")
    assert texts(morph.segment_surface_and_lemma(t, both, 0, 1), "line_no", "part") == ["a\tt\tB", "b\tu\tE", "c\tU\tS", ""]
    assert morph.split_lemmas([("koira", 9), ("talo", 8), ("koiratalo", 3)], prefixes=["talo"]) == [("koira", ["koira"]), ("talo", ["talo"]), ("koiratalo", ["koira", "talo"])]


def test_sgm(spark, lines):
    x = lines(['<doc sysid="s" docid="d1" genre="news">', '<seg id="1">A &amp; b</seg>', "</doc>", '<DOC docid="d2" sysid="s">', '<seg id="1"></seg>']).withColumn("g", F.lit(1))
    assert table(sgm.read_sgm(x, ["g"], O), "docid", "segid", "text") == [("d1", "1", "A &amp; b"), ("d2", "1", "")]
    bleu = lines(['BLEU = 0.25 for system "a" on segment 3 of document "d" (8 words)', "other"])
    assert table(sgm.read_bleu(bleu), "sysid", "docid", "segid", "bleu") == [("a", "d", "3", 0.25)]
    wrapped = sgm.wrap_in_xml(lines("ab"), "line_no", "tst", "t", "s")
    assert [r["line"] for r in wrapped.orderBy("key").collect()] == ['<tstset setid="t" srclang="any" trglang="any">', '<doc sysid="s" docid="dummy">', "<p>", '<seg id="1">a</seg>', '<seg id="2">b</seg>', "</p>", "</doc>", "</tstset>"]


def test_analysis(spark):
    df = spark.createDataFrame([("the cat", ["the cat"]), ("", ["x"])], "hyp string, refs array<string>")
    assert [round(r[0], 6) for r in df.select(analysis.chrf_score("hyp", "refs")).collect()] == [1.0, 0.0]
    assert analysis.evaluate_bleu(spark.createDataFrame([("a b c d e", "a b c d e")], "hyp string, ref string")).first()[0] == pytest.approx(100)
    assert analysis.evaluate_chrf(df.limit(1), betas=(1.0,)).first()["chrf"] == pytest.approx(1.0)
    one = spark.createDataFrame([("a a b a",), ("A A",), ("",)], "line string")
    assert [tuple(r[0]) for r in one.select(analysis.repeats("line")).collect()] == [(2, 1), (0, 0), (0, 0)]
    q = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    assert [r["bin"] for r in analysis.quantize(q, "v", 3).orderBy("v").collect()] == [1, 1, 2]


def test_segments_again(spark):
    rows_ = spark.createDataFrame([(1, 1, "Hi, you", "The a.", "b c", ["A,b", "the"])], "docid long, segid long, src string, bl string, sys string, refs array<string>")
    got = analysis.retokenize(rows_, "en", "en").first()
    assert (got["src"], got["bl"], got["refs"]) == ("Hi , you", "The a .", ["A , b", "the"])
    model = spark.createDataFrame([("the", "the", True), ("b", "B", True)], "word string, best string, sure boolean")
    got = analysis.retruecase(rows_, None, model).first()
    assert (got["src"], got["bl"], got["sys"], got["refs"]) == ("Hi, you", "the a.", "B c", ["A,b", "the"])


def test_noise_is_seeded(lines):
    x = lines(["a b c d e f g h", "z"])
    f = lambda: [r[0] for r in x.orderBy("line_no").select(noise.drop_tokens("line", O, 0.5)).collect()]
    assert f() == f() and f()[1] == "z"
    moved = [r[0] for r in x.orderBy("line_no").select(noise.perturb_order("line", O, 3)).collect()]
    assert sorted(moved[0].split()) == sorted("abcdefgh")
    at = {t: i for i, t in enumerate(moved[0].split())}
    assert all(abs(at[t] - i) <= 3 for i, t in enumerate("abcdefgh"))
    assert [r[0] for r in x.select(noise.perturb_order("line", O, 0)).collect()][0] == "a b c d e f g h"


def test_profile(lines):
    x = lines(['A "b", c-d. <b>', "x", "Y\tz."]).withColumn("g", F.lit(1))
    got = {(r["heading"], r["label"], r["count"]) for r in profile.profile(x, ["g"]).collect()}
    assert {("xml", "tag", 1), ("case", "U", 2), ("columns", "no", 2), ("hyphens", "cd", 1), ("quotes", "outside", 1)} <= got
    wide = profile.profile_table(x, ["g"]).first()
    assert (wide["line_count"], wide["case"], wide["xml"], wide["unk"]) == (3, "U 2 66%", "tag 1 all", "-")
    assert {r["m"] for r in x.sparkSession.createDataFrame([(5,), (50,), (20000,)], "n int").select(profile.magnitude(F.col("n")).alias("m")).collect()} == {"5", "d", "!"}


def test_bpe():
    merges = bpe.learn_merges([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], 4)
    assert merges[:3] == [("t", "</w>"), ("s", "t</w>"), ("e", "st</w>")]
    s = bpe.Segmenter(merges)
    assert s("lowest").split()[-1] == "est" and s("q") == "q"
    assert s("lowest new").replace("@@ ", "") == "lowest new"
    assert bpe.learn_merges([("a", 9)], 5) == [("a", "</w>")]

"""Sources, recipes, external steps, streams, and the contract of the entry module."""

import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.plans import recipe as R
from scriptorium.sources import files
from scriptorium.streaming import lines as stream


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n", encoding="utf-8")
    with gzip.open(tmp_path / "a.gz", "wt", encoding="utf-8") as f:
        f.write("g\n")
    (tmp_path / "a.xz").write_bytes(lzma.compress("ä\nö".encode()))
    (tmp_path / "latin").write_bytes("ä\r\nb".encode("iso-8859-15"))
    read = lambda n, **k: [r["line"] for r in files.read_lines(spark, str(tmp_path / n), **k).orderBy("line_no").collect()]
    assert read("a.txt") == ["x", "y"] and read("a.gz") == ["g"] and read("a.xz") == ["ä", "ö"] and read("latin", encoding="iso-8859-15") == ["ä", "b"]
    both = files.concatenate_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "a.gz")])
    assert [r["line"] for r in both.orderBy("file_idx", "line_no").collect()] == ["x", "y", "g"]
    files.write_lines(both, str(tmp_path / "out.gz"), ["file_idx", "line_no"])
    assert files.line_count(spark, str(tmp_path / "out.gz")) == 3
    for i in (1, 12, 3):
        (tmp_path / f"m.{i}").write_text("")
    assert files.highest(spark, str(tmp_path / "m.{_loop_index}")) == 12 and files.highest(spark, str(tmp_path / "n.{_loop_index}")) is None
    (tmp_path / "link").write_text("target\n")
    assert files.indirect(spark, str(tmp_path / "link")) == "target"
    with pytest.raises(ValueError):
        files.only_match(spark, str(tmp_path / "m.*"))
    assert files.only_match(spark, str(tmp_path / "li*")) == str(tmp_path / "link")
    (tmp_path / "two").mkdir()
    assert files.is_empty_folder(spark, str(tmp_path / "two"))
    for n in "ab":
        (tmp_path / "two" / n).write_bytes(f"{n}ä\r\n{n}\n".encode("iso-8859-15"))
    assert not files.is_empty_folder(spark, str(tmp_path / "two"))
    several = files.read_lines(spark, str(tmp_path / "two"), encoding="iso-8859-15").orderBy("line_no").collect()
    assert [r["line"] for r in several] == ["aä", "a", "bä", "b"] and len({r["line_no"] for r in several}) == 4
    files.copy(spark, str(tmp_path / "latin"), str(tmp_path / "latin2"))
    files.copy(spark, str(tmp_path / "a.txt"), str(tmp_path / "latin2"))
    assert (tmp_path / "latin2").read_bytes() == (tmp_path / "latin").read_bytes()


def test_recipe(spark, tmp_path, lines):
    r = R.Recipe(spark)
    inp = r.add_input("in", "corpus", df=lines(["A", "b"]))
    low = r.add_output("out", "low", str(tmp_path / "low"))
    (low,) = r.add_step([inp], [low], lambda x: x.select("line_no", X.lowercase("line").alias("line")))
    up = r.add_output("out", "up", wanted=True)
    r.add_step([low], [up], lambda x: x.withColumn("line", F.upper("line")))
    assert [s.outputs[0].key for s in r.plan()] == ["low", "up"] and [s.status for s in r.status()] == ["available", "waiting"]
    assert [x["line"] for x in r.make()[up].orderBy("line_no").collect()] == ["A", "B"]
    log = R.ExperimentLog(str(tmp_path / "log"))
    r.make([low], log)
    assert [x["event"] for x in log.read(spark).orderBy("time").collect()] == ["started", "finished"]
    assert r.plan([low]) == []
    r.force = True
    assert [s.outputs[0].key for s in R.Recipe.plan(r, [up])] == [] and not r._done(low)  # built ones are not built again
    r.force = False
    with pytest.raises(ValueError, match="twice"):
        r.add_step([inp], [low], lambda x: x)
    a, b = R.Target("c", "a"), R.Target("c", "b")
    r.add_step([a], [b], lambda x: x)
    r.add_step([b], [a], lambda x: x)
    with pytest.raises(ValueError, match="cycle"):
        r.plan([a])
    hand = R.Target("m", "hand")
    r.add_step([inp], [hand], R.manual("look at it"))
    with pytest.raises(R.NotDone, match="look"):
        r.get(hand)


def test_grid_and_config(tmp_path):
    assert len(R.grid({"a:x": ["1", "2", "3"], "b:y": ["p", "q"]})) == 6
    assert [g["a:x"] for g in R.grid({"a:x": ["1", "2", "3", "4"]}, {"a:x": "2"}, 1)] == ["1", "2", "3"]
    (tmp_path / "c.ini").write_text("[a]\nx = 1\ny = ${x}0\n[b]\nz = ${a:y}\n")
    assert R.read_config(str(tmp_path / "c.ini"), overrides={"a:x": "7"})["b"]["z"] == "70"
    assert R.expand_range(["f{i}", "g"], "{i}", 0, 2) == ["f0", "f1", "g"]
    assert R.parse_overrides(R.format_overrides({"a": "b"})) == {"a": "b"}


def test_external(spark, tmp_path, lines):
    (tmp_path / "i").write_text("b\na\n")
    step = R.ExternalStep("sort {argstr} {inp} > {out}", ["inp"], ["out"])
    step.run({"inp": str(tmp_path / "i"), "out": str(tmp_path / "o")}, "-r")
    assert (tmp_path / "o").read_text() == "b\na\n"
    with pytest.raises(ValueError):
        step.command({"inp": "x"})
    with pytest.raises(RuntimeError):
        R.run_command("false")
    assert [x["line"] for x in R.pipe_lines(lines("ab"), "tr a-z A-Z").orderBy("line_no").collect()] == ["A", "B"]
    many = spark.range(30_000, numPartitions=1).selectExpr("id", "concat('x', id) AS line")
    numbered = R.pipe_lines(many, "cat -n").orderBy("id").collect()  # one run for all batches of a partition
    assert [r["line"].split() for r in numbered[:: 29_999]] == [["1", "x0"], ["30000", "x29999"]]
    with pytest.raises(Exception, match="fewer lines"):
        R.pipe_lines(many, "head -n 5").collect()
    with pytest.raises(ValueError, match="nmt_train.command"):
        R.program("nmt_train")
    (tmp_path / "p.ini").write_text("[programs]\nnmt_train.command = my-train\nfast_align = align {inp} > {out}\n")
    conf = R.read_config(str(tmp_path / "p.ini"))
    assert R.program("nmt_train", conf).command({"shards": "s", "model": "m"}, "-x") == "my-train -x s m"
    assert R.program("fast_align", conf).command({"inp": "a", "out": "b"}) == "align a > b"
    scores = spark.createDataFrame([("m1", 2.0), ("m2", 1.0)], "model string, score double")
    assert tuple(R.choose_model(scores).first()) == ("m2", 1.0)


def test_command_line(spark, tmp_path, lines):
    (tmp_path / "c.ini").write_text("[exp]\nn = 1\n")

    def build(session, conf):
        r = R.Recipe(session, conf)
        inp = r.add_input("in", "x", df=lines(["a"] * int(conf["exp"]["n"])))
        r.add_step([inp], [r.add_output("out", "y", wanted=True)], lambda x: x)
        return r

    assert R.main(build, spark, [str(tmp_path / "c.ini"), "--status"]) == ["available out:y"]
    assert R.main(build, spark, [str(tmp_path / "c.ini"), "out:y"]) == ["made out:y"]
    (tmp_path / "d.ini").write_text("[exp]\nn = 0\n")
    assert R.main(build, spark, [str(tmp_path / "c.ini"), "--patch-conf", str(tmp_path / "d.ini"), "--force", "--status"]) == ["available out:y"]
    assert R.Platform().submit_command("r.py", "c.ini", R.Target("a", "b"), patches=["d.ini"], force=True)[-3:] == ["--patch-conf", "d.ini", "--force"]
    assert R.Platform(dry_run=True).schedule(build(spark, R.read_config(str(tmp_path / "c.ini"))), "r.py", "c.ini")[0][-2:] == ["--make", "out:y"]


def test_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A b\nb\n")
    s = stream.apply_cells(stream.stream_lines(spark, str(tmp_path)), {"line": X.lowercase})
    q = stream.running_counts(s).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select word, count from counted").collect()} == {("a", 1), ("b", 2)}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["word", "count"]

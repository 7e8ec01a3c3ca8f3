"""Recipes: named lazy DataFrames and external steps as a graph, with configuration, grids, status and a log.

A recipe declares how each output is made from inputs. Asking for outputs builds only their part of the graph, once for
each step, and leaves the work to Spark; nothing is written unless a target names a path.
"""

from __future__ import annotations

import argparse
import configparser
import datetime
import itertools
import json
import queue
import re
import shlex
import subprocess
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..storage import exists, is_file, matching, modified


class NotDone(Exception):
    """A step can't run: an input is missing, or a person has to do it."""


@dataclass(frozen=True)
class Target:
    """A named dataset. ``path`` is where it is written; ``exact_rows`` and ``allow_empty`` are checked against it."""

    section: str
    key: str
    path: str | None = None
    exact_rows: int | None = None
    allow_empty: bool = False

    def __str__(self) -> str:
        return f"{self.section}:{self.key}"


@dataclass
class Step:
    """Makes outputs from inputs: ``make`` gets the DataFrames in order and returns one, or one for each output."""

    inputs: Sequence[Target]
    outputs: Sequence[Target]
    make: Callable[..., DataFrame | Sequence[DataFrame] | None]
    resource: str = "default"
    external: bool = False


@dataclass
class JobStatus:
    status: str
    outputs: list[str]
    inputs: list[str] = field(default_factory=list)


class Recipe:
    def __init__(self, spark: SparkSession | None = None, config: configparser.ConfigParser | None = None):
        self.spark, self.config = spark or SparkSession.getActiveSession(), config
        self.steps: dict[Target, Step | None] = {}
        self.wanted: list[Target] = []
        self.force = False  # make outputs again that are there
        self._made: dict[Target, DataFrame] = {}

    def add_input(self, section: str, key: str, path: str | None = None, df: DataFrame | None = None) -> Target:
        t = Target(section, key, path)
        self._claim(t, None)
        if df is not None:
            self._made[t] = df
        return t

    def add_output(self, section: str, key: str, path: str | None = None, wanted: bool = False, **checks) -> Target:
        t = Target(section, key, path, **checks)
        if wanted:
            self.wanted.append(t)
        return t

    def use_output(self, section: str, key: str) -> Target:
        return next(t for t in self.steps if (t.section, t.key) == (section, key))

    def add_step(self, inputs: Sequence[Target], outputs: Sequence[Target], make: Callable, **kw) -> Sequence[Target]:
        step = Step(list(inputs), list(outputs), make, **kw)
        for t in outputs:
            self._claim(t, step)
        return outputs

    def _claim(self, t: Target, step: Step | None) -> None:
        if any((x.section, x.key) == (t.section, t.key) for x in self.steps):
            raise ValueError(f"{t} is made twice")
        self.steps[t] = step

    # --- planning ---

    def plan(self, outputs: Sequence[Target] | None = None) -> list[Step]:
        """The steps that the outputs need, inputs first. A cycle or an output without a step is an error."""
        order: list[Step] = []
        state: dict[Target, int] = {}

        def visit(t: Target, path: tuple[Target, ...]) -> None:
            if state.get(t) == 2 or t in self._made:
                return
            if state.get(t) == 1:
                raise ValueError("cycle: " + " -> ".join(map(str, [*path, t])))
            if t not in self.steps:
                raise NotDone(f"no step makes {t}")
            state[t] = 1
            step = self.steps[t]
            if step is not None and not self._done(t):
                for i in step.inputs:
                    visit(i, (*path, t))
                if step not in order:
                    order.append(step)
            state[t] = 2

        for t in outputs if outputs is not None else self.wanted:
            visit(t, ())
        return order

    def _done(self, t: Target) -> bool:
        return not self.force and bool(t.path) and (exists(self.spark, t.path.rstrip("/") + "/_SUCCESS") or is_file(self.spark, t.path))

    def _there(self, t: Target) -> bool:
        return bool(t.path) and exists(self.spark, t.path)

    def status(self, outputs: Sequence[Target] | None = None) -> list[JobStatus]:
        """done, available (all inputs are there) or waiting, for every step and input that the outputs need."""
        out, planned = [], self.plan(outputs)
        pending = {t for s in planned for t in s.outputs}
        for s in planned:
            ready = all(i not in pending and (self.steps[i] is not None or i in self._made or self._there(i)) for i in s.inputs)
            out.append(JobStatus("available" if ready else "waiting", [str(t) for t in s.outputs], [str(i) for i in s.inputs]))
        return out + [JobStatus("done", [str(t)]) for t in (outputs if outputs is not None else self.wanted) if t not in pending]

    def check(self, outputs: Sequence[Target] | None = None) -> list[Target]:
        """Inputs that are not there."""
        need = {i for s in self.plan(outputs) for i in s.inputs if self.steps.get(i) is None and i not in self._made}
        return sorted((t for t in need if not self._there(t)), key=str)

    def time_inversions(self) -> list[tuple[Target, Target]]:
        """(input, output) where the written input is newer than the output."""
        when = lambda t: modified(self.spark, t.path) if t.path else None
        pairs = [(i, o) for s in {id(s): s for s in self.steps.values() if s}.values() for i in s.inputs for o in s.outputs]
        return [(i, o) for i, o in pairs if when(i) and when(o) and when(i) > when(o)]

    # --- building ---

    def get(self, t: Target) -> DataFrame:
        """The DataFrame of a target, still lazy unless it was written."""
        if t in self._made:
            return self._made[t]
        step = self.steps.get(t)
        if step is None or self._done(t):
            if not self._there(t):
                raise NotDone(f"missing: {t}")
            self._made[t] = self._load(t)
            return self._made[t]
        got = step.make(*[self.get(i) for i in step.inputs])
        results = [got] if isinstance(got, DataFrame) else list(got or [])
        if not results and step.external:
            return self._made.setdefault(t, self._load(t))
        if len(results) != len(step.outputs):
            raise ValueError(f"{len(results)} results for {len(step.outputs)} outputs")
        self._made.update(zip(step.outputs, results))
        return self._made[t]

    def _load(self, t: Target) -> DataFrame:
        from ..sources.files import read_lines

        parquet = t.path.endswith(".parquet") or bool(matching(self.spark, t.path.rstrip("/") + "/*.parquet"))
        return self.spark.read.parquet(t.path) if parquet else read_lines(self.spark, t.path)

    def make(self, outputs: Sequence[Target] | None = None, log: ExperimentLog | None = None) -> dict[Target, DataFrame]:
        """Builds outputs; those with a path are written as Parquet and checked."""
        out = {}
        for t in outputs if outputs is not None else self.wanted:
            if log:
                log.write("started", str(t))
            df = self.get(t)
            if t.path and not self._done(t):
                df.write.mode("overwrite").parquet(t.path)
                df = self.spark.read.parquet(t.path)
                if t.exact_rows is not None and df.count() != t.exact_rows:
                    raise ValueError(f"{t} has not {t.exact_rows} rows")
                if not t.allow_empty and df.isEmpty():
                    raise ValueError(f"{t} is empty")
                self._made[t] = df
            out[t] = df
            if log:
                log.write("finished", str(t))
        return out


def manual(message: str) -> Callable[..., DataFrame]:
    """A step that a person has to do."""

    def make(*_: DataFrame) -> DataFrame:
        raise NotDone(message)

    return make


def rows_of_parameters(df: DataFrame, parameters: Mapping[str, object], column: str = "line") -> DataFrame:
    """The lines, and a row for each parameter behind them."""
    extra = df.sparkSession.createDataFrame([(f"{k}: {v}",) for k, v in parameters.items()], f"{column} string")
    return df.select(column).unionByName(extra)


# --- external programs ------------------------------------------------------------------------------------------------


@dataclass
class Response:
    code: int
    out: str
    err: str


def run_command(command: str | Sequence[str], allow_fail: bool = False, shell: bool = False) -> Response:
    done = subprocess.run(command if shell else shlex.split(command) if isinstance(command, str) else list(command), shell=shell, capture_output=True, text=True)
    if done.returncode and not allow_fail:
        raise RuntimeError(f"{command}: exit {done.returncode}: {done.stderr[-500:]}")
    return Response(done.returncode, done.stdout, done.stderr)


@dataclass
class ExternalStep:
    """A command template with named inputs and outputs and ``{argstr}``; ``autolog`` keeps its output in a file."""

    template: str
    inputs: Sequence[str]
    outputs: Sequence[str]
    autolog: str | None = None

    def command(self, paths: Mapping[str, str], argstr: str = "") -> str:
        if missing := [n for n in (*self.inputs, *self.outputs) if n not in paths]:
            raise ValueError(f"no path for {missing}")
        return self.template.format(argstr=argstr, **{n: shlex.quote(p) for n, p in paths.items()}).strip()

    def run(self, paths: Mapping[str, str], argstr: str = "") -> Response:
        got = run_command(self.command(paths, argstr), shell=True)
        if self.autolog:
            with open(self.autolog, "a", encoding="utf-8") as f:
                f.write(got.out)
        return got


def pipe_lines(df: DataFrame, command: str, column: str = "line") -> DataFrame:
    """Streams each partition through one run of a program that gives a line for a line."""
    from collections.abc import Iterator

    import pyarrow as pa

    others = [c for c in df.columns if c != column]
    schema = df.select(*others, column).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        # A program may hold lines back, so batches go in by a thread of their own, a bounded number ahead.
        sent: queue.Queue = queue.Queue(64)

        def feed() -> None:
            try:
                for batch in batches:
                    text = [x or "" for x in batch.column(len(others)).to_pylist()]
                    if any("\n" in x for x in text):
                        raise ValueError("a line has a newline")
                    sent.put(batch)
                    program.stdin.write("".join(x + "\n" for x in text).encode())
                program.stdin.close()
                sent.put(None)
            except Exception as e:  # given to the reader, which raises it
                program.kill()
                sent.put(e)

        threading.Thread(target=feed, daemon=True).start()
        while (batch := sent.get()) is not None:
            if isinstance(batch, Exception):
                raise batch
            done = [program.stdout.readline() for _ in range(len(batch))]
            if not all(x.endswith(b"\n") for x in done):
                raise ValueError(f"{command}: fewer lines out than in")
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], pa.array([x[:-1].decode() for x in done], pa.string())], names=[*others, column])
        if program.stdout.read() or program.wait():
            raise ValueError(f"{command}: more lines out than in, or exit {program.returncode}")

    return df.select(*others, column).mapInArrow(run, schema)


def _external(template: str, inputs: str, outputs: str) -> ExternalStep:
    return ExternalStep(template, inputs.split(), outputs.split())


#: Programs of a translation workflow. They are only called, and have to be installed. ``{command}`` is a site's own program,
#: which the configuration names: see ``program``.
PROGRAMS: dict[str, ExternalStep] = {
    "moses_tokenize": _external("tokenizer.perl {argstr} < {inp} > {out}", "inp", "out"),
    "train_morfessor": _external("morfessor-train {argstr} -s {model} -x {lexicon} --save-parameters {params} {inp}", "inp", "model params lexicon"),
    "train_morfessor_simple": _external("morfessor-train {argstr} -S {model} {inp}", "inp", "model"),
    "train_morfessor_semisup": _external("morfessor-train {argstr} -A {annots} -D {dev} -s {model} -x {lexicon} --save-parameters {params} {inp}", "inp annots dev", "model params lexicon"),
    "train_flatcat": _external("flatcat-train {argstr} {inp} -s {model}", "inp", "model"),
    "train_flatcat_semisup": _external("flatcat-train {argstr} {inp} -A {annots} -s {model}", "inp annots", "model"),
    "train_flatcat_autotune": _external("flatcat-train {argstr} {inp} --load-parameters {params} -s {model}", "inp params", "model"),
    "apply_morfessor": _external("morfessor-segment {argstr} -l {model} {inp} -o {out}", "inp model", "out"),
    "apply_flatcat": _external("flatcat-segment {argstr} {model} {inp} -o {out}", "inp model", "out"),
    "finnpos": _external("ftb-label < {inp} > {out}", "inp", "out"),
    "word2vec_cluster": _external("word2vec -train {inp} -output {out} {argstr}", "inp", "out"),
    "fast_align": _external("fast_align {argstr} -i {inp} > {out}", "inp", "out"),
    "symmetrize": _external("atools {argstr} -i {fwd} -j {rev} > {out}", "fwd rev", "out"),
    "train_lmclean": _external("{command} {argstr} {train} {dev} {model}", "train dev", "model"),
    "eval_lmclean": _external("{command} {argstr} {model} {test} > {scores}", "model test", "scores"),
    "score_lmclean": _external("{command} {argstr} {model} {test} > {scores}", "model test", "scores"),
    "nmt_vocabularies": _external("{command} {argstr} {src} {trg} > {vocab}", "src trg", "vocab"),
    "nmt_prepare": _external("{command} {argstr} {src} {trg} {vocab} {shards}", "src trg vocab", "shards"),
    "nmt_train": _external("{command} {argstr} {shards} {model}", "shards", "model"),
    "nmt_train_short": _external("{command} {argstr} --from {prev} {shards} {model}", "shards prev", "model"),
    "nmt_translate": _external("{command} {argstr} {model} < {inp} > {out}", "model inp", "out"),
    "nmt_translate_latent": _external("{command} {argstr} {model} --latent {latent} < {inp} > {out}", "model inp", "out latent"),
    "nmt_translate_ensemble": _external("{command} {argstr} {models} < {inp} > {out}", "models inp", "out"),
}


def program(name: str, config: configparser.ConfigParser | None = None) -> ExternalStep:
    """The step of a program. Section ``programs`` of the configuration may have another template for it, or ``name.command``,
    which is needed where the template has a ``{command}``."""
    known, section = PROGRAMS[name], config["programs"] if config is not None and config.has_section("programs") else {}
    template = section.get(name, known.template)
    if "{command}" in template:
        if f"{name}.command" not in section:
            raise ValueError(f"set {name}.command in section programs of the configuration")
        template = template.replace("{command}", section[f"{name}.command"])
    return ExternalStep(template, known.inputs, known.outputs, known.autolog)


# --- configuration, grids, log ----------------------------------------------------------------------------------------


def read_config(*paths: str, overrides: Mapping[str, str] | None = None) -> configparser.ConfigParser:
    """INI files with ``${section:key}`` interpolation, later ones first in rank; overrides are ``section:key`` to value."""
    between = configparser.ExtendedInterpolation()
    conf = configparser.ConfigParser(interpolation=between)
    conf.optionxform = str
    conf.read(paths, encoding="utf-8")
    for k, v in (overrides or {}).items():
        section, _, key = k.partition(":")
        if not conf.has_section(section):
            conf.add_section(section)
        conf.set(section, key, v)
    return conf


def expand_range(lines: Sequence[str], pattern: str, start: int, end: int) -> list[str]:
    """Lines with the pattern once for every number of [start, end); the others as they are."""
    return [x for line in lines for x in ([line.replace(pattern, str(i)) for i in range(start, end)] if pattern in line else [line])]


def grid(values: Mapping[str, Sequence[str]], center: Mapping[str, str] | None = None, window: int | None = None) -> list[dict[str, str]]:
    """The cartesian product of values; with a centre only values at most ``window`` places from it."""
    near = {}
    for k, vs in values.items():
        vs = list(vs)
        if center and window is not None and k in center:
            at = vs.index(center[k])
            vs = vs[max(0, at - window) : at + window + 1]
        near[k] = vs
    return [dict(zip(near, x)) for x in itertools.product(*near.values())]


def format_overrides(overrides: Mapping[str, str]) -> str:
    return json.dumps(dict(overrides), sort_keys=True)


def parse_overrides(text: str) -> dict[str, str]:
    return json.loads(text) if text else {}


def choose_model(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """(model, score) of the lowest score; ties by name."""
    from pyspark.sql import functions as F

    return scores.agg(F.min_by(model, F.struct(score, model)).alias(model), F.min(score).alias(score))


class ExperimentLog:
    """An append-only log of job events as JSON lines, read back as a table of the last days."""

    SCHEMA = "time timestamp, event string, target string, detail string"

    def __init__(self, path: str, history_days: int = 15):
        self.path, self.days = path, history_days

    def write(self, event: str, target: str, detail: str = "") -> None:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"time": now, "event": event, "target": target, "detail": detail}) + "\n")

    def read(self, spark: SparkSession) -> DataFrame:
        from pyspark.sql import functions as F

        return spark.read.schema(self.SCHEMA).json(self.path).where(F.col("time") >= F.current_timestamp() - F.expr(f"INTERVAL {self.days} DAYS"))


@dataclass
class Platform:
    """Where a recipe's steps run: at once, or as ``spark-submit`` commands that are returned (or only printed)."""

    name: str = "local"
    master: str = "local[*]"
    dry_run: bool = False

    def submit_command(self, script: str, conf: str, target: Target, overrides: Mapping[str, str] | None = None, patches: Sequence[str] = (), force: bool = False) -> list[str]:
        """The command of one output, to which all that changes the plan is passed on."""
        extra = [x for p in patches for x in ("--patch-conf", p)] + ["--force"] * force
        extra += ["--overrides", format_overrides(overrides)] if overrides else []
        return ["spark-submit", "--master", self.master, script, conf, "--make", str(target), *extra]

    def schedule(self, recipe: Recipe, script: str, conf: str, outputs: Sequence[Target] | None = None, overrides: Mapping[str, str] | None = None) -> list[list[str]]:
        """A command for each wanted output, dependencies being part of its plan."""
        commands = [self.submit_command(script, conf, t, overrides) for t in (outputs if outputs is not None else recipe.wanted)]
        if not self.dry_run:
            for c in commands:
                run_command(c)
        return commands


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Plans and runs a recipe.")
    p.add_argument("conf")
    p.add_argument("outputs", nargs="*", help="section:key; all wanted outputs if none is named")
    p.add_argument("--make", help="build one output")
    p.add_argument("--force", action="store_true", help="build outputs again that are there")
    p.add_argument("--patch-conf", action="append", default=[], help="a further configuration, which wins over conf")
    p.add_argument("--check", action="store_true", help="report missing inputs")
    p.add_argument("--status", action="store_true")
    p.add_argument("--mtimes", action="store_true", help="report outputs older than their inputs")
    p.add_argument("--overrides", type=parse_overrides, default={})
    p.add_argument("--grid", help="JSON file of section:key to values")
    p.add_argument("--dryrun", action="store_true")
    p.add_argument("--log")
    return p


def main(build: Callable[[SparkSession, configparser.ConfigParser], Recipe], spark: SparkSession, argv: Sequence[str]) -> list[str]:
    """The command line of a recipe script, whose ``build`` declares the steps; returns what was reported."""
    args = parser().parse_args(argv)
    points = [args.overrides]
    if args.grid:
        with open(args.grid, encoding="utf-8") as f:
            points = [{**args.overrides, **g} for g in grid(json.load(f))]
    said: list[str] = []
    for overrides in points:
        recipe = build(spark, read_config(args.conf, *args.patch_conf, overrides=overrides))
        recipe.force = args.force
        names = [args.make] if args.make else args.outputs
        outputs = [recipe.use_output(*re.split(":", n, maxsplit=1)) for n in names] or None
        if args.check:
            said += [f"missing {t}" for t in recipe.check(outputs)]
        elif args.mtimes:
            said += [f"{i} is newer than {o}" for i, o in recipe.time_inversions()]
        elif args.status or args.dryrun:
            said += [f"{s.status} {' '.join(s.outputs)}" for s in recipe.status(outputs)]
        else:
            said += [f"made {t}" for t in recipe.make(outputs, ExperimentLog(args.log) if args.log else None)]
    return said

"""Tasks, attempts and what is learned from them, as append-only tables and queries over them.

Tasks, attempts, evaluations and playbook versions are Parquet folders that only grow; ratings, generator dials, the
board of tasks and the summaries of bench runs are relations derived from them.
"""

from __future__ import annotations

import json
import subprocess
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlume import evals
from sqlume.generators import Task, generate
from sqlume.operators.fixpoint import shared_dir
from sqlume.output import shown, to_json

TABLES = {
    "tasks": "id string, kind string, generator string, source string, dial double, difficulty double, task string, context string, verify string, created_at double",
    "attempts": "task string, run string, solver string, solved boolean, detail string, calls long, dollars double, depth int, playbook_version int, seq long, recorded_at double",
    "evals": "run string, pack string, mode string, seq int, task string, kind string, solved boolean, detail string, calls long, tokens long, dollars double, depth int, turns int, wall_ms long, recorded_at double, model string",
    "playbook": "version int, kind string, sql string, adopted boolean, learned_from string, eval_note string, created_at double",
    "playbook_evals": "run_at double, kind string, candidate int, baseline_solved int, candidate_solved int, total int, baseline_dollars double, candidate_dollars double, adopted boolean",
}
REPLAY_SAMPLE = 5


# oracles by their specification


@dataclass(frozen=True)
class Verdict:
    passed: bool
    detail: str


def cells(answer: DataFrame) -> list[list[str]]:
    """The rows of an answer as text. Answers are small: they are read by the driver."""
    return [[shown(v) for v in r] for r in answer.toLocalIterator()]


def _norm(text: str) -> object:
    text = text.strip()
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return text.lower()


def verify(spec: dict, answer: DataFrame, workspace: str | None = None, judge: Callable[[str], str] | None = None, person: Callable[[str], bool] | None = None) -> Verdict:
    """Judge an answer by a specification: kind is exact, number, sat, shell, judge, oolong, redline or human."""
    kind, rows = spec["kind"], cells(answer)
    first = rows[0][0] if rows and rows[0] else ""
    if kind == "exact":
        bag = lambda rs: sorted(([_norm(c) for c in r] for r in rs), key=repr)
        want, got = bag([[str(c) for c in r] for r in spec["rows"]]), bag(rows)
        return Verdict(want == got, "the rows are as expected" if want == got else f"expected {len(want)} rows, {sum(r in want for r in got)} of {len(got)} are among them")
    if kind == "number":
        digits = "".join(c for c in first if c.isdigit() or c in ".-")
        ok = evals.number(digits, spec["value"], spec.get("tolerance", 0.0))
        return Verdict(ok, f"expected {spec['value']}, got {first or 'nothing'}")
    if kind == "sat":
        said = {c.strip().upper() for r in rows for c in r}
        if not spec["satisfiable"]:
            return Verdict("UNSAT" in said, "there is no assignment")
        values = {int(r[0].strip().lstrip("xX")): r[1].strip().lower() in ("1", "true", "t") for r in rows if len(r) > 1 and r[0].strip().lstrip("xX").isdigit()}
        ok = len(values) == spec["vars"] and evals.satisfies(spec["clauses"], values)
        return Verdict(ok, "the assignment holds" if ok else "the assignment is not complete or breaks a clause")
    if kind == "shell":
        done = subprocess.run(["sh", "-c", spec["command"]], input=to_json(answer), cwd=workspace, capture_output=True, text=True, timeout=600, check=False)
        return Verdict(done.returncode == 0, (done.stdout + done.stderr).strip()[-500:] or f"exit status {done.returncode}")
    if kind == "oolong":
        if spec.get("numeric"):
            digits = "".join(c for c in first if c.isdigit() or c in ".-")
            score = evals.counting(float(digits), float(spec["answer"][0])) if digits.strip(".-") else 0.0
        else:
            strip = lambda t: t.strip().rpartition(":")[2].strip().strip("'\"").lower()
            got = [strip(r[0]) for r in rows if r and r[0].strip()]
            got = [strip(x) for x in first.split(",")] if len(got) == 1 and len(spec["answer"]) > 1 else got
            want = {str(a).strip().lower() for a in spec["answer"]}
            score = float(bool(got) and set(got) <= want)
        return Verdict(score >= 1 - 1e-9, f"oolong score {score:.3f}")
    if kind == "redline":
        at = next((i for i, c in enumerate(answer.columns) if c.lower() in ("redline", "redlined", "redlined_clause", "clause", "revised", "revision")), 0)
        text = rows[0][at] if rows else ""
        words = lambda t: {w for w in "".join(c if c.isalnum() or c == "'" else " " for c in t.lower()).split() if len(w) >= 4}
        new = words(spec["redline"]) - words(spec["original"])
        recall = len(new & words(text)) / len(new) if new else 1.0
        if judge is not None:
            return _judged(judge, f"Clause: {spec['original']}\nReference: {spec['redline']}\nWhy: {spec.get('rationale', '')}\nChanges: {'; '.join(spec.get('changes', []))}\nRevision: {text}", recall)
        return Verdict(recall >= 0.5, f"redline recall {recall:.3f}")
    if kind == "judge":
        if judge is None:
            return Verdict(False, "no judge is given")
        return _judged(judge, f"Rubric: {spec['rubric']}\nReference: {spec.get('reference') or 'none'}\nAnswer: {json.dumps(rows, ensure_ascii=False)}", None)
    if kind == "human":
        return Verdict(False, "needs_review") if person is None else Verdict(bool(person(json.dumps(rows, ensure_ascii=False))), "a person decided")
    raise ValueError(f"there is no oracle {kind}")


def _judged(judge: Callable[[str], str], prompt: str, recall: float | None) -> Verdict:
    said = judge(prompt + "\nAnswer PASS or FAIL, then why.").strip()
    return Verdict(said.upper().startswith("PASS"), said[:500] + ("" if recall is None else f" (redline recall {recall:.3f})"))


# the tables


class Learn:
    """Tasks, attempts and playbooks in a folder; several may share it."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/learn-{uuid.uuid4().hex}"
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def add(self, name: str, rows: list[dict]) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def add_tasks(self, tasks: list[Task], source: str = "generated") -> list[str]:
        ids = [f"{t.generator}-{uuid.uuid4().hex[:8]}" for t in tasks]
        self.add("tasks", [{"id": i, "kind": t.kind, "generator": t.generator, "source": source, "dial": t.dial, "difficulty": t.difficulty, "task": t.task, "context": t.context, "verify": json.dumps(t.verify), "created_at": time.time()} for i, t in zip(ids, tasks)])
        return ids

    def propose(self, generator: str, seed: int, workspace: str | None = None) -> str:
        """A task at the generator's dial."""
        dial = {r["generator"]: r["dial"] for r in self.generator_state().collect()}.get(generator, 0.3)
        return self.add_tasks([generate(generator, dial, seed, workspace)])[0]

    def attempt(self, task: str, solver: str, verdict: Verdict, run: str = "", calls: int = 0, dollars: float = 0.0, depth: int = 0, version: int | None = None) -> None:
        seq = time.time_ns()
        self.add("attempts", [{"task": task, "run": run, "solver": solver, "solved": verdict.passed, "detail": verdict.detail, "calls": calls, "dollars": dollars, "depth": depth, "playbook_version": version, "seq": seq, "recorded_at": seq / 1e9}])

    # relations derived from them

    def board(self) -> DataFrame:
        """Tasks with their status, attempts and last attempt."""
        return evals.board(self.table("tasks"), self.table("attempts"))

    def trace_tasks(self) -> DataFrame:
        return evals.trace_tasks(self.table("tasks"), self.table("attempts"))

    def ratings(self) -> DataFrame:
        return evals.ratings(self.table("attempts"))

    def solver_ratings(self) -> DataFrame:
        own = self.table("attempts").groupBy("solver").agg(F.sum(F.col("solved").cast("int")).alias("solved"), F.sum("dollars").alias("dollars"))
        return self.ratings().where("kind = 'solver'").select(F.col("name").alias("solver"), "rating", F.col("attempts").alias("games")).join(own, "solver")

    def generator_state(self) -> DataFrame:
        own = self.table("tasks").select(F.col("id").alias("task"), "generator")
        return evals.generator_state(self.table("attempts").join(own, "task"))

    def bench_runs(self) -> DataFrame:
        return evals.bench_runs(self.table("evals"))

    # the playbook

    def playbook(self, kind: str) -> tuple[int, str] | None:
        """The version and script of a kind of tasks that was adopted last."""
        r = self.table("playbook").where((F.col("kind") == kind) & F.col("adopted")).orderBy(F.desc("version")).first()
        return (r["version"], r["sql"]) if r else None

    def consider(self, kind: str, sql: str, replay: Callable[[str, str | None], tuple[bool, float]], learned_from: str = "", sample: int = REPLAY_SAMPLE) -> bool:
        """Adopt a script if, replayed on the last tasks of its kind, it solves as many as the one in use and costs no more.

        replay(task, script or None) carries a task out and says whether it was solved and what it cost.
        """
        last = self.table("attempts").join(self.table("tasks").where(F.col("kind") == kind).select(F.col("id").alias("task")), "task").groupBy("task").agg(F.max("seq").alias("seq"))
        tasks = [r["task"] for r in last.orderBy(F.desc("seq")).limit(sample).collect()]
        used = self.playbook(kind)
        base, own = [replay(t, used[1] if used else None) for t in tasks], [replay(t, sql) for t in tasks]
        adopted = bool(tasks) and evals.adopt(own, base)
        version = (self.table("playbook").agg(F.max("version")).first()[0] or 0) + 1
        now = time.time()
        self.add("playbook", [{"version": version, "kind": kind, "sql": sql, "adopted": adopted, "learned_from": learned_from, "eval_note": f"{sum(s for s, _ in own)} of {len(own)} solved, {sum(s for s, _ in base)} before", "created_at": now}])
        self.add("playbook_evals", [{"run_at": now, "kind": kind, "candidate": version, "baseline_solved": sum(s for s, _ in base), "candidate_solved": sum(s for s, _ in own), "total": len(tasks), "baseline_dollars": float(sum(c for _, c in base)), "candidate_dollars": float(sum(c for _, c in own)), "adopted": adopted}])
        return adopted

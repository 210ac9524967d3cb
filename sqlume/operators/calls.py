"""The call operator: distinct arguments, memo, budget, batches, and the answers joined back.

Calls are made on the driver over an iterator of the distinct argument rows, at most ``concurrency`` at a time, and
each answer is made once: answers become a relation (in the shared folder beyond a bound) before anything reads them,
so no re-run of a Spark task repeats a call.

Where the provider says that it is ``portable``, the executors make the calls instead, each for a range of the
argument rows, so that nothing passes through the driver. Their number is known and reserved before any is made; answers, and the memo
of answers by function and arguments, are tables in the shared folder. A task that is lost is asked again.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.calls.budget import Budget
from sqlume.calls.providers import Reply, fingerprint
from sqlume.catalog import FunctionDef
from sqlume.errors import SqlError
from sqlume.functions.builtins import spark_type
from sqlume.operators.fixpoint import keep

FLUSH = 50_000


def template_prompt(f: FunctionDef, args: dict) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: str(args[m[1]]) if m[1] in args else m[0], f.body)


def batch_prompt(f: FunctionDef, items: list[dict]) -> str:
    """One prompt for several argument tuples; also used for one."""
    listed = json.dumps([{"item": i + 1, "args": a} for i, a in enumerate(items)], ensure_ascii=False)
    return (f"function: {f.name}\n{f.body}\nAnswer the template for every item with a {f.returns} value, as JSON "
            f'{{"answers": [{{"item": 1, "answer": ...}}]}}.\nitems: {listed}')


def coerce(value: object, kind: str) -> object:
    """A reply's value as a type of the dialect; ValueError where it does not fit."""
    if value is None:
        return None
    if kind == "BOOLEAN":
        if isinstance(value, bool):
            return value
        text = str(value).strip().lower()
        if re.match(r"(yes|true)\b", text):
            return True
        if re.match(r"(no|false)\b", text):
            return False
        raise ValueError(f"not a truth value: {value!r}")
    if kind == "BIGINT":
        if isinstance(value, bool) or float(value) != int(float(value)):
            raise ValueError(f"not an integer: {value!r}")
        return int(float(value)) if not isinstance(value, int) else value
    if kind == "DOUBLE":
        if isinstance(value, bool):
            raise ValueError(f"not a number: {value!r}")
        return float(value)
    if kind == "JSON":
        return json.dumps(json.loads(value) if isinstance(value, str) else value, separators=(",", ":"), ensure_ascii=False)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def parse_json(text: str) -> object:
    """The JSON in a reply, also inside a fence or after words."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    try:
        return json.loads(text)
    except ValueError:
        m = re.search(r"[\[{].*[\]}]", text, re.S)
        if m:
            return json.loads(m[0])
        raise


def parse_bool(text: str) -> bool:
    try:
        v = parse_json(text)
    except ValueError:
        v = text
    if isinstance(v, dict) and "answer" in v:
        v = v["answer"]
    out = coerce(v, "BOOLEAN")
    if out is None:
        raise ValueError("no answer")
    return bool(out)


def parse_items(text: str, n: int) -> list[str]:
    """Items of an expansion: a JSON array, the first array in an object, or bulleted lines; at most n."""
    try:
        v = parse_json(text)
    except ValueError:
        v = [re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip() for line in text.splitlines()]
        v = [x for x in v if x]
    if isinstance(v, dict):
        v = next((x for x in v.values() if isinstance(x, list)), [json.dumps(v)])
    if not isinstance(v, list):
        v = [v]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in v[: max(0, n)]]


class Caller:
    """Makes calls for a session: memo first, then the budget, then the provider; every call is traced."""

    def __init__(self, provider, budget, memo: dict[str, str], trace: list[dict], concurrency: int = 8) -> None:
        self.provider, self.budget, self.memo, self.trace, self.concurrency = provider, budget, memo, trace, concurrency
        self.use_memo = True
        self.answers = AnswerMemo()

    def ask(self, alias: str, prompt: str, name: str = "llm", valid=None) -> str:
        """One reply, from the memo where it has one. Replies that do not parse are not remembered."""
        key = fingerprint(alias, prompt)
        if self.use_memo and key in self.memo:
            self.trace.append({"function": name, "alias": alias, "fingerprint": key, "memo": True, "ok": True, "input_tokens": 0, "output_tokens": 0, "dollars": 0.0, "ms": 0})
            return self.memo[key]
        if self.provider is None:
            raise SqlError(f"{name} needs a provider; give the session one")
        self.budget.reserve(1)
        began = time.time()
        try:
            reply: Reply = self.provider.complete(alias, prompt)
        except Exception:
            self.trace.append({"function": name, "alias": alias, "fingerprint": key, "memo": False, "ok": False, "input_tokens": 0, "output_tokens": 0, "dollars": 0.0, "ms": int(1000 * (time.time() - began))})
            raise
        self.budget.settle(0, reply.input_tokens + reply.output_tokens, reply.dollars)
        self.trace.append({"function": name, "alias": alias, "fingerprint": key, "memo": False, "ok": True, "input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens, "dollars": reply.dollars, "ms": int(1000 * (time.time() - began))})
        if valid is None or valid(reply.text):
            self.memo[key] = reply.text
        return reply.text

    def scalar(self, f: FunctionDef, tuples: list[tuple]) -> list[object]:
        """Answers for argument tuples without nulls."""
        if f.form == "builtin":
            with ThreadPoolExecutor(self.concurrency) as pool:
                return list(pool.map(lambda t: self._builtin(f, t), tuples))
        names = [n for n, _ in f.args]
        groups = [tuples[i : i + f.batch] for i in range(0, len(tuples), f.batch)]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return [a for g in pool.map(lambda g: self._batch(f, names, g), groups) for a in g]

    def _builtin(self, f: FunctionDef, t: tuple) -> object:
        if f.name == "llm":
            return self.ask(t[1] if len(t) > 1 else "worker", t[0] + (f"\n[effort: {t[2]}]" if len(t) > 2 else ""), "llm")
        if f.name == "llm_bool":
            prompt = t[0] + '\nAnswer with JSON {"answer": true} or {"answer": false}.'
            text = self.ask("worker", prompt, f.name, lambda x: _ok(parse_bool, x))
            return parse_bool(text)
        schema = json.loads(t[1])
        prompt = f"{t[0]}\nAnswer with JSON of this schema: {json.dumps(schema)}"
        text = self.ask("worker", prompt, f.name, lambda x: _ok(parse_json, x))
        return json.dumps(parse_json(text), separators=(",", ":"), ensure_ascii=False)

    def _batch(self, f: FunctionDef, names: list[str], group: list[tuple]) -> list[object]:
        """One prompt for the group; what is missing or mistyped is asked once more together, then one by one."""
        out: dict[int, object] = {}
        left = list(range(len(group)))
        for attempt in range(2):
            if not left:
                break
            out.update(self._round(f, names, group, left))
            left = [i for i in left if i not in out]
            if len(group) == 1:
                break
        for i in left:
            got = self._round(f, names, group, [i]) if len(group) > 1 else {}
            if i not in got:
                raise SqlError(f"{f.name} got no usable answer for {group[i]!r}")
            out.update(got)
        return [out[i] for i in range(len(group))]

    def _round(self, f: FunctionDef, names: list[str], group: list[tuple], left: list[int]) -> dict[int, object]:
        prompt = batch_prompt(f, [dict(zip(names, group[i])) for i in left])
        text = self.ask(f.alias, prompt, f.name, lambda x: _ok(parse_json, x))
        out: dict[int, object] = {}
        try:
            answers = parse_json(text)
            answers = answers["answers"] if isinstance(answers, dict) else answers
        except (ValueError, KeyError):
            if len(left) == 1 and f.returns != "JSON":
                answers = [{"item": 1, "answer": text.strip()}]
            else:
                return out
        for a in answers if isinstance(answers, list) else []:
            try:
                k = int(a["item"])
                if 1 <= k <= len(left) and a["answer"] is not None:
                    out[left[k - 1]] = coerce(a["answer"], f.returns)
            except (TypeError, ValueError, KeyError):
                continue
        return out


def _ok(parse, text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


class AnswerMemo:
    """Answers of portable calls by function and arguments, as Parquet folders; one for each statement that made some."""

    def __init__(self) -> None:
        self.parts: dict[str, list[DataFrame]] = {}

    def known(self, key: str) -> DataFrame | None:
        out = None
        for p in self.parts.get(key, []):
            out = p if out is None else out.unionByName(p)
        return out


def _portable_answers(spark, need: DataFrame, f: FunctionDef, caller: Caller) -> DataFrame:
    """The answers made by executors: known ones joined, the rest asked in ranges of arguments, all of them kept."""
    args = need.columns
    key = fingerprint(f.alias, json.dumps([f.name, f.body, f.returns, [n for n, _ in f.args]]))
    known = caller.answers.known(key) if caller.use_memo else None
    need = keep(need, "need")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in args]
    rest = need if known is None else keep(need.alias("n").join(known.alias("k"), same, "left_anti"), "rest")
    left = rest.count()
    done = need.limit(0).withColumn("r", F.lit(None).cast(spark_type(f.returns)))
    if left:
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left // (4 * f.batch))))
        most = -(-left // f.batch) + parts  # each range may end in a batch that isn't full
        caller.budget.reserve(most)
        schema = ", ".join([*(f"{c} {t}" for c, t in rest.dtypes), f"r {spark_type(f.returns)}", "trace string"])
        provider, concurrency, step = caller.provider, caller.concurrency, f.batch * caller.concurrency

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = [tuple(None if v is pd.NA else v.item() if hasattr(v, "item") else v for v in t) for t in frame.itertuples(index=False)]
                for i in range(0, len(rows), step):
                    own = Caller(provider, Budget(), {}, [], concurrency)
                    got = own.scalar(f, rows[i : i + step])
                    out = pd.DataFrame([(*t, a) for t, a in zip(rows[i : i + step], got)], columns=[*args, "r"], dtype=object)
                    out["trace"] = [json.dumps(own.trace), *[None] * (len(got) - 1)]
                    yield out

        asked = keep(rest.repartitionByRange(parts, *args).sortWithinPartitions(*args).mapInPandas(run, schema), "answers")
        element = "array<struct<function:string,alias:string,fingerprint:string,memo:boolean,ok:boolean,input_tokens:bigint,output_tokens:bigint,dollars:double,ms:bigint>>"
        made = asked.where("trace is not null").select(F.explode(F.from_json("trace", element)).alias("t")).select("t.*")
        calls, tokens, dollars = made.agg(F.count("*"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)), F.coalesce(F.sum("dollars"), F.lit(0.0))).first()
        caller.budget.settle(most - calls, tokens, dollars)
        if hasattr(caller.trace, "frames"):
            caller.trace.frames.append(made)
        done = asked.drop("trace")
        caller.answers.parts.setdefault(key, []).append(done)
    if known is not None:
        old = need.alias("n").join(known.alias("k"), same).select(*[F.col(f"n.{c}") for c in args], F.col("k.r"))
        done = done.unionByName(old)
    return done


def answers(spark, need: DataFrame, f: FunctionDef, caller: Caller) -> DataFrame:
    """need's distinct argument rows (a0, a1, ...) with their answer (r)."""
    if getattr(caller.provider, "portable", False) and need.columns and f.args:
        return _portable_answers(spark, need, f, caller)
    size = max(1, f.batch) * max(1, caller.concurrency) * 4
    schema = ", ".join([*(f"a{i} {spark_type(t)}" for i, (_, t) in enumerate(f.args[: len(need.columns)])), f"r {spark_type(f.returns)}"])
    done: list[tuple] = []
    parts: list[DataFrame] = []

    def chunks() -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        for r in need.toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == size:
                yield rows
                rows = []
        if rows:
            yield rows

    for rows in chunks():
        done += [(*t, a) for t, a in zip(rows, caller.scalar(f, rows))]
        if len(done) >= FLUSH:
            parts.append(keep(spark.createDataFrame(done, schema), "answers"))
            done = []
    out = spark.createDataFrame(done, schema)
    for p in parts:
        out = out.union(p)
    return out

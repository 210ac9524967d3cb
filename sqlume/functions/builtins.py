"""The scalar functions of the dialect: their types, and the Spark SQL that computes them.

All count characters; a null argument gives null unless noted. Each entry has the least and most arguments, the
result type (a type, or a function of the argument types) and a builder from argument SQL and types to SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from sqlume.errors import SqlError

SPACE = r"[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


@dataclass(frozen=True)
class Builtin:
    least: int
    most: int
    returns: str | Callable[[list[str]], str]
    sql: Callable[[list[str], list[str]], str]
    takes: tuple[str, ...] = ()  # types by position; "" takes any, the last one repeats


def string(value: str) -> str:
    """A Spark SQL string literal."""
    out = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0").replace("\x1a", "\\Z")
    return f"'{out}'"


def render(x: str, kind: str) -> str:
    """Any value as text: doubles without exponent and without .0."""
    if kind == "DOUBLE":
        plain = f"CAST({x} AS STRING)"
        return (
            f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS STRING) WHEN isnan({x}) THEN 'NaN' WHEN abs({x}) = double('inf') THEN IF({x} > 0, 'inf', '-inf') "
            f"WHEN {x} = floor({x}) AND abs({x}) < 9e18 THEN CAST(CAST({x} AS BIGINT) AS STRING) "
            f"WHEN abs({x}) >= 1e-3 AND abs({x}) < 1e7 THEN {plain} "
            f"WHEN abs({x}) >= 9e15 THEN coalesce(CAST(try_cast({x} AS DECIMAL(38, 0)) AS STRING), {plain}) "
            f"WHEN abs({x}) < 1 THEN coalesce(regexp_replace(CAST(try_cast({x} AS DECIMAL(38, 37)) AS STRING), '\\\\.?0+$', ''), {plain}) "
            f"ELSE coalesce(regexp_replace(CAST(try_cast({x} AS DECIMAL(38, 18)) AS STRING), '\\\\.?0+$', ''), {plain}) END)")
    return x if kind in ("TEXT", "JSON") else f"CAST({x} AS STRING)"


def first_typed(types: list[str]) -> str:
    return next((t for t in types if t != "ANY"), "ANY")


def common(types: list[str]) -> str:
    """The type that numbers meet in, else the first."""
    known = [t for t in types if t != "ANY"]
    return "DOUBLE" if set(known) == {"BIGINT", "DOUBLE"} else first_typed(types)


def _substr(a: list[str], t: list[str]) -> str:
    s, p = a[0], a[1]
    if len(a) == 2:
        return f"substr({s}, CAST(greatest({p}, 1L) AS INT))"
    n = f"(CASE WHEN {a[2]} < 0 THEN raise_error('substr: negative length') ELSE {a[2]} END)"
    return f"(CASE WHEN {p} IS NULL OR {a[2]} IS NULL THEN CAST(NULL AS STRING) WHEN {p} + {n} <= greatest({p}, 1L) THEN substr({s}, 1, 0) ELSE substr({s}, CAST(greatest({p}, 1L) AS INT), CAST(least({p} + {n} - greatest({p}, 1L), 2147483647L) AS INT)) END)"


def _side(left: bool) -> Callable[[list[str], list[str]], str]:
    def sql(a: list[str], t: list[str]) -> str:
        s, n = a
        keep = f"CAST(CASE WHEN {n} >= 0 THEN least({n}, length({s})) ELSE greatest(length({s}) + {n}, 0L) END AS INT)"
        return f"left({s}, {keep})" if left else f"right({s}, {keep})"

    return sql


def _pad(left: bool) -> Callable[[list[str], list[str]], str]:
    def sql(a: list[str], t: list[str]) -> str:
        return f"{'lpad' if left else 'rpad'}({a[0]}, CAST(greatest({a[1]}, 0L) AS INT), {a[2] if len(a) > 2 else string(' ')})"

    return sql


def _round(a: list[str], t: list[str]) -> str:
    if len(a) == 1:
        return a[0] if t[0] == "BIGINT" else f"CAST(round({a[0]}) AS DOUBLE)"
    n = a[1].removesuffix("L")
    if not n.lstrip("-").isdigit():
        raise SqlError("round takes a literal number of digits")
    if t[0] == "BIGINT" and int(n) >= 0:
        return a[0]
    return f"CAST(round({a[0]}, {n}) AS {'BIGINT' if t[0] == 'BIGINT' else 'DOUBLE'})"


def _whole(name: str, x: str) -> str:
    """floor or ceil as a double; large values, infinities and NaN are whole already."""
    return f"(CASE WHEN abs({x}) < 4.5e15 THEN CAST({name}({x}) AS DOUBLE) ELSE {x} END)"


def _json_path(path: str) -> str:
    if path.startswith("'") and path.endswith("'"):
        p = path[1:-1]
        return string(p if p.startswith("$") else f"$.{p}" if not p.startswith("[") else f"${p}")
    return f"(CASE WHEN startswith({path}, '$') THEN {path} WHEN startswith({path}, '[') THEN '$' || {path} ELSE '$.' || {path} END)"


def _json_extract(a: list[str], t: list[str]) -> str:
    # a wrapped lookup keeps strings quoted and tells a JSON null from a missing value
    path = _json_path(a[1])
    return f"to_json(variant_get(parse_json({a[0]}), {path}, 'variant'))" if path.startswith("'") else f"to_json(try_variant_get(parse_json({a[0]}), {path}, 'variant'))"


def _json_string(a: list[str], t: list[str]) -> str:
    return f"get_json_object(CASE WHEN {a[0]} IS NOT NULL AND try_parse_json({a[0]}) IS NULL THEN raise_error('invalid JSON') ELSE {a[0]} END, {_json_path(a[1])})"


def _chr(a: list[str], t: list[str]) -> str:
    n = a[0]
    return f"(CASE WHEN {n} < 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN raise_error('chr: no such character') ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END)"


def _split_part(a: list[str], t: list[str]) -> str:
    s, d, n = a
    return (f"(CASE WHEN {n} < 1 THEN raise_error('split_part: the field number starts at 1') WHEN {d} = '' THEN IF({n} = 1, {s}, substr({s}, 1, 0)) "
            f"ELSE split_part({s}, {d}, CAST(least({n}, 2147483647L) AS INT)) END)")


def _to_common(name: str) -> Callable[[list[str], list[str]], str]:
    def sql(a: list[str], t: list[str]) -> str:
        kind = common(t)
        a = [f"CAST({x} AS DOUBLE)" if kind == "DOUBLE" and k == "BIGINT" else x for x, k in zip(a, t)]
        return a[0] if len(a) == 1 else f"{name}({', '.join(a)})"

    return sql


def _call(name: str, cast: str = "") -> Callable[[list[str], list[str]], str]:
    return lambda a, t: f"CAST({name}({', '.join(a)}) AS {cast})" if cast else f"{name}({', '.join(a)})"


T, N = "TEXT", "BIGINT"
BUILTINS: dict[str, Builtin] = {
    "upper": Builtin(1, 1, T, _call("upper"), (T,)),
    "lower": Builtin(1, 1, T, _call("lower"), (T,)),
    "trim": Builtin(1, 1, T, lambda a, t: f"regexp_replace({a[0]}, '^{SPACE}+|{SPACE}+$', '')", (T,)),
    "ltrim": Builtin(1, 1, T, lambda a, t: f"regexp_replace({a[0]}, '^{SPACE}+', '')", (T,)),
    "rtrim": Builtin(1, 1, T, lambda a, t: f"regexp_replace({a[0]}, '{SPACE}+$', '')", (T,)),
    "length": Builtin(1, 1, N, _call("length", "BIGINT"), (T,)),
    "substr": Builtin(2, 3, T, _substr, (T, N, N)),
    "left": Builtin(2, 2, T, _side(True), (T, N)),
    "right": Builtin(2, 2, T, _side(False), (T, N)),
    "strpos": Builtin(2, 2, N, lambda a, t: f"CAST(instr({a[0]}, {a[1]}) AS BIGINT)", (T, T)),
    "split_part": Builtin(3, 3, T, _split_part, (T, T, N)),
    "replace": Builtin(3, 3, T, _call("replace"), (T, T, T)),
    "concat": Builtin(1, 99, T, lambda a, t: f"concat_ws('', {', '.join(render(x, k) for x, k in zip(a, t))})"),
    "repeat": Builtin(2, 2, T, lambda a, t: f"repeat({a[0]}, CAST(greatest({a[1]}, 0L) AS INT))", (T, N)),
    "reverse": Builtin(1, 1, T, _call("reverse"), (T,)),
    "lpad": Builtin(2, 3, T, _pad(True), (T, N, T)),
    "rpad": Builtin(2, 3, T, _pad(False), (T, N, T)),
    "chr": Builtin(1, 1, T, _chr, (N,)),
    "ascii": Builtin(1, 1, N, _call("ascii", "BIGINT"), (T,)),
    "starts_with": Builtin(2, 2, "BOOLEAN", _call("startswith"), (T, T)),
    "contains": Builtin(2, 2, "BOOLEAN", _call("contains"), (T, T)),
    "coalesce": Builtin(1, 99, common, _to_common("coalesce")),
    "nullif": Builtin(2, 2, first_typed, _call("nullif")),
    "greatest": Builtin(1, 99, common, _to_common("greatest")),
    "least": Builtin(1, 99, common, _to_common("least")),
    "abs": Builtin(1, 1, lambda t: t[0], _call("abs"), ("DOUBLE",)),
    "round": Builtin(1, 2, lambda t: t[0] if t[0] == N else "DOUBLE", _round, ("DOUBLE", N)),
    "floor": Builtin(1, 1, lambda t: t[0] if t[0] == N else "DOUBLE", lambda a, t: a[0] if t[0] == N else _whole("floor", a[0]), ("DOUBLE",)),
    "ceil": Builtin(1, 1, lambda t: t[0] if t[0] == N else "DOUBLE", lambda a, t: a[0] if t[0] == N else _whole("ceil", a[0]), ("DOUBLE",)),
    "mod": Builtin(2, 2, N, _call("try_mod"), (N, N)),
    "json_extract": Builtin(2, 2, "JSON", _json_extract, ("JSON", T)),
    "json_extract_string": Builtin(2, 2, T, _json_string, ("JSON", T)),
}
AGGREGATES = frozenset("count sum avg min max string_agg bool_and bool_or".split())


def divide(a: str, b: str) -> str:
    """Division in doubles: x/0 is an infinity, 0/0 not a number."""
    return (f"(CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 OR isnan({a}) THEN double('nan') WHEN ({a} > 0) = (NOT startswith(CAST({b} AS STRING), '-')) THEN double('inf') ELSE double('-inf') END "
            f"ELSE {a} / {b} END)")


def cast(x: str, have: str, want: str) -> str:
    """CAST with the dialect's rules."""
    if have == want or have == "ANY":
        return f"CAST({x} AS {spark_type(want)})" if have == "ANY" else x
    if want == "TEXT":
        return render(x, have)
    if want == "BIGINT":
        if have == "DOUBLE":
            return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 9.3e18 THEN CAST({x} AS BIGINT) WHEN {x} IS NULL THEN CAST(NULL AS BIGINT) ELSE raise_error('CAST to BIGINT: not an integer') END)"
        if have in ("TEXT", "BOOLEAN"):
            return f"CAST({x} AS BIGINT)" if have == "BOOLEAN" else f"CAST(regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '') AS BIGINT)"
    if want == "DOUBLE" and have in ("BIGINT", "TEXT", "BOOLEAN"):
        return f"CAST({x} AS DOUBLE)"
    if want == "BOOLEAN" and have == "TEXT":
        low = f"lower({BUILTINS['trim'].sql([x], ['TEXT'])})"
        return f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS BOOLEAN) WHEN {low} IN ('true', 't', 'yes', '1') THEN true WHEN {low} IN ('false', 'f', 'no', '0') THEN false ELSE raise_error('CAST to BOOLEAN: not a truth value') END)"
    if want == "BOOLEAN" and have == "BIGINT":
        return f"({x} <> 0)"
    if want == "JSON":
        return f"to_json(parse_json({x}))" if have == "TEXT" else f"CAST({x} AS STRING)"
    if want == "VECTOR" and have in ("JSON", "TEXT"):
        return f"from_json({x}, 'array<float>')"
    raise SqlError(f"CAST from {have} to {want} is not supported")


def spark_type(kind: str) -> str:
    return {"BOOLEAN": "BOOLEAN", "BIGINT": "BIGINT", "DOUBLE": "DOUBLE", "TEXT": "STRING", "JSON": "STRING", "VECTOR": "ARRAY<FLOAT>", "ANY": "VOID"}.get(kind, kind)

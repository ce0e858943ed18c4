"""Theorem corpora: newline-delimited JSON in, typed tables out.

A line is one theorem.  An expression is an object with one field, its form;
an expression's number is its place, and operands come before their users.
Lines are checked strictly (every field there, none besides, kinds and ranges),
which needs recursion over levels and naturals of any size, so they are parsed
by Python's JSON reader in batches; an error names the place within the line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The thirteen node kinds, in their fixed order.
KINDS = ["Bvar", "Fvar", "ExprMvar", "Sort", "Const", "App", "Lambda", "Forall", "Let", "NatLiteral", "StringLiteral", "Metadata", "Proj"]
# Names of the format's enumerations.
BINDERS = ("default", "implicit", "strictImplicit", "instImplicit")
LOCAL_KINDS = ("default", "implementationDetail", "auxiliary")
MVAR_KINDS = ("natural", "synthetic", "syntheticOpaque")

_LOCAL = "struct<id:long,type:long,kind:string,is_instance:boolean,binder_info:string,val:long,nondep:boolean>"
_EXPR = "struct<kind:string,name:string,idx:long,names:array<string>,binder_info:string,val:string,level:string,meta:string,nondep:boolean,refs:array<long>>"
_MVAR = f"struct<id:long,decl_type:long,decl_kind:string,decl_locals:array<{_LOCAL}>,assignment:long,fvars:array<long>,pending:long>"
_LVL_MVAR = "struct<id:long,depth:long,idx:long,assignment:string>"
_TRN = f"struct<tactic:string,src:string,start:long,stop:long,open_goals:long,target:long,locals:array<{_LOCAL}>,mvars:array<{_MVAR}>,lvl_mvars:array<{_LVL_MVAR}>>"
SCHEMA = f"name string, module string, start long, stop long, exprs array<{_EXPR}>, trns array<{_TRN}>"

Check = Callable[[Any, str], Any]


class FormatError(ValueError):
    """A line that is no theorem record; the message begins with the place."""


def _bad(at: str, why: str):
    raise FormatError(f"{at}: {why}")


def _of(kind: type, what: str, ok: Callable[[Any], bool] = lambda v: True) -> Check:
    def check(v: Any, at: str) -> Any:
        return v if type(v) is kind and ok(v) else _bad(at, f"expected {what}")

    return check


_big = _of(int, "a natural number", lambda v: v >= 0)
_nat = _of(int, "a natural number below 2^63", lambda v: 0 <= v < 1 << 63)
_positive = _of(int, "a positive number", lambda v: 0 < v < 1 << 63)
_text, _some_text, _flag = _of(str, "a text"), _of(str, "a non-empty text", bool), _of(bool, "true or false")


def _one_of(names: tuple[str, ...]) -> Check:
    return _of(str, f"one of {list(names)}", lambda v: v in names)


def _list(item: Check, least: int = 0) -> Check:
    def check(v: Any, at: str) -> list:
        if type(v) is not list or len(v) < least:
            _bad(at, f"expected an array of {least} or more" if least else "expected an array")
        return [item(x, f"{at}[{k}]") for k, x in enumerate(v)]

    return check


def _maybe(item: Check) -> Check:
    return lambda v, at: None if v is None else item(v, at)


def _record(**fields: Check) -> Check:
    def check(v: Any, at: str) -> dict:
        if type(v) is not dict:
            _bad(at, "expected an object")
        if lacking := sorted(fields.keys() - v.keys()):
            _bad(at, f"missing fields {lacking}")
        if more := sorted(v.keys() - fields.keys()):
            _bad(at, f"unknown fields {more}")
        return {k: f(v[k], f"{at}.{k}") for k, f in fields.items()}

    return check


def _form(v: Any, at: str) -> tuple[str, Any, str]:
    if type(v) is not dict or len(v) != 1:
        _bad(at, "expected an object with one field, its form")
    ((name, inner),) = v.items()
    return name, inner, f"{at}.{name}"


def _level(v: Any, at: str) -> Any:
    if v == "zero":
        return v
    name, inner, at = _form(v, at)
    if name == "mvar":
        return {name: _nat(inner, at)}
    if name == "succ":
        return {name: _level(inner, at)}
    if name in ("max", "imax"):
        two = _list(_level)(inner, at)
        return {name: two} if len(two) == 2 else _bad(at, "expected two levels")
    return {name: _text(inner, at)} if name == "param" else _bad(at, "no such level")


def _texts_by_name(v: Any, at: str) -> dict:
    if type(v) is not dict:
        _bad(at, "expected an object")
    return {k: _text(x, f"{at}.{k}") for k, x in v.items()}


def _span(v: Any, at: str) -> list:
    two = _list(_nat)(v, at)
    if len(two) != 2:
        _bad(at, "expected two offsets")
    return two if two[0] <= two[1] else _bad(at, "ends before it begins")


_binder = dict(names=_list(_text, 1), type=_nat, body=_nat, binderInfo=_one_of(BINDERS))
#: Form of an expression -> kind, check, and which column each checked part is.
_FORMS: dict[str, tuple[str, Check, Callable[[Any], dict]]] = {
    "bvar": ("Bvar", _nat, lambda v: {"idx": v}),
    "fvar": ("Fvar", _nat, lambda v: {"idx": v}),
    "mvar": ("ExprMvar", _nat, lambda v: {"idx": v}),
    "sort": ("Sort", _level, lambda v: {"level": _json(v)}),
    "const": ("Const", _record(name=_text, universes=_list(_level)), lambda v: {"name": v["name"], "level": _json(v["universes"])}),
    "app": ("App", _record(fn=_nat, args=_list(_nat, 1)), lambda v: {"refs": [v["fn"], *v["args"]]}),
    "lambda": ("Lambda", _record(**_binder), lambda v: {"names": v["names"], "binder_info": v["binderInfo"], "refs": [v["type"], v["body"]]}),
    "forall": ("Forall", _record(**_binder), lambda v: {"names": v["names"], "binder_info": v["binderInfo"], "refs": [v["type"], v["body"]]}),
    "let": ("Let", _record(name=_text, type=_nat, val=_nat, body=_nat, nondep=_flag), lambda v: {"name": v["name"], "nondep": v["nondep"], "refs": [v["type"], v["val"], v["body"]]}),
    "natural": ("NatLiteral", _big, lambda v: {"val": str(v)}),
    "string": ("StringLiteral", _text, lambda v: {"val": v}),
    "metadata": ("Metadata", _record(data=_texts_by_name, expr=_nat), lambda v: {"meta": _json(v["data"]), "refs": [v["expr"]]}),
    "projection": ("Proj", _record(typeName=_text, idx=_nat, struct=_nat), lambda v: {"name": v["typeName"], "idx": v["idx"], "refs": [v["struct"]]}),
}


def _json(v: Any) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _expr(v: Any, at: str) -> dict:
    name, inner, at = _form(v, at)
    if name not in _FORMS:
        _bad(at, "no such expression")
    kind, check, columns = _FORMS[name]
    return {"kind": kind, "refs": []} | columns(check(inner, at))


_own_local = dict(id=_nat, type=_nat, kind=_one_of(LOCAL_KINDS), isInstance=_flag)
_const_local = _record(**_own_local, binderInfo=_one_of(BINDERS))
_let_local = _record(**_own_local, val=_nat, nondep=_flag)


def _local(v: Any, at: str) -> dict:
    got = (_let_local if type(v) is dict and "val" in v else _const_local)(v, at)
    return {"id": got["id"], "type": got["type"], "kind": got["kind"], "is_instance": got["isInstance"], "binder_info": got.get("binderInfo"), "val": got.get("val"), "nondep": got.get("nondep")}


_STATE = _record(
    target=_nat,
    locals=_list(_local),
    mvars=_list(_record(id=_nat, decl=_maybe(_record(type=_nat, locals=_list(_local), kind=_one_of(MVAR_KINDS))), assignment=_maybe(_nat), delayedAssign=_maybe(_record(fvars=_list(_nat), pending=_nat)))),
    lvlMvars=_list(_record(id=_nat, decl=_maybe(_record(depth=_nat, idx=_nat)), assignment=_maybe(_level))),
)
_THEOREM = _record(
    name=_some_text,
    module=_some_text,
    srcSpan=_maybe(_span),
    exprs=_list(_expr),
    trns=_list(_record(tactic=_record(kind=_text, src=_text), srcSpan=_span, openGoalCount=_positive, state=_STATE), 1),
)


def _mvar(v: dict) -> dict:
    decl, late = v["decl"] or {}, v["delayedAssign"] or {}
    return {"id": v["id"], "decl_type": decl.get("type"), "decl_kind": decl.get("kind"), "decl_locals": decl.get("locals"), "assignment": v["assignment"], "fvars": late.get("fvars"), "pending": late.get("pending")}


def _lvl_mvar(v: dict) -> dict:
    decl = v["decl"] or {}
    return {"id": v["id"], "depth": decl.get("depth"), "idx": decl.get("idx"), "assignment": None if v["assignment"] is None else _json(v["assignment"])}


def parse(line: str) -> dict:
    """One line's theorem as a row of :data:`SCHEMA`; :class:`FormatError` if it is none."""
    try:
        v = json.loads(line)
    except ValueError as e:
        raise FormatError(f"$: {e}") from e
    t = _THEOREM(v, "$")
    trns = []
    for x in t["trns"]:
        state = x["state"]
        trns.append({"tactic": x["tactic"]["kind"], "src": x["tactic"]["src"], "start": x["srcSpan"][0], "stop": x["srcSpan"][1], "open_goals": x["openGoalCount"], "target": state["target"], "locals": state["locals"], "mvars": [_mvar(m) for m in state["mvars"]], "lvl_mvars": [_lvl_mvar(m) for m in state["lvlMvars"]]})
    start, stop = t["srcSpan"] or (None, None)
    return {"name": t["name"], "module": t["module"], "start": start, "stop": stop, "exprs": t["exprs"], "trns": trns}


def _parsed(lines: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([parse(x) for x in batch.column(0).slice(lo, 256).to_pylist()], arrow)

    return lines.select("value").mapInArrow(body, schema)


def read_theorems(spark: SparkSession, path: str) -> DataFrame:
    """One theorem per line, as :data:`SCHEMA`; a malformed or blank line fails the query."""
    return _parsed(spark.read.text(path))


def stream_theorems(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_theorems`, as a file stream."""
    return _parsed(spark.readStream.text(path))


def expr_table(theorems: DataFrame) -> DataFrame:
    """``thm, id`` and an expression's columns, ``refs`` being its operands in order."""
    return theorems.select(F.col("name").alias("thm"), F.posexplode("exprs").alias("id", "e")).select("thm", "id", "e.*")


def transition_table(theorems: DataFrame) -> DataFrame:
    """``thm, step`` and a transition's columns."""
    return theorems.select(F.col("name").alias("thm"), F.posexplode("trns").alias("step", "t")).select("thm", "step", "t.*")


def violations(theorems: DataFrame) -> DataFrame:
    """``thm, what`` of every rule across a theorem that is broken: names unique, operands first, all references in range."""
    e, t = expr_table(theorems), transition_table(theorems)
    size = theorems.select(F.col("name").alias("thm"), F.size("exprs").cast("long").alias("n"))
    say = lambda df, what: df.select("thm", F.lit(what).alias("what"))
    in_range = t.join(size, "thm")
    local_bad = lambda x: (x["type"] >= F.col("n")) | F.coalesce(x["val"] >= F.col("n"), F.lit(False))
    beyond = lambda c: F.coalesce(c >= F.col("n"), F.lit(False))
    mvar_bad = lambda m: beyond(m["decl_type"]) | beyond(m["assignment"]) | beyond(m["pending"]) | F.coalesce(F.exists(m["decl_locals"], local_bad), F.lit(False)) | F.coalesce(F.exists(m["fvars"], beyond), F.lit(False))
    return (
        say(theorems.groupBy(F.col("name").alias("thm")).count().where("count > 1"), "duplicate name")
        .unionByName(say(e.where(F.exists("refs", lambda r: r >= F.col("id"))), "operand out of order"))
        .unionByName(say(in_range.where("target >= n"), "target out of range"))
        .unionByName(say(in_range.where(F.exists("locals", local_bad)), "local out of range"))
        .unionByName(say(in_range.where(F.exists("mvars", mvar_bad)), "metavariable out of range"))
        .distinct()
    )

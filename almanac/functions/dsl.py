"""A small causal expression language, compiled to Columns.

Expressions are Python syntax limited to fields, finite constants, + - * / and the named functions below.
Window subtrees become aliased columns, one per distinct subtree, so Spark evaluates all
windows of a partitioning in one pass; cross-sections (Rank) follow in a stage of their own.
"""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.cross import finite, full, past, percent_rank, quotient, trailing

#: The fields of a panel, and those that come from published statements.
FIELDS = frozenset("open high low close volume turnover returns vwap pit_roe pit_net_margin pit_earnings_growth pit_asset_growth pit_equity_growth pit_cashflow_margin".split())
MOST_NODES, MOST_WINDOW, MOST_LOOKBACK = 128, 252, 512
BINARY = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div"}
ARITY = {"Add": 2, "Sub": 2, "Mul": 2, "Div": 2, "Abs": 1, "Log": 1, "Rank": 1, "Ref": 2, "Delta": 2, "Mean": 2, "Std": 2, "Min": 2, "Max": 2, "TsRank": 2}
WINDOWED = frozenset("Ref Delta Mean Std Min Max TsRank".split())

#: The seed expressions.
SEEDS = {
    "MOM_20": "close / Ref(close, 20) - 1",
    "MOM_60": "close / Ref(close, 60) - 1",
    "REV_5": "-(close / Ref(close, 5) - 1)",
    "VOL_20": "Std(returns, 20)",
    "TURNOVER_MEAN_20": "Mean(turnover, 20)",
    "TURNOVER_CHANGE_20": "Mean(turnover, 5) / Mean(turnover, 20) - 1",
    "VOLUME_RATIO_5_20": "Mean(volume, 5) / Mean(volume, 20)",
    "PRICE_POSITION_60": "(close - Min(low, 60)) / (Max(high, 60) - Min(low, 60))",
}


#: Two technical candidates, and the formulas of a paper.
CANDIDATES = {"QUIET_REVERSAL": "-(close / Ref(close, 5) - 1) / (1 + turnover / Mean(turnover, 20))", "ACTIVE_CONTINUATION": "(close / Ref(close, 20) - 1) * (turnover / Mean(turnover, 60)) / (1 + turnover / Mean(turnover, 60))"}
PAPER = {"OPEN_TO_CLOSE": "Log(close / open)", "BODY": "(close - open) / (high - low + 0.001)"}


class ExpressionError(ValueError):
    pass


def parse(text: str, extra: frozenset[str] = frozenset()) -> tuple:
    """Nested tuples (operator, arguments...); fields are ('field', name), constants ('const', value). `extra` names fields beyond FIELDS."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ExpressionError(f"not an expression: {text!r}") from error
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise ExpressionError("too many nodes")
    out = _node(tree.body, FIELDS | extra)
    if lookback(out) > MOST_LOOKBACK:
        raise ExpressionError("looks back too far")
    if not fields(out):
        raise ExpressionError("a constant is not a panel")
    return out


def constant(node) -> float | None:
    """The value of a tree without fields; None where there is one."""
    if node[0] == "const":
        return float(node[1])
    parts = [constant(x) for x in node[1:] if isinstance(x, tuple)]
    if node[0] not in ("Neg", "Add", "Sub", "Mul", "Div") or None in parts:
        return None
    if node[0] == "Div":
        if parts[1] == 0:
            raise ExpressionError("a constant is divided by zero")
        return parts[0] / parts[1]
    return {"Neg": lambda a: -a, "Add": lambda a, b: a + b, "Sub": lambda a, b: a - b, "Mul": lambda a, b: a * b}[node[0]](*parts)


def _node(node, known) -> tuple:
    if isinstance(node, ast.Name):
        if node.id not in known:
            raise ExpressionError(f"unknown field {node.id}")
        return ("field", node.id)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float) and math.isfinite(node.value):
        return ("const", node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        inner = _node(node.operand, known)
        return ("Neg", inner) if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        out = (BINARY[type(node.op)], _node(node.left, known), _node(node.right, known))
        constant(out)
        return out
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        name = node.func.id
        if ARITY.get(name) != len(node.args):
            raise ExpressionError(f"unknown function or wrong arguments: {name}")
        if name not in WINDOWED:
            out = (name, *(_node(x, known) for x in node.args))
            constant(out)
            return out
        size = node.args[1]
        if not (isinstance(size, ast.Constant) and type(size.value) is int and (0 if name in ("Ref", "Delta") else 1) <= size.value <= MOST_WINDOW):
            raise ExpressionError(f"{name} needs a literal window")
        return (name, _node(node.args[0], known), size.value)
    raise ExpressionError(f"not allowed: {ast.dump(node)[:60]}")


def fields(node) -> set[str]:
    if node[0] == "field":
        return {node[1]}
    return set().union(*(fields(x) for x in node[1:] if isinstance(x, tuple)), set())


def parts(node):
    """The tree and every tree inside it."""
    yield node
    for x in node[1:]:
        if isinstance(x, tuple):
            yield from parts(x)


def render(node) -> str:
    """A tree as text that parses to the same tree."""
    if node[0] in ("field", "const"):
        return str(node[1]) if node[0] == "field" else repr(node[1])
    if node[0] == "Neg":
        return f"-({render(node[1])})"
    return f"{node[0]}({', '.join(render(x) if isinstance(x, tuple) else repr(x) for x in node[1:])})"


def divides(node) -> bool:
    """Whether a division by zero can make a value of the tree infinite."""
    return node[0] == "Div" or any(divides(x) for x in node[1:] if isinstance(x, tuple))


def lookback(node) -> int:
    """Calendar positions before the current one that a value depends on."""
    if node[0] == "field":
        return int(node[1] == "returns")
    if node[0] in WINDOWED:
        return lookback(node[1]) + node[2] - (node[0] not in ("Ref", "Delta"))
    return max((lookback(x) for x in node[1:] if isinstance(x, tuple)), default=0)


def signature(text: str, direction: int = 1) -> str:
    """A hash that is equal for expressions that differ in the order of sums and products or in where the sign stands."""

    def canon(n):
        if n[0] == "Neg":
            n = ("Mul", ("const", -1), n[1])
        parts = [canon(x) if isinstance(x, tuple) else repr(float(x)) if type(x) in (int, float) else repr(x) for x in n[1:]]
        return f"{n[0]}({','.join(sorted(parts) if n[0] in ('Add', 'Mul') else parts)})"

    node = parse(text)
    return hashlib.sha256(canon(("Mul", ("const", -1), node) if direction == -1 else node).encode()).hexdigest()


def identity(text: str, direction: int = 1) -> str:
    """A hash of the expression as it is written, spaces and brackets aside, and its direction."""
    parse(text)
    return hashlib.sha256(f"{ast.dump(ast.parse(text.strip(), mode='eval').body)}:{direction}".encode()).hexdigest()


def definition_id(name: str, family: str, expression: str, hypothesis: str, direction: int = 1, **more) -> str:
    """A short id that changes with any part of a definition. Names are upper case, directions 1 or -1."""
    if not re.fullmatch("[A-Z][A-Z0-9_]{0,63}", name) or direction not in (1, -1) or not family or not hypothesis:
        raise ExpressionError("incomplete definition")
    parse(expression)
    body = {"name": name, "family": family, "expression": expression, "hypothesis": hypothesis, "direction": direction, "source": "human_baseline", "paper": None, "generator": "human", "version": 1} | more
    return "F_" + hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def evaluate(panel: DataFrame, expressions: dict[str, str], member: str | None = None, extra: frozenset[str] = frozenset()) -> DataFrame:
    """panel(dt, t, inst, fields...) with one more column per expression; `extra` names further fields of the panel.

    The panel must be dense (a row for each date and instrument): offsets count calendar positions,
    and windows want a value in each. Rank compares the members of the date, all if `member` is not given.
    A division by zero is infinite and carried on, null inside windows; what ends NaN or infinite is null.
    """
    made: dict[tuple, str] = {}
    state = {"df": panel}

    def keep(node, column: Column) -> Column:
        if node not in made:
            made[node] = f"_w{len(made)}"
            state["df"] = state["df"].withColumn(made[node], column)
        return F.col(made[node])

    def build(node) -> Column:
        op = node[0]
        if op == "field":
            return F.col(node[1])
        if op == "const":
            return F.lit(float(node[1]))
        if node in made:
            return F.col(made[node])
        x = build(node[1])
        if op == "Neg":
            return -x
        if op in ("Add", "Sub", "Mul", "Div"):
            y = build(node[2])
            out = {"Add": lambda: x + y, "Sub": lambda: x - y, "Mul": lambda: x * y, "Div": lambda: quotient(x, y)}[op]()
            return F.nanvl(out, F.lit(None).cast("double")) if divides(node) else out
        if op == "Abs":
            return F.abs(x)
        if op == "Log":
            return F.when(x > 0, F.ln(x))
        if op not in ("Rank", "Ref", "Delta") and divides(node[1]):
            x = keep(("finite", node[1]), finite(x))
        elif op != "Rank" and node[1][0] != "field":
            x = keep(node[1], x)
        if op == "Rank":
            x = keep(("masked", node[1]), F.when(F.col(member), x) if member else x)
            return keep(node, percent_rank(x, "dt"))
        n = node[2]
        if op in ("Ref", "Delta"):
            before = F.lag(x, n).over(past()) if n else x
            return keep(node, before if op == "Ref" else x - before)
        frame = trailing(n)
        if op == "TsRank":
            a = keep(("list", node), F.collect_list(x).over(frame))
            below, same = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
            return keep(node, F.when((F.size(a) == n) & x.isNotNull(), (below + (same + 1) / 2) / n))
        return keep(node, full({"Mean": F.avg, "Std": F.stddev_samp, "Min": F.min, "Max": F.max}[op], x, n, frame))

    out = {name: finite(build(parse(text, extra))) for name, text in expressions.items()}
    df = state["df"]
    for name, column in out.items():
        df = df.withColumn(name, column)
    return df.drop(*made.values())

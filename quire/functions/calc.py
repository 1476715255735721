"""The calculator language of sampled documents, compiled to Column expressions.

A program is executed once, at plan time, on a stack of Columns; what is left is one
Catalyst expression for each value, so whole-stage code generation applies to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"%[^\r\n]*|[{}]|[^\s{}%]+")
NUMBER, BOOLEAN = "number", "boolean"


class Value:
    """A stack slot: a Column, its static type, and its constant if it is one."""

    def __init__(self, col: Column, kind: str = NUMBER, const: float | None = None):
        self.col, self.kind, self.const = col, kind, const


def parse(program: str) -> list:
    """Nested lists of numbers and operator names; braces around the whole are optional."""
    stack: list[list] = [[]]
    for t in _TOKEN.findall(program):
        if t.startswith("%"):
            continue
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) < 2:
                raise ValueError("unbalanced }")
            done = stack.pop()
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(float(t))
            except ValueError:
                stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("unbalanced {")
    return stack[0][0] if len(stack[0]) == 1 and isinstance(stack[0][0], list) else stack[0]


def _d(c: Column) -> Column:
    return c.cast("double")


def _whole(c: Column) -> Column:
    return c.cast("bigint")


_UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "neg": lambda x: -x,
    "ceiling": lambda x: _d(F.ceil(x)),
    "floor": lambda x: _d(F.floor(x)),
    "round": lambda x: _d(F.floor(x + 0.5)),
    "truncate": lambda x: _d(_whole(x)),
    "cvi": lambda x: _d(_whole(x)),
    "cvr": _d,
    "sin": lambda x: F.sin(F.radians(x)),
    "cos": lambda x: F.cos(F.radians(x)),
    "ln": F.ln,
    "log": F.log10,
    "sqrt": lambda x: F.when(x < 0, F.raise_error(F.lit("sqrt of a negative number"))).otherwise(F.sqrt(x)),
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "idiv": lambda a, b: _d(_whole(_d(_whole(a)) / _d(_whole(b)))),
    "mod": lambda a, b: _d(_whole(a) % _whole(b)),
    "exp": F.pow,
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
    "bitshift": lambda a, b: _d(F.when(b >= 0, F.call_function("shiftleft", _whole(a), b.cast("int"))).otherwise(F.call_function("shiftright", _whole(a), (-b).cast("int")))),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_LOGIC = {"and": (lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)), "or": (lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)), "xor": (lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b))}


def _count(stack: list[Value], what: str) -> int:
    n = stack.pop().const
    if n is None or n < 0 or n != int(n):
        raise ValueError(f"{what} needs a constant count of 0 or more")
    return int(n)


def _run(code: list, stack: list[Value]) -> None:
    for k, op in enumerate(code):
        if isinstance(op, float):
            stack.append(Value(F.lit(op), NUMBER, op))
        elif isinstance(op, list):
            continue  # taken by the if or ifelse behind it
        elif op in ("true", "false"):
            stack.append(Value(F.lit(op == "true"), BOOLEAN))
        elif op in _UNARY:
            x = stack.pop()
            stack.append(Value(_UNARY[op](x.col)))
        elif op in _BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append(Value(_BINARY[op](a.col, b.col)))
        elif op in _COMPARE:
            b, a = stack.pop(), stack.pop()
            if a.kind != b.kind:  # a truth value never equals a number
                if op not in ("eq", "ne"):
                    raise TypeError(f"{op} of a number and a truth value")
                stack.append(Value(F.lit(op == "ne"), BOOLEAN))
            else:
                stack.append(Value(_COMPARE[op](a.col, b.col), BOOLEAN))
        elif op in _LOGIC:
            b, a = stack.pop(), stack.pop()
            if a.kind != b.kind:
                raise TypeError(f"{op} of a number and a truth value")
            logical, bits = _LOGIC[op]
            stack.append(Value(logical(a.col, b.col), BOOLEAN) if a.kind == BOOLEAN else Value(_d(bits(_whole(a.col), _whole(b.col)))))
        elif op == "not":
            x = stack.pop()
            stack.append(Value(~x.col, BOOLEAN) if x.kind == BOOLEAN else Value(-x.col))
        elif op == "dup":
            stack.append(stack[-1])
        elif op == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif op == "pop":
            stack.pop()
        elif op == "copy":
            n = _count(stack, op)
            stack.extend(stack[len(stack) - n :] if n else [])
        elif op == "index":
            stack.append(stack[-1 - _count(stack, op)])
        elif op == "roll":
            j = stack.pop().const
            n = _count(stack, op)
            if j is None:
                raise ValueError("roll needs a constant shift")
            if n:
                top = stack[-n:]
                j = int(j) % n
                stack[-n:] = top[n - j :] + top[: n - j]
        elif op in ("if", "ifelse"):
            cond = stack.pop()
            if cond.kind != BOOLEAN:
                raise TypeError(f"{op} needs a truth value")
            yes, no = list(stack), list(stack)
            if op == "if":
                _run(code[k - 1], yes)
            else:
                _run(code[k - 2], yes)
                _run(code[k - 1], no)
            if len(yes) != len(no):
                raise ValueError("branches leave stacks of different depth")
            stack[:] = [a if a is b else Value(F.when(cond.col, a.col).otherwise(b.col), a.kind) for a, b in zip(yes, no, strict=True)]
        else:
            raise ValueError(f"unknown operator {op}")


def compile_program(program: str, *inputs: Column) -> list[Column]:
    """The Columns that the program leaves, bottom first, from the inputs as its first stack."""
    stack = [Value(_d(c)) for c in inputs]
    _run(parse(program), stack)
    return [v.col for v in stack]


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def exponential(x: Column, c0: list[float], c1: list[float], n: float, limits: list[tuple[float, float]] | None = None) -> list[Column]:
    """c0 + x^n * (c1 - c0) for each channel; only results are clipped."""
    out = [F.lit(a) + F.pow(x, F.lit(float(n))) * F.lit(b - a) for a, b in zip(c0, c1, strict=True)]
    return [clip(y, *r) for y, r in zip(out, limits, strict=True)] if limits else out


def stitching(x: Column, domain: tuple[float, float], bounds: list[float], encode: list[tuple[float, float]], parts: list[Callable[[Column], Column]]) -> Column:
    """The part whose interval holds x, at x mapped from the interval to its encoding.

    A bound belongs to the part above it, the end of the domain to the last part.
    """
    x = clip(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(parts))):
        lo, hi, (e0, e1) = edges[i], edges[i + 1], encode[i]
        at = F.lit(e0) if hi == lo else F.lit(e0) + (x - lo) * F.lit((e1 - e0) / (hi - lo))
        y = parts[i](at)
        out = y if out is None else F.when(x < edges[i + 1], y).otherwise(out)
    return out


def sampled(x: Column, domain: tuple[float, float], samples: list[float], decode: tuple[float, float], bits: int = 8) -> Column:
    """Linear interpolation between samples of ``bits`` bits, spread over the domain."""
    x, last = clip(x, *domain), len(samples) - 1
    at = (x - domain[0]) * F.lit(last / (domain[1] - domain[0]))
    lo = F.least(F.floor(at), F.lit(max(0, last - 1))).cast("int")
    table = F.array(*[F.lit(float(s)) for s in samples])
    a, b = F.element_at(table, lo + 1), F.element_at(table, F.least(lo + 2, F.lit(last + 1)))
    top = float(2**bits - 1)
    return F.lit(decode[0]) + (a + (at - lo) * (b - a)) * F.lit((decode[1] - decode[0]) / top)


def sampled_grid(xs: list[Column], domain: list[tuple[float, float]], size: list[int], samples: list[list[float]], decode: list[tuple[float, float]], bits: int = 8, encode: list[tuple[float, float]] | None = None, limits: list[tuple[float, float]] | None = None) -> list[Column]:
    """A sampled function of any number of inputs and outputs, as one expression an output.

    ``samples`` has a list of outputs for each point of the grid, the first input running
    fastest. An input is clipped to its domain, mapped to its encoding (all of its grid, if
    none is given) and clipped to the grid; the value is interpolated between the 2 ** n
    points around it, input by input, mapped from ``bits`` bits to its decoding and
    clipped to its limits. A null input gives null.
    """
    points = 1
    for n in size:
        points *= n
    if len(samples) != points or any(len(s) != len(decode) for s in samples) or not len(xs) == len(domain) == len(size):
        raise ValueError("a sample for each point of the grid and output is needed")
    places, stride = [], 1
    for x, (lo, hi), n, code in zip(xs, domain, size, encode or [(0.0, n - 1.0) for n in size], strict=True):
        at = F.lit(float(code[0])) if hi == lo else F.lit(float(code[0])) + (clip(x, lo, hi) - lo) * F.lit((code[1] - code[0]) / (hi - lo))
        at = F.when(x.isNotNull(), clip(at, 0.0, n - 1.0))
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        places.append((low * stride, high * stride, at - low))
        stride *= n
    out = []
    for k, (d0, d1) in enumerate(decode):
        table = F.array(*[F.lit(float(s[k])) for s in samples])

        def value(i: int, index: Column) -> Column:
            if i == len(places):
                return F.element_at(table, index + 1)
            low, high, part = places[i]
            a = value(i + 1, index + low)
            return a + part * (value(i + 1, index + high) - a)

        y = F.lit(float(d0)) + value(0, F.lit(0)) * F.lit((d1 - d0) / float(2**bits - 1))
        out.append(F.when(y.isNotNull(), clip(y, *limits[k])) if limits else y)
    return out

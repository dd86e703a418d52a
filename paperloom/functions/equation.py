"""Equation scripts and Office Math as LaTeX."""

from __future__ import annotations

import re
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.sources.xmltree import Node, read

# Words of the equation script and their LaTeX.
WORDS = {
    "TIMES": r"\times", "times": r"\times", "LEFT": r"\left", "RIGHT": r"\right", "under": r"\underline",
    "SMALLSUM": r"\sum", "sum": r"\sum", "SMALLPROD": r"\prod", "prod": r"\prod", "SMALLINTER": r"\cap", "CUP": r"\cup",
    "OPLUS": r"\oplus", "OMINUS": r"\ominus", "OTIMES": r"\otimes", "ODIV": r"\oslash", "ODOT": r"\odot", "LOR": r"\lor", "LAND": r"\land",
    "SUBSET": r"\subset", "SUPERSET": r"\supset", "SUBSETEQ": r"\subseteq", "SUPSETEQ": r"\supseteq", "IN": r"\in", "OWNS": r"\owns", "NOTIN": r"\notin",
    "LEQ": r"\leq", "GEQ": r"\geq", "<<": r"\ll", ">>": r"\gg", "<<<": r"\lll", ">>>": r"\ggg", "PREC": r"\prec", "SUCC": r"\succ", "UPLUS": r"\uplus",
    "±": r"\pm", "-+": r"\mp", "÷": r"\div", "CIRC": r"\circ", "BULLET": r"\bullet", "DEG": r" ^\circ", "AST": r"\ast", "STAR": r"\bigstar", "BIGCIRC": r"\bigcirc",
    "EMPTYSET": r"\emptyset", "THEREFORE": r"\therefore", "BECAUSE": r"\because", "EXIST": r"\exists", "!=": r"\neq", "SMCOPROD": r"\coprod", "coprod": r"\coprod",
    "SQCAP": r"\sqcap", "SQCUP": r"\sqcup", "SQSUBSET": r"\sqsubset", "SQSUBSETEQ": r"\sqsubseteq", "BIGSQCUP": r"\bigsqcup",
    "BIGOPLUS": r"\bigoplus", "BIGOTIMES": r"\bigotimes", "BIGODOT": r"\bigodot", "BIGUPLUS": r"\biguplus", "inter": r"\bigcap", "union": r"\bigcup", "UNDEROVER": "",
    "SIM": r"\sim", "APPROX": r"\approx", "SIMEQ": r"\simeq", "CONG": r"\cong", "==": r"\equiv", "DIAMOND": r"\diamond", "FORALL": r"\forall",
    "prime": "'", "Partial": r"\partial", "INF": r"\infty", "PROPTO": r"\propto", "lim": r"\lim", "Lim": r"\lim",
    "larrow": r"\leftarrow", "->": r"\rightarrow", "uparrow": r"\uparrow", "downarrow": r"\downarrow",
    "LARROW": r"\Leftarrow", "RARROW": r"\Rightarrow", "UPARROW": r"\Uparrow", "DOWNARROW": r"\Downarrow", "udarrow": r"\updownarrow", "<->": r"\leftrightarrow",
    "UDARROW": r"\Updownarrow", "LRARROW": r"\Leftrightarrow", "NWARROW": r"\nwarrow", "SEARROW": r"\searrow", "NEARROW": r"\nearrow", "SWARROW": r"\swarrow",
    "HOOKLEFT": r"\hookleftarrow", "HOOKRIGHT": r"\hookrightarrow", "PVER": r"\|", "MAPSTO": r"\mapsto",
    "CDOTS": r"\cdots", "LDOTS": r"\ldots", "VDOTS": r"\vdots", "DDOTS": r"\ddots", "DAGGER": r"\dagger", "DDAGGER": r"\ddagger", "DOTEQ": r"\doteq", "ASYMP": r"\asymp",
    "TRIANGLE": r"\triangle", "NABLA": r"\nabla", "ANGLE": r"\angle", "VDASH": r"\vdash", "DASHV": r"\dashv", "BOT": r"\bot", "TOP": r"\top", "MODELS": r"\models",
    "LAPLACE": r"\mathcal{L}", "sqrt": r"\sqrt", "int": r"\int", "dint": r"\iint", "tint": r"\iiint", "oint": r"\oint",
}
# Greek letters, whose command is the word itself.
LOWER_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
UPPER_GREEK = "GAMMA DELTA THETA LAMBDA XI PI SIGMA UPSILON PHI PSI OMEGA".split()
WORDS |= {w: "\\" + w for w in LOWER_GREEK} | {w: "\\" + w.capitalize() for w in UPPER_GREEK}
# Words that take the group behind them, with the command of each.
ACCENTS = {
    "vec": r"\overrightarrow", "dyad": r"\overleftrightarrow", "acute": r"\acute", "grave": r"\grave", "dot": r"\dot", "ddot": r"\ddot", "bar": r"\overline",
    "hat": r"\widehat", "check": r"\check", "arch": r"\overset{\frown}", "tilde": r"\widetilde", "BOX": r"\boxed",
}
MATRICES = {"matrix": "matrix", "pmatrix": "pmatrix", "bmatrix": "bmatrix", "dmatrix": "vmatrix", "cases": "cases"}
BRACES = {"OVERBRACE": r"\overbrace", "UNDERBRACE": r"\underbrace"}


class _Group(list):
    """The items between two braces."""


def _grouped(tokens: list[str]) -> list:
    stack: list[list] = [[]]
    for t in tokens:
        escaped = bool(stack[-1]) and ((t == "{" and stack[-1][-1] == r"\left") or (t == "}" and stack[-1][-1] == r"\right"))
        if escaped:
            stack[-1].append("\\" + t)
        elif t == "{":
            stack.append(_Group())
        elif t == "}" and len(stack) > 1:
            group = stack.pop()
            stack[-1].append(group)
        else:
            stack[-1].append(WORDS.get(t, t))
    while len(stack) > 1:  # braces that nothing closes are text
        rest = stack.pop()
        stack[-1] += ["{", *rest]
    return stack[0]


def _is_group(items: list, i: int) -> bool:
    return 0 <= i < len(items) and isinstance(items[i], _Group)


def _braced(group: _Group) -> str:
    inner = _latex(group)
    return f"{{ {inner} }}" if inner else "{ }"


def _takes_whole(group: _Group) -> str | None:
    """What a group becomes that holds a matrix or an accent and nothing else, as its braces go."""
    if len(group) == 2 and isinstance(group[1], _Group) and isinstance(group[0], str) and (group[0] in MATRICES or group[0] in ACCENTS):
        return _latex(group)
    return None


def _cells(group: _Group) -> str:
    return f" {_latex(group)} ".replace("#", " \\\\ ").replace("&amp;", "&")


def _latex(items: list) -> str:
    out: list[str] = []
    i = 0
    while i < len(items):
        x, i = items[i], i + 1
        if isinstance(x, _Group):
            whole = _takes_whole(x)
            piece = _braced(x) if whole is None else whole
            if i < len(items) and items[i] == "over":
                piece, i = r"\frac" + _braced(x), i + 1
            out.append(piece)
        elif x == "root" and _is_group(items, i) and items[i + 1 : i + 2] == ["of"] and _is_group(items, i + 2):
            out.append(rf"\sqrt[{_braced(items[i])[1:-1]}]{_braced(items[i + 2])}")
            i += 3
        elif x in MATRICES and _is_group(items, i):
            out.append(rf"\begin{{{MATRICES[x]}}}{_cells(items[i])}\end{{{MATRICES[x]}}}")
            i += 1
        elif x == "eqalign" and _is_group(items, i):
            out.append(rf"\eqalign{{{_cells(items[i])}}}")
            i += 1
        elif x in ACCENTS and _is_group(items, i):
            out.append(ACCENTS[x] + _braced(items[i]))
            i += 1
        elif x in BRACES and _is_group(items, i) and _is_group(items, i + 1):
            out.append(f"{BRACES[x]}{_braced(items[i])}^{_braced(items[i + 1])}")
            i += 2
        else:
            out.append(x)
    return " ".join(out)


def script_latex(script: str) -> str:
    """An equation script's LaTeX.

    ``over``, ``root`` and ``of`` count as words of their own, and only where the groups they need stand beside
    them; an unbalanced brace stays as text.
    """
    spaced = re.sub(r"([{}&])", r" \1 ", (script or "").replace("`", " "))
    return _latex(_grouped([t for t in spaced.split(" ") if t])).strip()


def _part(n: Node, tag: str) -> str:
    found = n.find(tag)
    return "".join(map(_math, found.kids)) if found else ""


def _scripted(n: Node, **marks: str) -> str:
    return "{" + _part(n, "e") + "}" + "".join(f"{mark}{{{_part(n, tag)}}}" for tag, mark in marks.items())


def _root(n: Node) -> str:
    degree = _part(n, "deg")
    return rf"\sqrt{f'[{degree}]' if degree else ''}{{{_part(n, 'e')}}}"


def _row(n: Node, sep: str) -> str:
    return sep.join("".join(map(_math, e.kids)) for e in n.all("e"))


_MATH = {
    "r": lambda n: "".join(t.text for t in n.all("t")),
    "f": lambda n: rf"\frac{{{_part(n, 'num')}}}{{{_part(n, 'den')}}}",
    "rad": _root,
    "sSup": lambda n: _scripted(n, sup="^"),
    "sSub": lambda n: _scripted(n, sub="_"),
    "sSubSup": lambda n: _scripted(n, sub="_", sup="^"),
    "nary": lambda n: rf"\sum {_part(n, 'e')}",
    "d": lambda n: rf"\left({_row(n, ' ')}\right)",
    "m": lambda n: r"\begin{matrix}" + r" \\ ".join(_row(line, " & ") for line in n.all("mr")) + r"\end{matrix}",
}


def _math(n: Node) -> str:
    return _MATH[n.tag](n) if n.tag in _MATH else "".join(map(_math, n.kids))


def office_math_latex(n: Node) -> str:
    """The LaTeX of an ``oMath`` or ``oMathPara`` element."""
    return _math(n).strip()


def _scripts(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda v: None if v is None else script_latex(v))


def _math_texts(elements: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return None if v is None else office_math_latex(read(v))
        except ParseError:
            return None

    return elements.map(one)


def script_latex_column(c: Column) -> Column:
    """`script_latex` of a column of equation scripts, by Arrow batches: the rewriting is recursive."""
    return F.pandas_udf(_scripts, "string")(c)


def office_math_column(c: Column) -> Column:
    """`office_math_latex` of a column of math elements as XML; null where that can't be read."""
    return F.pandas_udf(_math_texts, "string")(c)

"""The plain functions as Arrow-batched column functions. Each returns one struct or value, so that
a query that needs several of its fields evaluates it once; null in gives null out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from folioframe.functions import atoms as A
from folioframe.functions import latex as L
from folioframe.functions import tables as T
from folioframe.functions import tex as X
from folioframe.functions.lines import clean


def lazily(make: Callable) -> Callable:
    """Types are parsed by a session: the column function is made when it is first used."""
    made: list = []

    def use(*columns):
        if not made:
            made.append(make())
        return made[0](*columns)
    return use


def column(returns: str, f: Callable):
    """``f`` over a string column."""
    def make():
        if returns.startswith("struct"):
            names = [p.split(":")[0].strip() for p in _fields(returns)]

            def one(x: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([dict.fromkeys(names) if v is None else f(v) for v in x], columns=names)
            return F.pandas_udf(one, returns)

        def plain(x: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else f(v) for v in x], dtype=object)
        return F.pandas_udf(plain, returns)
    return lazily(make)


def column2(returns: str, f: Callable):
    """``f`` over two string columns, with a struct."""
    def make():
        names = [p.split(":")[0].strip() for p in _fields(returns)]

        def two(x: pd.Series, y: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([dict.fromkeys(names) if a is None or b is None else f(a, b) for a, b in zip(x, y)], columns=names)
        return F.pandas_udf(two, returns)
    return lazily(make)


def _fields(ddl: str) -> list[str]:
    inner, depth, out, start = ddl[ddl.index("<") + 1:ddl.rindex(">")], 0, [], 0
    for i, c in enumerate(inner + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append((inner + ",")[start:i])
            start = i + 1
    return out


lint = column("array<string>", L.lint)
normal_form = column("string", L.normal_form)
layout_form = column("string", lambda t: L.normal_form(L.split_tags(t)[0], True))
tags = column("struct<body:string,tags:array<string>>", lambda t: dict(zip(("body", "tags"), (lambda b, g: (b, [x[0] for x in g]))(*L.split_tags(t)))))
spans = column("struct<n:int,balanced:boolean>", lambda t: dict(zip(("n", "balanced"), (lambda s, b: (len(s), b))(*L.math_spans(t)))))
clean_output = column("struct<latex:string,error:string>", lambda t: dict(zip(("latex", "error"), L.clean_output(t))))
atoms = column("struct<n:int,symbols:array<string>,unsupported:array<string>>", lambda t: (lambda r: {"n": len(r["atoms"]), "symbols": [a["text"] for a in r["atoms"]], "unsupported": r["unsupported"]})(A.atoms(t)))
matrix_rows = column("struct<status:string,rows:int>", A.matrix_rows)
table = column("string", T.render_table)
clean_text = column("string", clean)
segments = column("array<struct<start:int,end:int,delim:string,env:string,body:string,line:int>>", X.segments)
score = column2("struct<strict:boolean,layout:boolean,loose:boolean,similarity:double,empty:boolean>", L.score)
compare = column2("struct<body:string,number:string,difference_count:int,differences:array<struct<a:array<string>,b:array<string>,truncated:boolean>>>", L.compare)
nfkc = column("string", lambda t: unicodedata.normalize("NFKC", t))
patch = column2("struct<latex:string,error:string>", lambda a, b: dict(zip(("latex", "error"), L.patch_equation(a, b))))

"""TeX sources: math segments in source order, macros, expansion, and the colour code of marked glyphs."""

from __future__ import annotations

import re

from folioframe.functions.latex import closing, lex

# Environments of displayed math and of verbatim text, and the expansion limit.
MATH_ENVIRONMENTS = frozenset(e + s for e in "equation align gather multline eqnarray flalign alignat displaymath math".split() for s in ("", "*"))
VERBATIM = frozenset("verbatim verbatim* lstlisting minted comment Verbatim".split())
EXPANSIONS = 2000
COLOUR_BASE = 40

_STEP = re.compile(r"(?P<comment>(?<!\\)%[^\n]*)|\\verb\*?(?P<q>[^a-zA-Z\s])(?:(?!(?P=q))[^\n])*(?P=q)|\\begin\s*\{(?P<env>[^}]*)\}|\\(?:re)?newcommand\*?|\\(?P<def>def)\b|(?P<open>\\\[|\\\(|\$\$|(?<!\\)\$)|\\.", re.S)


def _past_group(text: str, at: int) -> int:
    """Position after the balanced group at ``at`` (white space first), or ``at``."""
    m = re.compile(r"\s*\{").match(text, at)
    if not m:
        return at
    depth = 0
    for t, _, b in lex(text[m.end() - 1:]):
        depth += (t == "{") - (t == "}")
        if depth == 0:
            return m.end() - 1 + b
    return len(text)


def segments(text: str) -> list[dict]:
    """Math segments outside comments, verbatim text and definitions."""
    out: list[dict] = []
    at = 0
    ends = {"\\[": "\\]", "\\(": "\\)", "$$": "$$", "$": "$"}
    while m := _STEP.search(text, at):
        at = m.end()
        if m["env"] is not None:
            name = m["env"]
            if name in VERBATIM:
                end = text.find(f"\\end{{{name}}}", at)
                at = len(text) if end < 0 else end
            elif name in MATH_ENVIRONMENTS:
                depth, stop = 1, None
                for e in re.finditer(rf"\\(begin|end)\s*\{{{re.escape(name)}\}}", text[at:]):
                    depth += 1 if e[1] == "begin" else -1
                    if depth == 0:
                        stop = e
                        break
                if stop is None:
                    break
                out.append(_segment(text, m.start(), at + stop.end(), at, at + stop.start(), None, name))
                at += stop.end()
        elif m[0].startswith(("\\newcommand", "\\renewcommand")) or m["def"]:
            if m["def"]:
                brace = text.find("{", at)
                at = _past_group(text, brace) if brace >= 0 else len(text)
            else:
                at = _past_group(text, at) if re.match(r"\s*\{", text[at:]) else at + len(re.match(r"\s*(?:\\[a-zA-Z@]+)?", text[at:])[0])
                while o := re.match(r"\s*\[[^\]]*\]", text[at:]):
                    at += o.end()
                at = _past_group(text, at)
        elif m["open"]:
            mark = m["open"]
            body = at
            depth = 0
            stop = None
            for e in re.finditer(r"\\[a-zA-Z]+|\\.|\$\$?|[{}]|(?<!\\)%[^\n]*", text[at:], re.S):
                if e[0] in "{}":
                    depth += 1 if e[0] == "{" else -1
                elif depth <= 0 and (e[0] == ends[mark] or mark == "$" and e[0] == "$$"):
                    stop = e
                    break
            if stop is None:
                break
            size = 1 if mark == "$" else stop.end() - stop.start()
            out.append(_segment(text, m.start(), at + stop.start() + size, body, at + stop.start(), mark, None))
            at += stop.start() + size
    return out


def _segment(text, start, end, a, b, delim, env) -> dict:
    return {"start": start, "end": end, "delim": delim, "env": env, "body": text[a:b], "line": text.count("\n", 0, start) + 1}


_NEW = re.compile(r"\\(?P<how>newcommand|renewcommand|providecommand|DeclareMathOperator)\*?\s*(?:\{\s*\\(?P<a>[a-zA-Z@]+)\s*\}|\\(?P<b>[a-zA-Z@]+))\s*(?:\[(?P<n>\d)\])?\s*(?:\[(?P<opt>[^\]]*)\])?|\\def\s*\\(?P<c>[a-zA-Z@]+)(?P<args>(?:#\d)*)|\\let\s*\\(?P<d>[a-zA-Z@]+)\s*=?\s*(?P<to>\\[a-zA-Z@]+|.)")


def macros(text: str) -> dict[str, tuple[int, str | None, str]]:
    """name -> (arguments, default of the first, body). ``providecommand`` and ``def`` do not override."""
    clean = re.sub(r"(?<!\\)%[^\n]*", "", text)
    out: dict[str, tuple[int, str | None, str]] = {}
    for m in _NEW.finditer(clean):
        if m["d"]:
            out.setdefault(m["d"], (0, None, m["to"]))
            continue
        end = _past_group(clean, m.end())
        body = clean[m.end():end].strip()[1:-1]
        name = m["a"] or m["b"] or m["c"]
        if m["how"] == "DeclareMathOperator":
            out[name] = (0, None, f"\\operatorname{{{body}}}")
        else:
            got = (int(m["n"] or 0) if m["how"] else len(m["args"]) // 2, m["opt"], body)
            if m["how"] in ("newcommand", "renewcommand"):
                out[name] = got
            else:
                out.setdefault(name, got)
    return out


def expand(latex: str, known: dict[str, tuple[int, str | None, str]]) -> tuple[str, bool]:
    """Expand macros until none is left; False when the limit was met."""
    work = latex
    for _ in range(EXPANSIONS):
        ts = lex(work)
        hit = next(((i, t) for i, t in enumerate(ts) if t[0][:1] == "\\" and t[0][1:] in known), None)
        if hit is None:
            return work, True
        i, (name, a, b) = hit
        n, default, body = known[name[1:]]
        args: list[str] = []
        k = i + 1
        if default is not None and n:
            while k < len(ts) and ts[k][0].isspace():
                k += 1
            if k < len(ts) and ts[k][0] == "[":
                stop = next((j for j in range(k, len(ts)) if ts[j][0] == "]"), None)
                if stop is not None:
                    args.append(work[ts[k][2]:ts[stop][1]])
                    k = stop + 1
            if not args:
                args.append(default)
        while len(args) < n and k < len(ts):
            if ts[k][0].isspace():
                k += 1
            elif ts[k][0] == "{" and (stop := closing(ts, k)) is not None:
                args.append(work[ts[k][2]:ts[stop][1]])
                k = stop + 1
            else:
                args.append(ts[k][0])
                k += 1
        text = re.sub(r"#(\d)", lambda m: args[int(m[1]) - 1] if int(m[1]) <= len(args) else "", body)
        end = ts[k - 1][2] if n else b
        if re.search(r"\\[a-zA-Z]+$", text) and re.match("[a-zA-Z]", work[end:]):
            text += " "
        work = work[:a] + text + work[end:]
    return work, False


# ---------------------------------------------------------------- sources of a project

# Environments in which a row break may end the body.
ALIGNED = frozenset(e + s for e in "align gather eqnarray flalign alignat multline".split() for s in ("", "*"))
_INCLUDED = re.compile(r"\\(?:input|include|subfile)\s*\{(?P<file>[^}]+)\}|\\(?:sub)?import\s*\{(?P<folder>[^}]*)\}\s*\{(?P<part>[^}]+)\}")
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
_BEGIN = re.compile(r"\\begin\s*\{document\}")
_LAST_BREAK = re.compile(r"\\\\\s*(?:\[[^\]]*\])?\s*\Z")


def include_names(text: str, body_only: bool = False) -> list[str]:
    """Files that a source includes, as they are named; ``body_only``: from its document body."""
    plain = _COMMENT.sub(r"\1", text)
    if body_only:
        begin = _BEGIN.search(plain)
        plain = plain[begin.end():] if begin else ""
    return [m["file"] or (m["folder"] or "") + m["part"] for m in _INCLUDED.finditer(plain)]


def marker_positions(text: str, segment: dict) -> tuple[int, int]:
    """Where a marker opens and closes inside a segment's body: before a row break that ends an aligned one."""
    begin = text.index(segment["body"], segment["start"])
    body = segment["body"]
    last = _LAST_BREAK.search(body) if segment["env"] in ALIGNED else None
    return begin, begin + (last.start() if last else len(body))


def instrument(text: str, first: int = 0, main: bool = False, preamble: str = "") -> tuple[str, list[dict]]:
    """A source with a marker around every math segment, and the segments by number. Of a main file only the
    body is marked, and ``preamble`` goes before it."""
    begin = _BEGIN.search(text) if main else None
    if main and not begin:
        raise ValueError("a main file without a document body")
    head = text[:begin.start()] + preamble + text[begin.start():begin.end()] if begin else ""
    rest = text[begin.end():] if begin else text
    out, at, records = [head], 0, []
    for n, s in enumerate(segments(rest), first):
        a, b = marker_positions(rest, s)
        out += [rest[at:a], f"\\markB{{{n}}}", rest[a:b], "\\markE "]
        at = b
        records.append({"id": n, "delim": s["delim"], "env": s["env"], "line": s["line"] + (text.count("\n", 0, begin.end()) if begin else 0), "latex": s["body"]})
    return "".join([*out, rest[at:]]), records


_UNSUPPORTED = re.compile(r"\\(?:(?:New|Renew|Provide|Declare)(?:Document|Expandable(?:Document)?)Command|[exg]def)\s*\{?\s*\\([a-zA-Z@]+)")


def unsupported(text: str) -> set[str]:
    """Macros whose definitions are not followed."""
    return set(_UNSUPPORTED.findall(_COMMENT.sub(r"\1", text)))


def used_unsupported(latex: str, names: set[str]) -> list[str]:
    return sorted(names.intersection(re.findall(r"\\([a-zA-Z@]+)", latex)))

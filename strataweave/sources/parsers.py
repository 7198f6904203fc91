"""What a source file declares and imports.

Python is read by its own grammar (`ast`).  TypeScript, JavaScript, Rust and Go are read from tokens: declarations at
the outermost level, bodies by their brackets, and decisions by the tokens that make them (JSX text and tags have none);
that is exact for ordinary code and approximate where only a grammar could tell, such as conditional types in TypeScript.
Results have declared imports as written; functions.imports resolves them to paths.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from .lexer import BEFORE_VALUE, CLOSE, Token, script_tokens, tokens

SCRIPT = re.compile(r"<script([^>]*)>(.*?)</script>", re.S | re.I)
# What counts as a decision, by language.
PYTHON_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp, ast.match_case)
DECISIONS = {
    "typescript": frozenset(("if", "for", "while", "do", "catch", "case", "&&", "||")),
    "rust": frozenset(("if", "for", "while", "loop", "=>", "&&", "||", "?")),
    "go": frozenset(("if", "for", "case", "default", "&&", "||")),
}

#: How a name of a script begins.
NAME = re.compile(r"[^\W\d]|\$")


class Member(NamedTuple):
    name: str
    line_start: int
    line_end: int
    complexity: int


class Found(NamedTuple):
    functions: list[Member]
    classes: list[Member]
    imports: list[str]


def _closing(t: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    return next((j for j in range(i + 1, len(t)) if t[j].text in CLOSE and t[j].depth == t[i].depth), len(t) - 1)


def _body(t: list[Token], i: int, depth: int) -> int:
    """From a declaration at i: the place of its last token, a closing brace or what ends it without a body."""
    j = i
    while j < len(t):
        if t[j].depth == depth and t[j].text == "{":
            return _closing(t, j)
        if t[j].depth == depth and t[j].text == ";":
            return j
        j += 1
    return len(t) - 1


def _complexity(t: list[Token], a: int, b: int, language: str) -> int:
    part = t[a : b + 1]
    kinds = DECISIONS[language]
    n = 1 + sum(x.text in kinds for x in part)
    if language == "typescript":
        # a do's own while is no further decision; a ? before : , ) or = only marks what is optional
        n -= sum(x.text == "do" for x in part)
        n += sum(x.text == "?" and y.text not in (":", ",", ")", "=", ";", "]", "}") for x, y in zip(part, part[1:], strict=False))
    return n


def _member(t: list[Token], name: str, a: int, b: int, language: str, start: int | None = None) -> Member:
    return Member(name, t[a].line, t[b].end, _complexity(t, a if start is None else start, b, language))


def python(source: str) -> Found:
    """Top-level functions and classes without decorators; a module, and each name taken from it as one below it."""
    functions, classes, imports = [], [], []

    def member(node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) -> Member:
        n = 1 + sum(isinstance(x, PYTHON_DECISIONS) for x in ast.walk(node)) + sum(len(x.values) - 1 for x in ast.walk(node) if isinstance(x, ast.BoolOp))
        return Member(node.name, node.lineno, node.end_lineno or node.lineno, n)

    for node in ast.parse(source).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not node.decorator_list:
            functions.append(member(node))
        elif isinstance(node, ast.ClassDef) and not node.decorator_list:
            classes.append(member(node))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            imports += [module, *[f"{module}.{a.name}" for a in node.names if a.name != "*" and a.asname is None]]
        elif isinstance(node, ast.Import):
            imports.append(node.names[0].name)
    return Found(functions, classes, imports)


def _type_arguments_end(t: list[Token], i: int) -> int:
    """Behind the list of type arguments that < at i begins; i itself where it begins none."""
    depth = 0
    for j in range(i, len(t)):
        if t[j].depth == t[i].depth:
            depth += (t[j].text == "<") - (t[j].text == ">")
            if depth == 0:
                return j + 1
            if t[j].text == ";":
                return i
    return i


def _arrow(t: list[Token], i: int) -> bool:
    """Whether a value at i is a function expression or an arrow function, generic or not."""
    i += t[i].text == "async" if i < len(t) else 0
    if i < len(t) and t[i].text == "<":
        i = _type_arguments_end(t, i)
    if i >= len(t):
        return False
    if t[i].text == "function":
        return True
    if t[i].text != "(":
        return i + 1 < len(t) and t[i + 1].text == "=>" and NAME.match(t[i].text) is not None
    j = _closing(t, i) + 1
    if j < len(t) and t[j].text == ":":  # a type, up to the arrow; braces and arrows may be in it
        k = j + 1
        while k < len(t) and t[k].text not in ("=>", ";", "="):
            if t[k].text == "{" and t[k - 1].text not in (":", "|", "&", "<", ","):
                return False
            k = _closing(t, k) + 1 if t[k].text in ("(", "[", "{") else k + 1
        j = k
    return j < len(t) and t[j].text == "=>"


#: Marks and words that join what is before them with what comes, over a new line too.
GOES_ON = frozenset(". ?. => { } : ) ] ( [ , = + - * / % && || ?? ? | & ^ < > ! ~ instanceof in as satisfies extends".split())


def _statement_end(t: list[Token], i: int) -> int:
    """The last token of a statement at i: a semicolon, or what stands before a new line unless either side goes on."""
    for j in range(i + 1, len(t)):
        if t[j].depth != t[i].depth:
            continue
        if t[j].text == ";":
            return j
        twice = t[j - 1].text in ("+", "-") and t[j - 2].text == t[j - 1].text  # i++ ends a line
        if t[j].after_newline and t[j].text not in GOES_ON and (twice or t[j - 1].text not in GOES_ON - {")", "]", "}"} and t[j - 1].text not in BEFORE_VALUE):
            return j - 1
    return len(t) - 1


def typescript(source: str, offset: int = 0, jsx: bool = True) -> Found:
    """Functions, classes and constants that are functions, exported or not; imports of relative paths and of @/.

    Without jsx a < where a value may begin is a type's, as in files that can't hold elements.
    """
    t = script_tokens(source, jsx)
    functions, classes, imports = [], [], []
    i = 0
    while i < len(t):
        a = i
        while i < len(t) and t[i].text in ("export", "default", "declare", "abstract"):
            i += 1
        start = i
        text = t[i].text if i < len(t) else ""
        if text == "async" and i + 1 < len(t) and t[i + 1].text == "function":
            i += 1
            text = "function"
        if text == "function":
            name = i + 1 + (t[i + 1].text == "*" if i + 1 < len(t) else 0)
            end = _body(t, i, t[a].depth)
            if name < len(t) and NAME.match(t[name].text):
                functions.append(_member(t, t[name].text, start, end, "typescript"))
        elif text == "class" and i + 1 < len(t):
            end = _body(t, i, t[a].depth)
            classes.append(_member(t, t[i + 1].text, start, end, "typescript"))
        elif text in ("const", "let") and i + 1 < len(t):
            end = _statement_end(t, i)
            equals = next((j for j in range(i + 1, end + 1) if t[j].text == "=" and t[j].depth == t[i].depth), None)
            if equals is not None and NAME.match(t[i + 1].text) and _arrow(t, equals + 1):
                functions.append(_member(t, t[i + 1].text, start, end, "typescript", equals + 1))
        elif text == "import":
            end = next((j for j in range(i + 1, len(t)) if t[j].text[:1] in "'\"" and t[j].depth == t[i].depth), i)
            path = t[end].text.strip("'\"")
            if end > i and path.startswith((".", "@/")):
                imports.append(path)
        else:
            end = next((j for j in range(i, len(t)) if t[j].depth == t[a].depth and t[j].text in (";", "}")), len(t) - 1)
            # a statement without a semicolon ends before the next declaration
            end = next((j - 1 for j in range(i + 1, end + 1) if t[j].depth == t[a].depth and t[j].after_newline and t[j].text in ("export", "function", "class", "const", "let", "import", "async")), end)
        i = max(end + 1, a + 1)
    move = lambda m: m._replace(line_start=m.line_start + offset, line_end=m.line_end + offset)
    return Found([move(m) for m in functions], [move(m) for m in classes], imports)


def vue(source: str) -> Found:
    """The first script block as TypeScript, lines counted in the whole file."""
    block = SCRIPT.search(source)
    return typescript(block[2], source.count("\n", 0, block.start(2))) if block else Found([], [], [])


def rust(source: str) -> Found:
    """Functions, types, methods of impls as Type::name, use statements of the crate, and modules in files of their own."""
    t = tokens(source)
    functions, classes, imports = [], [], []
    i = 0
    while i < len(t):
        if t[i].text == "#":
            i = _closing(t, i + 1 + (t[i + 1].text == "!")) + 1 if i + 1 < len(t) else len(t)
            continue
        a = i
        while i < len(t) and t[i].text in ("pub", "async", "unsafe", "const", "extern", "default") and not (t[i].text == "const" and i + 1 < len(t) and t[i + 1].text not in ("fn", "unsafe", "async", "extern")):
            i = _closing(t, i + 1) + 1 if t[i].text == "pub" and i + 1 < len(t) and t[i + 1].text == "(" else i + 1
        if i >= len(t):
            break
        text, name = t[i].text, t[i + 1].text if i + 1 < len(t) else ""
        end = _body(t, i, t[a].depth)
        if text == "fn":
            functions.append(_member(t, name, a, end, "rust"))
        elif text in ("struct", "enum", "trait"):
            classes.append(_member(t, name, a, end, "rust"))
        elif text == "impl":
            brace = next((j for j in range(i, end) if t[j].text == "{" and t[j].depth == t[a].depth), end)
            head = [x.text for x in t[i + 1 : brace]]
            if "where" in head:
                head = head[: head.index("where")]
            if head[:1] == ["<"]:
                depth, j = 0, 0
                for j, x in enumerate(head):
                    depth += (x == "<") - (x == ">")
                    if depth == 0:
                        break
                head = head[j + 1 :]
            owner = "".join(head[head.index("for") + 1 :] if "for" in head else head)
            inner = t[brace].depth + 1
            for j in range(brace + 1, end):
                if t[j].text == "fn" and t[j].depth == inner:
                    first = j
                    while t[first - 1].text in ("pub", "async", "unsafe", "const", ")", "crate", "("):
                        first -= 1
                    functions.append(_member(t, f"{owner}::{t[j + 1].text}", first, _body(t, j, inner), "rust"))
        elif text == "use":
            end = next((j for j in range(i, len(t)) if t[j].text == ";" and t[j].depth == t[a].depth), end)
            imports.append("use " + "".join(x.text for x in t[i + 1 : end + 1]))
        elif text == "mod" and t[end].text == ";":
            imports.append(f"mod {name};")
        i = max(end + 1, a + 1)
    return Found(functions, classes, imports)


def go(source: str) -> Found:
    """Functions, methods as Type::name, struct and interface types, and imports; a second init is init_2 and so on."""
    t = tokens(source)
    functions, classes, imports, inits = [], [], [], 0
    i = 0
    while i < len(t):
        text, a = t[i].text, i
        end = i
        if text == "func" and i + 1 < len(t):
            end = next((j for j in range(i, len(t)) if t[j].text == "{" and t[j].depth == t[a].depth and not (t[j - 1].text in ("interface", "struct"))), len(t) - 1)
            end = _closing(t, end) if t[end].text == "{" else end
            if t[i + 1].text == "(":
                close = _closing(t, i + 1)
                owner = next((x.text for x in t[i + 2 : close][::-1] if re.match(r"[A-Za-z_]", x.text) and x.depth == t[i + 1].depth + 1), "")
                functions.append(_member(t, f"{owner}::{t[close + 1].text}", a, end, "go"))
            else:
                name = t[i + 1].text
                inits += name == "init"
                functions.append(_member(t, f"init_{inits}" if name == "init" and inits > 1 else name, a, end, "go"))
        elif text == "type" and i + 1 < len(t):
            end = _closing(t, i + 1) if t[i + 1].text == "(" else next((j for j in range(i + 1, len(t)) if t[j].depth == t[a].depth and (t[j].after_newline or t[j].text == "}")), len(t) - 1)
            for j in range(i + 1, end):
                if t[j + 1].text in ("struct", "interface") and re.match(r"[A-Za-z_]", t[j].text) and t[j].depth <= t[a].depth + 1:
                    brace = next((k for k in range(j, len(t)) if t[k].text == "{"), j)
                    close = _closing(t, brace)
                    classes.append(_member(t, t[j].text, j, close, "go"))
                    end = max(end, close)
        elif text == "import" and i + 1 < len(t):
            end = _closing(t, i + 1) if t[i + 1].text == "(" else next((j for j in range(i, len(t)) if t[j].text[:1] in "\"`"), i)
            imports += [x.text.strip("\"`") for x in t[i : end + 1] if x.text[:1] in "\"`"]
        i = max(end + 1, a + 1)
    return Found(functions, classes, imports)


PARSERS = {"python": python, "typescript": typescript, "javascript": typescript, "rust": rust, "go": go, "vue": vue}

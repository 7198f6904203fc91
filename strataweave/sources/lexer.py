"""Tokens of source files: plain ones, and those of scripts, which a stack of modes reads.

A script is in one of four modes: code; a template's text, whose ${} hold code; a tag of an element, whose attributes may
hold code or elements; and the text between an element's tags, which holds code in braces and further elements.  Text of
templates and elements gives no tokens, so quotes, words and question marks in it mean nothing; code inside gives its own,
one bracket deeper.  Where an element or a template begins and ends stands a token like that of a string.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|r#*\"(?:.*?)\"#*|b?\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)+'|'[A-Za-z_]\w*|[A-Za-z_$][\w$]*|\d[\w.]*|=>|&&|\|\||::|\?\.|\?\?|[^\w\s]", re.S)
#: The same for scripts, where templates are modes, a lone quote is no lifetime, and words may have letters beyond ASCII.
SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|=>|&&|\|\||\?\.(?!\d)|\?\?|[^\w\s]", re.S)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")

#: A regular expression between slashes, where a value may begin.
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: Words after which a value begins, as it does after most marks.
BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new instanceof yield await default".split())
#: A list of type parameters, where an element could begin as well: only they have a comma, a bound or a default there.
PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=|extends\s)")
#: An element's tag: a name (with dots, dashes or a colon), or none for a fragment.
TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
#: What a tag holds beside code, elements and its end.
ATTRIBUTE = re.compile(r"\s+|/\*.*?\*/|\"[^\"]*\"|'[^']*'|[^\s<>{}/\"']+|/(?!>)", re.S)


class Token(NamedTuple):
    text: str
    line: int
    end: int  # its last line
    depth: int
    after_newline: bool


def tokens(source: str) -> list[Token]:
    """Tokens without comments, with the depth of brackets that they are in (brackets: the depth outside)."""
    out, depth, line, at = [], 0, 1, 0
    fresh = True
    for match in TOKEN.finditer(source):
        begin, stop = match.span()
        line += source.count("\n", at, begin)
        fresh = fresh or "\n" in source[at:begin]
        text, at = match[0], stop
        end = line + text.count("\n")
        if not text.startswith(("//", "/*")):
            if text in CLOSE:
                depth = max(depth - 1, 0)
            out.append(Token(text, line, end, depth, fresh))
            if text in OPEN:
                depth += 1
            fresh = False
        line = end
    return out


def value_begins(out: list[Token]) -> bool:
    """Whether a slash or < after these tokens begins a value, not an operator."""
    last = out[-1].text if out else ""
    return last in BEFORE_VALUE or not (last in (")", "]", "}") or re.match(r"[\w$'\"`]", last))


class _Reader:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx = source, jsx
        self.at, self.line, self.counted = 0, 1, 0
        self.depth, self.fresh = 0, True
        self.out: list[Token] = []
        #: Modes from the outside in: code with the depth whose closing brace ends it, or another mode.
        self.modes: list[tuple[str, int]] = [("code", -1)]

    def emit(self, begin: int, stop: int, text: str, joined: bool = False) -> None:
        """A token of source[begin:stop]; joined if it goes on with what is before, whatever lines are between."""
        self.fresh = (self.fresh or "\n" in self.source[self.counted : begin]) and not joined
        self.line += self.source.count("\n", self.counted, begin)
        end = self.line + self.source.count("\n", begin, stop)
        if text in CLOSE:
            self.depth = max(self.depth - 1, 0)
        self.out.append(Token(text, self.line, end, self.depth, self.fresh))
        if text in OPEN:
            self.depth += 1
        self.line, self.counted, self.fresh = end, stop, False

    def read(self) -> list[Token]:
        steps = {"code": self.code, "template": self.template, "tag": self.tag, "text": self.text}
        while self.at < len(self.source):
            steps[self.modes[-1][0]]()
        return self.out

    def code(self) -> None:
        match = SCRIPT_TOKEN.search(self.source, self.at)
        if match is None:
            self.at = len(self.source)
            return
        begin, stop = match.span()
        text = match[0]
        self.at = stop
        if text.startswith(("//", "/*")):
            if "\n" in text:
                self.fresh = True
            return
        if text == "`":
            self.enter("template", begin, stop)
        elif text == "/" and value_begins(self.out) and (literal := REGEX.match(self.source, begin)):
            self.at = literal.end()
            self.emit(begin, self.at, literal[0])
        elif text == "<" and self.jsx and value_begins(self.out) and self.is_element(begin):
            self.at = TAG.match(self.source, begin).end()
            self.enter("tag", begin, self.at)
        else:
            self.emit(begin, stop, text)
            if text == "}" and self.depth == self.modes[-1][1]:
                self.modes.pop()

    def is_element(self, begin: int) -> bool:
        """An element has an end, of its own or a tag's; type arguments have neither."""
        if PARAMETERS.match(self.source, begin):
            return False
        name = TAG.match(self.source, begin)
        if re.compile(r"\s*/>").match(self.source, name.end()) or re.compile(r"</\s*" + re.escape(name[1] or "") + r"\s*>").search(self.source, name.end()):
            return True
        return re.compile(r"\s+[A-Za-z{]").match(self.source, name.end()) is not None and "/>" in self.source[name.end() :]

    def enter(self, mode: str, begin: int, stop: int) -> None:
        self.emit(begin, stop, "\"\"")
        self.depth += 1
        self.modes.append((mode, self.depth - 1))

    def leave(self, stop: int) -> None:
        """The end of an element or template; its token follows on what is before."""
        self.depth = self.modes.pop()[1]
        self.emit(stop - 1, stop, "\"\"", joined=True)

    def braces(self, begin: int, stop: int) -> None:
        """Code in braces inside text."""
        self.emit(begin, stop, "{", joined=True)
        self.modes.append(("code", self.depth - 1))

    def template(self) -> None:
        match = re.compile(r"\\.|`|\$\{", re.S).search(self.source, self.at)
        if match is None:
            self.at = len(self.source)
            return
        self.at = match.end()
        if match[0] == "`":
            self.leave(self.at)
        elif match[0] == "${":
            self.braces(*match.span())

    def tag(self) -> None:
        source, at = self.source, self.at
        if source.startswith("/>", at):
            self.at = at + 2
            self.leave(self.at)
        elif source[at] == ">":
            self.at = at + 1
            self.modes[-1] = ("text", self.modes[-1][1])
        elif source[at] == "{":
            self.at = at + 1
            self.braces(at, at + 1)
        elif source[at] == "<":
            self.at = TAG.match(source, at).end()
            if source[:at].rstrip().endswith("="):  # an element as an attribute's value
                self.enter("tag", at, self.at)
            else:  # type arguments of the element
                depth = 1
                while depth and self.at < len(source):
                    depth += (source[self.at] == "<") - (source[self.at] == ">")
                    self.at += 1
        else:
            match = ATTRIBUTE.match(source, at)
            self.at = match.end() if match else at + 1

    def text(self) -> None:
        match = re.compile(r"</[^>]*>|<|\{").search(self.source, self.at)
        if match is None:
            self.at = len(self.source)
            return
        begin, self.at = match.span()
        if match[0].startswith("</"):
            self.leave(self.at)
        elif match[0] == "{":
            self.braces(begin, self.at)
        else:
            self.at = TAG.match(self.source, begin).end()
            self.enter("tag", begin, self.at)


def script_tokens(source: str, jsx: bool = True) -> list[Token]:
    """Tokens of a script without comments; with jsx also elements are read, where only they can stand."""
    return _Reader(source, jsx).read()

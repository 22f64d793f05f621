"""Patterns: placeholders with types, and portable regular expressions spelt so that Java reads them alike.

The portable dialect matches in linear time and knows no look-around, back references or possessive forms. Where Java
gives the same letters another meaning, they are written out: `$` is the end of the text alone, `.` and line anchors
know only \\n as the end of a line, `&&` in a class is two characters, \\s leaves out the vertical tab, \\b and (?i) go by
ASCII words and full case folding, (?U) turns greed around, POSIX classes are real classes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .values import FLOAT, INT, GridError

# What each placeholder matches, and its kind.
PLACEHOLDERS = {"d": (r"[+-]?\d+", "int"), "f": (r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", "float"), "w": (r"\S+", "string")}
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
TYPES = {"int": ("bigint", INT), "float": ("double", FLOAT), "string": ("string", None)}
MOST_REPEATS = 1000
BLANKS = r"\t\n\f\r "
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Letters after a backslash that mean the same in Java; others are written out or refused.
_SAME = frozenset("AzdDwWQEpPtnfrxa")
#: Begins the name of a placeholder's group; no written name can.
_MARK = "\ue000"
_COUNT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


@dataclass(frozen=True)
class Pattern:
    regex: str
    kinds: tuple[str, ...]
    #: The pattern cut at its groups, (text, is group), where they stand side by side and none is repeated; else None.
    pieces: tuple[tuple[str, bool], ...] | None = None


def _refuse(what: str) -> GridError:
    return GridError("E402", what)


def _placeholders(source: str, word: str) -> str:
    def group(m: re.Match[str]) -> str:
        kind = m[1]
        if kind == "%":
            return "%"
        if kind not in PLACEHOLDERS:
            raise _refuse(f"unknown placeholder %{kind}" if kind else "unfinished placeholder")
        return f"(?P<{_MARK}{kind}>{word if kind == 'w' else PLACEHOLDERS[kind][0]})"

    return re.sub(r"%(.?)", group, source, flags=re.S)


class _Reader:
    """One pass over the pattern; flags are kept by group."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.kinds = text, 0, []
        self.out: list[str] = []
        self.flags = [{"i": False, "m": False, "s": False, "U": False}]
        self.open: list[bool] = []  # groups that are open: do they capture
        self.cuts: list[tuple[int, int]] = []  # pieces of `out` that are a capturing group at the top
        self.apart = True  # whether the groups stand side by side

    def read(self) -> Pattern:
        while self.at < len(self.text):
            self._token()
        if self.open:
            raise _refuse("a group isn't closed")
        if not self.apart:
            return Pattern("(?d)" + "".join(self.out), tuple(self.kinds))
        pieces, last = [], 0
        for a, b in self.cuts:
            pieces += [("".join(self.out[last:a]), False), ("".join(self.out[a:b]), True)]
            last = b
        return Pattern("(?d)" + "".join(self.out), tuple(self.kinds), (*pieces, ("".join(self.out[last:]), False)))

    def _take(self, n: int = 1) -> str:
        piece = self.text[self.at : self.at + n]
        self.at += n
        return piece

    def _token(self) -> None:
        c = self.text[self.at]
        if c == "(":
            self._open_group()
        elif c == ")":
            if not self.open:
                raise _refuse("a group isn't opened")
            self._take()
            self.out.append(")")
            self.flags.pop()
            if self.open.pop() and not self.open:
                self.cuts[-1] = (self.cuts[-1][0], len(self.out))
            self._repeat(group=True)
        elif c == "|":
            self.out.append(self._take())
            self.apart = self.apart and bool(self.open)
        elif c in "*+?":
            raise _refuse(f"nothing to repeat before {c}")
        elif c in "^$":
            self._take()
            many = self.flags[-1]["m"]
            self.out.append({"^": r"(?:^|(?<=\n))" if many else "^", "$": r"(?=\n|\z)" if many else r"\z"}[c])
            self._repeat()
        else:
            if c == "[":
                self.out.append(self._set())
            elif c == "\\":
                self.out.append(self._escape(False))
            else:
                self._take()
                self.out.append(("(?s:.)" if self.flags[-1]["s"] else r"[^\n]") if c == "." else "\\" + c if c in "{}]" else c)
            self._repeat()

    def _open_group(self) -> None:
        if m := re.match(r"\(\?P?<([^>]*)>", self.text[self.at :]):
            name = m[1]
            if name[:1] in ("=", "!") or not (re.fullmatch(r"\w+", name) or name.startswith(_MARK)):
                raise _refuse("look-around isn't supported")
            self._take(m.end())
            self._enter({_MARK + "d": "int", _MARK + "f": "float"}.get(name, "string"))
        elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", self.text[self.at :]):
            self._take(m.end())
            now = {**self.flags[-1], **dict.fromkeys(m[1], True), **dict.fromkeys(m[2] or "", False)}
            case = {True: "(?iu)", False: "(?-iu)"}[now["i"]] if now["i"] != self.flags[-1]["i"] else ""
            if m[3] == ")":
                self.flags[-1] = now
                self.out.append(case)
            else:
                self.flags.append(now)
                self.open.append(False)
                self.out.append("(?:" + case)
        elif self.text.startswith("(?", self.at):
            raise _refuse("look-around and other special groups aren't supported")
        else:
            self._take()
            self._enter("string")

    def _enter(self, kind: str) -> None:
        self.apart = self.apart and not self.open
        self.cuts.append((len(self.out), 0))
        self.kinds.append(kind)
        self.flags.append(dict(self.flags[-1]))
        self.open.append(True)
        self.out.append("(")

    def _repeat(self, group: bool = False) -> None:
        rest = self.text[self.at :]
        count = _COUNT.match(rest)
        if count:
            if max(int(count[1]), int(count[3] or 0)) > MOST_REPEATS or (count[3] and int(count[3]) < int(count[1])):
                raise _refuse(f"bad repetition {count[0]}")
            sign = self._take(count.end())
        elif rest[:1] in ("*", "+", "?") and rest:
            sign = self._take()
        else:
            return
        lazy = self.text.startswith("?", self.at)
        self._take(int(lazy))
        rest = self.text[self.at :]
        if rest[:1] in ("*", "+", "?") and rest or _COUNT.match(rest):
            raise _refuse("possessive and nested repetition isn't supported")
        self.out.append(sign + ("?" if lazy != self.flags[-1]["U"] else ""))
        if group and self.cuts and self.cuts[-1][1] == len(self.out) - 1:
            self.apart = False

    def _escape(self, in_set: bool) -> str:
        c = self._take(2)[1:]
        if c == "Q":
            end = self.text.find("\\E", self.at)
            quoted = self._take((end if end >= 0 else len(self.text)) - self.at)
            self._take(2)
            return re.sub(r"([^\w\s])", r"\\\1", quoted, flags=re.A)
        if c in ("p", "P"):
            m = re.match(r"\{(\^?)([A-Za-z_]+)\}|()([A-Z])", self.text[self.at :])
            if not m:
                raise _refuse("bad class name")
            self._take(m.end())
            name = m[2] or m[4]
            negated = (c == "P") != bool(m[1])
            return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c == "x":
            m = re.match(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}", self.text[self.at :])
            if not m:
                raise _refuse("bad code point")
            return "\\x" + self._take(m.end())
        if c == "s":
            return BLANKS if in_set else f"[{BLANKS}]"
        if c == "S":
            return f"[^{BLANKS}]"
        if c == "v":
            return r"\x0B"
        if c in ("b", "B") and not in_set:
            return EDGE if c == "b" else NO_EDGE
        if c == "" or (c.isalnum() and c not in _SAME) or (in_set and c in "AzQE"):
            raise _refuse(f"\\{c} isn't supported")
        return "\\" + c

    def _set(self) -> str:
        self._take()
        out = ["["]
        if self.text.startswith("^", self.at):
            out.append(self._take())
        first = True
        while True:
            if self.at >= len(self.text):
                raise _refuse("a class isn't closed")
            c = self.text[self.at]
            if c == "]" and not first:
                self._take()
                return "".join(out) + "]"
            first = False
            if m := re.match(r"\[:(\^?)(\w+):\]", self.text[self.at :]):
                if m[2] not in POSIX:
                    raise _refuse(f"unsupported class {m[0]}")
                self._take(m.end())
                out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
            elif c == "\\":
                out.append(self._escape(True))
            else:
                self._take()
                out.append("\\" + c if c in "[]&^" else c)


def translate(source: str, word: str = PLACEHOLDERS["w"][0]) -> Pattern:
    """The pattern for Java, the kinds of its groups, and its pieces."""
    return _Reader(_placeholders(source, word)).read()


def compile_pattern(source: str, word: str = PLACEHOLDERS["w"][0]) -> Pattern:
    """As `translate`, for extraction: `%d`, `%f`, `%w` are typed groups, `%%` a per cent sign, and a group is needed."""
    pattern = translate(source, word)
    if not pattern.kinds:
        raise _refuse("a pattern needs a group or placeholder")
    return pattern

"""Token classes of source texts, one function per language.

``tokens(language, text)`` gives ``(classes, starts)``. Keywords and punctuation
are their own classes; names, numbers and strings have one class each; a
character or string that can't be lexed is the class ``BAD``, which no grammar
takes.
"""

from __future__ import annotations

import re

Tokens = tuple[list[str], list[int]]

_NUM = r"0[xX][0-9a-fA-F_]+[nlL]?|0[bB][01_]+[nlL]?|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[nlLfFdDjJri]?"
_NAME = r"[^\W\d]\w*"


def words(text: str) -> frozenset[str]:
    """A set of space-separated words."""
    return frozenset(text.split())


JS_KEYWORDS = words(
    "break case catch class const continue default delete do else export extends finally for function if import in instanceof "
    "new return switch throw try typeof var void while let yield await async static get set of from as"
)
TS_KEYWORDS = JS_KEYWORDS | words(
    "type interface enum namespace declare abstract implements public private protected readonly override keyof infer is satisfies unique asserts"
)
GO_KEYWORDS = words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
)
JAVA_KEYWORDS = words(
    "abstract assert break case catch class const continue default do else enum extends final finally for if implements import instanceof "
    "interface native new package private protected public return static strictfp switch synchronized throw throws transient try volatile while "
    "record sealed permits non yield var"
)
PY_KEYWORDS = words(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass "
    "raise return try while with yield match case type"
)
RB_KEYWORDS = words(
    "alias and begin break case class def defined? do else elsif end ensure for if in module next not or redo rescue retry return then undef unless until "
    "when while yield BEGIN END"
)

_JS = re.compile(
    r"(?P<ws>[ \t\f\v ﻿]+)|(?P<nl>[\n  ])|(?P<com>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)"
    r'|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')'
    rf"|(?P<num>{_NUM})|(?P<name>#?[$\w\\]+)"
    r"|(?P<op>\.\.\.|=>|\?\.(?!\d)|===|!==|==|!=|<=|>=|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
#: After these a slash begins a regular expression.
_JS_OPERAND_END = frozenset(["ID", "NUM", "STR", "REGEX", "TPL", "TPLE", ")", "]", "}"])
_JS_NO_BREAK_BEFORE = frozenset(
    "... => ?. === !== == != <= >= **= ** &&= ||= ??= && || ?? << <<= += -= *= /= %= &= |= ^= + - * / % & | ^ < > = ? : ; , . ) ] } in instanceof of catch finally as satisfies extends implements is from (".split()
    + ["["]
)
_JS_NO_BREAK_AFTER = frozenset(
    "... => ?. === !== == != <= >= **= ** &&= ||= ??= && || ?? << <<= += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < = ? : ; , . ( [ { @ "
    "in instanceof new typeof void delete else do try finally case extends implements const var let function class import throw keyof is".split()
)


def _javascript(text: str, keywords: frozenset[str]) -> Tokens:
    classes: list[str] = []
    starts: list[int] = []
    at, size, broke = 0, len(text), False
    last = ""
    braces: list[int] = []  # open braces within each ${ }
    match, regex = _JS.match, _JS_REGEX.match

    def template(at: int, opening: bool) -> int:
        nonlocal last
        end = _TEMPLATE.match(text, at).end()
        if end >= size:
            last = "BAD"
        elif text[end] == "`":
            last, end = "TPL" if opening else "TPLE", end + 1
        else:
            last, end = "TPL0" if opening else "TPLM", end + 2
            if opening:
                braces.append(0)
            else:
                braces[-1] = 0
        if last == "TPLE":
            braces.pop()
        return end

    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    while at < size:
        char = text[at]
        begin = at
        if char == "`":
            cls = ""
            previous = last
            at = template(at + 1, True)
            cls, last = last, previous
        elif char == "}" and braces and braces[-1] == 0:
            previous = last
            at = template(at + 1, False)
            cls, last = last, previous
        elif char == "/" and last not in _JS_OPERAND_END and (m := regex(text, at)):
            cls, at = "REGEX", m.end()
        else:
            m = match(text, at)
            if m is None:
                cls, at = "BAD", size
            else:
                at, kind = m.end(), m.lastgroup
                if kind == "ws":
                    continue
                if kind == "nl":
                    broke = True
                    continue
                if kind == "com":
                    broke = broke or "\n" in m[0]
                    continue
                if kind == "name":
                    word = m[0]
                    cls = word if word in keywords else "ID"
                elif kind == "str":
                    cls = "STR"
                elif kind == "num":
                    cls = "NUM" if at >= size or not (text[at].isalnum() or text[at] in "_$") else "BAD"
                else:
                    cls = m[0]
                    if braces:
                        braces[-1] += (cls == "{") - (cls == "}")
        # a semicolon may be left out at a line end and before a closing brace
        if (broke and last and last not in _JS_NO_BREAK_AFTER and cls not in _JS_NO_BREAK_BEFORE) or (cls == "}" and last not in ("{", ";", ",")):
            classes.append(";")
            starts.append(begin)
        broke = False
        classes.append(cls)
        starts.append(begin)
        last = cls
        if cls == "BAD":
            break
    if last not in ("", ";", "BAD"):
        classes.append(";")
        starts.append(size)
    return classes, starts


_GO = re.compile(
    r"(?P<ws>[ \t\f\v]+)|(?P<nl>\n)|(?P<com>//[^\n]*)|(?P<mcom>/\*(?:[^*]|\*(?!/))*\*/)"
    r'|(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.[^\'\n]*)\')'
    rf"|(?P<num>{_NUM})|(?P<name>{_NAME})"
    r"|(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<-|&&|\|\||\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^~!<>=:;,.(){}\[\]])"
)
_GO_ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _go(text: str) -> Tokens:
    classes: list[str] = []
    starts: list[int] = []
    at, size = 0, len(text)
    match = _GO.match
    while at < size:
        m = match(text, at)
        if m is None:
            classes.append("BAD")
            starts.append(at)
            return classes, starts
        kind, begin, at = m.lastgroup, at, m.end()
        if kind in ("ws", "com"):
            continue
        if kind == "nl" or kind == "mcom":
            if (kind == "nl" or "\n" in m[0]) and classes and classes[-1] in _GO_ENDS:
                classes.append(";")
                starts.append(begin)
            continue
        word = m[0]
        classes.append(
            (word if word in GO_KEYWORDS else "ID") if kind == "name" else "STR" if kind == "str" else "NUM" if kind == "num" else word
        )
        starts.append(begin)
    if classes and classes[-1] in _GO_ENDS:
        classes.append(";")
        starts.append(size)
    return classes, starts


_JAVA = re.compile(
    r"(?P<ws>\s+|\x1a)|(?P<com>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)"
    r'|(?P<str>"""[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\'\n]+|\\\')\')'
    rf"|(?P<num>{_NUM})|(?P<name>[$\w]+)"
    r"|(?P<op>\.\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
_JSON = re.compile(
    r'(?P<ws>[ \t\n\r]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)'
    r"|(?P<name>true|false|null)|(?P<op>[{}\[\],:])"
)


def _plain(text: str, pattern: re.Pattern, keywords: frozenset[str]) -> Tokens:
    classes: list[str] = []
    starts: list[int] = []
    at, size, match = 0, len(text), pattern.match
    while at < size:
        m = match(text, at)
        if m is None:
            classes.append("BAD")
            starts.append(at)
            break
        kind, begin, at = m.lastgroup, at, m.end()
        if kind in ("ws", "com"):
            continue
        word = m[0]
        if kind == "num" and at < size and (text[at].isalnum() or text[at] == "_"):
            classes.append("BAD")
            starts.append(begin)
            break
        classes.append(
            (word if word in keywords else "ID") if kind == "name" else "STR" if kind == "str" else "NUM" if kind == "num" else word
        )
        starts.append(begin)
    return classes, starts


_PY = re.compile(
    r"(?P<ws>[ \t\f]+|\\\n)|(?P<nl>\n)|(?P<com>#[^\n]*)"
    r'|(?P<str>(?i:[rbuft]{0,2})(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'))'
    rf"|(?P<num>{_NUM})|(?P<name>{_NAME})"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
#: These are names unless they begin a statement of their own.
_PY_SOFT = frozenset(["match", "case", "type"])


def _python(text: str) -> Tokens:
    classes: list[str] = []
    starts: list[int] = []
    at, size, depth = 0, len(text), 0
    indents = [0]
    fresh = True  # at the begin of a logical line
    match = _PY.match
    while at < size:
        if fresh:
            line = at
            while at < size and text[at] in " \t\f":
                at += 1
            if at >= size:
                break
            if text[at] == "\n":
                at += 1
                continue
            if text[at] == "#":
                end = text.find("\n", at)
                at = size if end < 0 else end + 1
                continue
            width = len(text[line:at].expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                classes.append("INDENT")
                starts.append(at)
            while width < indents[-1]:
                indents.pop()
                classes.append("DEDENT" if width >= indents[-1] or len(indents) > 1 else "BAD")
                starts.append(at)
            if width != indents[-1]:
                classes.append("BAD")
                starts.append(at)
                return classes, starts
            fresh = False
        m = match(text, at)
        if m is None:
            classes.append("BAD")
            starts.append(at)
            return classes, starts
        kind, begin, at = m.lastgroup, at, m.end()
        if kind in ("ws", "com"):
            continue
        if kind == "nl":
            if not depth:
                classes.append("NEWLINE")
                starts.append(begin)
                fresh = True
            continue
        word = m[0]
        if kind == "name":
            cls = word if word in PY_KEYWORDS else "ID"
        elif kind == "str":
            cls = "STR"
        elif kind == "num":
            cls = "NUM" if at >= size or not (text[at].isalnum() or text[at] == "_") else "BAD"
            if cls == "BAD" and _NAME and re.match(r"(?:if|else|and|or|in|is|for)\b", text[at:]):
                cls = "NUM"
        else:
            cls = word
            if word in "([{":
                depth += 1
            elif word in ")]}":
                depth -= 1
        classes.append(cls)
        starts.append(begin)
    if not depth:
        if not fresh:
            classes.append("NEWLINE")
            starts.append(size)
        classes.extend(["DEDENT"] * (len(indents) - 1))
        starts.extend([size] * (len(indents) - 1))
    return classes, starts


_RB = re.compile(
    r"(?P<ws>[ \t\f\v]+|\\\n)|(?P<nl>\n)|(?P<com>#[^\n]*)"
    rf"|(?P<num>{_NUM})|(?P<ivar>@@?{_NAME}|\$(?:{_NAME}|[0-9~!@&`'+*$?:\"<>,./\;]))"
    rf"|(?P<name>{_NAME}[?!]?(?![=~])|{_NAME})"
    r"|(?P<op>\*\*=|<=>|===|\.\.\.|&&=|\|\|=|<<=|>>=|\*\*|==|!=|=~|!~|>=|<=|=>|->|&&|\|\||::|\.\.|&\.|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.(){}\[\]])"
)
_RB_HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Za-z_]\w*)\2")
_RB_PERCENT = re.compile(r"%([wWiIqQrs]?)([(\[{<|!/])")
_RB_SYMBOL = re.compile(rf":(?:{_NAME}[?!=]?(?!=)|{_NAME}|\[\]=?|[+*/<>=!~%&|^-]+)")
_RB_REGEX = re.compile(r"/(?:[^/\\\n]|\\.)*/[a-z]*")
_RB_MODULE = re.compile(r"[ \t]+(?:::)?[A-Z]")
_RB_OPERAND_END = frozenset(["ID", "CONST", "NUM", "STR", "SYM", "IVAR", ")", "]", "}", "end", "REGEX"])
_RB_NO_BREAK_AFTER = frozenset(
    "** <=> === == != =~ !~ >= <= => -> && || :: .. ... &. << >> += -= *= /= %= &= |= ^= **= &&= ||= <<= >>= + - * / % & ^ ! ~ < > = ? : , . ( [ { and or not".split()
)
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _ruby_string(text: str, at: int, quote: str) -> int:
    """End of a string with interpolation that begins behind the quote, or -1."""
    size = len(text)
    while at < size:
        char = text[at]
        if char == "\\":
            at += 2
        elif char == quote:
            return at + 1
        elif char == "#" and quote != "'" and text.startswith("#{", at):
            depth, at = 1, at + 2
            while at < size and depth:
                inner = text[at]
                if inner in "\"'`":
                    at = _ruby_string(text, at + 1, inner)
                    if at < 0:
                        return -1
                    continue
                depth += (inner == "{") - (inner == "}")
                at += 1
        else:
            at += 1
    return -1


def _ruby(text: str) -> Tokens:
    classes: list[str] = []
    starts: list[int] = []
    at, size = 0, len(text)
    pending: list[tuple[str, bool]] = []  # heredocs whose bodies begin on the next line
    last, spaced = "", False
    match = _RB.match
    while at < size:
        char, begin = text[at], at
        if text.startswith("=begin", at) and (at == 0 or text[at - 1] == "\n"):
            end = text.find("\n=end", at)
            if end < 0:
                classes.append("BAD")
                starts.append(at)
                break
            after = text.find("\n", end + 1)
            at = size if after < 0 else after
            continue
        if text.startswith("__END__", at) and (at == 0 or text[at - 1] == "\n") and text[at + 7 : at + 8] in ("", "\n"):
            break
        operand = last in _RB_OPERAND_END
        cls = ""
        if char in "\"'`":
            end = _ruby_string(text, at + 1, char)
            cls, at = ("STR", end) if end >= 0 else ("BAD", size)
            if cls == "STR" and text[at : at + 1] == ":" and text[at : at + 2] != "::" and last in ("{", ",", "("):
                cls, at = "LABEL", at + 1
        elif char == "<" and (not operand or (last == "ID" and spaced)) and (m := _RB_HEREDOC.match(text, at)):
            pending.append((m[3], bool(m[1])))
            cls, at = "STR", m.end()
        elif char == "%" and (not operand or (last == "ID" and spaced and text[at + 1 : at + 2] not in (" ", "="))) and (m := _RB_PERCENT.match(text, at)):
            close, depth, at = _CLOSERS.get(m[2], m[2]), 1, m.end()
            while at < size and depth:
                if text[at] == "\\":
                    at += 1
                elif text[at] == close:
                    depth -= 1
                elif text[at] == m[2]:
                    depth += 1
                at += 1
            cls = "BAD" if depth else "STR"
        elif char == ":" and text[at + 1 : at + 2] in ('"', "'"):
            end = _ruby_string(text, at + 2, text[at + 1])
            cls, at = ("SYM", end) if end >= 0 else ("BAD", size)
        elif char == ":" and text[at + 1 : at + 2] != ":" and (not operand or spaced) and (m := _RB_SYMBOL.match(text, at)):
            cls, at = "SYM", m.end()
        elif char == "/" and (not operand or (last == "ID" and spaced and text[at + 1 : at + 2] not in (" ", "="))) and (m := _RB_REGEX.match(text, at)):
            cls, at = "REGEX", m.end()
        else:
            m = match(text, at)
            if m is None:
                cls, at = "BAD", size
            else:
                kind, at, word = m.lastgroup, m.end(), m[0]
                if kind in ("ws", "com"):
                    spaced = True
                    continue
                if kind == "nl":
                    for name, loose in pending:
                        body = re.compile(rf"^{'[ ]*' if loose else ''}[ \t]*{name}[ \t]*$" if loose else rf"^{name}$", re.M).search(text, at)
                        if body is None:
                            classes.append("BAD")
                            starts.append(at)
                            return classes, starts
                        at = min(body.end() + 1, size)
                    pending = []
                    spaced = True
                    if last and last not in _RB_NO_BREAK_AFTER and last != "NL" and not re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*(?:\.(?!\.)|&\.)").match(text, at):
                        classes.append("NL")
                        starts.append(begin)
                        last = "NL"
                    continue
                if kind == "name":
                    label = text[at : at + 1] == ":" and text[at : at + 2] != "::" and last != "?" and last != "."
                    if label:
                        cls, at = "LABEL", at + 1
                    elif word == "module" and not _RB_MODULE.match(text, at):
                        cls = "ID"  # sources use it as a name
                    elif word in RB_KEYWORDS and last not in (".", "&.", "def"):
                        cls = word
                    else:
                        cls = "CONST" if word[0].isupper() else "ID"
                elif kind == "num":
                    cls = "NUM" if at >= size or not (text[at].isalnum() or text[at] == "_") else "BAD"
                else:
                    cls = "IVAR" if kind == "ivar" else word
                    if cls == ";":
                        if last in ("", "NL"):
                            continue
                        cls = "NL"
                    if cls == "[" and operand and not spaced:
                        cls = "INDEX"
                    elif cls == "(" and operand and not spaced:
                        cls = "CALL"
        if cls == "BAD":
            classes.append(cls)
            starts.append(begin)
            break
        classes.append(cls)
        starts.append(begin)
        last, spaced = cls, False
    if pending:
        classes.append("BAD")
        starts.append(size)
    return classes, starts


def tokens(language: str, text: str) -> Tokens:
    """Token classes of a text and where they start; line ends and a leading mark don't matter."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language == "javascript":
        return _javascript(text, JS_KEYWORDS)
    if language == "typescript":
        return _javascript(text, TS_KEYWORDS)
    if language == "go":
        return _go(text)
    if language == "java":
        return _plain(text, _JAVA, JAVA_KEYWORDS)
    if language == "json":
        return _plain(text, _JSON, words("true false null"))
    if language == "python":
        return _python(text)
    return _ruby(text)

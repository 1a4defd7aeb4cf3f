"""Lexers for Python, JavaScript and TypeScript (problem 2).

A lexer turns a file into its shape: one line of tokens a line, where names are ``a``, numbers ``n``, strings and
regular expressions ``s``, comments nothing, and keywords and marks themselves. A quote that opens no complete
literal stays in the shape, where no rule accepts it.
"""

from __future__ import annotations

import re

# Words with a meaning of their own, by language.
PYTHON_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case".split()
)
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
JS_CONTEXTUAL = frozenset("as async await from get let of set static yield accessor".split())
TS_CONTEXTUAL = frozenset("abstract asserts declare global implements infer interface is keyof module namespace override private protected public readonly satisfies type unique".split())

_PY = re.compile(
    r"""([^\W\d]\w*+(?!["']))"""
    r"""|[rRbBuUfFtT]{0,2}(\"\"\"[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')"""
    r"""|(\#[^\n]*|\f)"""
    r"""|(\\\n)"""
    r"""|((?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?!\w))""",
    re.S,
)
_COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_STRING = r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_WORD = r"#?[A-Za-z_$\u0080-\U0010ffff][\w$]*"
_JS = re.compile(
    rf"((?:[=(,\[!&|?{{;:+\-*%~^]|=>|\b(?:return|typeof|case|of|in))\s*+){_REGEX}"
    rf"|({_WORD})"
    rf"|({_STRING})"
    rf"|({_COMMENT})"
    r"|(`[^`\\$]*(?:(?:\\.|\$(?!\{)|\$\{[^`{}\"'/]*\})[^`\\$]*)*`)"
    rf"|({_NUMBER})",
    re.S,
)
_GENERIC = re.compile(r"(?<=[\w\]])<(?=[\w\[{(])[\w\s,.\[\]|?:'{};]*>(?=\s*(?:[(){},;>=|&\[\]\n]|extends|implements|$))")
#: What follows a mark or such a word in JSX and regular expressions is an operand.
_BEFORE_OPERAND = frozenset("( [ { , ; = : ? ! & | + - * % ~ ^ > => && || ?? return typeof case default of in do else yield await".split())
_SLOW = re.compile(rf"(\s+|{_COMMENT})|({_WORD})|({_STRING})|({_NUMBER})|(=>|&&|\|\||\?\?|\S)", re.S)
_TAG = re.compile(r"(\s+|[\w$.:-]+|=|\"[^\"]*\"|'[^']*')|(\{)|(/>)|(>)")


class Unterminated(Exception):
    """A literal or element without an end."""


def lines_of(source: str) -> str:
    return source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def python_shape(source: str) -> str:
    def token(m, words=PYTHON_WORDS):
        kind = m.lastindex
        if kind == 1:
            w = m[1]
            return w if w in words else "a"
        return ("s", "", " ", "n")[kind - 2]

    return _PY.sub(token, lines_of(source))


def javascript_shape(source: str, typescript: bool, jsx: bool) -> str:
    text = lines_of(source)
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    words = JS_RESERVED | JS_CONTEXTUAL | TS_CONTEXTUAL if typescript else JS_RESERVED | JS_CONTEXTUAL
    if jsx and ("</" in text or "/>" in text):
        shape = _scanned(text, words, True)
    else:

        def token(m):
            kind = m.lastindex
            if kind == 2:
                w = m[2]
                return w if w in words else "a"
            if kind == 1:
                return m[1] + " s"
            if kind == 4:
                return "\n" if "\n" in m[4] else " "
            return ("s", "", "`", "n")[kind - 3]

        shape = _JS.sub(token, text)
        if shape.count("`") != text.count("`") // 2 or text.count("`") % 2:
            shape = _scanned(text, words, jsx)
    if typescript:
        once = None
        while once != shape:
            once, shape = shape, _GENERIC.sub("", shape)
    return shape


def _scanned(text: str, words: frozenset, jsx: bool) -> str:
    """The shape by a scan with a stack of modes: nested templates and JSX. What ``${}`` or ``{}`` holds is put in
    round brackets, as if the template or element were called with it."""
    out: list[str] = []
    modes: list[str] = []  # "{": code in braces, "`": code of a template, "<": code of an element; "tag", "kids": an element
    last, i, n = ";", 0, len(text)
    regex = re.compile(_REGEX)
    while i < n:
        mode = modes[-1] if modes else ""
        if mode == "tag":
            m = _TAG.match(text, i)
            if not m:
                raise Unterminated("element")
            i = m.end()
            if m[2]:
                modes.append("<")
                out.append("(")
                last = "("
            elif m[3] or m[4]:
                modes.pop()
                if m[4]:
                    modes.append("kids")
            continue
        if mode == "kids":
            m = re.compile(r"[^<{]*").match(text, i)
            i = m.end()
            if text.startswith("{", i):
                modes.append("<")
                out.append("(")
                i, last = i + 1, "("
            elif m := re.compile(r"</\s*[\w$.:-]*\s*>").match(text, i):
                modes.pop()
                i = m.end()
            elif re.compile(r"<[A-Za-z_$>]").match(text, i):
                modes.append("tag")
                i += 1
            else:
                raise Unterminated("element")
            continue
        if mode == "text`":
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(text, i)
            i = m.end()
            if text.startswith("`", i):
                modes.pop()
                i += 1
            elif text.startswith("${", i):
                modes.append("`")
                out.append("(")
                i, last = i + 2, "("
            else:
                raise Unterminated("template")
            continue
        m = _SLOW.match(text, i)
        if m[1]:
            out.append("\n" if "\n" in m[1] else " ")
            i = m.end()
            continue
        if m[2]:
            last = m[2] if m[2] in words else "a"
            out.append(last)
        elif m[3] or m[4]:
            last = "s" if m[3] else "n"
            out.append(last)
        else:
            ch = m[5]
            if ch == "`":
                modes.append("text`")
                out.append("`")
                last = "s"
            elif ch == "/" and last in _BEFORE_OPERAND and (r := regex.match(text, i)):
                out.append("s")
                i, last = r.end(), "s"
                continue
            elif ch == "<" and jsx and last in _BEFORE_OPERAND and re.compile(r"<(?:[A-Za-z_$][\w$.:-]*(?=[\s/>])(?! extends\b)|>)").match(text, i):
                modes.append("tag")
                out.append(" s ")
                last = "s"
            elif ch == "{":
                modes.append("{")
                out.append("{")
                last = "{"
            elif ch == "}" and modes:
                out.append("}" if modes.pop() == "{" else ")")
                last = "}"
            else:
                out.append(ch)
                last = ch
        i = m.end()
    if modes and modes[-1] in ("tag", "kids", "text`", "`", "<"):
        raise Unterminated(modes[-1])
    return "".join(out)

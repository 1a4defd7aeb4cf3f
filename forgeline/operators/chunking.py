"""Semantic chunks of source files: classes, functions and methods of Python, JavaScript and TypeScript.

Files are parsed where they lie, one Arrow batch at a time; Python by its own parser, the others by a scan for
declarations outside of literals and comments, which finds their ends by matching brackets.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import PARSED_EXTENSIONS, chunk_key, clean_path, lookup, path_extension

_LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_MARK = re.compile(r"[\[({\])}]|(?<![\w$.#])(?P<word>function(?=[\s*(])|(?:class|interface|enum|const|let|var)(?=\s+[\w$\[{]))|(?<![\w$.#])(?P<key>#?[\w$]+|\"+)(?=\s*\??\s*[<(])")
_PREFIX = re.compile(r"(?:\b(?:export|default|declare|abstract|async|const)[ \t\n]+)*$")
_MODIFIERS = re.compile(r"(?:\b(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?:\basync\s*)?(?:\*\s*)?$")
_TYPE_PART = re.compile(r"=>|[\w$.\"]+|\S")
_TYPE_OPENS = frozenset("=> | & ? : is keyof extends typeof asserts infer readonly unique new abstract".split())
_CASE = re.compile(r"\b(?:case\b[^;{}]*|default\s*):$")
_PAIRED = {")": "(", "]": "[", "}": "{"}
ANONYMOUS = "<anonymous>"
_DEFINITION = re.compile(r"(class|def|async\s+def)\s+(\w+)")
_NO_METHOD = frozenset("if for while switch catch with return function await".split())


def _python_chunks(source: str, top: str | None = None) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    out: list[tuple] = []

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                out.append(("class" if is_class else "method" if owner else "function", child.name, owner, start, child.end_lineno))
                walk(child, child.name if is_class else owner)
            else:
                walk(child, owner)

    walk(tree, top)
    return out


def _healthy_chunks(lines: list[str], before: int = 0, top: str | None = None) -> list[tuple]:
    """What can be told of a Python file that does not parse: each statement at the outer indentation is taken alone; of
    a broken definition its head is kept, and its body is looked through in the same way."""
    full = [x for x in lines if x.strip()]
    margin = min((len(x) - len(x.lstrip()) for x in full), default=0)
    starts = [i for i, x in enumerate(lines) if x.strip() and len(x) - len(x.lstrip()) == margin and x[margin] not in ")]}#" and not (i and lines[i - 1].startswith("@", margin))]
    out: list[tuple] = []
    for start, end in zip(starts, [*starts[1:], len(lines)]):
        while end > start + 1 and not lines[end - 1].strip():
            end -= 1
        part = [x[margin:] for x in lines[start:end]]
        try:
            out += [(kind, name, owner, before + start + a, before + start + b) for kind, name, owner, a, b in _python_chunks("\n".join(part), top)]
        except (SyntaxError, ValueError, RecursionError):
            head = next(((i, m) for i, x in enumerate(part) if (m := _DEFINITION.match(x))), None)
            if head is None:
                continue
            i, m = head
            is_class = m[1] == "class"
            out.append(("class" if is_class else "method" if top else "function", m[2], top, before + start + 1, before + end))
            body = part[i + 1 :]
            if any(x.startswith((" ", "\t")) for x in body):
                out += _healthy_chunks([x if x.startswith((" ", "\t")) else "" for x in body], before + start + i + 1, m[2] if is_class else top)
    return out


def _blank(source: str) -> str:
    """The text with comments blanked out and literals as quotes, in the same places."""
    return _LITERAL.sub(lambda m: re.sub(r"[^\n]", " " if m[0][:2] in ("//", "/*") else '"', m[0]), source)


class _Script:
    """Positions in JavaScript or TypeScript without literals: matching brackets, types, values and their ends."""

    def __init__(self, source: str):
        self.code = _blank(source)
        self.close: dict[int, int] = {}
        opened: list[int] = []
        for m in re.finditer(r"[\[({\])}]", self.code):
            if m[0] in "[({":
                opened.append(m.start())
            elif any(self.code[o] == _PAIRED[m[0]] for o in opened[-3:]):
                while self.code[opened[-1]] != _PAIRED[m[0]]:
                    opened.pop()
                self.close[opened.pop()] = m.start()
        self.lines = [m.start() for m in re.finditer("\n", self.code)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def after(self, at: int) -> int:
        """The next place that is no space."""
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def behind(self, at: int) -> int:
        """Behind the bracket that closes the one at ``at``."""
        return self.close.get(at, len(self.code) - 1) + 1

    def generics(self, at: int) -> int:
        """Behind the type parameters at ``at``, if there are any."""
        depth, code = 0, self.code
        while at < len(code) and (depth or code[at] == "<"):
            c = code[at]
            if c in "({[":
                at = self.behind(at)
                continue
            if c in ");}]":
                break
            depth += (c == "<") - (c == ">" and code[at - 1] != "=")
            at += 1
        return at

    def type_end(self, at: int, until: tuple[str, ...]) -> int:
        """The place of the first of ``until`` behind the type at ``at``, or -1 where the type ends before it."""
        wants, last = True, at
        while m := _TYPE_PART.search(self.code, at):
            t = m[0]
            if not wants and t in until:
                return m.start()
            if not wants and t not in _TYPE_OPENS and (t not in "<[" or "\n" in self.code[last : m.start()]) or wants and t in "=;,)}]":
                return -1
            if t in _TYPE_OPENS:
                wants = True
            else:
                wants = False
            at = last = self.generics(m.start()) if t == "<" else self.behind(m.start()) if t in "({[" else m.end()
            wants = wants or t == "<" and self.code[self.after(at) : self.after(at) + 1] == "("
        return -1

    def body(self, at: int, ends: str = "{") -> int:
        """The place of ``ends`` behind type parameters, parameters and result type at ``at``, or -1."""
        at = self.after(self.generics(self.after(at)))
        if self.code[at : at + 1] != "(" or at not in self.close:
            return -1
        at = self.after(self.behind(at))
        if self.code.startswith(ends, at):
            return at
        return self.type_end(at + 1, (ends,)) if self.code[at : at + 1] == ":" else -1

    def class_body(self, at: int) -> int:
        while m := re.compile(r"[({\[<;})]").search(self.code, at):
            if m[0] == "{":
                return m.start()
            if m[0] in ";})":
                return -1
            at = self.generics(m.start()) if m[0] == "<" else self.behind(m.start())
        return -1

    def value_end(self, at: int) -> int:
        """The place of the comma, semicolon, line end or bracket that ends the expression at ``at``."""
        code, start = self.code, at
        while m := re.compile(r"[\[({<,;\])}\n]").search(code, at):
            c, at = m[0], m.start()
            if c in "[({":
                at = self.behind(at)
            elif c == "<":
                g = self.generics(at)
                at = g if code[g - 1 : g] == ">" and not re.match(r"[ \t]*[\w$\"!~+-]", code[g : g + 40]) else at + 1
            elif c == "\n":
                left, right = code[start:at].rstrip()[-2:], self.after(at)
                if left and (left in ("++", "--") or left[-1] not in "=+-*/%&|^!~?:<.>,") and not re.match(r"[.?:*/%&|^=<>+\-,]|(?:in|instanceof|as|satisfies)\b", code[right : right + 12]):
                    return at
                at = max(at + 1, right)
            else:
                return at
        return len(code)

    def function_head(self, at: int) -> int:
        """Behind the arrow, or behind the body, where the value at ``at`` is a function that is not called or used at
        once; else -1."""
        if m := re.compile(r"(?:async\s+)?function\b\s*\*?\s*[\w$]*").match(self.code, at):
            body = self.body(m.end())
            stop = self.behind(body)
            return stop if body >= 0 and self.code[self.after(stop) : self.after(stop) + 1] not in ("(", ".", "[", "?", '"') else -1
        m = re.compile(r"(?:async\b\s*)?(?=[<(])|(?:async\s+)?[\w$]+\s*(?==>)").match(self.code, at)
        if not m:
            return -1
        arrow = m.end() if self.code.startswith("=>", m.end()) else self.body(m.end(), "=>")
        return arrow + 2 if arrow >= 0 else -1

    def declared(self, at: int) -> tuple[list[tuple[int, int]], int]:
        """Names that declarators from ``at`` on bind to functions, and the end of the declaration."""
        names, code = [], self.code
        while True:
            at = self.after(at)
            name = at
            at = self.behind(at) if code[at : at + 1] in ("{", "[") else re.compile(r"[\w$]*").match(code, at).end()
            stop, at = at, self.after(at)
            if code[at : at + 1] == "!":
                at = self.after(at + 1)
            if code[at : at + 1] == ":":
                typed = self.type_end(at + 1, ("=", ",", ";"))
                at = typed if typed >= 0 else self.value_end(at)
            if code[at : at + 1] == "=":
                at = self.after(at + 1)
                head = self.function_head(at)
                if head >= 0:
                    names.append((name, stop))
                at = self.value_end(max(at, head))
            if code[at : at + 1] != ",":
                return names, at + 1 if code[at : at + 1] == ";" else max(stop, at)
            at += 1

    def is_statement(self, at: int) -> bool:
        """Whether a statement begins at ``at``."""
        before = self.code[max(0, at - 400) : at]
        left = before.rstrip()
        c = left[-1:]
        if not c or c in "{};)" or re.compile(r"export\s").match(self.code, at):
            return True
        if c == ":":
            return bool(_CASE.search(left))
        word = re.search(r"[\w$]+$", left)
        if word and word[0] in ("else", "do"):
            return True
        return "\n" in before[len(left) :] and (word is not None and word[0] not in ("new", "typeof", "void", "await", "extends") or c in "]\"'`")


def _script_chunks(source: str, typescript: bool) -> list[tuple]:
    """Declarations wherever statements stand, with the nearest class as parent. As in the engine's parser, bodies of
    functions, blocks, arguments and namespaces are searched; methods, interfaces and ``const``, ``let`` and ``var``
    declarations are one chunk a name and are not."""
    script = _Script(source)
    code, line = script.code, script.line
    out: list[tuple] = []
    open_: list[tuple[int, str, str | None, bool]] = []  # end, bracket, nearest class, whether it is that class' body
    classes: dict[int, str] = {}
    at = 0
    while m := _MARK.search(code, at):
        start, at, t = m.start(), m.end(), m[0]
        while open_ and start >= open_[-1][0]:
            open_.pop()
        end, bracket, owner, is_class = open_[-1] if open_ else (len(code), "", None, False)
        if t in _PAIRED:
            continue
        if m["word"]:
            first = start - len(_PREFIX.search(code[max(0, start - 80) : start])[0])
            if is_class or not script.is_statement(first):
                if t == "class":
                    body = script.class_body(at)
                    if body >= 0:
                        classes[body] = owner
                continue
            if t in ("const", "let", "var"):
                if re.match(r"\s+enum\b", code[at : at + 40]):
                    continue
                names, stop = script.declared(at)
                out += [("arrow_function", source[a:b], owner, line(first), line(max(first, stop - 1))) for a, b in names]
                at = max(at, stop)
                continue
            named = re.compile(r"\s*\*?\s*([\w$]*)").match(code, at)
            name = "" if t == "class" and named[1] in ("extends", "implements") else named[1]
            body = script.body(named.end()) if t == "function" else script.class_body(named.end() if name else at)
            if body < 0 or t in ("interface", "enum") and not typescript:
                continue
            out.append((t, name or ANONYMOUS, owner, line(first), line(script.behind(body) - 1)))
            if t == "class":
                classes[body] = name or ANONYMOUS
            at = body if t in ("class", "function") else script.behind(body)
            continue
        if t in "[({" and not (t == "[" and bracket == "{" and re.match(r"\s*[<(]", code[script.behind(start) : script.behind(start) + 40])):
            open_.append((script.close.get(start, len(code)), t, classes.get(start, owner), start in classes))
            continue
        stop = script.behind(start) if t == "[" else m.end()
        body = script.body(script.after(stop) + (code[script.after(stop)] == "?")) if bracket == "{" and t not in _NO_METHOD else -1
        first = start - len(_MODIFIERS.search(code[max(0, start - 120) : start])[0]) if body >= 0 else start
        left = code[max(0, first - 400) : first].rstrip()[-1:]
        if body >= 0 and (left in ("{", ",") or is_class and script.is_statement(first)):
            out.append(("method", source[start:stop], owner, line(first), line(script.behind(body) - 1)))
            at = script.behind(body)
        elif t == "[":
            open_.append((script.close.get(start, len(code)), t, owner, False))
    return out


def chunks_of(language: str | None, source: str | None) -> list[tuple] | None:
    """``(symbol_type, symbol_name, parent_symbol, start_line, end_line)`` in order; of a Python file that
    does not parse those of its healthy part, None where there are none and for other languages."""
    if not source:
        return []
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    try:
        return _python_chunks(text.removeprefix("﻿")) if language == "python" else _script_chunks(text, language == "typescript")
    except (SyntaxError, ValueError, RecursionError):
        return _healthy_chunks(text.removeprefix("﻿").split("\n")) or None if language == "python" else None


def extract_chunks(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, repository_id, file_path, symbol_type, symbol_name, parent_symbol, start_line, end_line, source_code,
    chunk_key, checksum`` of all chunks.

    ``files`` has ``key, repository_id, file_path, source_code``. Lines count from 1 and both ends belong to the
    chunk, decorators and ``export`` too. Other languages, null sources give no row, and of Python files that do not
    parse the healthy definitions are kept.
    """
    language = lookup(PARSED_EXTENSIONS, path_extension(F.col("file_path")))
    rows = files.select(F.col(key).cast("long").alias(key), "repository_id", clean_path(F.col("file_path")).alias("file_path"), language.alias("language"), "source_code").filter("language is not null and length(source_code) > 0")
    schema = f"{key} long, repository_id long, file_path string, symbol_type string, symbol_name string, parent_symbol string, start_line int, end_line int, source_code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, repo, path, lang, source in batch.itertuples(index=False):
                found = chunks_of(lang, source)
                lines = re.split(r"\r\n|\r|\n", source) if found else []
                out += [(k, repo, path, *c, "\n".join(lines[c[3] - 1 : c[4]])) for c in found or ()]
            yield pd.DataFrame(out, columns=[key, "repository_id", "file_path", "symbol_type", "symbol_name", "parent_symbol", "start_line", "end_line", "source_code"])

    found = rows.mapInPandas(run, schema)
    return found.withColumn("chunk_key", chunk_key(F.col("repository_id"), F.col("file_path"), F.col("parent_symbol"), F.col("symbol_name"), F.col("start_line"), F.col("end_line"))).withColumn("checksum", F.sha2("source_code", 256))

"""A lexer and a structural parser for brace languages: types, members, functions, calls and constants of one file.

It knows no grammar in full. Tokens are paired by their brackets; declarations are found by shape, bodies are searched
for calls, and every nested function becomes a unit of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LANGUAGES = {".cs": "csharp", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\#[a-z][^\n]*)
    |(?P<string>(?:\$@|@\$|\$|@)?\"\"\".*?\"\"\"|(?:\$@|@\$|@)"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<name>[A-Za-z_$@][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|::|\?\?|==|!=|<=|>=|&&|\|\||\+=|-=|\.\.\.|.)""",
    re.S | re.X,
)
OPEN, CLOSE = {"(": ")", "{": "}", "[": "]"}, {")", "}", "]"}
TYPE_WORDS = {"class", "interface", "record", "enum", "struct"}
#: Words before a bracket that call nothing.
NOT_CALLED = {"if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "typeof", "nameof", "function", "await", "new", "throw", "super", "base", "in", "of", "when", "sizeof", "default", "fixed", "do", "else", "yield", "void", "synchronized", "try"}
MODIFIERS = {"public", "private", "protected", "internal", "static", "readonly", "final", "abstract", "async", "override", "virtual", "sealed", "partial", "const", "export", "default", "declare", "new", "extern", "unsafe", "volatile", "transient", "synchronized", "native", "required"}


@dataclass
class Unit:
    id: str
    name: str
    kind: str
    line: int
    type: str | None = None
    params: list[tuple[str, str]] = field(default_factory=list)
    attrs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    children: list[str] = field(default_factory=list)
    body: str = ""
    abstract: bool = False


class Parser:
    def __init__(self, file: str, text: str):
        self.file, self.text = file, text
        self.language = next((v for k, v in LANGUAGES.items() if file.lower().endswith(k)), "")
        self.script = self.language in ("typescript", "javascript")
        self.tokens: list[str] = []
        self.at: list[int] = []
        lines, self.line = 1, []
        for m in TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.tokens.append(m[0])
                self.at.append(m.start())
                self.line.append(lines)
            lines += m[0].count("\n")
        self.pair = self._pairs()
        self.types: list[dict] = []
        self.units: list[Unit] = []
        self.fields: list[dict] = []
        self.imports: list[dict] = []
        self.constants: list[dict] = []

    def _pairs(self) -> dict[int, int]:
        pairs, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t in OPEN:
                stack.append(i)
            elif t in CLOSE:
                while stack and OPEN[self.tokens[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    pairs[j], pairs[i] = i, j
        return pairs

    def tok(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def source(self, a: int, b: int) -> str:
        """The text of tokens a to b - 1."""
        return self.text[self.at[a] : self.at[b - 1] + len(self.tokens[b - 1])] if a < b else ""

    def skip(self, i: int) -> int:
        """Past the token, or past its bracket's end."""
        return self.pair.get(i, i) + 1 if self.tok(i) in OPEN else i + 1

    def generic_end(self, i: int, end: int) -> int:
        """Past <...> that begins at i, or i if it is no list of types."""
        depth, j = 0, i
        while j < end:
            t = self.tok(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif not (re.match(r"[A-Za-z_$]", t) or t in (",", ".", "?", "[", "]", "|", "&", ":", ";", "{", "}", "=>", "(", ")") or t[:1] in "'\""):
                return i
            j += 1
        return i

    def pieces(self, a: int, b: int, by: str = ",", types: bool = False) -> list[tuple[int, int]]:
        """Token ranges between separators at the top level; in lists of declared types every <...> is one piece."""
        out, start, i = [], a, a
        while i < b:
            if self.tok(i) == "<" and (e := self.generic_end(i, b)) > i and (types or self.tok(e) in ("(", ",", ")", "", ">", "{")):
                i = e
                continue
            if self.tok(i) == by:
                out.append((start, i))
                start = i + 1
            i = self.skip(i)
        return out + [(start, b)] if start < b else out

    # --- values

    def value(self, a: int, b: int) -> dict:
        """kind, text (interpolations as {name}), refs (the interpolated expressions) and raw of an expression."""
        raw = self.source(a, b)
        while b - a > 2 and self.tok(a) == "(" and self.pair.get(a) == b - 1:
            a, b = a + 1, b - 1
        parts = self.pieces(a, b, "+")
        if b - a == 1 and self.tok(a)[:1] in "\"'`$@" and re.search(r"[\"'`]$", self.tok(a)):
            text, refs = self.literal(self.tok(a))
            return {"kind": "template" if refs else "string", "text": text, "refs": refs, "raw": raw}
        if len(parts) > 1 and any(y - x == 1 and re.search(r"[\"'`]$", self.tok(x)) for x, y in parts):
            text, refs = "", []
            for x, y in parts:
                v = self.value(x, y)
                text += v["text"] if v["kind"] in ("string", "template") else place(v["raw"])
                refs += v["refs"] if v["kind"] in ("string", "template") else [v["raw"]]
            return {"kind": "template" if refs else "string", "text": text, "refs": refs, "raw": raw}
        if b > a and self.tok(a) == "{" and self.pair.get(a) == b - 1:
            return {"kind": "object", "text": "", "refs": [], "raw": raw}
        if b > a and self.tok(a) == "[" and self.pair.get(a) == b - 1:
            return {"kind": "array", "text": "", "refs": [], "raw": raw}
        kind = "ident" if re.fullmatch(r"(?:this\.)?[\w$]+(?:\.[\w$]+)*", raw) else "other"
        return {"kind": kind, "text": place(raw), "refs": [raw], "raw": raw}

    def literal(self, t: str) -> tuple[str, list[str]]:
        m = re.match(r"(\$@|@\$|\$|@)?(\"\"\"|[\"'`])", t)
        inner = t[m.end() : len(t) - len(m[2])]
        refs: list[str] = []
        hole = r"\$\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}" if m[2] == "`" else r"\{([^{}:]+)(?::[^{}]*)?\}" if "$" in (m[1] or "") else None
        if hole:
            inner = re.sub(hole, lambda x: refs.append(x[1].strip()) or place(x[1]), inner)
        return (inner if "@" in (m[1] or "") else re.sub(r"\\(.)", r"\1", inner)), refs

    def named(self, a: int, b: int) -> dict[str, dict]:
        """Values of ``name: value`` and ``name = value`` pieces, and of shorthand names."""
        out = {}
        for x, y in self.pieces(a, b):
            if y - x > 2 and self.tok(x + 1) in (":", "="):
                out[self.tok(x).strip("\"'")] = self.value(x + 2, y)
            elif y - x == 1 and re.match(r"[A-Za-z_$]", self.tok(x)):
                out[self.tok(x)] = self.value(x, y)
        return out

    # --- attributes

    def attributes(self, i: int, end: int) -> tuple[list[dict], int]:
        out = []
        while i < end:
            t = self.tok(i)
            if self.language == "csharp" and t == "[" and i in self.pair:
                for x, y in self.pieces(i + 1, self.pair[i]):
                    k = next((j for j in range(x, y) if self.tok(j) == "("), y)
                    out.append(self.attribute(re.sub("Attribute$", "", self.tok(k - 1)), k, y))
                i = self.pair[i] + 1
            elif t.startswith("@") and len(t) > 1 and self.language != "csharp" and t != "@interface":
                k = i + 1
                name = t[1:]
                while self.tok(k) == ".":
                    name, k = self.tok(k + 1), k + 2
                stop = self.pair.get(k, k - 1) + 1 if self.tok(k) == "(" else k
                out.append(self.attribute(name, k, stop))
                i = stop
            else:
                break
        return out, i

    def attribute(self, name: str, k: int, end: int) -> dict:
        args, named = [], {}
        if self.tok(k) == "(" and k < end:
            for x, y in self.pieces(k + 1, self.pair.get(k, k)):
                if y - x > 2 and self.tok(x + 1) == "=" and re.match(r"\w", self.tok(x)):
                    named[self.tok(x)] = self.several(x + 2, y)
                else:
                    args += self.several(x, y)
            if self.script and len(args) == 1 and args[0]["kind"] == "object":
                named = {n: [v] for n, v in self.named(self.skip_to(k, "{") + 1, self.pair[self.skip_to(k, "{")]).items()}
        return {"name": name, "args": args, "named": named}

    def skip_to(self, i: int, t: str) -> int:
        while self.tok(i) != t:
            i += 1
        return i

    def several(self, a: int, b: int) -> list[dict]:
        """The values of an array or of a single expression."""
        if self.tok(a) in ("{", "[") and self.pair.get(a) == b - 1 and (self.tok(a) == "[" or self.language == "java"):
            return [self.value(x, y) for x, y in self.pieces(a + 1, b - 1)]
        return [self.value(a, b)]

    # --- declarations

    def parse(self) -> Parser:
        module = Unit(f"{self.file}:<module>", "<module>", "module", 1)
        self.block(0, len(self.tokens), None, module)
        if module.calls or module.children:
            self.units.append(module)
        return self

    def type_at(self, i: int, end: int) -> int | None:
        """Where the type keyword of a declaration at i is (after modifiers)."""
        while i < end and self.tok(i) in MODIFIERS:
            i += 1
        if self.tok(i) in TYPE_WORDS and re.match(r"[A-Za-z_]", self.tok(i + 1)) and self.tok(i - 1) != ".":
            return i + 1 if self.tok(i) == "record" and self.tok(i + 1) in ("class", "struct") else i
        return None

    def block(self, i: int, end: int, owner: str | None, module: Unit) -> None:
        """Statements outside types, or namespaces."""
        pending: list[dict] = []
        start = i
        while i < end:
            got, j = self.attributes(i, end) if self.tok(i - 1) in ("", ";", "}", "{", "]", ")") or i == start or pending else ([], i)
            if got:
                pending += got
                i = j
                continue
            if (k := self.type_at(i, end)) is not None:
                i = self.declare_type(k, end, pending, module)
                pending = []
                continue
            t = self.tok(i)
            if t in ("namespace", "module") and re.match(r"[A-Za-z_]", self.tok(i + 1)):
                while i < end and self.tok(i) not in ("{", ";"):
                    i += 1
                if self.tok(i) == "{":
                    self.block(i + 1, self.pair.get(i, end), owner, module)
                i = self.skip(i)
            elif t in ("using", "import", "package") or self.script and t == "export" and self.tok(i + 1) in ("{", "*"):
                i = self.take_import(i, end) if not (t == "using" and self.tok(i + 1) in ("var", "(")) else self.statement(i, end, module)
            else:
                i = self.statement(i, end, module)
            pending = []

    def take_import(self, i: int, end: int) -> int:
        j, line = i, self.line[i]
        while j < end and self.tok(j) != ";" and not (self.script and j > i and self.line[j] > line and self.tok(j - 1)[:1] in "'\""):
            j = self.skip(j)
        words = self.tokens[i:j]
        if self.script and words and words[-1][:1] in "'\"":
            source, k = words[-1].strip("'\""), 1
            while k < len(words) - 1 and words[k] != "from":
                if re.match(r"[A-Za-z_$]", words[k]) and words[k] not in ("as", "type"):
                    again = words[k + 1] == "as"
                    self.imports.append({"local": words[k + 2] if again else words[k], "imported": words[k], "source": source})
                    k += 2 * again
                k += 1
        elif not self.script and len(words) > 1:
            whole = "".join(w for w in words[1:] if w != "static")
            self.imports.append({"local": whole.rsplit(".", 1)[-1], "imported": whole.rsplit(".", 1)[-1], "source": whole})
        return j + (self.tok(j) == ";")

    def statement(self, i: int, end: int, module: Unit) -> int:
        """One statement: functions become units, the rest belongs to the module."""
        j = i
        while self.tok(j) in MODIFIERS and j < end:
            j += 1
        if self.tok(j) == "function" and re.match(r"[A-Za-z_$]", self.tok(j + 1)):
            return self.function(j + 1, end, None, [])
        a = j + 1 if self.tok(j) in ("let", "var") else j if self.tok(j - 1) == "const" and j > i else None
        if self.script and a is not None and re.match(r"[A-Za-z_$]", self.tok(a)):
            k = a + 1
            while k < end and self.tok(k) not in ("=", ";"):
                k = self.skip(k)
            if self.tok(k) == "=":
                stop = self.expression_end(k + 1, end)
                if (f := self.lambda_at(k + 1, stop)) is not None:
                    return self.arrow(f, stop, self.tok(a), None, [])
                self.initial(a, k + 1, stop, None)
        stop = self.expression_end(i, end)
        self.calls_in(i, stop, module)
        return max(stop + (self.tok(stop) == ";"), i + 1)

    def initial(self, name: int, a: int, b: int, owner: str | None, type: str = "", constant: bool = True) -> None:
        v = self.value(a, b)
        if constant and v["kind"] == "string":
            self.constants.append({"type": owner, "name": self.tok(name), "value": v["text"]})
        self.fields.append({"type": owner, "name": self.tok(name), "of": type, "value": v["raw"]})

    def expression_end(self, i: int, end: int) -> int:
        """Where the statement that begins at i ends: a semicolon, or in scripts a line end between complete expressions."""
        start = i
        while i < end and self.tok(i) != ";":
            j = self.skip(i)
            if self.tok(i) == "{" and self.tok(start) in ("if", "for", "foreach", "while", "try", "switch", "else", "do", "finally", "catch") and self.tok(j) not in ("else", "catch", "finally", "while"):
                return j
            if self.script and j < end and self.line[j] > self.line[j - 1] and not re.match(r"[.?:+\-*/&|=,)\]}]|=>", self.tok(j)) and not re.match(r"[.?:+\-*/&|=,(\[]$|=>$", self.tok(j - 1)) and self.tok(j - 1) not in MODIFIERS:
                return j
            i = j
        return min(i, end)

    def declare_type(self, k: int, end: int, attrs: list[dict], module: Unit) -> int:
        kind, name, i = self.tok(k), self.tok(k + 1), k + 2
        if self.tok(i) == "<":
            i = max(self.generic_end(i, end), i + 1)
        members = []
        if self.tok(i) == "(":
            members = self.params(i)
            i = self.pair.get(i, i) + 1
        bases, start = [], i
        while i < end and self.tok(i) not in ("{", ";"):
            i = self.skip(i) if self.tok(i) != "<" else max(self.generic_end(i, end), i + 1)
        for x, y in self.pieces(start, i, types=True):
            words = [w for w in self.tokens[x:y] if w not in (":", "extends", "implements", "where")]
            if words:
                bases.append("".join(words))
        self.types.append({"name": name, "kind": kind, "bases": bases, "line": self.line[k], "attrs": attrs})
        for n, t in members:
            self.fields.append({"type": name, "name": n, "of": t, "value": ""})
        if self.tok(i) == "{":
            if kind != "enum":
                self.members(i + 1, self.pair.get(i, end), name, kind, module)
            return self.pair.get(i, i) + 1
        return i + 1

    def params(self, i: int) -> list[tuple[str, str]]:
        out = []
        for a, b in self.pieces(i + 1, self.pair.get(i, i), types=True):
            _, a = self.attributes(a, b)
            while self.tok(a) in MODIFIERS | {"this", "ref", "out", "params", "in"} and a < b - 1:
                a += 1
            if self.script:
                colon = next((j for j in range(a, b) if self.tok(j) == ":"), None)
                stop = next((j for j in range(a, b) if self.tok(j) == "="), b)
                out.append((self.tok(a), self.source(colon + 1, stop) if colon else ""))
            else:
                stop = next((j for j in range(a, b) if self.tok(j) == "="), b)
                if stop > a:
                    out.append((self.tok(stop - 1), self.source(a, stop - 1)))
        return out

    def members(self, i: int, end: int, owner: str, kind: str, module: Unit) -> None:
        while i < end:
            attrs, i = self.attributes(i, end)
            if i >= end:
                break
            if (k := self.type_at(i, end)) is not None:
                i = self.declare_type(k, end, attrs, module)
                continue
            start = i
            while i < end and self.tok(i) not in ("(", "=", ";", "{", "=>", ":"):
                if self.tok(i) == "<":
                    i = max(self.generic_end(i, end), i + 1)
                else:
                    i = self.skip(i)
            name = i - 1
            if self.tok(name) in (">", "?", "!"):
                name = next((j for j in range(i, start, -1) if self.tok(j) == "<" and self.generic_end(j, end) == i), i) - 1
            t = self.tok(i)
            if t == "(":
                i = self.function(name, end, owner, attrs, i, abstract=kind == "interface" or "abstract" in self.tokens[start:name])
            elif t == ":" and self.script:
                colon = i
                while i < end and self.tok(i) not in ("=", ";") and not (self.line[min(i + 1, len(self.line) - 1)] > self.line[i] and self.tok(i + 1) != "|"):
                    i = self.skip(i)
                of = self.source(colon + 1, min(i + (self.tok(i) not in ("=", ";")), end))
                if self.tok(i) == "=":
                    stop = self.expression_end(i + 1, end)
                    self.field_value(name, i + 1, stop, owner, of, attrs)
                    i = stop
                else:
                    self.fields.append({"type": owner, "name": self.tok(name), "of": of, "value": "", "attrs": attrs})
                i += 1
            elif t == "=":
                stop = self.expression_end(i + 1, end)
                self.field_value(name, i + 1, stop, owner, "" if self.script else self.field_type(start, name), attrs)
                i = stop + (self.tok(stop) == ";")
            elif t == ";":
                if name > start:
                    self.fields.append({"type": owner, "name": self.tok(name), "of": "" if self.script else self.field_type(start, name), "value": "", "attrs": attrs})
                i += 1
            elif t == "=>":
                stop = self.expression_end(i + 1, end)
                u = Unit(f"{owner}.{self.tok(name)}", self.tok(name), "method", self.line[start], owner, [], attrs, body=self.source(i + 1, stop))
                self.calls_in(i + 1, stop, u)
                self.units.append(u)
                i = stop + 1
            elif t == "{":
                self.fields.append({"type": owner, "name": self.tok(name), "of": self.field_type(start, name), "value": "", "attrs": attrs})
                i = self.pair.get(i, i) + 1
                if self.tok(i) == "=":
                    stop = self.expression_end(i + 1, end)
                    self.field_value(name, self.skip_to(i, "=") + 1, stop, owner, "", [])
                    i = stop + 1
            else:
                i += 1

    def field_type(self, start: int, name: int) -> str:
        while start < name and self.tok(start) in MODIFIERS:
            start += 1
        return self.source(start, name)

    def field_value(self, name: int, a: int, b: int, owner: str, of: str, attrs: list[dict]) -> None:
        if self.script and (f := self.lambda_at(a, b)) is not None:
            self.arrow(f, b, self.tok(name), owner, attrs)
        else:
            self.initial(name, a, b, owner, of)
            self.fields[-1]["attrs"] = attrs

    def function(self, name: int, end: int, owner: str | None, attrs: list[dict], paren: int | None = None, abstract: bool = False) -> int:
        i = paren if paren is not None else self.skip_to(name, "(")
        params = self.params(i)
        own = self.tok(name)
        constructor = owner is not None and own in (owner, "constructor")
        if constructor:
            for n, t in params:
                self.fields.append({"type": owner, "name": n, "of": t, "value": ""})
        line, i = self.line[name], self.pair.get(i, i) + 1
        while i < end and self.tok(i) not in ("{", ";", "=>"):
            if self.script and abstract and self.line[i] > self.line[i - 1]:
                break
            i = max(self.generic_end(i, end), i + 1) if self.tok(i) == "<" else self.skip(i)
        u = Unit(f"{owner}.{'<init>' if constructor else own}" if owner else f"{self.file}:{own}", own, "method" if owner else "function", line, owner, params, attrs)
        if self.tok(i) == "{":
            stop = self.pair.get(i, end)
            u.body = self.source(i, stop + 1)
            self.calls_in(i + 1, stop, u)
            i = stop + 1
        elif self.tok(i) == "=>":
            stop = self.expression_end(i + 1, end)
            u.body = self.source(i + 1, stop)
            self.calls_in(i + 1, stop, u)
            i = stop + 1
        else:
            u.abstract = True
            i += self.tok(i) == ";"
        self.units.append(u)
        return max(i, name + 1)

    # --- nested functions and calls

    def lambda_at(self, i: int, end: int) -> int | None:
        """Where the parameters of a function expression at i begin, or None."""
        j = i + 1 if self.tok(i) == "async" else i
        if self.tok(j) == "function":
            return j
        if self.tok(j) == "(" and j in self.pair:
            k = self.pair[j] + 1
            if self.tok(k) == ":" and self.script:
                while k < end and self.tok(k) not in ("=>", ",", ";", ")", "{"):
                    k = max(self.generic_end(k, end), k + 1) if self.tok(k) == "<" else k + 1
            return j if self.tok(k) in ("=>",) or self.language == "java" and self.tok(k) == "-" and self.tok(k + 1) == ">" else None
        if re.match(r"[A-Za-z_$]", self.tok(j)) and (self.tok(j + 1) == "=>" or self.language == "java" and self.tok(j + 1) == "-" and self.tok(j + 2) == ">"):
            return j
        return None

    def arrow(self, i: int, end: int, name: str | None, owner: str | None, attrs: list[dict], parent: Unit | None = None) -> int:
        """A function expression as a unit; returns where it ends."""
        line, params = self.line[i], []
        column = self.at[i] - self.text.rfind("\n", 0, self.at[i])
        id = f"{owner}.{name}" if owner and name else f"{self.file}:{name}" if name else f"{self.file}:anon@{line}:{column}"
        j = self.skip_to(i, "(") if self.tok(i) == "function" else i
        if self.tok(j) == "(":
            params = self.params(j)
            j = self.pair.get(j, j)
        elif re.match(r"[A-Za-z_$]", self.tok(j)):
            params = [(self.tok(j), "")]
        while j < end and self.tok(j) not in ("=>", "{") and not (self.tok(j) == "-" and self.tok(j + 1) == ">"):
            j += 1
        j += {"=>": 1, "-": 2}.get(self.tok(j), 0)
        u = Unit(id, name or "anonymous", "method" if owner else "function" if name else "anonymous", line, owner or (parent.type if parent else None), params, attrs)
        if self.tok(j) == "{" and j in self.pair:
            stop = self.pair[j] + 1
            u.body = self.source(j, stop)
            self.calls_in(j + 1, stop - 1, u)
        else:
            stop = j
            while stop < end and self.tok(stop) not in (",", ";", ")", "]", "}"):
                stop = self.skip(stop)
            u.body = self.source(j, stop)
            self.calls_in(j, stop, u)
        self.units.append(u)
        if parent is not None:
            parent.children.append(id)
        return max(stop, i + 1)

    def calls_in(self, i: int, end: int, unit: Unit) -> None:
        while i < end:
            if (f := self.lambda_at(i, end)) is not None and self.tok(i - 1) != ".":
                i = self.arrow(f, end, None, None, [], unit)
                continue
            if self.tok(i) == "function" and re.match(r"[A-Za-z_$]", self.tok(i + 1)):
                i = self.function(i + 1, end, None, [])
                continue
            t = self.tok(i)
            if re.match(r"[A-Za-z_$]", t) and t not in NOT_CALLED:
                k = i + 1
                targs = ""
                if self.tok(k) == "<" and self.tok(e := self.generic_end(k, end)) == "(":
                    targs, k = self.source(k + 1, e - 1), e
                if self.tok(k) == "(" and k in self.pair:
                    unit.calls.append(self.call(i, k, targs, unit))
            if self.script and self.tok(i) in ("const", "let", "var") and self.tok(i + 2) == "=":
                stop = self.expression_end(i + 3, end)
                if self.lambda_at(i + 3, stop) is None:
                    self.initial(i + 1, i + 3, stop, None, constant=unit.kind == "module")  # a function's variable is no constant of others
            elif not self.script and t == "var" and self.tok(i + 2) == "=":
                stop = self.expression_end(i + 3, end)
                self.initial(i + 1, i + 3, stop, None, constant=unit.kind == "module")  # a function's variable is no constant of others
            i += 1

    def call(self, name: int, paren: int, targs: str, unit: Unit) -> dict:
        chain, j = [], name - 1
        while self.tok(j) in (".", "?.", "!"):
            j -= 1
            while self.tok(j) == "!":
                j -= 1
            if self.tok(j) in (")", "]") and j in self.pair:
                open_ = self.pair[j]
                j = open_ - 1
                if self.tok(j) == ">":
                    j = next((x for x in range(j, -1, -1) if self.tok(x) == "<"), 0) - 1
                chain.append(self.tok(j) + "()" if self.tok(open_) == "(" else self.tok(j) + "[]")
            else:
                chain.append(self.tok(j))
            j -= 1
        fresh = self.tok(j) == "new" or self.tok(name - 1) == "new"
        args, named, objects = [], {}, {}
        for x, y in self.pieces(paren + 1, self.pair[paren]):
            label = None
            if self.language == "csharp" and self.tok(x + 1) == ":" and re.match(r"[A-Za-z_]", self.tok(x)):
                label, x = self.tok(x), x + 2
            if (f := self.lambda_at(x, y)) is not None:
                column = self.at[f] - self.text.rfind("\n", 0, self.at[f])
                v = {"kind": "function", "text": f"{self.file}:anon@{self.line[f]}:{column}", "refs": [], "raw": self.source(x, y)}
            else:
                v = self.value(x, y)
                if v["kind"] == "object":
                    for n, w in self.named(x + 1, y - 1).items():
                        objects.setdefault(n, w)
            if label:
                named[label] = v
            args.append(v)
        receiver = ".".join(c for c in reversed(chain) if c != "this")
        return {"receiver": receiver, "method": self.tok(name), "targs": targs, "args": args, "named": {**objects, **named}, "line": self.line[name], "new": fresh, "raw": self.source(paren + 1, self.pair[paren])}


def place(expr: str) -> str:
    """An interpolated expression as a placeholder."""
    t = expr.strip()
    if m := re.fullmatch(r"(?:this\.)?(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)", t):
        return "{" + m[1].lstrip("_") + "}"
    if m := re.search(r"\[\s*[\"']([^\"']+)[\"']\s*\]$", t):
        return "{" + m[1] + "}"
    return "{expr}"

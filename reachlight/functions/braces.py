"""Facts about TypeScript, JavaScript and Go modules, by a tokenizer and matched brackets.

They have the shape of the Python facts, so that the same joins serve all languages. Only what these need is read:
call chains, function bodies, branches, try blocks, assignments. A module whose brackets don't match, or that holds
an unended string, gives an error and no facts.
"""

from __future__ import annotations

import re

from reachlight.functions.extract import EMPTY

TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n\f\v ﻿]+|//[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d][\w$]*|[$_][\w$]*)|(?P<num>\d[\w.]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tpl>`(?:\\.|[^`\\])*`)|(?P<punc>=>|:=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|<-|\.\.\.|[^\s])""",
    re.S,
)
REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
GO_WORDS = set("func select range go defer chan map package struct type interface".split())
KEYWORDS = set("if for while switch catch function func return typeof select range go defer case else do new in of instanceof delete void await yield import export class struct interface map chan var let const type package throw try finally".split())
FALSE = {"false", "0", "null", "nil", "undefined"}
SIGNALS = re.compile(r"setRequestHandler|registerTool|server\.tool|@modelcontextprotocol/sdk|DynamicStructuredTool")
LINE_SIGNALS = re.compile(r"tool\(|execute ?:")
NOT_CODE = re.compile(r"^\s*(?://|import |from )")
GO_FRAMEWORKS = ("github.com/modelcontextprotocol/go-sdk", "github.com/mark3labs/mcp-go", "github.com/metoro-io/mcp-golang", "anthropic-sdk-go")
GO_REGISTER = {"AddTool", "AddToolHandler", "NewTypedToolHandler", "RegisterTool"}
QUIET_FIELDS = ("conf", "log", "output", "trace")


class Braces:
    def __init__(self, source: str, go: bool):
        self.source, self.go = source, go
        self.keywords = KEYWORDS if go else KEYWORDS - GO_WORDS
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        pos = 0
        while pos < len(source):
            if source[pos] == "/" and not go and self._regex_may_begin() and (m := REGEX.match(source, pos)):
                self._add("str", '""', pos)
            else:
                m = TOKEN.match(source, pos)
                if not m:
                    break
                if m.lastgroup != "space":
                    if m.lastgroup == "punc" and m[0] in "\"'`":
                        raise SyntaxError(f"unended string at {pos}")
                    self._add(m.lastgroup, m[0], pos)
            pos = m.end()
        self.newlines = [i for i, c in enumerate(source) if c == "\n"]
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.outer: list[int] = []  # the bracket that each token lies in, or -1
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] == "punc" and t in ")]}":
                if not stack or "([{".index(self.text[stack[-1]]) != ")]}".index(t):
                    raise SyntaxError(f"unbalanced {t} in line {self.line(i)}")
                self.close[stack[-1]], self.open[i] = i, stack[-1]
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            if self.kind[i] == "punc" and t in "([{":
                stack.append(i)
        if stack:
            raise SyntaxError(f"unbalanced {self.text[stack[-1]]} in line {self.line(stack[-1])}")
        self.n = len(self.text)
        self.functions = self._functions()
        self.blocks = self._blocks()

    def _add(self, kind: str, text: str, pos: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.at.append(pos)

    def _regex_may_begin(self) -> bool:
        return not self.text or self.kind[-1] == "punc" and self.text[-1] not in ")]}" or self.text[-1] in ("return", "typeof", "case")

    def line(self, i: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.newlines, self.at[i]) + 1

    def col(self, i: int) -> int:
        line = self.line(i)
        return self.at[i] - (self.newlines[line - 2] + 1 if line > 1 else 0)

    def get(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n else ""

    def body_after(self, i: int) -> int:
        """The brace that opens a body after a header's closing parenthesis at i; -1 if none follows."""
        j = i + 1
        if self.go:
            while j < self.n and self.text[j] != "{":
                if self.line(j) != self.line(j - 1) and self.text[j - 1] not in (",", "("):
                    return -1
                j = self.close.get(j, j) + 1
                if self.get(j - 1) in ("interface", "struct") and self.get(j) == "{":
                    j = self.close[j] + 1
            return j if j < self.n else -1
        if self.get(j) == ":":
            j += 1
            while j < self.n and (self.kind[j] in ("id", "str", "num") or self.text[j] in "<>[]|.,&()?" or self.text[j] == "=>" and self.get(j + 1) != "{"):
                j += 1
        return j if self.get(j) == "{" else -1

    def _functions(self) -> list[dict]:
        out = []

        def add(name: str, first: int, lo: int, hi: int, params: list[str]) -> None:
            out.append({"ord": first, "name": name, "first": first, "lo": lo, "hi": hi, "params": params})

        for i in range(self.n):
            t = self.text[i]
            if t == "=>" and not self.go:
                head = i - 1
                while head > 0 and self.text[head] != ")" and self.kind[head] == "id" and self.get(head - 1) in (":", "|", "."):
                    head -= 2
                first = self.open[head] if self.text[head] == ")" else head
                named = first - 1 - (self.get(first - 1) == "async")
                name = self.get(named - 1) if self.get(named) in ("=", ":") else ""
                body = i + 1
                if self.get(body) == "{":
                    hi = self.close[body]
                else:
                    hi = body
                    while hi < self.n and self.text[hi] not in (",", ";", ")", "]", "}") and not (hi > body and self.line(hi) > self.line(hi - 1) and self.kind[hi] == "id" and self.kind[hi - 1] != "punc"):
                        hi = self.close.get(hi, hi) + 1
                    hi -= 1
                add(name if name.isidentifier() else "", first, body, hi, self._names(first, head) if self.text[head] == ")" else [self.text[head]])
                continue
            if t != "(":
                continue
            close = self.close[i]
            if self.go:
                before = self.get(i - 1)
                literal = before == "func" and self.get(close + 1) != "" and not (self.kind[close + 1] == "id" and self.get(close + 2) == "(" and self.outer[i] == -1)
                named = self.kind[i - 1] == "id" and (self.get(i - 2) == "func" or self.get(i - 2) == ")" and self.get(self.open.get(i - 2, 0) - 1) == "func") if i > 1 else False
                if literal or named:
                    body = self.body_after(close)
                    if body >= 0:
                        add(before if named else "", i, body, self.close[body], self._names(i, close))
                continue
            before = self.get(i - 1)
            declared = before == "function" or self.get(i - 2) in ("function", "*")
            method = self.kind[i - 1] == "id" and before not in self.keywords and self.get(i - 2) in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "override", "readonly", "*", ",") if i else False
            if declared or method:
                body = self.body_after(close)
                if body >= 0:
                    add("" if before == "function" else before, i, body, self.close[body], self._names(i, close))
        return out

    def _names(self, lo: int, hi: int) -> list[str]:
        return [self.text[k] for k in range(lo + 1, hi) if self.kind[k] == "id" and (self.get(k - 1) in ("(", ",", "{", "...") or k == lo + 1)]

    def _blocks(self) -> list[dict]:
        """If, try and catch blocks: kind, the tokens of head, body and else, and what is known of them."""
        out = []
        for i in range(self.n):
            t = self.text[i]
            if t == "if" and self.get(i - 1) != ".":
                if self.go:
                    body = i + 1
                    while body < self.n and self.text[body] != "{":
                        body = self.close.get(body, body) + 1
                    head = (i + 1, body - 1)
                else:
                    if self.get(i + 1) != "(":
                        continue
                    body, head = self.close[i + 1] + 1, (i + 2, self.close[i + 1] - 1)
                if body >= self.n:
                    continue
                end = self.close.get(body) if self.text[body] == "{" else self._statement_end(body)
                other = end + 1 if self.get(end + 1) == "else" else end + 2 if self.get(end + 1) == ";" and self.get(end + 2) == "else" else 0
                out.append({"ord": i, "kind": "If", "head": head, "body": (body, end), "orelse": (other + 1, self._else_end(other + 1)) if other else None, "never": head[0] == head[1] and self.text[head[0]] in FALSE})
            elif t == "try" and self.get(i + 1) == "{":
                end = self.close[i + 1]
                caught = end + 1 if self.get(end + 1) == "catch" else -1
                inside = None
                if caught >= 0:
                    open_ = caught + 1 if self.get(caught + 1) == "{" else self.close.get(caught + 1, caught) + 1
                    inside = (open_, self.close.get(open_, open_))
                    out.append({"ord": caught, "kind": "ExceptHandler", "head": None, "body": inside, "orelse": None, "never": False})
                out.append({"ord": i, "kind": "Try", "head": None, "body": (i + 1, end), "orelse": None, "never": False, "swallows": bool(inside) and "throw" not in self.text[inside[0] : inside[1]]})
        return out

    def _statement_end(self, i: int) -> int:
        line = self.line(i)
        while i + 1 < self.n and self.text[i] != ";" and self.line(i + 1) == line:
            i = self.close.get(i, i) + (0 if i in self.close else 1)
            if i in self.open:
                line = self.line(i)
                if i + 1 < self.n and self.line(i + 1) == line:
                    i += 1
                else:
                    break
        return min(i, self.n - 1)

    def _else_end(self, i: int) -> int:
        if self.get(i) == "{":
            return self.close[i]
        if self.get(i) == "if":
            j = i + 1
            while j < self.n and self.text[j] != "{":
                j = self.close.get(j, j) + 1
            end = self.close.get(j, j)
            return self._else_end(end + 2) if self.get(end + 1) == "else" else end
        return self._statement_end(i)

    def chain(self, i: int) -> tuple[int, str, str, str]:
        """(first token, dotted name, receiver's last name, inner call's name) of the callee that ends at token i."""
        parts, inner = [self.text[i]], ""
        while self.get(i - 1) in (".", "?."):
            i -= 2
            if self.kind[i] == "id":
                parts.insert(0, self.text[i])
            elif self.text[i] == ")":
                i = self.open[i] - 1
                if i >= 0 and self.kind[i] == "id":
                    i, inner, _, _ = self.chain(i)
                parts.insert(0, inner if "." in inner else "?")
                break
            else:
                parts.insert(0, "?")
                break
        name = ".".join(parts)
        return i, name, parts[-2].split(".")[-1] if len(parts) > 1 else "", inner

    def argument_spans(self, open_: int) -> list[tuple[int, int]]:
        out, lo, k, end = [], open_ + 1, open_ + 1, self.close[open_]
        while k <= end:
            if k == end or self.text[k] == ",":
                if k > lo:
                    out.append((lo, k - 1))
                lo = k + 1
            k = self.close.get(k, k) + 1 if k != end else k + 1
        return out

    def argument(self, pos: int, lo: int, hi: int) -> dict:
        ids = [self.text[k] for k in range(lo, hi + 1) if self.kind[k] == "id" and self.get(k - 1) not in (".", "?.") and self.text[k] not in self.keywords]
        plain = all(self.kind[k] == "id" or self.text[k] in (".", "?.") for k in range(lo, hi + 1)) and self.kind[lo] == "id"
        literal = None
        if lo == hi and self.kind[lo] in ("str", "tpl"):
            literal = re.sub(r"\$\{[^}]*\}", "{var}", self.text[lo][1:-1]) if not self.go else self.text[lo][1:-1]
        return {"pos": pos, "kw": None, "name": self.text[lo] if plain and self.text[lo] not in FALSE | {"true"} else None, "text": literal, "literals": [literal] if literal is not None else [], "roots": ids}

    def use(self, first: int, open_: int, fn: dict | None) -> str:
        """What becomes of a call's value, in the words of the Python facts; Discard if it is thrown away on purpose."""
        i = first - 1
        while self.get(i) in ("await", "(") and not (self.get(i) == "(" and self.get(i - 1) in ("if", "while")):
            if self.get(i) == "(" and self.kind[i - 1] == "id":
                break
            i -= 1
        t, after = self.get(i), self.get(self.close[open_] + 1)
        if t in ("!", "return", "throw"):
            return {"!": "UnaryOp", "return": "Return", "throw": "Raise"}[t]
        if t == "void":
            return "Discard"
        if t in ("&&", "||", "??", "?") or after in ("&&", "||", "??", "?", "==", "!=", "===", "!=="):
            return "BoolOp"
        if t in ("=", ":="):
            names, k = [], i - 1
            while k >= 0 and (self.kind[k] == "id" or self.text[k] in (",", "{", "}")) and self.text[k] not in ("const", "let", "var", "if", "for", "switch") and self.line(k) == self.line(i):
                names += [self.text[k]] if self.kind[k] == "id" else []
                k -= 1
            if names and all(x == "_" for x in names):
                return "Discard"
            lo, hi = (self.close[open_] + 1, fn["hi"]) if fn else (self.close[open_] + 1, self.n)
            later = set(self.text[lo:hi])
            return "Assign" if any(x in later for x in names if x != "_") else "Expr"
        for b in self.blocks:
            if b["kind"] == "If" and b["head"][0] <= first <= b["head"][1]:
                return "If"
        return "If" if t == "(" and self.get(i - 1) in ("if", "while") else "Expr"

    def lines(self, span: tuple[int, int] | None) -> list[dict]:
        return [] if span is None else [{"lo": self.line(span[0]), "hi": self.line(min(span[1], self.n - 1))}]

    def steps(self, i: int, around: list[dict]) -> list[dict]:
        inside = lambda span: span is not None and span[0] <= i <= span[1]
        out = []
        for b in self.blocks:
            spans = [b["body"], b["orelse"], b["head"]]
            if any(map(inside, spans)):
                every = [s for s in spans if s]
                out.append({"ord": b["ord"], "kind": b["kind"], "never": b["never"], "body": inside(b["body"]), "orelse": inside(b["orelse"]), "swallows": b.get("swallows", False), "body_ranges": self.lines(b["body"]), "orelse_ranges": self.lines(b["orelse"]), "lo": self.line(min(s[0] for s in every)), "hi": self.line(max(s[1] for s in every))})
        out += [{"ord": f["ord"], "kind": "function", "never": False, "body": False, "orelse": False, "swallows": False, "body_ranges": [], "orelse_ranges": [], "lo": self.line(f["lo"]), "hi": self.line(f["hi"])} for f in around]
        return sorted(out, key=lambda s: -s["ord"])

    def assigned(self, fn: dict | None, name: str) -> list[tuple[int, int]]:
        """Token spans of what a variable is assigned in a function, up to the line's end."""
        out = []
        for k in range(*(fn["lo"], fn["hi"]) if fn else (0, self.n)):
            if self.text[k] in ("=", ":="):
                j = k - 1
                while j >= 0 and (self.kind[j] == "id" or self.text[j] == ",") and self.line(j) == self.line(k):
                    if self.text[j] == name:
                        end = k + 1
                        while end + 1 < self.n and self.line(end + 1) == self.line(k):
                            end += 1
                        out.append((k + 1, end))
                    j -= 1
        return out

    def unneeded(self, name: str, args: list[tuple[int, int]], fn: dict | None) -> str:
        """For Go: why a call isn't the caller's doing: it removes its own temporary file, opens a log or configuration file, or fetches an address that an interface returned."""
        if not args:
            return ""
        lo, hi = args[0]
        span = lambda s: "".join(self.text[s[0] : s[1] + 1])
        var = self.text[lo] if self.kind[lo] == "id" else ""
        if name.startswith("os.Remove") and lo == hi and var:
            made = [span(s) for s in self.assigned(fn, var)]
            made += [span(s) for m in made if m.endswith(".Name()") for s in self.assigned(fn, m[: -len(".Name()")])]
            return "temporary" if any("os.CreateTemp" in m or "os.MkdirTemp" in m for m in made) else ""
        if name in ("os.OpenFile", "os.Create", "os.WriteFile") and var:
            fields = [self.text[hi]] if hi > lo else [self.text[s[1]] for s in self.assigned(fn, var) if self.get(s[1] - 1) == "."]
            return "setup" if any(q in f.lower() for f in fields for q in QUIET_FIELDS) else ""
        if name == "http.Get" and var:
            for s in self.assigned(fn, var):
                opened = next((k for k in range(s[0], s[1] + 1) if self.text[k] == "("), -1)
                if opened > s[0]:
                    _, made, receiver, _ = self.chain(opened - 1)
                    if receiver or re.search("get|fetch|list|find", made.lower()):
                        return "returned"
        return ""

    def signal(self, f: dict) -> str:
        """Why an agent can reach a function; ''."""
        if self.go:
            if any(x in self.source[: self.at[f["first"]]] for x in GO_FRAMEWORKS):
                return "agent_framework_import"
            return "tool_registration" if f["name"] in self.handlers else ""
        body = self.source[self.at[f["first"]] : self.at[f["hi"]] + 1]
        if SIGNALS.search(body) or any(LINE_SIGNALS.search(x) and not NOT_CODE.match(x) for x in body.split("\n")):
            return "tool_handler"
        rows, start = self.source.split("\n"), self.line(f["first"]) - 1
        if f["name"]:
            word = re.compile(rf"(?<![\w$]){re.escape(f['name'])}(?![\w$])")
            for k, x in enumerate(rows):
                if "tool(" in x and not NOT_CODE.match(x) and word.search(x):
                    return "tool_registration"
                if "setRequestHandler" in x and any(word.search(y) for y in rows[k : k + 3]):
                    return "tool_registration"
            if "DynamicStructuredTool" in self.source and word.search(self.source[: self.at[f["first"]]] + self.source[self.at[f["hi"]] :]):
                return "tool_registration"
        for x in rows[max(0, start - 3) : start + 1]:
            if not NOT_CODE.match(x) and re.search(r"tool\(|execute ?:|setRequestHandler|DynamicStructuredTool|registerTool", x):
                return "inline_handler"
        cls = [(i, self.close[k]) for i in range(self.n) if self.text[i] == "class" and self.kind[i + 1 if i + 1 < self.n else i] == "id" for k in [next((k for k in range(i, self.n) if self.text[k] == "{"), -1)] if k >= 0 and k < f["first"] < self.close[k]]
        if cls and (SIGNALS.search(self.source) or any(LINE_SIGNALS.search(x) and not NOT_CODE.match(x) for x in rows)):
            lo, hi = cls[-1]
            name = re.escape(self.text[lo + 1])
            rest = rows[: self.line(lo) - 1] + rows[self.line(hi) :]
            if any(re.search(rf"new {name}\b|\b{name}\(|: {name}\b|<{name}>", x) and not x.strip().startswith("//") for x in rest):
                return "tool_class"
        return ""

    def facts(self) -> dict:
        opens = [i for i in range(1, self.n) if self.text[i] == "(" and self.kind[i] == "punc" and self.kind[i - 1] == "id" and self.text[i - 1] not in self.keywords]
        headers = {f["first"] for f in self.functions}
        opens = [i for i in opens if i not in headers]
        self.handlers = set()
        if self.go:
            for i in opens:
                if self.text[i - 1] in GO_REGISTER:
                    self.handlers |= {self.text[hi] for lo, hi in self.argument_spans(i) if self.kind[hi] == "id" and all(self.kind[k] == "id" or self.text[k] == "." for k in range(lo, hi + 1))}
        shell = set()
        if not self.go:
            for m in re.finditer(r"(?:import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+|(?:const|let|var)\s+(\w+)\s*=\s*require\()['\"](?:node:)?child_process['\"]", self.source):
                shell.add(m[1] or m[2])
        whole = None
        if not self.go and re.search("setRequestHandler|registerTool", self.source):
            whole = {"ord": -1, "name": "", "first": 0, "lo": 0, "hi": max(0, self.n - 1), "params": []}
        calls = []
        for i in opens:
            first, name, receiver, _ = self.chain(i - 1)
            if self.go and name == "panic":
                continue
            around = sorted((f for f in self.functions if f["lo"] <= i <= f["hi"]), key=lambda f: -f["ord"])
            declared = [f for f in around if f["name"]] if self.go else around
            fn = (declared[-1] if self.go else declared[0]) if declared else whole
            spans = self.argument_spans(i)
            names = [name] + ([f"child_process.{self.text[i - 1]}"] if receiver in shell else [])
            calls.append({
                "ord": i, "line": self.line(first), "col": self.col(first), "kind": "attr" if "." in name else "name", "callee": name, "last": self.text[i - 1], "names": names, "exact": [], "mods": [receiver] if receiver else [],
                "receiver": receiver, "module_name": receiver, "text": re.sub(r"\s+", " ", self.source[self.at[first] : self.at[self.close[i]] + 1])[:120], "args": [self.argument(k, *s) for k, s in enumerate(spans)],
                "parent": self.use(first, i, around[0] if around else None), "origin": "", "chain": [], "strong": False, "fn": fn["ord"] if fn else None, "near_params": around[0]["params"] if around else [],
                "fids": [f["ord"] for f in around] + ([-1] if whole else []), "constant_in": [], "steps": self.steps(i, around), "classes": [self.unneeded(name, spans, declared[-1] if declared else None)] if self.go else [], "class_bases": [], "fn_decorators": [],
            })
        functions = [
            {
                "ord": f["ord"], "name": f["name"], "lo": self.line(f["lo"]), "hi": self.line(f["hi"]), "decorators": [], "params": f["params"],
                "raises": ("panic" if self.go else "throw") in self.text[f["lo"] : f["hi"]], "bases": [], "passed_to": [], "listed_in": ["module_registration" if f is whole else s] if f is whole or (s := self.signal(f)) else [],
                "branches": [], "action_lines": [], "aliases": [],
            }
            for f in [*self.functions, *([whole] if whole else [])]
        ]
        return EMPTY | {"calls": calls, "functions": functions}


def extract_braces(source: str, language: str) -> dict:
    """Facts and error, as extract() gives them for Python. It never raises for any source."""
    try:
        return Braces(source, language == "go").facts() | {"error": ""}
    except (SyntaxError, RecursionError, MemoryError, IndexError, KeyError, ValueError) as e:
        return EMPTY | {"error": f"{type(e).__name__}: {e}"}

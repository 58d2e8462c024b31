"""Secret scans: assignment-aware lexing of source and configuration text, beside three plain patterns.

The lexer reads assignments: a target name, a sign (`=`, `:`, `:=`, `=>`), with or without a type (`name: type =`, `var name type =`), and an expression;
elements and attributes of markup (`<password>..</password>`, `key="password" value=".."`); indented block values; directives (`#define NAME ".."`,
`ENV NAME ..`); calls that set something (`setPassword("..")`, `define('DB_PASSWD', '..')`); authorization schemes, passwords in addresses (`//user:..@host`)
and private key blocks. An expression is read into literals, names and calls:
strings with escapes, unquoted values, `+` chains, alternatives (`||`, `??`, `or`), literals side by side in parentheses, and the arguments of
calls but for the key of a look-up (`getenv("KEY")`); comments and white space of any length are passed over. Names link assignments into a graph:
a name stands for its last definition before, or the first one behind if there is none before. The sensitivity of a target's
words passes along that graph to every constant it reaches until nothing changes, and a literal is scored by the most sensitive name it reaches
and by its own make. Literals that reach `threshold` become spans of kind `pair`, unless a plain pattern's span covers them already.

Defined results: null text is empty and has no spans; spans are code points, end exclusive, in order of start, then kind as
in KINDS, then end; a literal met twice is one span with its higher score. Repeated rows are scanned row by row. Columns of the input are never
mixed with results, whatever their names. Texts of any length are read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, text_values

KINDS = ("assign", "access", "hex", "pair")

# fixed values: the plain patterns of the contract
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Sensitivity of the words of a target name.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.7, "creds": 0.8, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "private": 0.5, "signing": 0.5, "encryption": 0.5, "access": 0.4, "api": 0.4, "key": 0.4, "salt": 0.5, "dsn": 0.5, "connection": 0.3, "session": 0.3, "client": 0.1}
# fixed values: whole literals that stand for a secret without being one
_HARMLESS = re.compile(
    r"(?:(?:your|my|the|some|an?|example|sample|dummy|test(?:ing)?|fake|mock|default|insert|enter|replace|change|this|none|null|nil|true|false|undefined|todo|placeholder|redacted|hidden|masked|password|passwd|passphrase|pwd|pass|secret|token|api|key|value|name|user|string|here|me|with|of|in|it|id|is|not|empty|\d{1,6}|[-_. ])+|x{3,}|\*+|\.+|-+|<[^<>]*>|\$\{[^}]*\}|\{\{.*\}\}|\{[^}]*\}|%\w*%?|\$\w+|\[[^\]]*\])\Z",
    re.ASCII | re.IGNORECASE,
)
#: Words that speak of a secret or to a reader, so that quoted words with one of them are prose and no passphrase.
_PROSE = frozenset("a an and are be by can do enter for from has if in is invalid it missing must no not of on or please required should that the this to too was were will with wrong you your password passphrase secret token key".split())
#: Callees whose first argument is a key to look up.
_LOOKUPS = frozenset("getenv get env environ getproperty property config setting settings param parameter read lookup fetch var variable variables secret input prompt getpass ask require option options getstring require_env".split())
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-$")
_FIRST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_VALUE = re.compile(
    r"""(?:[rbufRBUF]{1,2}(?=["']))?(?:\"\"\"((?:[^\\"]|\\.|"(?!""))*+)\"\"\"|\'\'\'((?:[^\\']|\\.|'(?!''))*+)\'\'\'|"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\n]*+)`|([A-Za-z0-9_.+/$~^!@#%&*?-]++(?:=+(?![A-Za-z0-9_"'=]))?))""",
    re.DOTALL,
)
_BARE = 6
_CALL = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*+(?=[(\[])", re.ASCII)
_SPACE = re.compile(r"(?:\s|\\\r?\n)*+")
_SIGN = re.compile(r":=|=>|[=:]")
_SIGNED = re.compile(r"[ \t]*+(?::=|=>|[=:])")
#: A type between a colon and the sign of an assignment: `name: type = `.
_TYPED = re.compile(r"""[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., |]*+(?:\[[\w., |]*+\][\w., |]*+)*+\]|<[\w., ]*+(?:<[\w., ]*+>[\w., ]*+)*+>)?+[?]?+(?:[ \t]++=(?![=>])(?=[ \t"'`])|[ \t]*+=(?=["'`]))""", re.ASCII)
#: `var name type` before a sign, `#define NAME`, `ENV NAME` and the like before a value.
_DECLARED = re.compile(r"\b(?:var|const|let)[ \t]+([A-Za-z_]\w*)[ \t]+[\w.\[\]*]*$", re.ASCII)
_DIRECTIVE = re.compile(r"^[ \t]*+(?:#[ \t]*+define|ENV|ARG|setenv|setx|SetEnv|machine|login)[ \t]++([A-Za-z_]\w*+)[ \t]++(?=[^\s=])", re.MULTILINE | re.ASCII)
#: Calls that set something: by their own name, or by a name they are given before the value.
_SETTER = re.compile(r"""\b([A-Za-z_]\w*+)\(\s*+(?=["'`])""", re.ASCII)
_NAMED_CALL = re.compile(r"""\b[A-Za-z_]\w*+\(\s*+(["'])([\w.:/-]++)\1\s*+,\s*+(?=["'`])""", re.ASCII)
_ASKS = re.compile(r"(?:get|read|fetch|find|load|ask|prompt|input|is|has|check|valid|verify|require|lookup|print|log|warn|error|raise|test|assert|describe|it|label|message|msg)", re.IGNORECASE)
_SCHEME = re.compile(r"""\b(?:proxy-)?authorization["']?\s*+[:=,]\s*+["']?(?:bearer|basic|token)[ \t]++([A-Za-z0-9._~+/-]++=*+)""", re.IGNORECASE | re.ASCII)
_CREDENTIALS = re.compile(r"""://[^\s/:@"'<>]*+:([^\s/@"'<>:]++)@[\w\[]""")
_KEY_BEGIN, _KEY_END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"), "-----END "
_JOIN = re.compile(r"\|\||\?\?|\?:|\+(?!=)|(?:or|else)\b|,")
_BLOCK = re.compile(r"[ \t]*[|>][-+]?[0-9]?[ \t]*\r?\n((?:[ \t]*\r?\n)*([ \t]+)[^\n]*)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</([\w.:-]++)\s*+>")
_ATTRIBUTES = re.compile(r"""\b(?:key|name|id)\s*+=\s*+(["'])([^"'<>\n]*+)\1\s++value\s*+=\s*+(["'])([^"'<>\n]*+)\3""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*", re.ASCII)
_CONSTANT = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
#: Without one of these a text has no sensitive name.
_HINTS = sorted({min((h for h in NAME_WEIGHTS if h in w), key=len) for w in NAME_WEIGHTS})


def name_score(name: str) -> float:
    """0 to 1: how likely the words of a target name announce a secret; words that only qualify add up."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = "".join(words)
    best = max((NAME_WEIGHTS[w] for w in NAME_WEIGHTS if len(w) > 5 and w in joined), default=0.0)
    return min(1.0, max(best, sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words))))


def literal_score(value: str, quoted: bool = True) -> float:
    """0 to 1: length and character entropy of a literal; placeholders, paths and prose score 0, quoted words without prose a passphrase's."""
    if len(value) < 6 or _HARMLESS.match(value) or value.startswith(("http://", "https://", "/", "./")):
        return 0.0
    if any(c.isspace() for c in value):
        words = value.split()
        phrase = quoted and 3 <= len(words) <= 12 and len(value) >= 15 and "\n" not in value and value[-1] not in ".!?:" and _PROSE.isdisjoint(w.lower().strip(",;") for w in words)
        return 0.6 if phrase else 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 4) * min(1.0, 0.4 + 0.2 * classes + len(value) / 64)


class Blanks:
    """Passes over white space and comments; remembers where the next end of a line and of a comment is, so that none is looked for twice."""

    def __init__(self, text: str):
        self.text, self.ends = text, {"\n": (0, -1), "*/": (0, -1)}

    def _next(self, mark: str, pos: int) -> int:
        asked, found = self.ends[mark]
        if not asked <= pos <= found:
            found = self.text.find(mark, pos)
            found = len(self.text) if found < 0 else found
            self.ends[mark] = pos, found
        return found

    def behind(self, pos: int) -> int:
        text = self.text
        while True:
            pos = _SPACE.match(text, pos).end()
            two = text[pos : pos + 2]
            if two in ("# ", "#\t", "//"):
                stop = self._next("\n", pos)
            elif two == "/*":
                stop = self._next("*/", pos + 2)
                stop += 2 if stop < len(text) else 0
            else:
                return pos
            if stop == len(text):  # behind it there is no value
                return pos
            pos = stop


def expression(text: str, pos: int, blanks: Blanks) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, bare) of the operands from `pos` on, and the place behind them. Behind a line break, what has a sign of its own is a
    name, and a bare word that is not indented is no value unless it is in brackets or behind an operator."""
    found: list[tuple[int, int, bool]] = []
    calls: list[str | None] = []  # open brackets: the callee while its first argument is awaited
    joined, end = False, pos
    while True:
        start = pos
        while True:
            pos = blanks.behind(pos)
            if text[pos : pos + 1] not in ("(", "[") or not text[pos : pos + 1]:
                break
            calls.append(None)
            pos += 1
        call = _CALL.match(text, pos)
        if call and text.find("\n", start, pos) < 0:
            calls.append(call[0].rsplit(".", 1)[-1].lower())
            end = pos = call.end() + 1
            joined = True
            continue
        value = _VALUE.match(text, pos)
        if not value:
            # an empty call, such as f() || "x"
            if calls and text[pos : pos + 1] in (")", "]") and text[pos : pos + 1]:
                pass
            else:
                break
        else:
            bare = value.lastindex == _BARE
            if text.find("\n", start, pos) >= 0 and (_SIGNED.match(text, value.end()) or bare and not (calls or joined or text[pos - 1] in " \t")):
                break
            if calls and _SIGNED.match(text, value.end()) and text[value.end() : value.end() + 2] != "==":
                break  # an assignment of its own: an argument's name, a key
            key = bool(calls) and calls[-1] is not None and calls[-1] in _LOOKUPS
            if calls:
                calls[-1] = None
            if not key:
                found.append((*value.span(value.lastindex), bare))
            end = pos = value.end()
        while True:
            after = pos
            pos = blanks.behind(pos)
            if not calls or text[pos : pos + 1] not in (")", "]") or not text[pos : pos + 1]:
                break
            calls.pop()
            end = pos = pos + 1
        # a call goes on: .get("X")
        sign = _JOIN.match(text, pos)
        if sign and (sign[0] != "," or calls) and not (text.find("\n", after, pos) >= 0 and sign[0] in ("or", "else")):
            pos, joined = sign.end(), True
        elif calls and text[pos : pos + 1] in ("'", '"', "`") and text[pos : pos + 1]:
            joined = True
        else:
            break
    return found, end


def block_value(text: str, pos: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Lines of an indented block value (`|` or `>` behind the sign) as literals, and the place behind them."""
    block = _BLOCK.match(text, pos)
    if not block:
        return [], pos
    indent, found, at = block[2], [], block.start(1)
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if line.strip():
            if not line.startswith(indent):
                break
            found.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip()), False))
        at = stop + 1
    return found, min(at, len(text))


class Assignments:
    """Assignments of a text: target, its weight, literals, and the names its expression holds."""

    def __init__(self, text: str):
        self.text = text
        self.made: list[tuple[float, list[tuple[int, int, bool]], list[str]]] = []
        self.defined: dict[str, list[int]] = {}
        self._read()
        for m in _ELEMENT.finditer(text):
            if m[1] == m[3]:
                s, e = m.span(2)
                self._add(m[1], [(s + len(m[2]) - len(m[2].lstrip()), s + len(m[2].rstrip()), True)], False)
        for m in _ATTRIBUTES.finditer(text):
            self._add(m[2], [(*m.span(4), True)], False)
        self._read_calls()

    def _add(self, name: str, operands: list[tuple[int, int, bool]], names_count: bool = True) -> None:
        literals, names = [], []
        for s, e, bare in operands:
            word = self.text[s:e]
            if bare and names_count and _IDENT.fullmatch(word):
                names.append(word)
            # a bare word is a literal of configuration files if it stands alone and is neither plain letters nor a constant's name
            if not bare or not names_count or not (word.isalpha() or _CONSTANT.fullmatch(word) or len(operands) > 1 and _IDENT.fullmatch(word)):
                literals.append((s, e, not bare))
        if literals or names:
            self.defined.setdefault(name, []).append(len(self.made))
            self.made.append((name_score(name), literals, names))

    def _read(self) -> None:
        text, done, blanks = self.text, 0, Blanks(self.text)
        for sign in _SIGN.finditer(text):
            at = sign.start()
            if at < done:  # inside a literal
                continue
            if text[at : at + 2] == "==" or text[at : at + 3] == "://" or (at and text[at - 1] in "=!<>+-*/"):
                continue
            last = at
            while last > done and text[last - 1] in " \t":
                last -= 1
            while last > done and text[last - 1] in "\"']":
                last -= 1
            first = last
            while first > done and text[first - 1] in _NAME_CHARS:
                first -= 1
            while first < last and text[first] not in _FIRST:
                first += 1
            if first == last:
                continue
            begin, name = sign.end(), text[first:last]
            typed = _TYPED.match(text, begin) if sign[0] == ":" else None
            declared = _DECLARED.search(text, max(done, first - 120), first) if sign[0] == "=" else None
            if typed:
                begin = typed.end()
            elif declared:
                name = declared[1]
            operands, end = block_value(text, begin)
            if not operands:
                operands, end = expression(text, begin, blanks)
            self._add(name, operands)
            done = max(done, end) if operands else done

    def _read_calls(self) -> None:
        """Values that no sign stands before: of directives, of calls that set something, of authorization schemes."""
        text, blanks = self.text, Blanks(self.text)
        for m in _DIRECTIVE.finditer(text):
            if name_score(m[1]) > 0:
                self._add(m[1], expression(text, m.end(), blanks)[0][:1])
        for m in _SETTER.finditer(text):
            # a name that asks or checks takes a key or words for a reader
            if name_score(m[1]) > 0 and not _ASKS.match(m[1]) and m[1].lower() not in _LOOKUPS:
                value = _VALUE.match(text, m.end())
                if value and value.lastindex != _BARE:
                    self._add(m[1], [(*value.span(value.lastindex), False)])
        for m in _NAMED_CALL.finditer(text):
            value = _VALUE.match(text, m.end())
            if value and value.lastindex != _BARE and name_score(m[2]) > 0:
                self._add(m[2], [(*value.span(value.lastindex), False)])
        for m in _SCHEME.finditer(text):
            self._add("authorization", [(*m.span(1), False)])

    def literals(self) -> list[tuple[int, int, float]]:
        """(start, end, score): every literal by the highest weight that reaches its assignment along names."""
        weights = [w for w, _, _ in self.made]
        known = self.defined
        for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
            # the heaviest first, so that every assignment is passed once at most
            todo = [i] if self.made[i][0] == weights[i] else []
            while todo:
                j = todo.pop()
                for name in self.made[j][2]:
                    places = known.get(name)
                    if places:
                        before = bisect_left(places, j)
                        k = places[before - 1] if before else next((p for p in places if p != j), j)
                        if weights[k] < weights[i]:
                            weights[k] = weights[i]
                            todo.append(k)
        best: dict[tuple[int, int], float] = {}
        for w, (_, literals, names) in zip(weights, self.made, strict=True):
            for s, e, quoted in literals:
                word = self.text[s:e]
                if w > 0 and not (not quoted and word in known and word in names):  # a known name is no literal
                    best[s, e] = max(best.get((s, e), 0.0), w * literal_score(word, quoted))
        return [(s, e, w) for (s, e), w in best.items()]


def lexed_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of every literal that reaches a sensitive name, of passwords in addresses and of private key blocks."""
    lower = text.lower()
    found = Assignments(text).literals() if any(h in lower for h in _HINTS) else []
    if "://" in text and "@" in text:
        found += [(*m.span(1), literal_score(m[1])) for m in _CREDENTIALS.finditer(text)]
    at = 0
    while (begin := _KEY_BEGIN.search(text, at)) is not None:
        end = text.find(_KEY_END, begin.end())
        if end < 0:  # none ends any more
            break
        body = text[begin.end() : end]
        if body.strip():
            found.append((begin.end() + len(body) - len(body.lstrip()), begin.end() + len(body.rstrip()), 1.0))
        at = end
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the plain patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    lower = text.lower()
    if any(h in lower for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def scan_text(text: str, threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with the lexer's."""
    base = base_spans(text)
    extra = sorted({(s, 3, e) for s, e, w in lexed_literals(text) if w >= threshold})
    # base spans by start, with the farthest end so far, so that each literal looks once
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    extra = [x for x in extra if not (n := bisect_right(starts, x[0])) or ends[n - 1] < x[2]]
    return base, sorted(base + extra)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, n_pair, base_sha256, spans. No shuffle; reads two columns."""

    def fn(batch):
        cols: list[list] = [[], [], [], [], [], []]
        for text in text_values(batch.column(1)):
            base, spans = scan_text(text or "", threshold)
            counts = Counter(k for _, k, _ in spans)
            for c, v in zip(cols, (counts[0], counts[1], counts[2], counts[3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[id_col, "n_assign", "n_access", "n_hex", "n_pair", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], fn, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string")


def redact_text(text: str, threshold: float = 0.5, mark: str = "[secret]") -> str:
    """`text` with every span replaced by `mark`; overlapping spans are replaced as one."""
    _, spans = scan_text(text, threshold)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`; secrets in `text_col` are replaced by `mark`, null stays null."""
    at = docs.columns.index(text_col)

    def fn(batch):
        old = batch.column(at)
        new = [None if t is None else redact_text(t, threshold, mark) for t in text_values(old)]
        cols = list(batch.columns)
        cols[at] = pa.array(new, old.type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_batches(docs, docs.columns, fn, docs.schema)

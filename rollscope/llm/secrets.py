"""Secret scan: base patterns, and assignment-aware lexing of source and configuration syntax.

The lexer turns a text into names, literals and marks. `name = literal`, `name: literal`, `name: type = literal`,
`"name" => literal`, `name, name = literal, literal`, `<name>literal</name>` and calls such as `set(name, literal)` give
name-literal pairs, each branch of a conditional one; a name assigned before stands for its
value where it is assigned on, and adjacent or added literals are one value. A literal is reported if the name it
ends up under is sensitive and the value looks like a credential: the score is the weight of the most sensitive
word of the name times the plausibility of the value, and SCORE or more counts. Lines that begin with a comment mark
are comments; elsewhere such a mark ends nothing, since texts may hold URLs and anchors on one long line.

Values are kept as what they were put together from, with the sums that their score needs, so that assignments which
build on each other cost one step each, however often a value is added to itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame

from rollscope.llm.common import bounded_batches, with_columns_of
from rollscope.llm.spans import Span, digest, outside, printed

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SCORE = 0.5

# How telling a word of a name is.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "private": 0.6, "key": 0.6, "pass": 0.8,
}
# Words of a literal that stand for a secret and are none; digits may follow.
PLACEHOLDER = re.compile(
    r"(?:^|[^a-z0-9])(?:changeme|example|placeholder|your[a-z]*|dummy|sample|redacted|none|null)[0-9]*(?![a-z0-9])|xxxx|\*{4}", re.IGNORECASE | re.ASCII
)
#: What a literal begins with, without its quotation mark.
QUOTES = {'"': "", "'": r"(?:(?<![A-Za-z])|(?<=\b[bBfFrRuU]))", "`": ""}


def _lexer(banned: frozenset[str]) -> re.Pattern[str]:
    """Tokens of source and configuration text; banned quotation marks begin no literal."""
    closed = [f"{before}{q}(?:[^{q}\\\\\n]|\\\\.)*{q}" for q, before in QUOTES.items() if q not in banned]
    unclosed = [x[:-1] for x in closed]
    return re.compile(
        rf"""(?P<comment>^[^\S\n]*(?:\#|//)[^\n]*)|(?P<blank>[^\S\n]+)|(?P<slash>//+)
        |(?P<text>{"|".join(closed) or "(?!)"})|(?P<unclosed>{"|".join(unclosed) or "(?!)"})
        |(?P<prefix>\b[bBfFrRuU](?=["']))
        |(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
        |(?P<assign>:=|=>|->|=(?!=)|:(?!//))|(?P<join>[+.](?=\s))|(?P<bare>[A-Za-z0-9+/_=~-][A-Za-z0-9+/_.=~-]*)
        |(?P<line>\n)|(?P<other>.)""",
        re.VERBOSE | re.ASCII | re.DOTALL | re.MULTILINE,
    )


LEXERS = {frozenset(x): _lexer(frozenset(x)) for n in range(4) for x in combinations(QUOTES, n)}
TAGGED = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>([^<>\s]+)</\1\s*>", re.ASCII)
SENSITIVE = re.compile("|".join(sorted(WEIGHTS)), re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, by start and then kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def name_weight(name: str) -> float:
    """The weight of the most sensitive word of an identifier in any case style."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    parts = re.split(r"[^a-z0-9]+", words.lower())
    return max((WEIGHTS.get(x, 0.0) for x in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


class Value:
    """A literal, or what others make together: its length, shares of characters, kinds of them, and flaws."""

    __slots__ = ("span", "parts", "n", "shares", "kinds", "blank", "placeholder", "told")

    def __init__(self, span: tuple[int, int] | None, parts: list[Value], n: float, shares: dict[str, float], kinds: int, blank: bool, placeholder: bool):
        self.span, self.parts, self.told = span, parts, False
        self.n, self.shares, self.kinds, self.blank, self.placeholder = n, shares, kinds, blank, placeholder

    @classmethod
    def literal(cls, text: str, start: int, end: int) -> Value:
        value, n = text[start:end], end - start
        kinds = sum(1 << i for i, k in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) if re.search(k, value))
        blank = bool(re.search(r"\s", value)) or "${" in value or "{{" in value
        return cls((start, end), [], n, {c: k / n for c, k in Counter(value).items()}, kinds, blank, bool(PLACEHOLDER.search(value)))

    @classmethod
    def of(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        n = sum(p.n for p in parts)
        shares: Counter[str] = Counter()
        for p in parts:
            for c, x in p.shares.items():
                shares[c] += x * (p.n / n if n else 0.0)
        kinds = 0
        for p in parts:
            kinds |= p.kinds
        n = min(1e300, n)  # that of a value added to itself again and again stays finite
        return cls(None, parts, n, shares, kinds, any(p.blank for p in parts), any(p.placeholder for p in parts))

    def weight(self) -> float:
        """How much it looks like a credential: length, variety, and no placeholder."""
        if self.n < 8 or self.blank:
            return 0.0
        if self.placeholder:
            return 0.1
        entropy = -sum(x * math.log2(x) for x in self.shares.values() if x > 0)
        return min(1.0, entropy / 3.0) * (1.0 if self.kinds.bit_count() >= 2 else 0.6)

    def tell(self) -> Iterator[tuple[int, int]]:
        """Spans of the literals it was made of that no value has told before."""
        todo = [self]
        while todo:
            one = todo.pop()
            if not one.told:
                one.told = True
                if one.span:
                    yield one.span
                todo += one.parts


def tokens(text: str) -> Iterator[re.Match[str]]:
    """Tokens in order. A mark whose literal is not closed is one of its own, and up to where it looked no mark like it is tried
    again, as none could be closed there; so every letter is read a bounded number of times."""
    at, until = 0, {}
    while at < len(text):
        banned = frozenset(q for q, end in until.items() if end > at)
        limit = min((until[q] for q in banned), default=len(text))
        for m in LEXERS[banned].finditer(text, at):
            if m.lastgroup == "unclosed":
                until[m[0][0]] = m.end()
                break
            yield m
            at = m.end()
            if at >= limit:
                break


def _paired(target: str, targets: list[str], told: list[Value], value: list[Value]) -> list[tuple[str, Value]]:
    """The names of an assignment with their values; `value` is what the last one is made of."""
    values = [*told, Value.of(value)] if value else told
    if len(targets) == len(values):
        return list(zip(targets, values, strict=True))
    one = max(targets, key=name_weight) if targets else target
    return [(one, x) for x in values]


def assigned_values(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) for every assignment, with names assigned before put in.

    Of groups, lists and calls each member is a value of the name; what is called is none. Of names assigned in a chain the
    most sensitive one stands, as of several names with another number of values. Both branches of `a if b else c`, `b ? a : c`,
    `a or c`, `a || c` and `a ?? c` are values; what is asked for is none. Tags are matched by their names, without nesting.
    """
    if "</" in text:
        for m in TAGGED.finditer(text):
            yield m[1], Value.literal(text, *m.span(2))
    known: dict[str, Value] = {}
    name: str | None = None
    argument = False  # the name is the first argument of a call
    target: str | None = None  # the name left of an assignment mark whose value is being read
    annotated: str | None = None  # a name whose type is being read
    value: list[Value] = []
    plain = True  # the value has names only
    joining, mark, before, last = True, "", "", ""
    depth, latest = 0, ""  # brackets that are open in the value, and the last name in it
    ahead: list[str] = []  # names with commas after them
    targets: list[str] = []  # those of a parallel assignment
    told: list[Value] = []  # their values so far
    asking, branches = False, False  # in the condition of an `if`, and in the branches after a question mark

    for m in tokens(text):
        kind, word = m.lastgroup, m[0]
        if kind in ("blank", "comment", "prefix"):
            continue
        start, end = m.span()
        if kind == "text":
            start, end = start + 1, end - 1
        if annotated:
            if word == "=":
                target, value, plain, joining, mark, depth, annotated = annotated, [], True, True, word, 0, None
            elif kind == "line":
                annotated = None
        elif target is None:
            if kind == "assign" and name or word == "," and name and argument:
                target, value, plain, joining, mark, depth = name, [], True, True, word, 0
                targets, told, ahead, asking, branches = [*ahead, name] if ahead and word == "=" else [], [], [], False, False
            elif word == "," and name and last == "name":
                ahead.append(name)
                name = None
            elif kind in ("name", "text"):
                ahead = ahead if before == "," and kind == "name" else []
                name, argument = text[start:end], before == "("
            elif kind != "other" or word not in "\"'])":
                name, ahead = None, []
        elif asking and kind != "line":
            asking = word != "else"
        elif kind == "name" and word == "if" and value and not joining:
            if not depth and not targets:
                known[target] = Value.of(value)
            yield target, Value.of(value)
            value, plain, joining, asking = [], True, True, True
        elif value and (kind == "name" and word == "or" and not joining or word in ("|", "?") and mark != ":" or branches and word == ":"):
            if word != "?" or text[end : end + 1] == "?":  # what stands before a single question mark is the condition
                yield target, Value.of(value)
            branches = word == "?" and text[end : end + 1] != "?"
            value, plain, joining = [], True, True
        elif word in ("|", "?") and not value and joining and before == word:
            pass
        elif word == "," and value and not depth and len(told) + 1 < len(targets):
            told.append(Value.of(value))
            value, plain, joining = [], True, True
        elif kind == "join" and value:
            joining = True
        elif kind == "name" and joining and text[end : end + 1] == "(":
            pass
        elif kind == "other" and word in "([" and joining:
            depth += 1
        elif depth and kind == "line":
            continue
        elif depth and word == ",":
            if value:
                yield target, Value.of(value)
            value, plain, joining = [], True, True
        elif depth and kind == "other" and word in ")]":
            depth, joining = depth - 1, False
        elif kind == "assign" and word == mark == "=" and value and plain and not targets:
            # Between brackets it is a named argument, which stands for itself.
            target, value, joining = latest if depth else max(target, latest, key=name_weight), [], True
        elif kind == "assign" and (not value or word == "=" and mark == ":" and plain):
            value, plain, joining = [], True, True
        elif kind in ("text", "bare", "name") and joining or kind == "text" and value:
            value.append(known.get(word) or Value.literal(text, start, end) if kind == "name" else Value.literal(text, start, end))
            plain, joining, latest = plain and kind == "name" and word not in known, False, word
        elif word in ("[", "|") and mark == ":" and value and plain:
            annotated, target = target, None
        else:
            for target, one in _paired(target, targets, told, value):
                known[target] = one
                yield target, one
            target, depth, name = None, 0, text[start:end] if kind in ("name", "text") else None
            argument = before == "("
        before, last = word, kind
    if target:
        yield from _paired(target, targets, told, value)


def lexed_spans(text: str) -> list[Span]:
    """Literals under sensitive names. A text without a mark or a call, or without a sensitive word, has none."""
    if not ("=" in text or ":" in text or "->" in text or "(" in text or "</" in text) or not SENSITIVE.search(text):
        return []
    found = set()
    for name, value in assigned_values(text):
        weight = name_weight(name) if SENSITIVE.search(name) else 0.0
        if weight and weight * value.weight() >= SCORE:
            found.update(("literal", a, b) for a, b in value.tell() if b > a)
    return sorted(found, key=lambda x: x[1:])


def _scan(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        base = base_spans(text)
        n = Counter(kind for kind, _, _ in base)
        every = sorted(base + outside(lexed_spans(text), base), key=lambda x: (x[1], KINDS.index(x[0])))
        out.append((n["assign"], n["access"], n["hex"], digest(base), printed(every)))
    return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, code points).

    Null texts are empty and give no spans; texts, names and literals of any length are read whole. Of literals of the
    method that overlap a base span or an earlier literal none is added. Repeated rows give repeated results, null
    doc_ids are kept, an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    kinds = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return with_columns_of(rows, _scan, kinds, "text")

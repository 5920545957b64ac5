"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds what they miss.

The tagger is trained on labelled spans: windows of the corpus around digits and at-signs, labelled by the base
patterns, and the same windows with their spans rewritten to forms that the patterns don't match (`00` for a
plus sign, spelled-out at-signs and dots, spaced parts). The sample is the TRAIN_WINDOWS windows with the
smallest hashes among all distinct ones, so it is bounded, uniform and the same in every run.

Windows of WINDOW characters lie on one grid over the whole text and overlap by half. Their scores are averaged where
they overlap, weighted towards the middle of a window, and one path is decoded over each region. Every kind of span
holds a digit, an at-sign, or an `at` that is bracketed or followed by a `dot`, else its check drops it; so regions begin
as the cells of the grid around those and the address characters that adjoin them, and grow while a decoded span
reaches their edge. Cells outside of regions can hold no span that would be kept, whatever their length.
Decoded spans that fail their kind's check, or touch a base span, are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rollscope.llm.common import bounded_batches, with_columns_of
from rollscope.llm.spans import Span, digest, outside, printed
from rollscope.llm.tagger import PAD, Tagger, encoded

KINDS = ("email", "ip", "card", "phone")
TRAIN_WINDOWS = 1200
WINDOW = 48
CELL = WINDOW // 2
BATCH = 1 << 20

AT = r"[(\[{<] ?at ?[)\]}>]|\bat\b(?=[^\n]{1,80}?\bdot\b)"
TRIGGER = re.compile(rf"[0-9@]|{AT}", re.ASCII | re.IGNORECASE)
#: What is looked for where the text has no word `dot`.
PLAIN_TRIGGER = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]", re.ASCII | re.IGNORECASE)
MAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
JOINED = re.compile(r" ?[A-Za-z0-9._%+-]*")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether digits, of any number and with any zeros before them, are at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The contract's patterns, by kind and then start."""
    found: list[Span] = []
    free = 0  # where the next match may start: matches don't overlap
    for m in MAIL.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            free = m.end()
    # Four runs of digits and dots: a failed start inside a run would fail as the run's first digit does.
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def cells(text: str) -> int:
    return max(1, -(-len(text) // CELL))


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges of cells around the triggers: of the address characters that adjoin one, and a cell more on both sides."""
    found: list[list[int]] = []
    last, joined = cells(text), 0
    for m in (TRIGGER if "dot" in text or "DOT" in text or "Dot" in text else PLAIN_TRIGGER).finditer(text):
        start, end = m.start(), m.end()
        while start > joined and (LOCAL.match(text, start - 1) or start == m.start() and text[start - 1] == " "):
            start -= 1
        if end > joined:
            joined = JOINED.match(text, end).end()
        a, b = max(0, start // CELL - 1), min(last, -(-max(end, joined) // CELL) + 1)
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def tag_numbers(length: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 2k + 1 at the start of a span of kind k and 2k + 2 inside."""
    tags = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        tags[start:end] = 2 * KINDS.index(kind) + 2
        tags[start] -= 1
    return tags


def tagged_spans(tags: np.ndarray) -> list[Span]:
    found: list[Span] = []
    for i, tag in enumerate(tags.tolist()):
        if tag and (tag % 2 or not found or found[-1][2] != i or KINDS.index(found[-1][0]) != (tag - 1) // 2):
            found.append((KINDS[(tag - 1) // 2], i, i + 1))
        elif tag:
            found[-1] = (found[-1][0], found[-1][1], i + 1)
    return found


def rewritten(kind: str, text: str, rng: random.Random) -> str:
    """A form of a span that the base patterns don't match."""
    if kind == "email":
        at, dot = rng.choice([(" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", " (dot) "), (" at ", " dot ")])
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return rng.choice([" . ", "[.]", ". "]).join(text.split("."))
    if kind == "card":
        return rng.choice([".", "  ", "_"]).join(re.findall(".{1,4}", re.sub("[^0-9]", "", text)))
    return "00" + text[1:] if rng.random() < 0.6 else "0" + text[2:].lstrip()


def new_card(rng: random.Random) -> str:
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    digits += next(d for d in "0123456789" if luhn(digits + d))
    return rng.choice(["", " ", "-"]).join(re.findall(".{4}", digits))


def training_set(snippets: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and tags of the snippets and of their rewritten forms."""
    rng, ids, tags = random.Random(seed), [], []

    def add(text: str, spans: list[Span]) -> None:
        for start in range(0, max(1, len(text) - WINDOW // 2), WINDOW // 2):
            one, two = np.full(WINDOW, PAD), np.zeros(WINDOW, dtype=np.int64)
            some = encoded(text)[start : start + WINDOW]
            one[: len(some)] = some
            two[: len(some)] = tag_numbers(len(text), spans)[start : start + WINDOW]
            ids.append(one)
            tags.append(two)

    for text in snippets:
        spans = sorted(base_spans(text), key=lambda x: (x[1], -x[2]))
        spans = [s for i, s in enumerate(spans) if not any(o[1] < s[2] and s[1] < o[2] for o in spans[:i])]
        add(text, spans)
        if spans:
            kind, start, end = rng.choice(spans)
            new = rewritten(kind, text[start:end], rng)
            if rng.random() < 0.3:
                kind, new = "card", new_card(rng)
                new = rewritten("card", new, rng) if rng.random() < 0.5 else new
            add(text[:start] + new + text[end:], [(kind, start, start + len(new))])
    return np.array(ids).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def fit_tagger(snippets: list[str]) -> Tagger | None:
    """None without snippets: then only the base patterns find anything."""
    if not snippets:
        return None
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(*training_set(snippets))
    return tagger


def plausible(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return bool(re.search(rf"@|{AT}", text, re.IGNORECASE)) and bool(re.search(r"\.|dot", text, re.IGNORECASE))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(octet, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def window_scores(tagger: Tagger, codes: list[np.ndarray], wanted: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """Mean scores over ranges of cells (text, from, to) of the windows that hold each character."""
    pieces = []  # (range, first character of the window in its text)
    flat = [(t, a, b) for t, some in enumerate(wanted) for a, b in some]
    for r, (t, a, b) in enumerate(flat):
        most = max(1, cells(codes[t]) - 1)  # windows of the text
        pieces += [(r, w * CELL) for w in range(max(0, a - 1), min(most, b))]
    middle = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    bounds = [(a * CELL, min(b * CELL, len(codes[t]))) for t, a, b in flat]
    total = [np.zeros((high - low, tagger.n_tags), np.float32) for low, high in bounds]
    weight = [np.zeros(high - low, np.float32) for low, high in bounds]
    for begin in range(0, len(pieces), 2048):
        some = pieces[begin : begin + 2048]
        ids = np.full((len(some), WINDOW), PAD)
        for row, (r, at) in zip(ids, some, strict=True):
            part = codes[flat[r][0]][at : at + WINDOW]
            row[: len(part)] = part
        for (r, at), scores in zip(some, tagger.emissions(ids), strict=True):
            low, high = max(at, bounds[r][0]), min(at + WINDOW, bounds[r][1])
            total[r][low - bounds[r][0] : high - bounds[r][0]] += scores[low - at : high - at] * middle[low - at : high - at, None]
            weight[r][low - bounds[r][0] : high - bounds[r][0]] += middle[low - at : high - at]
    return [t / w[:, None] for t, w in zip(total, weight, strict=True)]


def decoded(tagger: Tagger, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best tag path over each of the score tables, padded together in lots of BATCH rows or fewer (or of one table)."""
    paths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
    order = sorted((r for r, s in enumerate(scores) if len(s)), key=lambda r: len(scores[r]))
    while order:
        n = 1
        while n < min(256, len(order)) and (n + 1) * len(scores[order[n]]) <= BATCH:
            n += 1
        some, order = order[:n], order[n:]
        lengths = np.array([len(scores[r]) for r in some])
        every = np.zeros((n, lengths.max(), tagger.n_tags), np.float32)
        for row, r in zip(every, some, strict=True):
            row[: len(scores[r])] = scores[r]
        for r, path in zip(some, tagger.decode(every, lengths), strict=True):
            paths[r] = path[: len(scores[r])]
    return paths


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def model_spans(tagger: Tagger, texts: list[str], whole: bool = False) -> list[list[Span]]:
    """Spans that the tagger decodes in each text; `whole` decodes every text from end to end instead of its regions."""
    found: list[list[Span]] = [[] for _ in texts]
    todo = {t: ([(0, cells(text))] if whole else regions(text)) for t, text in enumerate(texts) if text}
    todo = {t: some for t, some in todo.items() if some}
    codes = {t: encoded(texts[t]) for t in todo}
    while todo:
        some = list(todo)
        paths = iter(decoded(tagger, window_scores(tagger, [codes[t] for t in some], [todo[t] for t in some])))
        again: dict[int, list[tuple[int, int]]] = {}
        for t in some:
            spans, grown = [], []
            for a, b in todo[t]:
                path, at = next(paths), a * CELL
                left, right = a > 0 and path[0] > 0, b < cells(texts[t]) and path[-1] > 0
                grown.append((max(0, a - 4 * left), min(cells(texts[t]), b + 4 * right)))
                spans += [(kind, at + start, at + end) for kind, start, end in tagged_spans(path)]
            if merged_ranges(grown) != todo[t]:
                again[t] = merged_ranges(grown)
                continue
            for kind, start, end in spans:
                raw = texts[t][start:end]
                start, end = start + len(raw) - len(raw.lstrip()), end - len(raw) + len(raw.rstrip())
                if end > start and plausible(kind, texts[t][start:end]):
                    found[t].append((kind, start, end))
        todo = again
    return found


def _snippets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The TRAIN_WINDOWS snippets of a task with the smallest hashes."""
    least: dict[str, str] = {}
    for frame in frames:
        for text in frame["text"]:
            for a, b in regions(text):
                for start in range(a * CELL, min(b * CELL, len(text)), 2 * WINDOW):
                    snippet = text[start : min(b * CELL, start + 2 * WINDOW)]
                    least[hashlib.md5(snippet.encode()).hexdigest()] = snippet
        if len(least) > 4 * TRAIN_WINDOWS:
            least = {k: least[k] for k in heapq.nsmallest(TRAIN_WINDOWS, least)}
    kept = heapq.nsmallest(TRAIN_WINDOWS, least)
    yield pd.DataFrame({"key": kept, "snippet": [least[k] for k in kept]}, dtype="object")


def train(docs: DataFrame) -> Tagger | None:
    """A tagger from the bounded sample of windows of these documents."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    sample = texts.mapInPandas(_snippets, "key string, snippet string").dropDuplicates(["key"])
    return fit_tagger([row.snippet for row in sample.orderBy("key").limit(TRAIN_WINDOWS).collect()])


def every_span(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and then start."""
    base = [base_spans(t) for t in texts]
    more = model_spans(tagger, texts) if tagger else [[] for _ in texts]
    by_kind = lambda s: sorted(s, key=lambda x: (KINDS.index(x[0]), x[1]))
    return [(by_kind(b), by_kind(b + outside(m, b))) for b, m in zip(base, more, strict=True)]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end by kind, code points).

    Null texts are empty and give no spans; repeated rows give repeated results; other columns are ignored. Texts and
    runs of digits of any length are read whole. Of spans of the method that overlap the first stays, of those with
    one start the longest. An empty table gives none, and without digits or at-signs there is no tagger to train.
    """
    tagger = train(docs)

    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for base, every in every_span(tagger, texts.tolist()):
            n = Counter(kind for kind, _, _ in base)
            out.append((*(n[k] for k in KINDS), digest(base), printed(every)))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    return with_columns_of(rows, scan, f"{counts}, base_sha256 string, spans string", "text")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the union is replaced once."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with every span masked in `text`; `n_chars` follows if there is one. Null texts stay null.

    Rows and all other columns stay, repeated rows as well; spans are those of `find_personal_data`.
    """
    tagger = train(docs)

    def mask(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        return pd.Series([masked(t, every) for t, (_, every) in zip(whole, every_span(tagger, whole), strict=True)], dtype=object)

    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), F.pandas_udf(mask, "string")(F.col("text"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

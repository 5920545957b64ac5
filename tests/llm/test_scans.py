import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rollscope.llm import licenses, pii, secrets, toxicity
from rollscope.llm.queries import QUERIES
from rollscope.llm.tagger import Tagger
from tests.llm.fixtures import documents, empty

# --- personal data


def contract_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@-+ ()_%4é", max_size=60))
def test_pii_base_is_the_contract(text):
    assert pii.base_spans(text) == contract_pii(text)


def test_pii_base_on_planted_and_long_texts():
    text = "a@b.c@d.e x.y@mail.example.org 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +49 (30) 1234-567"
    assert pii.base_spans(text) == contract_pii(text)
    digits = "9" * 5000
    assert pii.base_spans(f"1.2.3.{digits} 1.2.3.{'0' * 5000}7") == [("ip", 5007, 5007 + 5007)]
    for long in ("a" * 100_000, "1" * 100_000, "1." * 50_000, "+1 " * 30_000, "a@" * 30_000):
        pii.base_spans(long)


def test_tagger_gradients():
    rng = np.random.default_rng(1)
    ids, tags = rng.integers(0, 40, (3, 7)), rng.integers(0, 3, (3, 7))
    tagger = Tagger(3, embedding=3, hidden=4)
    _, grads = tagger.gradients(ids, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = tagger.p[name].copy(), []
        for step in (1e-2, -1e-2):
            tagger.p[name] = kept.copy()
            tagger.p[name][at] += step
            losses.append(tagger.gradients(ids, tags)[0])
        tagger.p[name] = kept
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(g[at]), rel=0.02, abs=1e-3)


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(2)
    tagger = Tagger(3)
    tagger.p["move"] = rng.standard_normal((3, 3)).astype(np.float32)
    scores = rng.standard_normal((4, 5, 3)).astype(np.float32)
    lengths = np.array([5, 3, 1, 4])
    found = tagger.decode(scores, lengths)
    for s, n, path in zip(scores, lengths, found, strict=True):
        value = lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(tagger.p["move"][a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        every = [tuple(p) for p in np.ndindex(*(3,) * n)]
        assert value(path[:n]) == pytest.approx(max(map(value, every)), abs=1e-5)


def test_tagger_finds_rewritten_forms():
    rng = random.Random(3)
    words = lambda: " ".join("".join(rng.choice("aeiorstn") for _ in range(rng.randint(2, 8))) for _ in range(6))
    phone = lambda: f"+{rng.randint(10, 99)} ({rng.randint(10, 99)}) {rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    snippets = [f"{words()} {rng.choice([phone, ip])()} {words()}" for _ in range(300)] + [f"{words()} {rng.randint(1, 99)} {words()}" for _ in range(60)]
    tagger = pii.fit_tagger(snippets)
    hits = 0
    for _ in range(40):
        text = f"{words()} 00{phone()[1:]} {words()}"
        hits += any(kind == "phone" for kind, _, _ in pii.every_span(tagger, [text])[0][1])
    assert hits >= 30
    base, every = pii.every_span(tagger, ["mail a.b@c.de now"])[0]
    assert set(base) <= set(every)


def test_pii_queries(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in QUERIES["op2_pii"](spark, sf).collect():
        want = sorted(contract_pii(docs[r.doc_id]), key=lambda x: (order[x[0]], x[1]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.KINDS)


def test_regions_give_what_whole_texts_give(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    texts += [f"{'a' * 60} [at] example dot org, or +49 {'1 ' * 40}", "x" * 200 + " 00491234567890 " + "y" * 200, ""]
    tagger = pii.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert pii.model_spans(tagger, texts) == pii.model_spans(tagger, texts, whole=True)
    assert sum(map(len, pii.model_spans(tagger, texts))) > 0
    one = pii.window_scores(tagger, [pii.encoded(texts[0][:100])], [[(0, 5)]])[0]
    ids = np.zeros((4, pii.WINDOW), dtype=np.int64)
    for w in range(4):
        part = pii.encoded(texts[0][:100])[w * pii.CELL : w * pii.CELL + pii.WINDOW]
        ids[w, : len(part)] = part
    every = tagger.emissions(ids)
    for i in range(100):  # the mean over the windows that hold a character, weighted to their middles
        held = [(every[w, i - w * 24], min(i - w * 24 + 1, 48 - (i - w * 24))) for w in range(4) if 0 <= i - w * 24 < 48]
        assert one[i] == pytest.approx(sum(s * k for s, k in held) / sum(k for _, k in held), rel=1e-4, abs=1e-5)


def test_pii_odd_rows(spark):
    df = documents(spark)
    assert pii.find_personal_data(df).count() == df.count()
    assert pii.find_personal_data(empty(spark)).count() == 0
    masked = pii.mask_personal_data(documents(spark, ["mail a@b.cd or +49 (30) 1234-5678", None]))
    assert masked.columns == df.columns
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[0].text == "mail [EMAIL] or [PHONE]" and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text is None


# --- secrets


def contract_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "=", ": ", "'", '"', "abc123456", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "x", " ", "\n", "+", "."]), max_size=14).map("".join))
def test_secret_base_is_the_contract(text):
    assert secrets.base_spans(text) == contract_secrets(text)


def test_lexer():
    code = 'cfg_pw = "hunter2Zed99"\nuser: bob\npassword = cfg_pw\n"api-key": "ab12" + "cd34EF56"\nauthToken -> Zx81_Kq2m1\n# password = "InComment99"\nnote: token of love\npassword = "changeme1"\n'
    assert [code[a:b] for _, a, b in secrets.lexed_spans(code)] == ["hunter2Zed99", "ab12", "cd34EF56", "Zx81_Kq2m1"]
    assert secrets.lexed_spans("no assignment here, only a password") == []
    secrets.lexed_spans("key=" * 20_000)


def told(code):
    return [code[a:b] for _, a, b in secrets.lexed_spans(code)]


def test_lexer_forms():
    assert told('client.set("db_pwd", "Zx81Kq2m1LL9")') == ["Zx81Kq2m1LL9"]
    assert told("setenv('API-KEY', 'Zx81Kq2m1LL9', 1); put(user, bob)") == ["Zx81Kq2m1LL9"]
    assert told('passphrase: str = "Zx81Kq2m1LL9"\nuser_pwd: Optional[str] = "Ab12Cd34Ef"\npwd: Optional[str]\n') == ["Zx81Kq2m1LL9", "Ab12Cd34Ef"]
    assert told('db_pwd = "Zx81NullKq2m1LL9"') == ["Zx81NullKq2m1LL9"] and told('db_pwd = "null-1234567"') == []
    assert told('see http://a.b/c#d and don\'t set db_pwd = "S3cretXyz9", it isn\'t safe # or pwd: "Qw3rTyUi0p"') == ["S3cretXyz9", "Qw3rTyUi0p"]
    long = "x" * 300
    assert told(f'{long}_pwd = "Zx81Kq2m1LL9"') == ["Zx81Kq2m1LL9"]
    assert told('db_pwd = "' + "ab" * 9000 + '"') == told('db_pwd = "' + "ab" * 90 + '"') == []
    assert told("db_pwd = b'Zx81Kq2m1LL9'") == ["Zx81Kq2m1LL9"]


def test_lexer_on_values_that_build_on_each_other():
    assert told('a = "Zx81"\n' + "a = a + a\n" * 2000 + "db_pwd = a\n" * 50) == ["Zx81"]
    lines = "".join(f'a = a + "k{i}Z"\n' for i in range(20_000))
    assert len(told('a = "Zx81"\n' + lines + "db_pwd = a\n")) == 20_001


def test_many_spans_in_linear_time():
    extra = [("literal", 10 * i, 10 * i + 6) for i in range(100_000)]
    base = [("hex", 20 * i + 5, 20 * i + 9) for i in range(50_000)]
    assert secrets.outside(extra, base) == [s for s in extra if s[1] % 20]
    assert secrets.outside([("a", 0, 5), ("b", 3, 9), ("c", 5, 7)], []) == [("a", 0, 5), ("c", 5, 7)]


def brute_outside(extra, base):
    kept = []
    for s in sorted(set(extra), key=lambda x: (x[1], -x[2], x[0])):
        if not any(s[1] < e and a < s[2] for _, a, e in [*base, *kept]):
            kept.append(s)
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8))
def test_outside(extra, base):
    extra, base = ([("k", a, a + n) for a, n in some] for some in (extra, base))
    assert secrets.outside(extra, base) == brute_outside(extra, base)


def test_secret_queries(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_secrets"](spark, sf).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in contract_secrets(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    df = documents(spark)
    assert secrets.scan_secrets(df).count() == df.count()
    assert secrets.scan_secrets(empty(spark)).count() == 0


# --- licences


def contract_licences(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Under the MIT", "license", "CC BY", "nc", "Apache", "License, Version 2", "é", "the", "x1", "-", "0"]), max_size=12).map(" ".join))
def test_licence_base_is_the_contract(text):
    assert licenses.Scanner().scan(text.encode())[:5] == contract_licences(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
def test_matching_statistics(templates, text):
    automaton = licenses.SuffixAutomaton(templates)
    found = lambda part: [n for n, t in enumerate(templates) if any(t[i : i + len(part)] == part for i in range(len(t)))]
    for at, (state, n) in enumerate(automaton.statistics(text), 1):
        best = max(k for k in range(at + 1) if k == 0 or found(text[at - k : at]))
        assert n == best
        if n:
            assert sorted(automaton.ends[state]) == found(text[at - n : at])
            part = text[at - n : at]
            for number, ends in automaton.ends[state].items():
                assert sorted(ends) == [e for e in range(n, len(templates[number]) + 1) if templates[number][e - n : e] == part]


def test_licence_chains():
    scanner = licenses.Scanner()
    gpl = "x y This work is licensed under the GNU General Public License, version 3. z"
    assert scanner.scan(gpl.encode())[4:] == ("", "gpl-3", 1.0)
    cut = gpl.replace("General", "Genral")
    assert scanner.scan(cut.encode())[5] == "gpl-3"
    assert scanner.scan(b"the license of this work")[5] == ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=3, max_size=14), st.lists(st.integers(0, 5), max_size=24))
def test_chains_against_all_chains(template, text):
    """The heaviest chain of matches, by trying every one of them at each of its places."""
    letters = "abcdefgh"
    scanner = licenses.Scanner((("x", " ".join(letters[i] for i in template)),), {})
    number = {letters[i]: scanner.number.get(letters[i].encode(), -1) for i in range(6)}
    ids = np.array([number[letters[i]] for i in text], dtype=np.int32)
    places = [(end, n, to) for end, n, state in scanner.matches(ids) for to in scanner.automaton.ends[state].get(0, ())]
    best = {}
    for end, n, to in places:
        best[end, to] = n
        for (e, t), w in list(best.items()):
            over = max(0, e - (end - n), t - (to - n))
            if (e, t) != (end, to) and e <= end and over < n and 0 <= end - n + over - e <= licenses.GAP and e < end:
                best[end, to] = max(best[end, to], w + n - over)
    want = min(1.0, max(best.values()) / len(template)) if best else None
    found = scanner.covered(ids)
    assert (found[0][1] if found else None) == want


def test_chain_over_a_phrase_that_repeats():
    text = "one two three alpha beta gamma one two three delta epsilon zeta one two three"
    scanner = licenses.Scanner((("x", text),), {})
    assert scanner.scan(b"one two three delta epsilon zeta one two three")[6] == pytest.approx(9 / 15)
    cut = "one two three alpha zz gamma one two three delta epsilon zz one two three"
    assert scanner.scan(cut.encode())[6] >= 11 / 15
    scanner.scan(b"one two three qq " * 30_000)


def test_licence_queries(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_licenses"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == contract_licences(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    df = documents(spark)
    assert licenses.scan_licenses(df).count() == df.count()
    assert licenses.scan_licenses(empty(spark)).count() == 0


SECRETS = {
    'db_pwd = ("S3cretXyz9!")': ["S3cretXyz9!"],
    '{"db_pwd": ["S3cretXyz9!", "Qw8rTy2zUi"]}': ["S3cretXyz9!", "Qw8rTy2zUi"],
    'db_pwd = [\n "S3cretXyz9!",\n "Abcd1234Efgh",\n]\nother = "notOne12"': ["S3cretXyz9!", "Abcd1234Efgh"],
    'x = db_pwd = "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd = x = "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd=os.getenv("X","S3cretXyz9!")': ["S3cretXyz9!"],
    'set("db_pwd", "S3cretXyz9!")': ["S3cretXyz9!"],
    'db_pwd: str = "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd, user = "S3cretXyz9!", "Notasecret12"': ["S3cretXyz9!"],
    'user, db_pwd = "Notasecret12", "S3cretXyz9!"': ["S3cretXyz9!"],
    'user, db_pwd = "S3cretXyz9!"\nx = "Notasecret12"': ["S3cretXyz9!"],
    'a, b = "S3cretXyz9!", "Notasecret12"\ndb_pwd = a': ["S3cretXyz9!"],
    'one, two, three\ndb_pwd = "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd = a if b == "Notasecret12" else "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd = "S3cretXyz9!" if b else "Abcd1234Efgh"': ["S3cretXyz9!", "Abcd1234Efgh"],
    'db_pwd = "S3cretXyz9!" if b\nuser = "Notasecret12"': ["S3cretXyz9!"],
    'db_pwd = production12 ? "S3cretXyz9!" : "Abcd1234Efgh"; x = "Notasecret12"': ["S3cretXyz9!", "Abcd1234Efgh"],
    'db_pwd = os.getenv("HOME") or "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd = env || "S3cretXyz9!"': ["S3cretXyz9!"],
    'db_pwd = env ?? "S3cretXyz9!"': ["S3cretXyz9!"],
    "<db_pwd>S3cretXyz9!</db_pwd> <user>Notasecret12</user>": ["S3cretXyz9!"],
    '<db_pwd type="x">S3cretXyz9!</db_pwd><db_pwd>S3cretXyz9!</user>': ["S3cretXyz9!"],
    'db_pwd = "\\"S3cretXyz9!"': ['\\"S3cretXyz9!'],
    'db_pwd = os.getenv("HOME")': [],
    'label = ("S3cretXyz9!")': [],
    'db_pwd = (\nlabel = "S3cretXyz9!"': [],
}


@pytest.mark.parametrize("text", SECRETS)
def test_values_in_groups_lists_calls_and_chains(text):
    sensitive = [v for n, v in secrets.assigned_values(text) if secrets.name_weight(n) * v.weight() >= secrets.SCORE]
    assert sorted(text[a:b] for v in sensitive for a, b in v.tell()) == sorted(SECRETS[text])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab='\"`\\\\\n(,", max_size=40))
def test_tokens_are_those_of_plain_lexing(text):
    """Marks that are not tried again would not have begun a literal: every token is what a lexer that tries them all finds."""
    want, at = [], 0
    lexer = secrets.LEXERS[frozenset()]
    while at < len(text):
        m = lexer.match(text, at)
        end = at + 1 if m.lastgroup == "unclosed" else m.end()
        want.append((at, end))
        at = end
    assert [m.span() for m in secrets.tokens(text)] == want


def test_lexing_is_linear_in_quotes():
    import time

    start = time.perf_counter()
    for text in ("<db_pwd " * 50_000, "<" + "a" * 400_000, "a, " * 150_000 + 'db_pwd = "x"', 'db_pwd = a ' + '|| "b" ? c : ' * 40_000, 'db_pwd = "' + '\\"' * 200_000, ("'" + '\\"' * 50 + "`") * 4000, "\"'`" * 100_000):
        list(secrets.assigned_values(text))
    assert time.perf_counter() - start < 20


# --- toxicity


def brute_kernel(s, t, n=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + j[-1] - j[0] + 2)
    return total


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=0, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_kernel(s, t):
    assert toxicity.kernel([s], [t])[0] == pytest.approx(brute_kernel(s, t), rel=1e-4, abs=1e-6)


def test_landmark_kernels_against_brute_force():
    rng = np.random.default_rng(5)
    word = lambda low, high: toxicity.START + "".join(rng.choice(list("abcdeé"), rng.integers(low, high)))
    strings = sorted({word(4, 6) for _ in range(4)})
    words = sorted({word(0, 6) for _ in range(30)} | {s + "abc" for s in strings} | {s[:4] + "b" + s[4:] for s in strings})
    found = toxicity.Landmarks(strings).likeness(words)
    got = {}
    for i, j, v in zip(*(x.tolist() for x in found), strict=True):
        got[words[i], strings[j]] = max(v, got.get((words[i], strings[j]), 0.0))
    want = {}
    for w in words:
        for s in strings:
            begins = [w[:n] for n in range(toxicity.ORDER, len(w) + 1)]
            v = max((brute_kernel(b, s) / (brute_kernel(b, b) * brute_kernel(s, s)) ** 0.5 for b in begins), default=0.0)
            if v >= toxicity.FLOOR:
                want[w, s] = v**toxicity.POWER
    assert got == pytest.approx(want, rel=1e-3)
    assert all(got[s + "abc", s] == pytest.approx(1) for s in strings)


def test_features_are_a_nystroem_map():
    strings = [toxicity.START + s for s in ("gorbla", "gorbli", "pathet", "idiot")]
    value = np.array([[brute_kernel(s, t) / (brute_kernel(s, s) * brute_kernel(t, t)) ** 0.5 for t in strings] for s in strings])
    whiten = toxicity.Landmarks(strings).whiten
    # Of the landmarks themselves, single strings, the map's inner products are their kernel values.
    mapped = value**toxicity.POWER @ whiten
    assert mapped @ mapped.T == pytest.approx(value**toxicity.POWER, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, sf).filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert sum(p == t for p, t in known) / len(known) > 0.96
    assert sum(p for p, t in known if t) / sum(t for _, t in known) > 0.8  # some labels have no ground in the text
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_gapped_spellings():
    clean = [f"a fine text of good words number {i} with others" for i in range(60)]
    toxic = [f"a fine text you gorblax of words {i}" for i in range(30)] + [f"he is a gorblax and so on {i}" for i in range(30)]
    model = toxicity.Model(clean + toxic, [0] * 60 + [1] * 60)
    scores = model.scores(["what a gorblax", "what a g.o.r.b.l.a.x", "what a g o r b l a x", "what a gor-bblax", "what a fine text"])
    assert (scores[:4] > 0.5).all() and scores[4] < 0.5


def test_other_spellings_of_telling_strings():
    """Of strings learnt from labels nearly all are found with a letter doubled, half with one inserted or left out; clean words stay clean."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiorstnlmdu") for _ in range(rng.randint(3, 9)))
    text = lambda *x: " ".join([*(word() for _ in range(20)), *x])
    insults = ["gorblax", "pifflewop", "zwackel", "kumquob"]
    toxic = [text(rng.choice(insults)) for _ in range(200)]
    model = toxicity.Model([text() for _ in range(200)] + toxic, [0] * 200 + [1] * 200)
    found = lambda words: float(np.mean(model.scores([f"You are a {x} and so on" for x in words]) >= 0.5))
    assert found(insults) == 1.0
    spelt = {"doubled": [], "inserted": [], "left out": []}
    for s in insults:
        spelt["doubled"] += [s[:i] + s[i] + s[i:] for i in range(len(s))]
        spelt["inserted"] += [s[:i] + "j" + s[i:] for i in range(1, len(s))]
        spelt["left out"] += [s[:i] + s[i + 1 :] for i in range(1, len(s))]
    shares = {k: found(v) for k, v in spelt.items()}
    assert shares["doubled"] > 0.9 and shares["inserted"] >= 0.45 and shares["left out"] >= 0.45, shares
    assert found([word() for _ in range(300)]) < 0.02


def test_toxicity_odd_rows(spark):
    df = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (3, None, 0), (None, 1, 1), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert toxicity.score_toxicity(df, labels).count() == df.count()
        assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    assert toxicity.drop_toxic(df, none).count() == df.count()
    assert toxicity.drop_toxic(df, none).columns == df.columns

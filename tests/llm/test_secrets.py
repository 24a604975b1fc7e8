import math
import random
import re
import time
from collections import Counter

from lodestone.llm import secrets
from tests.llm.samples import frame, rows

KEY = "q7Zr2LkP9xVb4TnW8sYd3HfGm"


def naive(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= n]
    return ",".join(x[-1] for x in sorted(found))


def test_base_spans_match_plain_search():
    rng = random.Random(3)
    bits = ["token", " = ", '"', "Password", ":", "api_key", "apikey", "AKIA", "ABCD0123" * 2, "0123456789abcdef" * 2, "xyz", " ", "é", "ſecret=abcdefg", "secret=abc", "a.b"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert secrets.joined(secrets.base_spans(text)) == naive(text)


def test_windows_match_plain_entropy():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh" if rng.random() < 0.4 else KEY) for _ in range(rng.randrange(70)))
        covered = set()
        for i in range(len(text) - 19):
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(text[i : i + 20]).values())
            if h >= 3.7 - 1e-9:
                covered |= set(range(i, i + 20))
        assert covered == {x for a, b in secrets.high_windows(text, 20, 3.7) for x in range(a, b)}


def test_added_spans_and_allow_list():
    assert secrets.entropy_spans(f"x {KEY} y") == [(2, 2 + len(KEY), "entropy_alnum")]
    for plain in ("internationalisation-and-localisation", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678901234567890123", "123e4567-e89b-12d3-a456-426614174000", "your-EXAMPLE-key-a8B7c6D5e4F3"):
        assert secrets.entropy_spans(plain) == []


def test_table(spark):
    data = [*rows(), (900, f"api_key: {KEY}", None, None, 1, None, None)]
    got = {r.doc_id: r for r in secrets.secret_scan(frame(spark, data)).collect()}
    assert got[900].n_assign == 1 and "entropy_alnum" in got[900].spans
    assert got[0].spans == "" and got[1].spans == "" and None in got
    assert secrets.secret_scan(frame(spark, [])).count() == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(frame(spark, data)).collect()}
    assert masked[900] == "<SECRET>" and masked[0] is None and masked[5] == "one two"


def test_allow_list_takes_rulers_and_slugs():
    old = [re.compile(p) for p in (r"[A-Za-z]?[a-z]+([_/=-]+[A-Za-z]?[a-z]*)*", r"[A-Z]+([_/=-]+[A-Z]*)*")]
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("aabBC-_1") for _ in range(rng.randrange(10)))
        assert [bool(p.fullmatch(text)) for p in old] == [bool(p.fullmatch(text)) for p in secrets.ALLOW[:2]]
    begun = time.process_time()
    for text in (f"Chapter{'=' * 5000}1", f"{'ab-' * 5000}1", f"{'AB_' * 5000}1", f"a{'-' * 5000}1"):
        secrets.secret_spans(text)
    assert time.process_time() - begun < 5


def test_keys_glued_to_names():
    rng = random.Random(7)
    for glue in "=_/-+":
        key = "".join(rng.choice("0123456789ABCDEF") for _ in range(64))
        text = f"SESSION_KEY{glue}{key} and more"
        covered = {x for a, b, _ in secrets.entropy_spans(text) for x in range(a, b)}
        assert set(range(12, 12 + 64)) <= covered
    assert secrets.entropy_spans("0123456789ABCDEF3B7C") == [(0, 20, "entropy_alnum")]
    assert secrets.entropy_spans("Img_123456789012345678901234567890") == []


def test_entropy_spans_match_a_plain_scan():
    """Every window of every maximal run of every class, in candidates that the allow-list leaves."""
    rng = random.Random(8)
    bits = ["0123456789abcdef", "ABCDEF0123", "0" * 40, "a" * 30, "-" * 25, "=" * 3, "_", "/", KEY, KEY[::-1], "deadbeef", " ", "é", "word", "Some-Slug", "9f86d081884c7d65"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if any(a.fullmatch(m[0]) for a in secrets.ALLOW):
                continue
            for _, chars, window, least in secrets.CLASSES:
                at = 0
                while at < len(m[0]):
                    end = at
                    while end < len(m[0]) and m[0][end] in chars:
                        end += 1
                    run = m[0][at:end]
                    if run == m[0] or not any(a.fullmatch(run) for a in secrets.ALLOW):
                        for i in range(len(run) - window + 1):
                            h = -sum(c / window * math.log2(c / window) for c in Counter(run[i : i + window]).values())
                            if h >= least - 1e-9:
                                want |= set(range(m.start() + at + i, m.start() + at + i + window))
                    at = end + 1
        spans = secrets.entropy_spans(text)
        assert {x for a, b, _ in spans for x in range(a, b)} == want, text
        assert all(b < c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))


def test_runs_of_one_character_of_every_class_and_length():
    for ch in "0aAzZ9+/=_-":
        for n in (19, 20, 21, 24, 25, 48, 1000):
            for text in (ch * n, f"key {ch * n}f", f"{KEY}{ch * n}", f"x{ch * n}{KEY}"):
                secrets.secret_spans(text)
    begun = time.process_time()
    for text in ("-" * 100_000, "a" + "-" * 100_000 + "1", "=" * 100_000 + KEY, "0" * 100_000):
        secrets.secret_spans(text)
    assert time.process_time() - begun < 20

import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii
from tests.llm.samples import frame, rows


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def naive(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    out = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [x[-1] for x in sorted(out)]


def texts():
    rng = random.Random(9)
    bits = ["a", "b.c", "@", "x-y.org", ".", "_", "1", "23", "255", "256", "0", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.2.3.4", "é", "\U0001f600", "a@b.c", "\n", "00012"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(500)]
    return [*out, "1" * 30_000, "1 " * 20_000, "a@b" + ".c" * 20_000, "a" * 50_000, "+1" + "0 " * 9000, "9." * 9000]


def test_base_spans_match_plain_search(spark):
    data = [*rows(), *((1000 + i, t, None, None, 0, None, None) for i, t in enumerate(texts()))]
    got = pii.personal_data(frame(spark, data)).collect()
    assert len(got) == len(data)
    want = {d: naive(t or "") for d, t, *_ in data}
    for r in got:
        w = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(w).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in w) for k in pii.BASE]
        mine = r.spans.split(",") if r.spans else []
        assert [x for x in mine if x.split(":")[0] in pii.BASE and x in w] == w
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_method_adds_spans_and_keeps_plain_numbers_out(spark):
    data = [(i, f"word {i} mail: u{i}@mail.example.com and call +1 (212) 555-01{i % 90 + 10} now", None, None, 0, None, None) for i in range(80)]
    data += [(100 + i, f"contact (212) 555-01{i + 10} today", None, None, 0, None, None) for i in range(30)]
    data += [(200 + i, f"serial {1234567890120 + i * 10 + 7}x and version 1.2.3.{300 + i}", None, None, 0, None, None) for i in range(40)]
    data += [(300 + i, f"card: 4111111111111111 411111111111{i:04d} end", None, None, 0, None, None) for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, data)).collect()}
    assert all("plain_card:6:22" in got[300 + i] for i in range(40))
    assert all("local_phone:8:22" in got[100 + i] for i in range(30))
    assert not any("ip:" in got[200 + i] for i in range(40))


def test_reliabilities_recover_planted_ones():
    rng = random.Random(1)
    yes, no = (0.9, 0.85, 0.7, 0.6, 0.8), (0.1, 0.1, 0.2, 0.3, 0.4)
    table, truth = {}, {}
    for _ in range(20_000):
        t = rng.random() < 0.6
        v = tuple(1 if rng.random() < (yes if t else no)[i] else -1 for i in range(5))
        table[v] = table.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + t
    chance, post, prior = pii.estimate_reliabilities(table.items())
    assert abs(prior - 0.6) < 0.03 and all(abs(chance[i][1][2] - yes[i]) < 0.04 and abs(chance[i][0][2] - no[i]) < 0.05 for i in range(5))
    assert sum(n * ((post[v] >= 0.5) == (truth[v] / n >= 0.5)) for v, n in table.items()) > 19_000


def test_luhn_expression(spark):
    got = spark.createDataFrame([(f"{i:012d}",) for i in range(0, 5000, 7)], "d string").withColumn("ok", pii.luhn(F.col("d"))).collect()
    assert all(r.ok == luhn(r.d) for r in got)


def test_added_spans_are_what_the_method_says(spark):
    """Candidates against plain search, and the result against the candidates' probabilities."""
    rng = random.Random(3)
    bits = ["Mr. John Doe", "Dr. Xyz", "mail: ", "anna (at) web (dot) org", "(212) 555-0142", "call 212-555-0199", "4111111111111111", "1234567890123", "a@b.co", "10.1.2.300", "10.1.2.3", "+49 170 1234567", " ", ", ", "order ", "x", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(300)]
    data = [(i, t, None, None, 0, None, None) for i, t in enumerate(texts)]
    rows_, spans = pii.span_candidates(frame(spark, data))
    of = {r.uid: r.doc_id for r in rows_.select("uid", "doc_id").collect()}
    found = spans.select("uid", "kind", "start", "end", "base", "probability").collect()
    plain = lambda p: p.replace("|\\G", "").replace("++", "+")
    want = {(i, k, m.start(), m.end()) for k, p in pii.LOOSE.items() for i, t in enumerate(texts) for m in re.finditer(plain(p), t)}
    got = {(of[r.uid], pii.KINDS[r.kind], r.start, r.end) for r in found if pii.KINDS[r.kind] in pii.LOOSE}
    assert got == want and len({k for _, k, _, _ in want}) == 4
    kept = {}
    for r in sorted(found, key=lambda r: (r.start, r.kind)):
        base = [b for b in found if b.uid == r.uid and b.base]
        if r.base or (r.probability >= 0.5 and not any(b.start < r.end and r.start < b.end for b in base)):
            kept.setdefault(of[r.uid], []).append(f"{pii.KINDS[r.kind]}:{r.start}:{r.end}")
    result = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, data)).collect()}
    assert result == {i: ",".join(kept.get(i, [])) for i in range(len(texts))}


def test_classifier_uses_the_text():
    """Spans of the same votes are told apart by what their likes in the same surroundings got."""
    plain = (4, 0, 0, 0, 0, 1)
    known = {(4, 0, 0, 0, 1, 1, 0, 3, 0, 0): 300, (4, 0, -1, -1, -1, 1, 0, 7, 0, 0): 300, (*plain, 0, 3, 0, 0): 20, (*plain, 0, 7, 0, 0): 20}
    post = {(0, 0, 0, 1, 1): 0.95, (0, -1, -1, -1, 1): 0.05, (0, 0, 0, 0, 1): 0.5}
    got = pii.train_span_classifier(known, post)
    assert got[*plain, 0, 3, 0, 0] > got[*plain, 0, 7, 0, 0] + 0.05


def test_gazetteers():
    codes = re.compile(pii.CODES)
    assert all(codes.match(x) for x in ("+1 212", "+49", "+351 2", "+44", "+7", "+886", "+972")) and not any(codes.match(x) for x in ("+0", "+10"[:2].replace("1", "0"), "49"))
    issuers = re.compile(pii.ISSUERS)
    assert all(issuers.match(x) for x in ("4111", "5500", "2221", "2720", "3400", "6011", "3530")) and not any(issuers.match(x) for x in ("1234", "9000", "2220", "2721", "0000"))
    assert re.search(pii.TLDS, "a@b.co") and re.search(pii.TLDS, "a@b.museum") and not re.search(pii.TLDS, "a@b.local")

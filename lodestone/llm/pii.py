"""Personal data by weak supervision, in DataFrame and SQL functions only.

Four base patterns and a few looser ones propose spans. Five labelers (format, checksum, gazetteer, context, boundary)
vote yes, no or nothing on each. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability without labels; its posteriors train a logistic span classifier, which besides the votes sees the text: the
word before a span, what follows it, its length and its separators. Base spans always stay, other candidates where the
classifier says so.

Texts are read once and never shuffled: what leaves the scan is, per match, the length of the gap before it, the match and
a few characters around it; positions are running sums over those. All features have few values, so the table of their
combinations is bounded, and both fits run on the driver whatever the size of the corpus.

The patterns are the contract's with possessive repeats and a guard that skips starts inside a run in which an earlier
start has failed: the same leftmost matches, in linear time and without deep recursion.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import settle

_WORD = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_WORD}])|\G)[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "masked_email": rf"(?:(?<![{_WORD}])|\G)[{_WORD}]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "plain_card": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "person": r"(?:Mrs?|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
KINDS = (*BASE, *LOOSE)
#: Cheap tests for what a pattern's matches must contain.
NEEDS = {"email": ("@",), "phone": ("+",), "masked_email": ("(at)", "[at]"), "person": ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ")}
BEFORE, AFTER = 40, 1
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Fixed values, by the rules that give them. Country domains have two letters; the others are listed.
TLDS = r"(?i)\.([a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|aero|coop|museum|jobs|travel|tel|cat|asia|post|xxx|app|dev|blog|shop|store|site|online|tech|cloud|email|news|club|live|world|life|group|agency|company|academy|health|design|digital|media|studio|systems|solutions|services|center|support|network|press|wiki|xyz|top|bank|law|art|eco)$"
#: The country codes of telephone numbers, as the numbering plan divides its nine zones.
CODES = r"^\+(?:1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[035789][0-9])|9(?:[0-58]|[679][0-9]))"
#: First digits of card numbers by issuer.
ISSUERS = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3(?:0[0-59]|[4-9])|6(?:011|4[4-9]|5|2|3|7))"
#: Common given names of English, German, Spanish and French speakers.
NAMES = tuple(
    "Adam Alan Albert Alejandro Alexander Alice Amanda Amelie Amy Ana Andrea Andreas Andrew Angela Anja Anna Anne Anthony Antoine Antonio Barbara Benjamin Bernd Betty Brenda Brian Camille Carl Carlos Carmen Carol Caroline Catherine Charles Charlotte Christian "
    "Christine Christopher Claire Claudia Cristina Daniel David Deborah Diego Dieter Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Francois Frank Frederic Gabriel George Gerard Gloria Gregory Guillaume Hannah Hans "
    "Heather Heike Heinz Helen Henry Hugo Isabel Jack Jacob Jacques James Jan Jane Janet Jason Javier Jean Jennifer Jessica Joan John Jonas Jorge Jose Joseph Joshua Juan Julia Julie Karen Karin Karl Katharina Katherine Kenneth Kevin Klaus Laura Lea Leon Linda "
    "Lisa Louis Lucas Lucia Luis Lukas Manuel Margaret Maria Marie Mark Markus Martin Mary Mathieu Matthew Maximilian Melissa Michael Michel Miguel Monika Nancy Nathalie Nicolas Nicole Olivier Pablo Pamela Patricia Patrick Paul Pedro Peter Petra Philippe "
    "Pierre Rachel Raul Rebecca Richard Robert Rosa Ruth Sabine Samuel Sandra Sarah Sebastian Sergio Sofia Sophie Stefan Stephanie Stephen Steven Susan Teresa Thomas Timothy Ursula Uwe Valerie Victor Vincent Walter Werner William Wolfgang".split()
)
FOR = r"(?i)(e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|credit|iban|account|ip|host|server|addr\w*|write to|reach)\W*$"
AGAINST = r"(?i)(version|release|v|order|invoice|isbn|doi|serial|part|no|nr|id|page|section)[\W]*$"
LABELERS = ("format", "checksum", "gazetteer", "context", "boundary")


def _items(kind: str, number: int) -> Column:
    """Of each match: kind, ordinal, length of the gap before it, the match and the characters around it."""
    gap = lambda i: F.element_at(f"gaps_{kind}", i)
    return F.transform(
        f"found_{kind}",
        lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("ordinal"), F.length(gap(i + 1)).alias("gap"), m.alias("match"),
            F.right(gap(i + 1), F.lit(BEFORE)).alias("before"), F.left(gap(i + 2), F.lit(AFTER)).alias("after"),
        ),
    )


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, items) for every row: all matches of all patterns, one pass over the text."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    patterns = {**BASE, **LOOSE}
    found = {}
    for kind, pattern in patterns.items():
        all_ = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if needs := [F.col("text").contains(x) for x in NEEDS.get(kind, ())]:
            all_ = F.when(functools.reduce(operator.or_, needs), all_).otherwise(none)
        found[f"found_{kind}"] = all_
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"gaps_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", p, -1)) for k, p in patterns.items()})
    return rows.select("uid", "doc_id", F.concat(*(_items(k, n) for n, k in enumerate(KINDS))).alias("items"))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    value = lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c)
    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _voted(items: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Positions, validity and votes of each match."""
    running = Window.partitionBy("uid", "kind").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    digits = F.regexp_replace("match", "[^0-9]", "")
    is_ = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])
    rows = items.withColumns({"end": F.sum(F.col("gap") + size).over(running), "digits": digits, "n_digits": F.length(digits)})
    rows = rows.withColumn("start", F.col("end") - size).withColumn("luhn", F.when(is_("card", "plain_card") & F.col("n_digits").between(12, 19), luhn(F.col("digits"))).otherwise(False))
    rows = rows.withColumn(
        "base",
        F.when(is_("email"), True).when(is_("ip"), F.col("match").rlike(OCTETS)).when(is_("card"), F.col("luhn")).when(is_("phone"), F.col("n_digits").between(9, 15)).otherwise(False),
    )
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    vote = lambda test, otherwise=no: F.when(test, yes).otherwise(otherwise)
    m = F.col("match")
    edge = r"[A-Za-z0-9]"
    word = F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]{0,4}$", 1))
    gaps = F.regexp_replace("match", "[A-Za-z0-9]+", "")
    return rows.withColumns({
        "v_format": F.when(F.col("base"), yes).when(is_(*LOOSE), none).otherwise(no),
        "v_checksum": F.when(is_("card", "plain_card"), vote(F.col("luhn"))).when(is_("ip"), vote(F.col("base") & ~m.startswith("0"))).when(is_("email"), vote(m.rlike(r"\.[A-Za-z]{2,6}$"))).when(is_("phone", "local_phone"), vote(m.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), none)).otherwise(none),
        "v_gazetteer": F.when(is_("card", "plain_card"), vote(F.col("digits").rlike(ISSUERS))).when(is_("ip"), F.when(m.rlike(r"^(10|127|192\.168|0)\."), no).otherwise(none)).when(is_("email", "masked_email"), vote(m.rlike(TLDS), none)).when(is_("phone"), vote(m.rlike(CODES))).when(is_("person"), vote(F.regexp_extract("match", r"\. ([A-Z][a-z]+)", 1).isin(*names), none)).otherwise(none),
        "v_context": F.when(F.col("before").rlike(AGAINST), no).otherwise(vote(F.col("before").rlike(FOR), none)),
        "v_boundary": F.when(F.right(F.col("before"), F.lit(1)).rlike(edge) | F.col("after").rlike(edge), no).otherwise(yes),
        "size_class": F.least(F.lit(3), F.floor(size / 12)).cast("int"),
        "word": F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(CLASSES["word"] - 1))).cast("int"),
        "next": F.when(F.col("after").rlike("[A-Za-z]"), 1).when(F.col("after").rlike("[0-9]"), 2).when(F.col("after").rlike(r"[^\s]"), 3).otherwise(0),
        "gaps": F.when(gaps == "", 0).when(gaps.rlike(r"^ +$"), 1).when(gaps.rlike("^-+$"), 2).otherwise(3),
    })


VOTES = [f"v_{x}" for x in LABELERS]
#: What the classifier sees of the text, and how many values each has: length, the word before (by hash; 0: none), what follows, separators.
CLASSES = {"size_class": 4, "word": 16, "next": 4, "gaps": 4}
PATTERN = ["kind", *VOTES, *CLASSES]


def estimate_reliabilities(patterns: Iterable[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[list[list[float]]], dict[tuple[int, ...], float], float]:
    """Expectation-maximisation over (votes, count): each labeler's chance of no, nothing, yes for false and true spans; posteriors; prior."""
    table: dict[tuple[int, ...], int] = {}
    for votes, n in patterns:
        table[votes] = table.get(votes, 0) + n
    post = {v: min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v in table}
    chance: list[list[list[float]]] = []
    prior = 0.5
    for _ in range(rounds):
        chance = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in LABELERS]
        for c, (lo, hi) in enumerate(((0, 2), (2, 0))):  # a labeler is taken to be better than chance until the votes say otherwise
            for x in chance:
                x[c][lo] += 2 * (lo == 0) + 0.5 * (lo == 2)
                x[c][hi] += 0.0
        mass = [1.0, 1.0]
        for votes, n in table.items():
            for c, p in enumerate((1 - post[votes], post[votes])):
                mass[c] += n * p
                for x, v in zip(chance, votes, strict=True):
                    x[c][v + 1] += n * p
        prior = mass[1] / sum(mass)
        for x in chance:
            for c in (0, 1):
                x[c] = [y / sum(x[c]) for y in x[c]]
        for votes in table:
            odds = math.log(prior / (1 - prior)) + sum(math.log(x[1][v + 1] / x[0][v + 1]) for x, v in zip(chance, votes, strict=True))
            post[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, post, prior


def _features(keys: list[tuple[int, ...]]) -> np.ndarray:
    """Positions of each pattern's ones: its kind, every vote, every class of its text, and the constant."""
    sizes = np.array([len(KINDS), *[3] * len(VOTES), *CLASSES.values(), 1])
    values = np.array([[*k, 0] for k in keys], np.int64).reshape(-1, len(sizes))
    values[:, 1 : 1 + len(VOTES)] += 1
    return values + np.cumsum(sizes) - sizes


def train_span_classifier(counts: dict[tuple[int, ...], int], post: dict[tuple[int, ...], float], rounds: int = 400) -> dict[tuple[int, ...], float]:
    """Logistic regression of the posteriors on a span's features; the probability of every pattern seen."""
    if not counts:
        return {}
    ones = _features(list(counts))
    share = np.array(list(counts.values()), float)
    share /= share.sum()
    target = np.array([post[k[1 : 1 + len(VOTES)]] for k in counts])
    weights = np.zeros(ones.max() + 1)
    prob = lambda: 1 / (1 + np.exp(-np.clip(weights[ones].sum(axis=1), -30, 30)))
    for _ in range(rounds):
        slope = np.repeat(share * (prob() - target), ones.shape[1])
        weights = weights - np.bincount(ones.ravel(), weights=slope, minlength=len(weights)) - 1e-4 * weights
    return dict(zip(counts, prob().tolist(), strict=True))


def span_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = NAMES) -> tuple[DataFrame, DataFrame]:
    """(every row's uid and doc_id, with its items; all matches with position, votes, ``base`` and ``probability``)."""
    rows = settle(_matches(docs, id_col, text_col))
    voted = settle(_voted(rows.select("uid", F.explode("items").alias("i")).select("uid", "i.*"), names).drop("before", "after", "gap", "digits", "luhn"))
    table = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*PATTERN).count().collect()}  # bounded: kinds x votes x classes
    _, post, _ = estimate_reliabilities((k[1 : 1 + len(VOTES)], n) for k, n in table.items())
    probability = train_span_classifier(table, post)
    scores = docs.sparkSession.createDataFrame([(*k, p) for k, p in sorted(probability.items())], ", ".join(f"{c} int" for c in PATTERN) + ", probability double")
    return rows, voted.join(F.broadcast(scores), PATTERN)  # no larger than the table of patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, names: tuple[str, ...] = NAMES) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans.

    Added spans never overlap base ones; added ones may overlap each other. Null and empty texts have no spans; very long
    ones are searched whole, in time that grows with their length. Null ids, ties and repeated rows stay, one row out for
    each row in; other columns are ignored; an empty table gives no rows. ``names`` is the gazetteer of given names.
    """
    rows, spans = span_candidates(docs, id_col, text_col, names)
    span = F.struct("start", "kind", "end")
    count = lambda kind: F.count(F.when(F.col("base") & (F.col("kind") == KINDS.index(kind)), 1)).alias(f"n_{kind}")
    by_doc = spans.groupBy("uid").agg(
        *map(count, BASE),
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("kept"),
        F.collect_list(F.when(~F.col("base") & (F.col("probability") >= least), span)).alias("more"),
    )
    out = rows.select("uid", "doc_id").join(by_doc, "uid", "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    kept = F.coalesce("kept", empty)
    clear = F.filter(F.coalesce("more", empty), lambda w: ~F.exists(F.coalesce(F.col("kept"), empty), lambda b: (b.start < w.end) & (w.start < b.end)))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(text(kept).cast("binary"), 256).alias("base_sha256"), text(F.sort_array(F.concat(kept, clear))).alias("spans"))

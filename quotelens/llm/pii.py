"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns give spans that always stand. A second, looser pattern gives candidates that the base
ones miss (numbers written without a plus sign, addresses with (at) and (dot), card numbers inside
longer digit runs). Four labelers vote on every span: strict format, gazetteer words before it, the
characters around it, and its variety of digits. The counts of vote patterns (a few hundred rows at
most, whatever the corpus) go through expectation-maximisation, which estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic classifier is trained on those
probabilities and decides over candidates. Its weights become a column expression.

Offsets come from splitting a text by a pattern: the pieces between matches and the matches
themselves are one after another in the text, so their lengths add up to positions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the look-behinds change no match; they spare retries that
#: can't succeed, and deep recursion over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -][0-9]", "phone": r"\+[0-9]"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++"
    r"|(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
LOOSE_NEEDED = r"[0-9]{3}[ .-][0-9]{4}|[0-9]{4}[ -]?[0-9]{4}|[\[(]at[\])]"
#: Gazetteers: words before a span that speak for its kind, and words that speak against any.
WORDS = {
    "email": "mail|write|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|login|address|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte|account|konto",
    "phone": "phone|tel|call|fax|mobile|telefon|llama|appel",
}
AGAINST = "isbn|issn|version|order|invoice|serial|page|ref|doi|total|chapter"
CONTEXT = 40
#: Digits from which a match that fails its check is an example of a number that is not personal data.
LEAST = {"ip": 4, "card": 13, "phone": 9}
LABELERS = ("format", "gazetteer", "surroundings", "variety")
ROUNDS = 50
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((F.length(d) - i) % 2 == 0, digit).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False)


def _located(text: Column, pattern: str, needed: str, make) -> Column:
    """``make(hit, start, before, after)`` of every match, nulls dropped; positions in code points."""
    has = text.rlike(needed)
    gaps = F.when(has, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    hits = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    sample = make(F.lit(""), F.lit(0), F.lit(""), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        made = make(x["hit"], start, x["gap"], x["next"])
        more = F.when(x["hit"].isNotNull() & made.isNotNull(), F.concat(acc["out"], F.array(made))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), more.alias("out"))

    empty = F.filter(F.array(sample), lambda _: F.lit(False))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _span(kind: Column, start: Column, hit: Column, base: bool, before: Column, after: Column, format_vote: Column) -> Column:
    """A span with its votes: -1 against, 0 abstaining, 1 for."""
    left = F.lower(F.right(before, F.lit(CONTEXT)))
    words = F.lit(False)
    for k, name in enumerate(KINDS):
        words = F.when(kind == k, left.rlike(rf"\b(?:{WORDS[name]})")).otherwise(words)
    gazetteer = F.when(words, 1).when(left.rlike(rf"\b(?:{AGAINST})\b"), -1).otherwise(0)
    glued = before.rlike("[A-Za-z0-9#$€@=_/-]$") | F.coalesce(after, F.lit("")).rlike("^[A-Za-z0-9@=_/-]")
    digits = _digits(hit)
    variety = F.when(kind == 0, 0).when(F.length(F.regexp_replace(digits, "([0-9])(?=.*\\1)", "")) <= 2, -1).otherwise(1)
    return F.struct(
        kind.cast("int").alias("kind"),
        start.cast("int").alias("start"),
        (start + F.length(hit)).cast("int").alias("end"),
        F.lit(base).alias("base"),
        format_vote.cast("int").alias("format"),
        gazetteer.cast("int").alias("gazetteer"),
        F.when(glued, -1).otherwise(1).cast("int").alias("surroundings"),
        variety.cast("int").alias("variety"),
    )


def spans(docs: DataFrame) -> DataFrame:
    """Add ``_base``, ``_failed`` and ``_loose``: arrays of spans with votes.

    Failed ones match a base pattern but not its check; they teach what other numbers look like, and
    are never spans themselves. Loose ones never overlap base ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = {}
    for k, kind in enumerate(KINDS):

        def make(hit, start, before, after, k=k, kind=kind):
            valid = _valid(kind, hit)
            likely = valid if kind == "email" else valid | (F.length(_digits(hit)) >= LEAST[kind])
            return F.when(likely, _span(F.lit(k), start, hit, valid, before, after, F.when(valid, 1).otherwise(-1)))

        columns[f"_all_{kind}"] = _located(text, BASE[kind], NEEDED[kind], make)

    def loose(hit, start, before, after):
        n = F.length(_digits(hit))
        kind = F.when(hit.rlike(r"[\[(]at[\])]"), 0).when(n == 16, 2).otherwise(3)
        vote = F.when(kind == 0, 1).when(kind == 2, F.when(luhn(_digits(hit)), 1).otherwise(-1)).otherwise(F.when(hit.rlike(r"\(|-"), 1).otherwise(0))
        return _span(kind, start, hit, False, before, after, vote)

    columns["_maybe"] = _located(text, LOOSE, LOOSE_NEEDED, loose)
    found = docs.withColumns(columns).withColumn("_all", F.concat(*(F.col(f"_all_{kind}") for kind in KINDS)))
    found = found.withColumns({"_base": F.filter("_all", lambda s: s["base"]), "_failed": F.filter("_all", lambda s: ~s["base"])})
    free = F.filter("_maybe", lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return found.withColumn("_loose", free).drop(*(f"_all_{kind}" for kind in KINDS), "_all", "_maybe")


class Model(NamedTuple):
    """Logistic weights by (feature, value) and what EM found of the labelers."""

    weights: dict[tuple[str, int], float]
    bias: float
    reliability: dict[str, dict[int, tuple[float, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], float, float | None]]) -> tuple[list[float], dict]:
    """Probability that spans with each vote pattern are personal data, by EM over independent labelers.

    ``patterns``: (votes, number of spans, known probability or None). Base spans are known to stand
    and matches that fail their check known not to; they anchor the two classes, and the rest start
    from the share of votes in favour. A vote's probability in either class is smoothed by one count.
    Labelers are taken to be no worse than chance: a vote in favour is never made likelier by the
    other class, nor a vote against by personal data.
    """
    belief = [
        (1 + sum(v > 0 for v in votes)) / (2 + sum(v != 0 for v in votes)) if known is None else known for votes, _, known in patterns
    ]
    table: dict = {}
    for _ in range(ROUNDS):
        yes = sum(b * n for b, (_, n, _) in zip(belief, patterns))
        no = sum((1 - b) * n for b, (_, n, _) in zip(belief, patterns))
        table = {}
        for j, name in enumerate(LABELERS):
            for vote in (-1, 0, 1):
                for_yes = sum(b * n for b, (v, n, _) in zip(belief, patterns) if v[j] == vote)
                for_no = sum((1 - b) * n for b, (v, n, _) in zip(belief, patterns) if v[j] == vote)
                a, b = (for_yes + 1) / (yes + 3), (for_no + 1) / (no + 3)
                if vote * (a - b) < 0:
                    a = b = (for_yes + for_no + 1) / (yes + no + 3)
                table.setdefault(name, {})[vote] = (a, b)
        for i, (votes, _, known) in enumerate(patterns):
            if known is None:
                log = math.log((yes + 1) / (no + 1))
                for name, vote in zip(LABELERS, votes):
                    a, b = table[name][vote]
                    log += math.log(a / b)
                belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return belief, table


def train(rows: list[tuple[int, tuple[int, ...], float, float | None]]) -> Model:
    """Span classifier from (kind, votes, number of spans, known): logistic regression on the EM probabilities."""
    belief, table = estimate([row[1:] for row in rows])
    weights: dict[tuple[str, int], float] = {}
    bias = 0.0
    total = sum(row[2] for row in rows) or 1.0
    features = [[("kind", kind), *zip(LABELERS, votes)] for kind, votes, *_ in rows]
    for _ in range(400):
        step: dict[tuple[str, int], float] = {}
        step_bias = 0.0
        for f, b, row in zip(features, belief, rows):
            z = bias + sum(weights.get(x, 0.0) for x in f)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - b) * row[2] / total
            step_bias += error
            for x in f:
                step[x] = step.get(x, 0.0) + error
        bias -= 2.0 * step_bias
        for x, g in step.items():
            weights[x] = weights.get(x, 0.0) - 2.0 * (g + 1e-4 * weights.get(x, 0.0))
    return Model(weights, bias, table)


def fit(docs: DataFrame) -> Model:
    """Count vote patterns over all documents and train: at most 4 kinds x 3 origins x 3^4 votes to the driver."""
    of = lambda column, known: F.transform(column, lambda s: s.withField("known", F.lit(known).cast("double")))
    found = spans(docs.select("text")).select(F.explode(F.concat(of("_base", 1), of("_failed", 0), of("_loose", None))).alias("s"))
    counted = found.select("s.*").groupBy("kind", *LABELERS, "known").count().collect()
    rows = [(r[0], tuple(r[1:5]), float(r[6]), r[5]) for r in counted]
    return train(sorted(rows, key=lambda r: (r[0], r[1], -1 if r[3] is None else r[3])))


def _accepted(model: Model, s: Column) -> Column:
    z = F.lit(model.bias)
    for name in ("kind", *LABELERS):
        term = F.lit(0.0)
        for (feature, value), w in sorted(model.weights.items()):
            if feature == name:
                term = F.when(s[name] == value, F.lit(w)).otherwise(term)
        z = z + term
    return z >= 0


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (all): arrays of (kind number, start, end), by kind and start.

    A null or empty text has no spans; repeated rows are treated alike; other columns stay, but ones
    named like the added columns are replaced. No shuffle.
    """
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    found = spans(docs.drop("base_spans", "spans"))
    added = F.filter("_loose", lambda s: _accepted(model, s))
    return found.withColumns(
        {
            "base_spans": F.array_sort(F.transform("_base", bare)).cast(SPAN),
            "spans": F.array_sort(F.transform(F.concat(F.col("_base"), added), bare)).cast(SPAN),
        }
    ).drop("_base", "_failed", "_loose")


def redact(found: DataFrame) -> DataFrame:
    """Replace every span of ``text`` by its kind in brackets; spans that overlap become one, named by the first."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind"] + 1))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate(ordered, start, step, end)).otherwise(text))


def _digest(column: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_digest("base_spans"), 256).alias("base_sha256"),
        _digest("spans").alias("spans"),
    )

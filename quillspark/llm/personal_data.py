"""Operator 3: personal data by weak supervision, in DataFrame functions alone.

1. Candidates: the base patterns of four kinds, and looser forms of each.
2. Labelers vote on every candidate for, against or not at all: its form, a
   checksum or range, a gazetteer of issuers, endings and country codes, cue
   words in the context before it, and the characters around it.
3. Expectation-maximisation over the counts of vote patterns (at most 3^5 for
   each kind and form, whatever the table) estimates each labeler's reliability.
4. The estimated classes train the final span classifier, a logistic model over
   votes and length.  Base spans always stay; the classifier adds others that
   don't overlap a span of their kind.

Defined results: a null text counts as the empty one and has no spans; a null
doc_id stays null; repeated rows give repeated results; without candidates the
classifier accepts nothing; other columns are ignored by ``spans`` and kept by
``redact``; an empty table gives an empty result.  Base matches of a kind are
leftmost and don't overlap; what is added overlaps none of them.  A very long text
is read whole; its matches are arrays of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, id_and_text, staged

KINDS = ("email", "ip", "card", "phone")
_MAIL = r"A-Za-z0-9._%+-"

#: Leftmost non-overlapping matches.  A match may only start where its run of characters does, or where the match
#: before ended: elsewhere it would fail as well, and long runs stay linear.  Possessive groups don't recurse.
BASE = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs fail the count of digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<![{_MAIL}])[{_MAIL}]{{1,64}}\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]{{1,63}}(?:\s?[(\[]\s?dot\s?[)\]]\s?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@|(?i)[(\[]\s?at\s?[)\]]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]|(?:[0-9A-Fa-f]{1,4}:){7}", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}

#: Gazetteers.
ENDINGS = "com org net edu gov mil int info biz io dev app ai co us uk ie de at ch fr be es pt it nl se no dk fi pl cz ru ua tr jp cn kr in br mx ca au nz za".split()
CUES = {
    "email": r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt|schreib",
    "ip": r"\bip\b|host|server|address|login|adresse|direcci",
    "card": r"card|visa|master|amex|credit|debit|carte|karte|tarjeta|pay",
    "phone": r"phone|tel|call|mobile|cell|fax|ruf|appel|llam|whatsapp",
}
AGAINST = r"token|key|hash|secret|version|isbn|issn|order|invoice|serial|sha|md5|uuid"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

VOTES = ("form", "check", "gazetteer", "context", "around")
_SPAN = "array<struct<b:int,e:int,s:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<b, e, s>> of the matches: places from the lengths of what lies between and of what matched."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(a: Column, x: Column) -> Column:
        b = a["at"] + F.length(x["g"])
        e = b + F.length(F.coalesce(x["m"], F.lit("")))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(b.alias("b"), e.alias("e"), x["m"].alias("s")))).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(pairs, none, step, lambda a: a["out"])
    return F.filter(found, lambda x: x["s"].isNotNull())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(2 * c.cast("int"), F.lit(10)) + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.pmod(F.aggregate(places, F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _octets(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _count(s: Column, least: int, most: int) -> Column:
    return F.length(_digits(s)).between(least, most)


def _is_base(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(s)
    if kind == "card":
        return _count(s, 13, 19) & _luhn(_digits(s))
    return _count(s, 9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1).cast("int")


def _labels(kind: str, loose: bool, text: Column, x: Column) -> list[Column]:
    s = x["s"]
    before = F.lower(F.substring(text, F.greatest(x["b"] - 39, F.lit(1)), F.least(x["b"], F.lit(40))))
    left = F.when(x["b"] > 0, F.substring(text, x["b"], F.lit(1))).otherwise("")
    right = F.substring(text, x["e"] + 1, F.lit(1))
    always, never = F.lit(True), F.lit(False)
    if kind == "email":
        ending = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)[)\]\s]*$", 1))
        check, gazetteer = _vote(ending.rlike("^[a-z]{2,}$"), always), _vote(ending.isin(ENDINGS), never)
    elif kind == "ip":
        check = _vote(always if loose else _octets(s), always)
        gazetteer = _vote(never, s.rlike(r"^(?:0|127|255)\."))
    elif kind == "card":
        check, gazetteer = _vote(_luhn(_digits(s)), always), _vote(_digits(s).rlike(ISSUERS), always)
    else:
        check, gazetteer = _vote(_count(s, 9, 15) & ~_digits(s).rlike(r"^(.)\1+$"), always), _vote(s.rlike(COUNTRIES), s.startswith("+"))
    form = _vote(F.lit(not loose) & _is_base(kind, s), never if loose else always)
    context = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    around = _vote(~left.rlike(r'[\p{L}\p{N}_"=#-]') & ~right.rlike(r'[\p{L}\p{N}_"=]'), left.rlike(r'[\p{L}\p{N}_"=#]') | right.rlike(r'[\p{L}\p{N}_"=]'))
    return [v.alias(name) for name, v in zip(VOTES, (form, check, gazetteer, context, around))]


CANDIDATE = "array<struct<kind:int,b:int,e:int,base:boolean,loose:boolean,form:int,check:int,gazetteer:int,context:int,around:int,size:int>>"


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes: base matches that hold, then others that overlap none of those."""
    none = F.array().cast(CANDIDATE)

    def of_kind(k: int, kind: str) -> Column:
        def made(loose: bool):
            def one(x: Column) -> Column:
                base = F.lit(False) if loose else _is_base(kind, x["s"])
                return F.struct(F.lit(k).alias("kind"), x["b"].alias("b"), x["e"].alias("e"), base.alias("base"), F.lit(loose).alias("loose"), *_labels(kind, loose, text, x), F.least(F.floor((x["e"] - x["b"]) / 4), F.lit(8)).cast("int").alias("size"))

            return one

        strict = F.filter(F.transform(_matches(text, BASE[kind]), made(False)), lambda x: x["base"]).cast(CANDIDATE)
        loose = F.transform(_matches(text, LOOSE[kind]), made(True)).cast(CANDIDATE)
        if kind == "card":  # groups of digits are everywhere: without checksum only a cue word makes a candidate
            loose = F.filter(loose, lambda x: (x["check"] == 1) | (x["context"] == 1))
        both = F.transform(F.array(F.struct(strict.alias("a"), loose.alias("z"))), lambda p: F.concat(p["a"], F.filter(p["z"], lambda x: ~F.exists(p["a"], lambda y: (x["b"] < y["e"]) & (y["b"] < x["e"])))))[0]
        return F.when(text.rlike(NEEDS[kind]), both).otherwise(none)

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def reliabilities(patterns: dict[tuple, float], turns: int = 60) -> tuple[float, list[tuple[float, float]], dict[tuple, float]]:
    """Expectation-maximisation over vote patterns: the share of true spans, each labeler's chance to vote for a true and for
    a false one (where it votes), and each pattern's probability.  Labelers are taken to be better than chance at first."""
    share, rates = 0.7, [(0.8, 0.2)] * len(VOTES)
    chance: dict[tuple, float] = {}
    for _ in range(turns):
        for p in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for v, (a, b) in zip(p, rates):
                if v >= 0:
                    yes, no = yes + math.log(a if v else 1 - a), no + math.log(b if v else 1 - b)
            chance[p] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(patterns.values())
        true = sum(n * chance[p] for p, n in patterns.items())
        share = min(0.99, max(0.01, (true + 1) / (total + 2)))
        rates = []
        for i in range(len(VOTES)):
            voted = [(p, n) for p, n in patterns.items() if p[i] >= 0]
            for_true, all_true = sum(n * chance[p] * p[i] for p, n in voted), sum(n * chance[p] for p, n in voted)
            for_false, all_false = sum(n * (1 - chance[p]) * p[i] for p, n in voted), sum(n * (1 - chance[p]) for p, n in voted)
            # priors keep the classes apart: a labeler is right more often than not
            rates.append((min(0.99, (for_true + 8) / (all_true + 10)), max(0.01, (for_false + 2) / (all_false + 10))))
    return share, rates, chance


def _inputs(votes: tuple, size: int) -> list[float]:
    """Inputs of the classifier: a constant, each vote as for (1), against (-1) or none (0), and the length."""
    return [1.0, *[float((v > 0) - (v == 0)) for v in votes], size / 8]


def classifier(rows: list[tuple[tuple, int, float, float]], turns: int = 400, rate: float = 0.5, pull: float = 1.0) -> list[float]:
    """Logistic weights from rows of (votes, size, count, probability)."""
    weights = [0.0] * (len(VOTES) + 2)
    total = sum(r[2] for r in rows)
    data = [(_inputs(v, s), n / total, y) for v, s, n, y in rows]
    for _ in range(turns if total else 0):
        slope = [-pull * w / (total + 10) for w in weights]
        for x, n, y in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            slope = [g + n * (y - p) * a for g, a in zip(slope, x)]
        weights = [w + rate * g for w, g in zip(weights, slope)]
    return weights


class SpanModel:
    def __init__(self, rates: dict[int, list[tuple[float, float]]], weights: dict[int, list[float]]):
        self.rates, self.weights = rates, weights

    def accepts(self, x: Column) -> Column:
        """Whether a candidate is a span: base ones always are."""

        def chance(w: list[float]) -> Column:
            total = F.lit(w[0]) + F.lit(w[-1]) * x["size"] / 8
            for name, a in zip(VOTES, w[1:-1]):
                total = total + F.lit(a) * F.when(x[name] > 0, 1.0).when(x[name] == 0, -1.0).otherwise(0.0)
            return total

        out = F.lit(False)
        for kind, w in self.weights.items():
            out = F.when(x["kind"] == kind, chance(w) >= 0).otherwise(out)
        return x["base"] | out


def learn(found: DataFrame) -> SpanModel:
    """Reliabilities and classifier from the candidates (column ``candidates``) of all documents."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in VOTES], "c.size").count().collect()  # bounded: patterns x lengths
    rates, weights = {}, {}
    for kind in range(len(KINDS)):
        rows = [(tuple(r[v] for v in VOTES), r["size"], r["count"]) for r in counts if r["kind"] == kind]
        patterns: dict[tuple, float] = {}
        for v, _, n in rows:
            patterns[v] = patterns.get(v, 0) + n
        if patterns:
            _, rates[kind], chance = reliabilities(patterns)
            weights[kind] = classifier([(v, s, n, chance[v]) for v, s, n in rows])
    return SpanModel(rates, weights)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, b, e), sorted, for every whole text."""
    found = staged(id_and_text(docs).select("doc_id", candidates(F.col("text")).alias("candidates")), "candidates")
    model = learn(found)
    place = lambda x: F.struct(x["kind"].alias("kind"), x["b"].alias("b"), x["e"].alias("e"))
    return found.select(
        "doc_id",
        F.sort_array(F.transform(F.filter("candidates", lambda x: x["base"]), place)).alias("base"),
        F.sort_array(F.transform(F.filter("candidates", model.accepts), place)).alias("spans"),
    )


def as_text(places: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["b"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars, where there is one, counted anew.

    Overlapping spans of several kinds become one mark, of the kind that starts first.
    """
    found, mark = free_name(docs, "found"), free_name(docs, "mark")
    text = F.coalesce("text", F.lit(""))
    held = staged(docs.withColumn(found, candidates(text)), "redacted")
    model = learn(held.select(F.col(found).alias("candidates")))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.sort_array(F.transform(F.filter(found, model.accepts), lambda x: F.struct(x["b"].alias("b"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(a: Column, x: Column) -> Column:
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, x["b"] - a["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["b"] < a["at"], a["out"]).otherwise(out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.col(mark), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = held.withColumn(mark, spans).withColumn("text", F.when(F.size(mark) > 0, whole).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out

"""Personal data by weak supervision: labelers vote on spans, their reliability is estimated, and a
span classifier is trained on the result.

Candidates are spans of four kinds. The strict patterns give the base spans, which always stay. Loose
patterns give what they miss: addresses with the signs spelled out, longer network addresses, numbers
written without a country code, card numbers with other separators, and what fails a strict check.

Five labelers vote for or against a candidate or abstain: strict format, a check of the value (digit sums,
ranges, numbers of digits), a gazetteer (domain endings, card issuers, country codes, reserved networks),
words before it and its neighbouring characters. Expectation-maximisation (Dawid and Skene, 1979) over
the counts of vote patterns estimates how often each labeler is right on true and on false spans,
and the probability of each pattern. These probabilities are the labels on which the final classifier, naive
Bayes over hashed features of form and surrounding words, is trained; a loose candidate
is added if two labelers of content are for it and none is against, the classifier and the votes each give it THRESHOLD or more, and
neither a base span nor a better candidate that is accepted too overlaps it.

Everything is column expressions and joins on small tables: texts are read once and never shuffled, a
candidate travels with the few characters beside it. Vote patterns (KINDS * 3^5 at most) come to the driver;
the classifier is a table of KINDS * SLOTS * BUCKETS rows at most.

Defined results: null texts have no spans; matches that fail are dropped without retries; repeated
rows are handled alike, each for itself; texts of any length and any number of spans are searched whole;
columns of the input other than those named are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.llm.common import lower_ascii, materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "check", "gazetteer", "words", "edges")
#: A loose candidate needs BACKED of these for it, and none against.
EVIDENCE, BACKED = ("check", "gazetteer", "words"), 2
#: Characters kept beside a candidate, and of a candidate.
BESIDE, SHOWN = 48, 80
#: Rounds of expectation-maximisation, the first guess of a labeler's reliability, and the weight of that guess in votes.
ROUNDS, RELIABLE, GUESS = 50, 0.85, 20.0
#: Hashed values of each of the classifier's features, and the pseudo-count of each.
BUCKETS, SMOOTHING = 1024, 0.5
#: Probability from which a loose candidate is added.
THRESHOLD = 0.9
#: Positions are summed in pieces of this many matches.
PIECE = 512

# Patterns of the base spans. A run that no match ends before is tried from its start only, and repeats are
# possessive: equal matches, in time that grows with the text.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must stand in a text for a pattern to be tried at all.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<] ?(?:at|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\.|[\[({<] ?(?:dot|\.) ?[\])}>]) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}+(?::|[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}+(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9.])[0-9]{4}[._/][0-9]{4,6}[._/][0-9]{4,5}(?:[._/][0-9]{3,4})?(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-][0-9]{2,4}[\x20./-][0-9]{3,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z]|[.-][0-9])",
}
LOOSE_NEEDED = {"email": r"(?i)[\[({<] ?(?:at|@) ?[\])}>]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9][._/][0-9]{4}", "phone": r"[0-9)][\x20./-][0-9]"}

# Gazetteers (fixed values).
DOMAIN_ENDINGS = (
    "com org net edu gov mil int info biz name io co ai app dev de uk fr es it nl be ch at se no dk fi pl cz pt ie eu us ca mx "
    "br ar cl jp cn kr in id my sg th vn ph au nz za ng ke eg tr ru ua ro hu gr il ae sa"
)
COUNTRY_CODES = "1|7|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
CARD_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|62|35)"
NO_HOST = r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\.|^169\.254\."
# Words before a span that speak for its kind, and words that speak against any (fixed values).
WORDS_FOR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write|reach|from|to|cc",
    "ip": "ip|ipv4|ipv6|address|host|server|client|login|from|addr|dns",
    "card": "card|credit|visa|mastercard|amex|debit|karte|tarjeta|carte|payment|pan",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|tel[ée]fono|t[ée]l|handy|dial",
}
WORDS_AGAINST = "order|invoice|isbn|issn|version|build|serial|ticket|tracking|sku|ref|page|pp|id|no|nr|date|total|amount|price|doi"


def running_sums(sizes: Column) -> Column:
    """Sums of an array up to and with each place, in pieces, so that long arrays stay cheap."""
    def ahead(xs: Column, first: Column) -> Column:
        kind = "struct<at:int,out:array<int>>"
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)
        return F.aggregate(xs, start, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")).cast(kind), lambda s: s["out"])

    starts = F.sequence(F.lit(1), F.size(sizes), F.lit(PIECE))
    pieces = F.transform(starts, lambda i: F.slice(sizes, i, F.lit(PIECE)))
    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    firsts = F.concat(F.array(F.lit(0)), ahead(totals, F.lit(0)))
    return F.when(F.size(sizes) <= PIECE, ahead(sizes, F.lit(0))).otherwise(
        F.flatten(F.zip_with(pieces, F.slice(firsts, F.lit(1), F.size(pieces)), ahead)))


def matches(text: Column, pattern: str, base) -> Column:
    """Structs of all matches, places in code points; `span` shows SHOWN characters, `value` the first digits,
    and `base`, a function of span and value, tells whether the match is a base span."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"), F.split(text, pattern, -1).alias("gaps"))

    def placed(f: Column) -> Column:
        spans, n = f["spans"], F.size(f["spans"])
        ahead, behind = F.slice(f["gaps"], F.lit(1), n), F.slice(f["gaps"], F.lit(2), n)
        sizes = F.zip_with(spans, ahead, lambda m, g: F.length(m) + F.length(g))
        rows = F.arrays_zip(spans.alias("span"), running_sums(sizes).alias("end"), ahead.alias("ahead"), behind.alias("behind"))
        return F.transform(rows, lambda m: F.struct(
            base(m["span"], value_of(m["span"])).alias("base"), (m["end"] - F.length(m["span"])).alias("start"),
            m["end"].alias("end"), F.substring(m["span"], 1, SHOWN).alias("span"), value_of(m["span"]).alias("value"),
            F.right(m["ahead"], F.lit(BESIDE)).alias("before"), F.substring(m["behind"], 1, BESIDE).alias("after")))

    return once(found, placed)


def once(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def value_of(span: Column) -> Column:
    """Digits of a span, 40 at most."""
    return F.substring(F.regexp_replace(span, "[^0-9]", ""), 1, 40)


def luhn(digits: Column) -> Column:
    """Whether the digit sum with every second digit doubled, from the right, is divisible by ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def holds(kind: str):
    """A function of span and digits: whether a match of the strict pattern is a base span."""
    def octets(span: Column, _: Column) -> Column:
        short = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))

    return {
        "email": lambda span, value: F.lit(True), "ip": octets,
        "card": lambda span, value: F.when(F.length(value).between(13, 19), luhn(value)).otherwise(False),
        "phone": lambda span, value: F.length(value).between(9, 15),
    }[kind]


def candidates(text: Column) -> Column:
    """All candidates of a text; `strict` tells whether the strict pattern found one."""
    parts = []
    for number, kind in enumerate(KINDS):
        for strict in (True, False):
            has = F.rlike(text, F.lit((NEEDED if strict else LOOSE_NEEDED)[kind]))
            found = matches(text, (STRICT if strict else LOOSE)[kind], holds(kind) if strict else lambda span, value: F.lit(False))
            if kind == "card" and strict:  # numbers of other lengths are no candidates
                found = F.filter(found, lambda m: F.length(m["value"]).between(13, 19))
            parts.append(F.when(has, F.transform(found, _named(number, strict))))
    return once(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())), _without_covered)


def _without_covered(found: Column) -> Column:
    """The candidates that are base spans or touch none: what a base span covers is no finding of its own."""
    return once(F.filter(found, lambda c: c["base"]), lambda base: F.filter(
        found, lambda c: c["base"] | ~F.exists(base, lambda b: crosses(b, c))))


def crosses(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _named(number: int, strict: bool):
    return lambda m: F.struct(F.lit(number).alias("kind"), F.lit(strict).alias("strict"), *[
        m[c].alias(c) for c in ("base", "start", "end", "span", "value", "before", "after")])


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def by_kind(of: dict[str, Column]) -> Column:
    out = F.lit(0)
    for number, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == number, of[kind]).otherwise(out)
    return out


def with_votes(spans: DataFrame) -> DataFrame:
    """The votes of all labelers, a column each: 1 for, -1 against, 0 where one abstains."""
    span, value, digits = F.col("span"), F.col("value"), F.length("value")
    before, after = lower_ascii(F.col("before")), lower_ascii(F.col("after"))
    ending = F.regexp_extract(lower_ascii(span), r"([a-z]+)[^a-z]*$", 1)
    known = ending.isin(*DOMAIN_ENDINGS.split())
    never = F.lit(False)
    checks = {
        "email": vote(F.rlike(span, F.lit(r"(?i)[a-z]{2,}[^a-z]*$")), F.rlike(span, F.lit(r"\.\.|^[.-]|[0-9]$"))),
        "ip": vote(F.col("base") | F.rlike(span, F.lit("(?i)[0-9a-f]{3,4}:.*:[0-9a-f]")), F.col("strict") & ~F.col("base")),
        "card": vote(F.when(digits.between(13, 19), luhn(value)).otherwise(False), F.lit(True)),
        "phone": vote(digits.between(9, 15), digits < 8),
    }
    gazetteers = {
        "email": vote(known, ~known),
        "ip": vote(F.col("base") & ~F.rlike(span, F.lit(NO_HOST)) | F.rlike(span, F.lit("(?i)^(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):")),
                   F.rlike(span, F.lit(NO_HOST))),
        "card": vote(F.rlike(value, F.lit(CARD_ISSUERS)), ~F.rlike(value, F.lit(CARD_ISSUERS))),
        "phone": vote(F.rlike(span, F.lit(rf"^\+ ?\(?(?:{COUNTRY_CODES})")), never),
    }
    cue = lambda words: F.rlike(before, F.lit(rf"(?U)(?<!\w)(?:{words})(?!\w)[^\n]{{0,16}}$"))
    words = {kind: vote(cue(WORDS_FOR[kind]), cue(WORDS_AGAINST)) for kind in KINDS}
    glued = F.rlike(before, F.lit(r"[\p{L}\p{N}_@/=-]$")) | F.rlike(after, F.lit(r"^[\p{L}\p{N}_@/=]|^[-.][\p{N}]"))
    return spans.withColumns({
        "format": vote(F.col("strict"), ~F.col("strict")), "check": by_kind(checks), "gazetteer": by_kind(gazetteers),
        "words": by_kind(words), "edges": vote(~glued, glued),
    })


Pattern = tuple[int, ...]


def estimate(patterns: dict[Pattern, int]) -> dict[Pattern, float]:
    """Probability of a true span for every (kind, *votes), from how often each stands.

    Every labeler that does not abstain is right at a rate of its own on true and on false spans, every kind
    has a share of true ones; to abstain says nothing."""
    rows = sorted(patterns.items())
    guess = {True: {1: RELIABLE, -1: 1 - RELIABLE}, False: {1: 1 - RELIABLE, -1: RELIABLE}}
    rates = {y: [{0: 1.0, **guess[y]} for _ in LABELERS] for y in guess}
    shares = dict.fromkeys(range(len(KINDS)), 0.5)
    found: dict[Pattern, float] = {}
    for _ in range(ROUNDS):
        for (kind, *votes), _n in rows:
            like = {
                y: (shares[kind] if y else 1 - shares[kind]) * math.prod(rates[y][k][v] for k, v in enumerate(votes))
                for y in (True, False)
            }
            found[kind, *votes] = like[True] / (like[True] + like[False])
        for kind in shares:
            own = [(found[p], n) for p, n in rows if p[0] == kind]
            shares[kind] = (sum(f * n for f, n in own) + GUESS / 2) / (sum(n for _, n in own) + GUESS)
        for y in (True, False):
            for k in range(len(LABELERS)):
                seen = {v: GUESS * guess[y][v] for v in (1, -1)}
                for p, n in rows:
                    if p[k + 1]:
                        seen[p[k + 1]] += n * (found[p] if y else 1 - found[p])
                rates[y][k] = {0: 1.0, **{v: x / sum(seen.values()) for v, x in seen.items()}}
    return found


def features() -> Column:
    """Hashed features of a candidate: form, length, and what stands beside it."""
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("span", r"\p{Nd}+", "9"), r"\p{L}+", "a"), "(9[. -]|a[.])\\1+", "$1")
    before, after = lower_ascii(F.col("before")), lower_ascii(F.col("after"))
    shape = F.regexp_replace(F.regexp_replace("span", r"\p{Nd}", "9"), r"\p{L}", "a")
    return F.array(
        F.left(form, F.lit(24)), F.left(shape, F.lit(24)), F.least(F.length("value"), F.lit(24)).cast("string"),
        F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1), F.regexp_extract(after, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1),
        F.right(before, F.lit(1)), F.left(after, F.lit(1)),
    )


def span_classifier(spans: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(kind, slot, bucket, ratio) of naive Bayes, and the log odds of each kind. Counts are thousandths of
    probabilities in whole numbers, so sums do not depend on their order."""
    weight = F.round(F.col("probability") * 1000).cast("long")
    counted = spans.select("kind", weight.alias("yes"), (1000 - weight).alias("no"), F.posexplode(buckets()).alias("slot", "bucket"))
    table = materialise(counted.groupBy("kind", "slot", "bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    sums = {r["kind"]: (r["yes"] + 500, r["no"] + 500) for r in table.filter("slot = 0").groupBy("kind").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    def share(count: str, i: int) -> Column:
        # pseudo-counts in the proportion of the classes: a value that is new speaks for neither
        own = by_number({k: v[i] / 1000 for k, v in sums.items()})
        part = by_number({k: v[i] / sum(v) for k, v in sums.items()})
        return (F.col(count) / 1000 + SMOOTHING * part) / own

    model = table.select("kind", "slot", "bucket", F.log(share("yes", 0) / share("no", 1)).alias("ratio"))
    return model, {k: math.log(yes / no) for k, (yes, no) in sums.items()}


def by_number(of: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for kind, value in of.items():
        out = F.when(F.col("kind") == kind, F.lit(value)).otherwise(out)
    return out


def buckets() -> Column:
    return F.transform(features(), lambda f, slot: F.pmod(F.xxhash64(slot, f), F.lit(BUCKETS)).cast("int"))


def added_spans(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end, probability) of the loose candidates that votes and classifier accept."""
    voted = with_votes(spans)
    patterns = voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    labels = estimate({tuple(r[c] for c in ("kind", *LABELERS)): r["n"] for r in patterns})
    known = spans.sparkSession.createDataFrame(
        [(*p, probability) for p, probability in labels.items()], ", ".join(f"{c} int" for c in ("kind", *LABELERS)) + ", probability double")
    # both small tables have a bound: KINDS * 3^5 patterns, KINDS * features * BUCKETS ratios
    labelled = voted.join(F.broadcast(known), ["kind", *LABELERS])
    model, odds = span_classifier(labelled)
    backed = sum((F.col(c) > 0).cast("int") for c in EVIDENCE) >= BACKED
    loose = labelled.filter("not base").filter(backed & (F.least(*EVIDENCE) >= 0)).select(
        "row", "kind", "start", "end", "probability", F.posexplode(buckets()).alias("slot", "bucket"))
    score = F.round(F.sum("ratio") + by_number(odds), 6)
    judged = (
        loose.join(F.broadcast(model), ["kind", "slot", "bucket"])
        .groupBy("row", "kind", "start", "end", "probability").agg(score.alias("score"))
        .withColumn("classified", 1 / (1 + F.exp(-F.col("score"))))
    )
    return judged.filter((F.col("probability") >= THRESHOLD) & (F.col("classified") >= THRESHOLD)).select(
        "row", "kind", "start", "end", F.col("classified").alias("probability"))


def personal_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of `docs` with `spans`, an array of (kind, start, end, base, probability) by kind and
    start; kind is a number in KINDS. Rows without a span have an empty array."""
    found = materialise(docs.select(
        *keep, F.monotonically_increasing_id().alias("row"), candidates(F.coalesce("text", F.lit(""))).alias("candidates")))
    spans = found.select("row", F.inline("candidates"))
    added = added_spans(spans).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "probability")).alias("added"))
    base = F.transform(F.filter("candidates", lambda c: c["base"]), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(True).alias("base"),
        F.lit(1.0).alias("probability")))
    better = lambda a, b: (a["probability"] > b["probability"]) | ((a["probability"] == b["probability"]) & (
        F.struct(a["start"], a["kind"], a["end"]) < F.struct(b["start"], b["kind"], b["end"])))
    left = F.filter("added", lambda a: ~F.exists("added", lambda b: crosses(a, b) & better(b, a)))
    more = F.transform(left, lambda a: F.struct(
        a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end"), F.lit(False).alias("base"), a["probability"].alias("probability")))
    joined = found.join(added, "row", "left").withColumn("base", base)
    return joined.select(*keep, F.sort_array(F.concat("base", F.coalesce(more, F.array().cast(
        "array<struct<kind:int,start:int,end:int,base:boolean,probability:double>>")))).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans may not overlap."""
    marks = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ends = F.concat(F.array(F.lit(0)), F.transform(by_place, lambda s: s["end"]))
    pieces = F.zip_with(by_place, F.slice(ends, F.lit(1), F.size(by_place)), lambda s, end: F.concat(
        F.substr(text, end + 1, s["start"] - end), F.get(marks, s["kind"])))
    return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(ends, -1) + 1))


def personal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, the digest of the base spans, and all spans."""
    found = personal_spans(docs, "doc_id")
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda i: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    counts = {f"n_{k}": number(i) for i, k in enumerate(KINDS)}
    return found.withColumns(counts).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

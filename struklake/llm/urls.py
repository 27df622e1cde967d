"""URL filter: allow and block rules, and for the rest a ratio of character language models.

URLs that a rule judges are the examples: two variable-order Markov models, one of accepted and
one of rejected URLs, give every character a probability from the ORDER characters before it.
An order's counts are interpolated with the next shorter order's probability by the number of
different followers seen (Witten and Bell, 1991), down to a uniform alphabet. The verdict comes
from the log-likelihood difference per character, less a threshold that is calibrated on a fold of
examples which the models do not count.

Everything is counts of distinct strings: hosts and paths are scored once each, however many pages
a host has, and shorter orders are rolled up from the table of the longest.

Defined results: null urls and urls without `://` have empty host and path and are judged by the
models; repeated rows are judged alike; urls of any length are judged whole, in time that grows with it; without examples of both verdicts in training or
calibration the threshold is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import drop_clashing, lower_ascii, materialise

#: (host, path, verdict): fits the host, its subdomains, and urls whose path starts with the path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Longest context in characters.
ORDER = 4
#: Characters of the uniform distribution below order 0.
ALPHABET = 256
#: Characters of a string that are handled together.
PIECE = 256
#: Rows of the models (three short columns) up to which they are broadcast.
BROADCAST_RATIOS = 200_000
#: Examples with digest mod FOLDS = 0 calibrate the threshold, the others train.
FOLDS = 5
#: Thresholds are tried in steps of 1 / STEPS.
STEPS = 100


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, named).otherwise(out)
    return out


def fold(host: Column, path: Column) -> Column:
    digest = F.md5(F.concat(host, path))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % FOLDS


def strings(df: DataFrame) -> Column:
    """Host and path with ORDER start marks of their own and an end mark."""
    return F.array(*[
        F.concat(F.lit(mark * ORDER), F.col(c), F.lit("\x03")) for mark, c in (("\x01", "host"), ("\x02", "path"))
    ])


def grams(texts: DataFrame, *keep: str) -> DataFrame:
    """Every character of `s` with the ORDER characters before it, and the columns `keep`. Strings are cut into pieces
    first and travel with none of their characters, so time and rows grow with their length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("s") - ORDER, F.lit(1)), F.lit(PIECE))
    pieces = texts.select(*keep, F.explode(F.transform(
        starts, lambda i: F.substr(F.col("s"), i, F.lit(PIECE + ORDER)))).alias("piece"))
    places = F.sequence(F.lit(1), F.length("piece") - ORDER)
    return pieces.select(*keep, F.explode(F.transform(places, lambda i: F.struct(
        F.substr(F.col("piece"), i, F.lit(ORDER)).alias("context"), F.substr(F.col("piece"), i + ORDER, F.lit(1)).alias("c")))).alias("g")
    ).select(*keep, "g.context", "g.c")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(context, c, ratio): log of the accepted over the rejected probability of c."""
    below = None
    for order in range(ORDER + 1):
        at = F.substring("context", ORDER - order + 1, order) if order else F.lit("")
        level = counts.groupBy(at.alias("context"), "c").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        # a context has no more rows than there are characters
        here = Window.partitionBy("context")
        level = level.withColumns({
            name: column for k in ("good", "bad") for name, column in (
                (f"{k}_n", F.sum(k).over(here)), (f"{k}_kinds", F.sum((F.col(k) > 0).cast("long")).over(here)))
        })
        if below is None:
            level = level.withColumns({"low_good": F.lit(1 / ALPHABET), "low_bad": F.lit(1 / ALPHABET)})
        else:
            shorter = below.select(
                F.col("context").alias("short"), F.col("c").alias("short_c"),
                F.col("p_good").alias("low_good"), F.col("p_bad").alias("low_bad"),
            )
            level = level.join(
                shorter, (F.substring("context", 2, ORDER) == F.col("short")) & (F.col("c") == F.col("short_c"))
            )
        below = level.select("context", "c", *[
            F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_kinds") * F.col(f"low_{k}"))
                   / (F.col(f"{k}_n") + F.col(f"{k}_kinds"))).otherwise(F.col(f"low_{k}")).alias(f"p_{k}")
            for k in ("good", "bad")
        ])
    return below.select("context", "c", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def string_scores(urls: DataFrame) -> DataFrame:
    """(s, ratio, n): summed log ratio and characters of every distinct host and path."""
    trains = F.when(F.col("fold") != 0, F.col("named.verdict"))
    texts = materialise(
        urls.select(F.explode(strings(urls)).alias("s"), trains.alias("label")).groupBy("s").agg(
            F.sum((F.col("label") == "allow").cast("long")).alias("good"),
            F.sum((F.col("label") == "block").cast("long")).alias("bad"),
        ).na.fill(0).withColumn("number", F.monotonically_increasing_id())
    )
    counts = materialise(
        grams(texts, "good", "bad").groupBy("context", "c").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    ratios = materialise(log_ratios(counts))
    # the small side is told, as sizes of exploded rows are only guessed: models of few contexts are broadcast
    ratios = F.broadcast(ratios) if ratios.count() <= BROADCAST_RATIOS else ratios.hint("merge")
    scores = (
        grams(texts, "number").join(ratios, ["context", "c"]).groupBy("number")
        .agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("n"))
    )
    return texts.select("number", "s").join(scores.hint("merge"), "number").select("s", "ratio", "n")


def calibrated(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on the calibration fold. Differences per
    character lie within +-log(probability), so the histogram has a few thousand rows at most."""
    bars = (
        scored.filter("fold = 0 and named is not null")
        .groupBy(F.floor(F.col("score") * STEPS).alias("bar"))
        .agg(F.sum((F.col("named.verdict") == "allow").cast("long")).alias("good"),
             F.sum((F.col("named.verdict") == "block").cast("long")).alias("bad"))
        .collect()
    )
    good, bad = sum(b["good"] for b in bars), sum(b["bad"] for b in bars)
    if not good or not bad:
        return 0.0
    # Accuracies are compared as whole numbers (times 2 * good * bad), so ties are exact; half is
    # what no threshold at all has.
    best, below_good, below_bad, before = (good * bad, 0.0), 0, 0, None
    for b in sorted(bars, key=lambda b: b["bar"]):
        # all bars before this one are blocked: the threshold lies midway between
        rate = (good - below_good) * bad + below_bad * good
        edge = ((b["bar"] if before is None else before + 1) + b["bar"]) / (2 * STEPS)
        best, before = max(best, (rate, edge), key=lambda x: x[0]), b["bar"]
        below_good, below_bad = below_good + b["good"], below_bad + b["bad"]
    return best[1]


def judged(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and score (log-likelihood difference per character,
    less the threshold), which replace columns of these names."""
    pages = drop_clashing(pages, "host", "path", "rule", "verdict", "score")
    host, path = split_url(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    named = split.withColumns({
        "named": rule_of(F.col("host"), F.col("path"), rules), "fold": fold(F.col("host"), F.col("path")),
    })
    texts = materialise(string_scores(named.select("host", "path", "named", "fold")))
    scored = named.withColumn("__s", strings(named))
    for i in range(2):
        side = texts.select(F.col("s").alias(f"__s{i}"), F.col("ratio").alias(f"__ratio{i}"), F.col("n").alias(f"__n{i}"))
        scored = scored.join(side, F.col("__s")[i] == F.col(f"__s{i}"))
    scored = scored.withColumn("score", (F.col("__ratio0") + F.col("__ratio1")) / (F.col("__n0") + F.col("__n1")))
    threshold = calibrated(scored)
    verdict = F.coalesce("named.verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(
        *pages.columns, "host", "path", F.col("named.rule").alias("rule"), verdict.alias("verdict"),
        (F.col("score") - threshold).alias("score"),
    )


def verdict_digest(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    def levels() -> str:
        out = []
        for k in range(ORDER + 1):
            out.append(f"""
c{k} AS (SELECT substr(context, {ORDER - k + 1}, {k}) AS context, c, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad
         FROM counts GROUP BY ALL),
t{k} AS (SELECT context, sum(good)::BIGINT AS good_n, count(*) FILTER (good > 0) AS good_kinds,
                sum(bad)::BIGINT AS bad_n, count(*) FILTER (bad > 0) AS bad_kinds FROM c{k} GROUP BY context),
p{k} AS (SELECT c{k}.context, c{k}.c,
         CASE WHEN good_n > 0 THEN (good + good_kinds * {low(k, 'good')}) / (good_n + good_kinds) ELSE {low(k, 'good')} END AS p_good,
         CASE WHEN bad_n > 0 THEN (bad + bad_kinds * {low(k, 'bad')}) / (bad_n + bad_kinds) ELSE {low(k, 'bad')} END AS p_bad
         FROM c{k} JOIN t{k} USING (context) {'' if not k else f'JOIN p{k - 1} s ON s.context = substr(c{k}.context, 2) AND s.c = c{k}.c'})""")
        return ",".join(out)

    def low(k: int, kind: str) -> str:
        return f"s.p_{kind}" if k else f"{1 / ALPHABET}::DOUBLE"

    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    string = "repeat(chr({}), {}) || {} || chr(3)"
    return f"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
x AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
n AS (SELECT *, CASE {cases} ELSE NULL END AS named,
             ('0x' || substr(md5(host || path), 1, 8))::BIGINT % {FOLDS} AS fold,
             {string.format(1, ORDER, 'host')} AS s1, {string.format(2, ORDER, 'path')} AS s2 FROM x),
texts AS (
    SELECT s, count(*) FILTER (fold <> 0 AND named.verdict = 'allow') AS good,
           count(*) FILTER (fold <> 0 AND named.verdict = 'block') AS bad
    FROM (SELECT s1 AS s, named, fold FROM n UNION ALL SELECT s2, named, fold FROM n) GROUP BY s),
grams AS (
    SELECT s, good, bad, substr(s, i - {ORDER}, {ORDER}) AS context, substr(s, i, 1) AS c
    FROM (SELECT *, unnest(range({ORDER + 1}, length(s) + 1)) AS i FROM texts)),
counts AS (SELECT context, c, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM grams GROUP BY ALL),{levels()},
scores AS (
    SELECT s, sum(ln(p_good) - ln(p_bad)) AS ratio, count(*) AS n
    FROM grams JOIN p{ORDER} USING (context, c) GROUP BY s),
z AS (SELECT n.*, (a.ratio + b.ratio) / (a.n + b.n) AS score
      FROM n JOIN scores a ON a.s = s1 JOIN scores b ON b.s = s2),
bars AS (
    SELECT floor(score * {STEPS}) AS bar, count(*) FILTER (named.verdict = 'allow') AS good,
           count(*) FILTER (named.verdict = 'block') AS bad
    FROM z WHERE fold = 0 AND named IS NOT NULL GROUP BY bar),
rates AS (
    SELECT bar, (sum(good) OVER () - coalesce(sum(good) OVER w, 0)) * sum(bad) OVER ()
                + coalesce(sum(bad) OVER w, 0) * sum(good) OVER () AS rate,
           sum(good) OVER () * sum(bad) OVER () AS half,
           (coalesce(lag(bar) OVER (ORDER BY bar) + 1, bar) + bar) / {2 * STEPS} AS edge
    FROM bars WINDOW w AS (ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce((SELECT edge FROM rates WHERE rate > half ORDER BY rate DESC, bar LIMIT 1), 0) AS threshold)
SELECT page_id, host, path, named.rule AS rule,
       coalesce(named.verdict, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM z, best"""


ORACLE = _oracle()

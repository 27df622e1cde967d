"""Main text of web pages by differencing with the page of the nearest URL.

A page becomes text lines, one for each block, each marked by where it stands: in the article, in
boilerplate (by element, role, class or id: menus, headers, footers, sidebars, notices, adverts,
forms, comments), or open. The lines of the article, or the open ones if the page marks none, are the
text's candidates. What a page itself marks as boilerplate goes without any partner, for menus and
adverts that change from page to page are shared by no two.

Of the candidates those go that a template repeats. Pages of one host with the same candidates count
once; these distinct pages, marked and open ones apart, are sorted by path, and each is paired with the
neighbour that shares the longer start of the path (of equals the one before). The longest common
subsequence of both pages' candidates is what differencing takes for the template.

Of an open page these lines go. Inside a marked article such lines may also be quotations and phrases of the
text, or both pages versions of one text (README has figures), so an exact count follows. Pages that share
at most half of their lines with their nearest one are witnesses. A line that differencing shows on two
thirds of a host's witnesses, and on four at least, is its template's, and goes from all marked pages of
the host. Headings, captions, cells and the like (`FIRM`) of an article are not differenced: sections of
many articles have the same titles.

Pages of one host may be any share of the table: distinct pages are dealt by range over tasks, only
hashes of lines travel with them, and each range is given the last page of the one before and the
first of the one after. So the result depends on neither the number of ranges nor copies. The lines found
for a host are at most one and a half times those of its average witness.

Defined results: null html gives an empty text; null urls and urls without `://` have the empty
host and are not paired; repeated rows and copies are extracted alike; a page alone on its host keeps
its candidates; other columns of the input are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import materialise
from struklake.llm.urls import split_url

TAG = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(hidden)(?=[\s/]|$)", re.DOTALL)
#: Elements whose content is no markup; it ends at their own end tag.
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are boilerplate wherever they stand, and such that are outside an article only.
BOILERPLATE = frozenset("nav footer aside form menu dialog button select fieldset head datalist".split())
OUTER_BOILERPLATE = frozenset({"header"})
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class or id that mark boilerplate outside an article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|"
    r"overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|repl(?:y|ies)|responses?|feedback|discussion|"
    r"disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|footer|"
    r"widget|toolbar|pagination|pager|skip|masthead|alert|copyright|outbrain|taboola|hidden)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Inside an article only containers are marked, by a whole class or id: one of the words that mean
#: nothing else there, with or without the name of a part of a page.
CONTAINERS = frozenset("article aside div dl li ol section table ul".split())
INNER_MARKS = re.compile(
    r"(?:(?:article|blog|entry|fb|page|post|reader|site|user|wp)[_-]+)?(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|sidebar|menu|nav|"
    r"navbar|navigation|breadcrumbs?|comments?|commentlist|repl(?:y|ies)|disqus|respond|share|sharing|recommended|"
    r"newsletter|subscribe|subscription|signup|login|footer|widget|toolbar|pagination|pager|masthead|copyright|outbrain|"
    r"taboola|hidden)(?:[_-]+(?:area|author|bar|block|body|box|buttons?|container|content|form|item|links?|list|meta|notice|placement|section|slot|thread|unit|"
    r"widget|wrapper|\d+))*",
    re.IGNORECASE,
)
#: Regions in which an article is no main text: what is open here has no forgotten end tag.
FOREIGN = frozenset("aside footer dialog".split())
FOREIGN_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|comments?|commentlist|repl(?:y|ies)|responses?|feedback|discussion|"
    r"disqus|respond|related|recommended|newsletter|footer|widget|outbrain|taboola|hidden)(?=$|[\s_-])",
    re.IGNORECASE,
)
OUTER_MARKS = re.compile(r"(?:^|[\s_-])(?:header|top|topbar|site-title|logo)(?=$|[\s_-])", re.IGNORECASE)
ARTICLES = frozenset(("article", "main"))
ARTICLE_MARKS = re.compile(
    r"^(?:(?:page|site|blog|single|full|inner|news)[_-]+)?(?:article|post|entry|story|main|content|body|text)"
    r"(?:[_-]+(?:article|post|entry|story|main|content|body|text))*$",
    re.IGNORECASE,
)
ARTICLE, OPEN, OUTER = 0, 1, 2
#: Elements of an article whose lines are the article's own, however many pages have them.
FIRM = frozenset("h1 h2 h3 h4 h5 h6 td th dt dd caption figcaption pre".split())
#: Witnesses that must show a line at least, and the least share of a host's witnesses (over, under).
WITNESSES, SHARE = 4, (2, 3)


def attributes(rest: str) -> dict[str, str]:
    return {
        (m[1] or m[5]).lower(): entities.unescape(next((g for g in m.groups()[1:4] if g is not None), ""))
        for m in ATTRIBUTE.finditer(rest)
    }


def kind_of(name: str, rest: str, in_article: bool) -> int | None:
    """OUTER or ARTICLE if the element opens such a region, else None."""
    if name in BOILERPLATE or (name in OUTER_BOILERPLATE and not in_article):
        return OUTER
    if rest and ("=" in rest or "hidden" in rest):
        have = attributes(rest)
        names = f"{have.get('class', '')} {have.get('id', '')}"
        if (
            "hidden" in have or have.get("aria-hidden") == "true" or have.get("role", "").lower() in ROLES
            or re.search(r"display\s*:\s*none", have.get("style", ""))
        ):
            return OUTER
        if name not in ("html", "body"):
            if in_article:
                if name in CONTAINERS and any(INNER_MARKS.fullmatch(c) for c in names.split()):
                    return OUTER
            elif name not in ARTICLES and MARKS.search(names):
                return OUTER
            if not in_article and name not in ARTICLES and OUTER_MARKS.search(names):
                return OUTER
            if name in ("div", "section", "td") and any(ARTICLE_MARKS.match(c) for c in names.split()):
                return ARTICLE
        if have.get("role", "").lower() in ARTICLES:
            return ARTICLE
    return ARTICLE if name in ARTICLES else None


def is_foreign(name: str, rest: str) -> bool:
    """Whether an element opens a region that an article does not end: comments, sidebars, footers, adverts."""
    have = attributes(rest) if "=" in rest else {}
    return name in FOREIGN or FOREIGN_MARKS.search(f"{have.get('class', '')} {have.get('id', '')}") is not None


def page_lines(page: str | None, trusting: bool = True) -> list[tuple[int, str, bool]]:
    """(region, text, firm) of every block that has text, in page order. An article inside boilerplate ends it, as its end tag
    was left out; if `trusting`, not if the boilerplate is foreign to main texts."""
    page = page or ""
    lines: list[tuple[int, str, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int | None]] = []  # open elements that are no inline ones
    inner: list[int] = []  # regions that are open
    foreign: list[int] = []  # places in the stack of boilerplate that an article does not end
    firm: list[int] = []  # places in the stack of an article's firm elements

    def region() -> int:
        return OUTER if OUTER in inner else ARTICLE if ARTICLE in inner else OPEN

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            lines.append((region(), text, bool(firm)))

    def close(name: str) -> None:
        """Close the innermost open element of that name and what is still open inside it."""
        if any(n == name for n, _ in stack):
            end_block()
            while stack:
                n, kind = stack.pop()
                if foreign and foreign[-1] == len(stack):
                    foreign.pop()
                if firm and firm[-1] == len(stack):
                    firm.pop()
                if kind is not None:
                    inner.remove(kind)
                if n == name:
                    return

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            buffer.append(page[at:])
            break
        buffer.append(page[at:start])
        m = TAG.match(page, start)
        if not m:
            buffer.append("<")
            at = start + 1
            continue
        at = m.end()
        if m["name"] is None:
            continue
        name, rest = m["name"].lower(), m["rest"]
        if m["close"]:
            if name not in INLINE:
                close(name)
            elif stack and any(n == name for n, _ in stack):
                close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            if name not in INLINE:
                end_block()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            close("p")
        if name == "li" and stack and stack[-1][0] == "li":
            close("li")
        kind = kind_of(name, rest, ARTICLE in inner)
        if name in ARTICLES and OUTER in inner and not foreign and not any(n in ARTICLES for n, _ in stack):
            # an article never starts inside a menu: an end tag was left out
            end_block()
            stack.clear()
            inner.clear()
            firm.clear()
        if name in VOID or rest.rstrip().endswith("/"):
            if name not in INLINE:
                end_block()
            continue
        if name in INLINE and kind is None:
            continue
        end_block()
        if trusting and kind == OUTER and is_foreign(name, rest):
            foreign.append(len(stack))
        if name in FIRM and ARTICLE in inner:
            firm.append(len(stack))
        stack.append((name, kind))
        if kind is not None:
            inner.append(kind)
    end_block()
    return lines


def marked_candidates(page: str | None) -> tuple[bool, list[str], list[bool]]:
    """Whether the page marks an article, its lines, or the open ones if it marks none, and whether each is firm."""
    lines = page_lines(page)
    marked = any(kind == ARTICLE for kind, _, _ in lines)
    if not marked:  # perhaps the region around the article was never closed: it then holds most of the page's text
        inside = [line for line in page_lines(page, trusting=False) if line[0] == ARTICLE]
        if sum(len(text) for _, text, _ in inside) > sum(len(text) for kind, text, _ in lines if kind == OPEN):
            marked, lines = True, inside
    lines = [line for line in lines if line[0] == (ARTICLE if marked else OPEN)]
    return marked, [text for _, text, _ in lines], [firm for _, _, firm in lines]


def candidates(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks an article, and its lines, or the open ones if it marks none."""
    return marked_candidates(page)[:2]


def common_lines(a: Sequence, b: Sequence) -> set[int]:
    """Places in `a` of a longest common subsequence of both, in memory that grows with their lengths
    (Hirschberg, 1975)."""
    names = {t: k for k, t in enumerate(set(a) & set(b))}
    at = [i for i, t in enumerate(a) if t in names]
    x = np.array([names[a[i]] for i in at], dtype=np.int64)
    y = np.array([names[t] for t in b if t in names], dtype=np.int64)
    found: set[int] = set()

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, dtype=np.int64)
        for v in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
        return row

    def search(x: np.ndarray, y: np.ndarray, first: int) -> None:
        n = min(len(x), len(y))
        same = x[:n] == y[:n]
        ahead = n if same.all() else int(same.argmin())
        found.update(range(first, first + ahead))
        x, y, first = x[ahead:], y[ahead:], first + ahead
        n = min(len(x), len(y))
        same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
        behind = n if same.all() else int(same.argmin())
        found.update(range(first + len(x) - behind, first + len(x)))
        x, y = x[: len(x) - behind], y[: len(y) - behind]
        if not len(x) or not len(y):
            return
        if len(x) == 1:
            if (y == x[0]).any():
                found.add(first)
            return
        half = len(x) // 2
        cut = int((lengths(x[:half], y) + lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        search(x[:half], y[:cut], first)
        search(x[half:], y[cut:], first + half)

    search(x, y, 0)
    return {at[i] for i in found}


#: A page as its neighbours see it: path and hashes of the lines that are differenced.
Seen = tuple[str, list[int]]


def template_lines(page: Seen, before: Seen | None, after: Seen | None) -> list[int] | None:
    """Places of the lines that the page shares with its nearest neighbour; None without neighbours."""
    near = [p for p in (before, after) if p is not None]
    if not near:
        return None
    nearest = max(near, key=lambda p: len(commonprefix([page[0], p[0]])))  # the first of equals
    return sorted(common_lines(page[1], nearest[1]))


def _lines(html: Column) -> Column:
    @F.pandas_udf("marked boolean, lines array<string>, firm array<boolean>")
    def of_page(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([marked_candidates(p) for p in pages], columns=["marked", "lines", "firm"])

    return of_page(html)


def _find_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open pages the places of shared lines; of marked pages that are witnesses the hashes of shared lines, perhaps none."""
    fields = ("path", "hashes")
    for batch in batches:
        hosts, codes, gone, shown = [], [], [], []
        for row in batch.to_pylist():
            seen = [tuple(p[f] for f in fields) if p else None for p in (row["page"], row["before"], row["after"])]
            places = template_lines(*seen)
            hashes = seen[0][1]
            if places is None or (2 * len(places) > len(hashes) if row["marked"] else not places):
                continue
            hosts.append(row["host"])
            codes.append(row["code"])
            gone.append(None if row["marked"] else places)
            shown.append(list({hashes[i] for i in places}) if row["marked"] else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(codes, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(shown, pa.list_(pa.int64()))],
            names=["host", "code", "gone", "shown"],
        )


def neighbours(distinct: DataFrame) -> DataFrame:
    """(host, marked, code, page, before, after) of distinct pages (host, marked, code, page), where page is a
    struct that begins with the path: the pages before and after it in its host's order, marked and open ones apart."""
    order = ["host", "marked", "page.path", "code"]
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(
        distinct.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    )
    row = F.struct("host", "marked", F.col("page.path").alias("path"), "code", "page")
    by_range = Window.orderBy("range")  # one row per range
    ends = dealt.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last")).withColumn(
        "beside", F.array(F.lag("last").over(by_range), F.lead("first").over(by_range))
    ).select("range", F.explode("beside").alias("r")).filter("r is not null")
    lent = ends.select("r.host", "r.marked", "r.code", "r.page", "range", F.lit(True).alias("lent"))
    by_path = Window.partitionBy("range").orderBy(*order)
    group = F.struct("host", "marked")
    beside = lambda f: F.when(f(group).over(by_path) == group, f("page").over(by_path))
    return (
        dealt.withColumn("lent", F.lit(False)).unionByName(lent)
        .withColumns({"before": beside(F.lag), "after": beside(F.lead)})
        .filter("not lent").select("host", "marked", "code", "page", "before", "after")
    )


def template_of_hosts(witnesses: DataFrame) -> DataFrame:
    """(host, line) of the lines that enough of a host's witnesses (host, shown) show."""
    of_host = witnesses.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= WITNESSES)
    of_line = (
        witnesses.select("host", F.explode("shown").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("showing"))
        .filter(F.col("showing") >= WITNESSES)
    )
    over, under = SHARE
    return of_line.join(of_host, "host").filter(F.col("showing") * under >= F.col("n") * over).select("host", "line")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host, path = split_url(F.col("url"))
    # A page is parsed once; its lines are kept, as templates and texts need them.
    parsed = materialise(pages.select("page_id", "url", host.alias("host"), path.alias("path"), _lines(F.col("html")).alias("p")).select(
        "page_id", "url", "host", "path", "p.marked", "p.lines", "p.firm", F.xxhash64("p.marked", "p.lines", "p.firm").alias("code")))
    each = F.filter(F.arrays_zip("lines", "firm"), lambda x: ~x["firm"])
    page = F.struct("path", F.transform(each, lambda x: F.xxhash64(x["lines"])).alias("hashes"))
    distinct = materialise(
        parsed.filter(F.col("host") != "").withColumn("page", page).filter(F.size("page.hashes") > 0)
        .groupBy("host", "code").agg(F.first("marked").alias("marked"), F.min("page").alias("page"))
    )
    differenced = materialise(neighbours(distinct).mapInArrow(_find_templates, "host string, code long, gone array<int>, shown array<long>"))
    # Both tables are written, so that their sizes are known: texts are shuffled only if these are too large to broadcast.
    of_pages = materialise(differenced.filter("gone is not null").select("host", "code", "gone"))
    of_hosts = materialise(
        template_of_hosts(differenced.filter("shown is not null").select("host", "shown"))
        .groupBy("host").agg(F.collect_list("line").alias("template")).withColumn("marked", F.lit(True))
    )
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    own = F.filter(F.arrays_zip("lines", "firm"), lambda x: x["firm"] | ~F.array_contains("template", F.xxhash64(x["lines"])))
    kept = (
        F.when(F.col("template").isNotNull(), own["lines"])
        .when(F.size("gone") > 0, F.transform(F.array_except(places, "gone"), lambda i: F.get("lines", i)))
        .otherwise(F.col("lines"))
    )
    return (
        parsed.join(of_pages, ["host", "code"], "left").join(of_hosts, ["host", "marked"], "left")
        .select("page_id", "url", F.array_join(kept, "\n").alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )


#: The given pages mark one article each, of headings and paragraphs with bold text and line breaks; on
#: such pages the text can be told in SQL. Pages of other kinds are held against brute force in the tests.
ORACLE = r"""
WITH bodies AS (
    SELECT page_id, url, replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '<b>', '') AS body
    FROM pages),
blocks AS (SELECT page_id, url, string_split_regex(body, '</?(?:p|h1)>') AS parts FROM bodies),
texts AS (
    SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda b: trim(regexp_replace(
               regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\p{Z}]+', ' ', 'g'))),
           lambda b: b <> ''), chr(10)) AS text
    FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts"""

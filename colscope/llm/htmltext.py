"""Main text of pages as the maximum-scoring run of words and tags.

A page is a sequence of items: words score positive, tags negative. The weights are learnt from labelled pages, that
is from pages that mark their article themselves (an article or main element): for each kind of item (a word
under certain boilerplate elements, a link word, a plain word, each tag name) the log ratio of its rate inside and
outside the marked article, so that a page without such marks is cut by the same weights. One linear scan over
the items finds the contiguous run with the highest sum; the blocks of that run that no boilerplate element
encloses are the text. What a boilerplate element holds inside the article adds nothing, so that no advert or form
can outweigh the words before it.

Boilerplate is known by an element's name or by a part of its class, id or role. Names of layouts don't count: words
that begin with one of LAYOUT ("with-sidebar"), classes that hold an article in the labelled pages, and, on any page,
what encloses its first article.

The tokenizer is one regular expression; wrong nesting, tags that are never closed and pages that break off are
ordinary input. A page takes time linear in its length, whatever its tags. Pages are read one by one in a single pass
without a shuffle; null and empty pages have the empty text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents

#: Comments, declarations, and tags with quoted values; a tag that the page's end cuts off is a tag. A tag never fails to
#: match once it has begun, so that nothing is read twice.
ITEM = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
SPACE = re.compile(r"\s+")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements of HTML by their part in a page.
#: Their content is no markup and never shown text.
RAW = frozenset("script style template textarea iframe title".split())
#: Elements that hold no part of an article; noscript holds notices to readers without scripts.
ASIDE = frozenset("nav header footer aside form button select menu dialog noscript".split())
#: Words in class, id or role that mark such a part.
ASIDE_WORDS = frozenset("""ad ads advert advertisement banner breadcrumb comment comments consent cookie cookies footer menu
    nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsored subscribe widget
    contentinfo complementary search disqus replies respond masthead""".split())
#: Words in class or id that say how a page is laid out, not what an element holds.
LAYOUT = frozenset("has with without no not is hide show".split())
#: Elements that don't break a block.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span
    strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open paragraph when it opens a block.
ENDS_PARAGRAPH = frozenset("""address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6
    header hr main menu nav ol p pre section table ul""".split())
ARTICLE = frozenset(("article", "main"))
#: Weights lie between these bounds; labelled pages that are read for them, about.
MOST, TRAIN_PAGES = 4.0, 2_000
#: Rate of an unseen kind: as if seen so often on either side.
PRIOR = 1.0


def names_of(attributes: str) -> set[str]:
    """The words in class, id and role, in lower case."""
    return set(" ".join(" ".join(x) for x in NAMED.findall(attributes)).lower().split())


def boilerplate(names: set[str], layout: frozenset[str]) -> bool:
    """Whether a word of class, id or role marks a part that is no article; words in layout never do."""
    for name in names - layout:
        parts = re.split(r"[_-]+", name)
        if parts[0] not in LAYOUT and not ASIDE_WORDS.isdisjoint(parts):
            return True
    return False


def parse(page: str, layout: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, words, breaks, inside): kind "<name>" for a tag with no words, or a text's surroundings with its words.

    inside: whether an article or main element is open. breaks: whether a block ends here. A kind ".name" stands for an
    element of that class, id or role that holds the page's first article. Tags in boilerplate inside an article are ".".
    """
    stack: list[list] = []  # open elements: name, whether it is boilerplate, whether so by its class, its names
    open_names: Counter = Counter()
    blocks: list[int] = []  # places in the stack of those that break a block
    aside = marked = 0
    found = False  # whether an article has begun

    def close(to: int) -> None:
        nonlocal aside, marked
        while len(stack) > to:
            name, part, _, _ = stack.pop()
            open_names[name] -= 1
            aside -= part
            marked -= name in ARTICLE
        while blocks and blocks[-1] >= to:
            blocks.pop()

    at = 0
    while True:
        m = ITEM.search(page, at)
        text = page[at: m.start() if m else len(page)]
        if text:
            link = any(e[0] == "a" for e in stack[-4:])
            yield ("aside" if aside else "link" if link else "word"), html.unescape(text), False, marked > 0
        if not m:
            return
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        within = marked > 0 and aside > 0
        if m.group(1):
            if open_names[name] > 0:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                close(to)
            yield "." if within else "</" + name, "", name not in INLINE, marked > 0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "." if within else "<" + name, "", name not in INLINE, marked > 0
            continue
        if name in ENDS_PARAGRAPH and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        opens = name not in VOID and not m.group(3).endswith("/")
        if opens and name in ARTICLE and not found:
            found = True
            for e in stack:
                yield from ((f".{word}", "", False, False) for word in sorted(e[3]))
                if e[2]:
                    e[1] = e[2] = False
                    aside -= 1
        names = names_of(m.group(3)) if opens else set()
        by_name = name in ASIDE and not (name == "header" and marked)
        by_class = bool(names) and not by_name and name not in ("body", "html") and boilerplate(names, layout)
        part = opens and (by_name or by_class)
        yield "." if marked > 0 and (aside or part) else "<" + name, "", name not in INLINE, marked > 0
        if opens:
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append([name, part, by_class, names])
            open_names[name] += 1
            aside += part
            marked += name in ARTICLE


def blocks_of(page: str, layout: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, bool, bool, int]]:
    """The items of a page with the number of words of each; a tag counts as one."""
    for kind, text, breaks, inside in parse(page, layout):
        yield kind, text, breaks, inside, 1 if kind[0] in "<." else len(text.split())


def layout_of(weights: dict[str, float]) -> frozenset[str]:
    """Classes that hold articles, as learn() notes them among the weights."""
    return frozenset(k[1:] for k in weights if k[0] == "." and len(k) > 1)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum, of equal ones the first to end; (0, 0) if none is above 0."""
    best = total = 0.0
    start = first = last = 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


def score(kind: str, inside: bool, n: int, weights: dict[str, float]) -> float:
    """What an item adds: nothing if it stands in boilerplate inside the article."""
    return 0.0 if kind[0] == "." or inside and kind == "aside" else weights.get(kind, weights["<"]) * n


def main_text(page: str | None, weights: dict[str, float], layout: frozenset[str] | None = None) -> str:
    """Text of the best run, empty where nothing scores above 0."""
    if not page:
        return ""
    items = list(blocks_of(page, layout_of(weights) if layout is None else layout))
    first, last = best_run([score(kind, inside, n, weights) for kind, _, _, inside, n in items])
    out: list[str] = []
    block: list[str] = []
    for kind, text, breaks, _, _ in [*items[first:last], ("<", "", True, False, 0)]:
        if breaks:
            joined = SPACE.sub(" ", "".join(block)).strip()
            if joined:
                out.append(joined)
            block = []
        elif kind in ("word", "link"):
            block.append(text)
    return " ".join(out)


def learn(pages: DataFrame, html_col: str = "html", rows: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights of the kinds of items from about `rows` pages that mark their article.

    Without any such page, words score 1, link and boilerplate words -1 and tags -0.5. Kinds seen less than
    five times in these pages have the weight of "<" (the mean tag). Names ".class" are classes that hold articles there.
    """
    labelled = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = labelled.count()
    default = {"word": 1.0, "link": -1.0, "aside": -1.0, "<": -0.5}
    if not n:
        return default
    share = min(1.0, rows / n)
    sample = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for page in b["html"]:
                for kind, _, _, inside, n in blocks_of(page):
                    seen[inside][kind] += n
        kinds = sorted(seen[0].keys() | seen[1].keys())
        if kinds:
            yield pd.DataFrame({"kind": kinds, "outside": [seen[0][k] for k in kinds], "inside": [seen[1][k] for k in kinds]})

    # a row for each tag name and class that the labelled sample, bounded by `rows`, shows often enough
    seen = sample.mapInPandas(count, "kind string, outside long, inside long").where("kind <> '.'").groupBy("kind").agg(
        F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).where(
        "outside + inside >= 5 or (startswith(kind, '.') and outside > 0)").collect()
    table = [r for r in seen if r["kind"][0] != "."]
    inside, outside = (sum(r[k] for r in table) or 1 for k in ("inside", "outside"))
    weights = dict(default) | {r["kind"]: 0.0 for r in seen if r["kind"][0] == "."}
    tags = []
    for r in table:
        w = math.log((r["inside"] + PRIOR) / (inside + PRIOR)) - math.log((r["outside"] + PRIOR) / (outside + PRIOR))
        if r["kind"][0] == "<":
            # a tag never speaks for the article: paragraphs are cheap, what stands outside is dear
            weights[r["kind"]] = min(-0.05, max(-MOST, w))
            tags.append((weights[r["kind"]], r["inside"] + r["outside"]))
        elif r["kind"] == "word":
            weights["word"] = min(MOST, max(0.25, w))
        else:
            weights[r["kind"]] = max(-MOST, min(-0.05 if r["kind"] == "aside" else 0.25, w))
    if tags:
        weights["<"] = sum(w * n for w, n in tags) / sum(n for _, n in tags)
    return weights


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each; null and empty pages and pages without any words have the empty text."""
    if text_col.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"the table has a column {text_col}")

    layout = layout_of(weights)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights, layout) for p in pages], dtype=object)

    return pages.withColumn(text_col, text(F.col(html_col).cast("string")))


def op9_html(spark, folder: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; null and empty pages have the empty text and 0."""
    pages = documents(spark, folder, "pages")
    done = extract(pages.select("page_id", "url", "html"), learn(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

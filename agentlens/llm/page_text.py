"""HTML extraction by a site style tree.

Pages are parsed into blocks, each under its path of elements (name and class).
The trees of one host are merged: a branch of the style tree is a path, and at it
stand the presentations that the host's pages have there (the order of what the
branch's elements hold) and the contents (the blocks' texts). Both are scored by
their entropy over the pages, as a share of the largest that so many pages could
have:

* presentation: 0 if every page arranges the branch alike, 1 if each has its own way;
* content: the mean over the branch's texts of `1 - log k / log n` for a text on k of
  the n pages, so 0 if all have the same and 1 if no text comes twice;
* importance: `1 - (1 - presentation) * (1 - content)`: only what is arranged alike and
  says the same is unimportant, on hosts of any size.

Branches of `LEAST_PAGES` pages or more whose importance is below `LEAST_IMPORTANCE`
are removed from each page, inside articles and outside alike. A repeated paragraph at
a branch that stays, stays too: it is part of the articles that hold it.

A menu or advert whose entries differ on every page repeats no text, but its words:
they come from a vocabulary that doesn't grow with the site, while texts bring new
words on every page. So branches outside articles are scored by their words as well,
as by texts: a word on k of n pages counts `1 - log k / log n`. This falls towards 0
with the number of pages for a fixed vocabulary, and hardly at all for an open one. A
branch goes if its importance by words is below `WORD_SHARE` of the importance of the
host's body, the branch with the most text. Inside articles words
don't count: the headings of a paper repeat, too.

On a host of few pages words tell nothing yet. An element that is a menu or the like
by its name (`nav`, `footer`, class `ad`, `comments`) is outside on every host, and so
is one whose longer name holds such a word, unless over three quarters of the page's
text are in it.

Pages that show one body count once: a page's body is the longest content that it has
at a branch inside an article, or all its text if there is none. So an article doesn't
become boilerplate by being copied.

Of the branches that stay, those inside articles (or main) are the page's content,
unless there is more text around them: then the articles are no more than part of
it (teasers beside the body), and all of it stays.

Style nodes are counted as (host, branch, digest, body), so a host with a third of
all pages is a partial aggregation like any other.

Defined cases: null or empty html has no text; character references are decoded
(also ones without a semicolon, where HTML allows it; a tag ends one); `br` is white space, other
elements within a block part no words; unclosed elements end with their parent; a
tag that the page's end cuts off is left out; repeated pages are extracted each; a
null url is a host of its own; other columns are kept, but for ones named `text`,
`n_chars`, `_host` or `_low`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import table, written
from agentlens.llm.markup import Block, Page, parsed
from agentlens.llm.url_filter import url_host

LEAST_IMPORTANCE, WORD_SHARE, LEAST_PAGES = 0.25, 0.8, 8
#: Removed branches up to this number are broadcast (under 200 bytes each); more join by host.
BROADCAST_BRANCHES = 50_000
STYLE, TEXT, PAGE, WORD, SIZE = 0, 1, 2, 3, 4


def digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def shown(page: Page) -> list[Block]:
    """The blocks that names leave."""
    return [b for b in page.blocks if not b.outside]


def kept_blocks(page: Page, low: frozenset[str] = frozenset()) -> list[Block]:
    """The blocks at other branches than `low`; only the articles', unless there is more text around them."""
    kept = [b for b in shown(page) if b.path not in low]
    inside = [b for b in kept if b.content]
    return inside if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in kept) else kept


def style_nodes(page: Page) -> list[tuple[str, int, int, int]]:
    """(branch, kind, node, body): the page's branches with text, their styles, texts and (outside articles) words by digest, and how much text they hold."""
    at: dict[str, list[str]] = {}
    for b in shown(page):
        at.setdefault(b.path, []).append(b.text)
    inside = {b.path for b in page.blocks if b.content and not b.outside}
    joined = max(("\n".join(at[path]) for path in inside), key=lambda t: (len(t), t), default=None)
    body = digest(*(b.text for b in shown(page) or page.blocks)) if joined is None else digest("", joined)
    paths = {b.path for b in page.blocks}
    nodes = {(path, PAGE, 0, body) for path in paths} | {(path, STYLE, digest(*page.styles.get(path, ())), body) for path in paths}
    nodes |= {(path, SIZE, sum(map(len, texts)), body) for path, texts in at.items()}
    nodes |= {(path, WORD, digest(path, word), body) for path, word in {(b.path, w) for b in page.blocks if not b.content for w in b.text.lower().split()}}
    return sorted(nodes | {(b.path, TEXT, digest(b.path, b.text), body) for b in page.blocks})


def merged_nodes(pages: DataFrame, html: str) -> DataFrame:
    """(_host, branch, kind, node, body) for each page and node."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *node) for host, page in zip(batch["_host"], batch[html]) for node in style_nodes(parsed(page or ""))]
            yield pd.DataFrame(rows, columns=["_host", "branch", "kind", "node", "body"])

    return pages.select("_host", html).mapInPandas(nodes, "_host string, branch string, kind int, node bigint, body bigint")


def node_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(_host, branch, kind, node, k): on how many of a host's bodies a node stands."""
    return merged_nodes(pages, html).distinct().groupBy("_host", "branch", "kind", "node").agg(F.count("*").alias("k"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """(_host, branch, n_pages, styles, size, presentation, content, importance, by_words) of `node_counts`; by_words is null inside articles."""
    k, kind = F.col("k"), F.col("kind")
    of = lambda what, value: F.when(kind == what, value)
    sums = nodes.groupBy("_host", "branch").agg(
        F.max(of(PAGE, k)).alias("n_pages"),
        F.count(of(STYLE, 1)).alias("styles"), F.sum(of(STYLE, k)).alias("_n"), F.sum(of(STYLE, k * F.log(k))).alias("_s"),
        F.coalesce(F.avg(of(TEXT, F.log(k))), F.lit(0.0)).alias("_t"), F.avg(of(WORD, F.log(k))).alias("_w"),
        F.coalesce(F.sum(of(SIZE, F.col("node") * k)), F.lit(0)).alias("size"),
    )
    n, pages = F.col("_n"), F.col("n_pages")
    spread = F.when(n > 1, 1 - F.col("_s") / (n * F.log(n))).otherwise(F.lit(1.0))
    own = lambda mean: F.when(pages > 1, 1 - F.col(mean) / F.log(pages)).otherwise(F.lit(1.0))
    importance = lambda mean: 1 - (1 - spread) * (1 - own(mean))
    by_words = F.when(F.col("_w").isNotNull(), importance("_w"))
    return sums.select("_host", "branch", "n_pages", "styles", "size", spread.alias("presentation"), own("_t").alias("content"), importance("_t").alias("importance"), by_words.alias("by_words"))


def low_branches(tree: DataFrame) -> DataFrame:
    """(_host, branch) of the branches that the tree removes."""
    known = tree.filter(F.col("n_pages") >= LEAST_PAGES)
    repeated = F.col("importance") < LEAST_IMPORTANCE
    bodies = known.filter(~repeated).groupBy("_host").agg(F.max(F.struct("size", "branch", F.coalesce("by_words", "importance").alias("of_body")))["of_body"].alias("of_body"))
    return known.join(bodies, "_host", "left").filter(repeated | (F.col("by_words") < WORD_SHARE * F.col("of_body"))).select("_host", "branch")


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with text (empty if none) and n_chars."""
    rows = pages.drop("text", "n_chars", "_host", "_low").withColumn("_host", url_host(F.col(url)))
    tree = written(style_tree(node_counts(rows, html)))
    low = low_branches(tree).groupBy("_host").agg(F.collect_set("branch").alias("_low"))
    low = written(low)  # so that the pages are parsed once for the tree and once for their text, and a hot host's pages can be split
    few = low.agg(F.coalesce(F.sum(F.size("_low")), F.lit(0))).first()[0] <= BROADCAST_BRANCHES
    joined = rows.join(F.broadcast(low) if few else low, "_host", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = ["\n\n".join(b.text for b in kept_blocks(parsed(page or ""), frozenset(() if low is None else low))) for page, low in zip(batch[html], batch["_low"])]
            rest = batch.drop(columns=[html, "_low"])
            rest["text"] = out
            rest["n_chars"] = [len(t) for t in out]
            yield rest

    kept = [f for f in joined.schema if f.name not in (html, "_low", "_host")]
    ordered = joined.select(*[f.name for f in kept], html, "_low")
    return ordered.mapInPandas(texts, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "text string", "n_chars bigint"]))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

"""HTML extraction by equivalence classes of tokens across the pages of a host.

A token is an element's opening tag in its role (its path of enclosing elements, with classes and ids) or a block of
text in its place. Tokens of one host that occur equally often on every page share an occurrence vector and form a
class. Vectors are compared by order-free digests that Spark sums up by host and token, so no host is ever gathered.
Classes that stand on nearly all pages are the host's template: its elements that stand once a page are its slots, and
the text of classes of two tokens or more is deducted, but for headings, paragraphs, list items and table cells: these
are text wherever they stand, and an article may share them with others. On a page the template's text is what stands there in the template's order.
The slot that holds the article is the innermost template element with all of the host's text that is not
menus, notices, template and the like; what stands in it on each page is extracted.
"""

import hashlib
import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

# HTML elements by what they mean for text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr math semantics annotation mrow mi mn mo ms mtext mspace mfrac "
    "msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable "
    "mtr mtd".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th hr option col thead tbody tfoot caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style noscript template iframe svg canvas object audio video nav footer aside form "
    "button select textarea dialog menu datalist".split()
)
MAIN = frozenset("article main".split())
#: Never hidden by their names.
KEPT = MAIN | {"html", "body"}
# Words of classes, ids and roles that name what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended comment comments reply replies "
    "disqus respond pagination pager widget toolbar login search complementary contentinfo".split()
)
OUTER_NAMES = frozenset("header masthead topbar".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
# Words that a class may add to these without naming something else.
PLACES = frozenset(
    "site main top bottom left right primary secondary global bar box block section inner list links item items "
    "button buttons icons".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template)\b.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"(?<![A-Za-z0-9])([a-z]+)[0-9]*(?![A-Za-z0-9])|(?<![A-Za-z0-9])[a-z][a-z0-9]+", re.I)

#: Shares of a host's pages that meet its template apart from each other.
SALTS = 32

#: A template's classes stand on this share of a host's pages, blank ones left out, and have this many tokens.
FREQUENT = 0.9
CLASS_LEAST = 2
#: On fewer pages no text is taken for a template's.
PAGES_LEAST = 3

TOKENS = "host string, page long, path string, text long, depth int, n int, chars long, at int, main boolean"


def _names(token: str, names: frozenset) -> bool:
    """Whether a class, id or role says nothing but one of ``names``: each of its words does, or tells where it is."""
    words = {found[1] or found[0] for found in _WORD.finditer(token.lower())}
    return bool(words & names) and words <= names | PLACES


def _opened(tag: str, attributes: str, inside: bool) -> tuple[str, bool, str | None]:
    """An element's name in paths, whether its tag tells that what it holds is not the article's, and whether its names
    do: ``comments`` or ``other``."""
    names = _NAMED.findall(attributes) if "=" in attributes else ()
    role = tag + "".join("." + " ".join(sorted(set((a or b or c).split()))) for _, a, b, c in names)
    hidden = tag in HIDDEN or not inside and tag == "header"
    said = [t for _, a, b, c in names for t in (a or b or c).split()] if tag not in KEPT else []
    of = NAMES if inside else NAMES | OUTER_NAMES
    named = [t for t in said if _names(t, of)]
    return role, hidden, ("comments" if any(_names(t, COMMENTS) for t in named) else "other") if named else None


def _hidden(elements: list[list], texts: list[tuple]) -> list[bool]:
    """For each of ``(parent, tag, hidden by tag, named)`` whether what it holds is not the article's.

    Names hide no element that holds an article or main element with text, nor one with most of the page's text, unless it is
    reader comments; and none if nothing would be left.
    """
    by_tag, chars, mains = [], [0] * len(elements), [False] * len(elements)
    for parent, _, off, _ in elements:
        by_tag.append(off or parent >= 0 and by_tag[parent])
    total = 0
    for element, text in texts:
        if element < 0:
            total += len(text)
        elif not by_tag[element]:
            total += len(text)
            chars[element] += len(text)
    for i in range(len(elements) - 1, -1, -1):
        parent, tag, _, _ = elements[i]
        if parent >= 0:
            chars[parent] += chars[i]
            mains[parent] |= mains[i] or tag in MAIN and chars[i] > 0
    out: list[bool] = []
    for i, (parent, _, _, named) in enumerate(elements):
        off = named is not None and not mains[i] and (named == "comments" or 2 * chars[i] <= total)
        out.append(by_tag[i] or off or parent >= 0 and out[parent])
    return out if any(element < 0 or not out[element] for element, _ in texts) else by_tag


def blocks(page: str):
    """``(path, depth, hidden, text, leaf)`` of elements as they open, with no text, and of blocks of text, in page order.

    The path has the enclosing elements; inline elements and those that end by themselves are not part of it. ``leaf``
    tells blocks of the latter: headings, paragraphs, list items, table cells and the like.
    """
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, element, inside the article
    elements: list[list] = []
    events: list[tuple] = []  # path, depth, element, text, in a leaf
    pieces: list[str] = []
    at, leaf = 0, False

    def flush():
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            _, path, element, _ = stack[-1] if stack else ("", "", -1, False)
            events.append((path, len(stack), element, text, leaf))

    for found in _TOKEN.finditer(page):
        if found.start() > at:
            pieces.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = (found[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        flush()
        if tag in LEAF or tag in VOID:
            leaf = not found[2] if tag in LEAF else leaf
            continue
        leaf = False
        if found[2]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                k -= 1
            if k >= 0:
                del stack[k:]
            continue
        _, path, parent, inside = stack[-1] if stack else ("", "", -1, False)
        role, off, named = _opened(tag, found[4], inside)
        elements.append([parent, tag, off, named])
        stack.append((tag, f"{path}/{role}", len(elements) - 1, inside or tag in MAIN))
        events.append((stack[-1][1], len(stack), len(elements) - 1, None, False))
        if found[4].endswith("/") and tag not in MAIN:
            stack.pop()
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    hidden = _hidden(elements, [(element, text) for _, _, element, text, _ in events if text is not None])
    for path, depth, element, text, inner in events:
        yield path, depth, element >= 0 and hidden[element], text, inner


def _is_main(path: str) -> bool:
    return re.match(r"[a-z0-9:-]*", path.rpartition("/")[2])[0] in MAIN


def _text_token(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _counted(page: str) -> dict:
    """For each ``(path, text)`` on the page that is not hidden: its depth, how often it stands there, how much text
    it holds, and after how many blocks of text it comes first. Elements have no text, blocks of text a digest; blocks in
    leaves are no template's and only count."""
    seen: dict[tuple, list] = {}
    at = 0
    for path, depth, hidden, text, leaf in blocks(page):
        if hidden:
            continue
        if text is None:
            seen.setdefault((path, None), [depth, 0, 0, at])[1] += 1
        else:
            if not leaf:
                token = seen.setdefault((path, _text_token(path, text)), [depth, 0, 0, at])
                token[1] += 1
                token[2] += len(text)
            at += 1
            while path:
                if (path, None) in seen:
                    seen[path, None][2] += len(text)
                path = path.rpartition("/")[0]
    return seen


def _tokens(batches):
    for batch in batches:
        out = []
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
            for (path, token), (depth, n, chars, at) in _counted(text or "").items():
                out.append((host, page, path, token, depth, n, chars, at, token is None and _is_main(path)))
        columns = list(zip(*out)) or [()] * 9
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 2, pa.int64(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["host", "page", "path", "text", "depth", "n", "chars", "at", "main"],
        )


def _in_order(places: list[int]) -> set[int]:
    """The members of a longest increasing run through ``places``."""
    tails, ends, before = [], [], {}
    for place in places:
        k = bisect_left(tails, place)
        before[place] = ends[k - 1] if k else None
        tails[k:k + 1], ends[k:k + 1] = [place], [place]
    run, at = set(), ends[-1] if ends else None
    while at is not None:
        run.add(at)
        at = before[at]
    return run


def article(page: str, template: str | None, fixed: list[int] | None = None) -> str:
    """The blocks in the template's slot less its text tokens ``fixed``; on a page without that element, in its own
    article or all that is shown. A page with none but template text is all there is to tell, and keeps it."""
    shown = [(path, text, leaf) for path, _, hidden, text, leaf in blocks(page) if not hidden]
    opened = {path for path, text, _ in shown if text is None}
    under = lambda path, top: path == top or path.startswith(top + "/")
    if template in opened:
        tops = [template]
    else:
        mains = sorted((p for p in opened if _is_main(p)), key=lambda p: p.count("/"))
        tops = [p for i, p in enumerate(mains) if not any(under(p, q) for q in mains[:i])] or [""]
    token_of = lambda path, text, leaf: None if leaf or not fixed else _text_token(path, text)
    said = [(token_of(path, text, leaf), path, text) for path, text, leaf in shown if text is not None]
    place = {token: i for i, token in enumerate(fixed or ())}
    run = _in_order([place[token] for token in dict.fromkeys(token for token, _, _ in said) if token in place])
    held = [(token, text) for token, path, text in said if any(under(path, top) for top in tops)]
    own = [text for token, text in held if place.get(token) not in run]
    return "\n".join(own or [text for _, text in held])


def _texts(batches):
    for batch in batches:
        out = [article(text or "", top, fixed) for text, top, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "top", "fixed")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"]
        )


def _named(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        url.alias("url"),
        F.col(html_col).cast("string").alias("html"),
        host.alias("host"),
        F.xxhash64(F.col(id_col), url).alias("page"),
    )


def equivalence_classes(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(host, path, text, depth, chars, main, support, most, least, at, vector, pages, size, outer)``: tokens with
    their classes.

    ``text`` is null for elements. Tokens of a host with equal ``vector`` and ``support`` are one class of ``size``
    tokens. ``outer`` marks elements that stand once a page on ``FREQUENT`` of the host's ``pages``, blank ones left
    out; ``main`` article and main elements. Blocks of text on fewer pages, or fewer than ``PAGES_LEAST``, are left out.
    """
    named = _named(pages, id_col, url_col, html_col).select("host", "page", "html")
    tokens = named.mapInArrow(_tokens, TOKENS).groupBy("host", "path", "text").agg(
        F.first("depth").alias("depth"),
        F.first("main").alias("main"),
        F.sum("chars").alias("chars"),
        F.count("*").alias("support"),
        F.max("n").alias("most"),
        F.min("n").alias("least"),
        F.avg("at").alias("at"),
        # a sum, as repeated rows would undo each other in bit_xor
        F.try_sum(F.shiftright(F.xxhash64("page", "n"), 20)).alias("vector"),
    )
    # nearly all blocks of text stand on one page; a host's are not gathered
    tokens = tokens.where(F.col("text").isNull() | (F.col("support") >= PAGES_LEAST))
    held = named.where(F.col("html").rlike(r"\S")).groupBy("host").agg(F.count("*").alias("pages"))
    tokens = tokens.join(held, "host")
    frequent = F.col("support") >= F.col("pages") * FREQUENT
    tokens = tokens.where(F.col("text").isNull() | frequent)
    size = F.count("*").over(Window.partitionBy("host", "vector", "support"))
    outer = F.col("text").isNull() & frequent & (F.col("most") == 1)
    return tokens.select("*", size.alias("size"), outer.alias("outer"))


def templates(classes: DataFrame) -> DataFrame:
    """``(host, top, fixed)``: the element of each host's template whose slot holds the article, and the text tokens
    of the template in their order on pages.

    The article or main element with the most text if there is one, else the innermost element that holds
    all of the text. Text of the template does not count, unless the host has no other.
    """
    fixed = classes.where(F.col("text").isNotNull() & (F.col("size") >= CLASS_LEAST) & (F.col("most") == F.col("least")))
    order = F.array_sort(F.collect_list(F.struct("at", "text")))
    tokens = fixed.groupBy("host").agg(F.transform(order, lambda t: t["text"]).alias("fixed"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    deducted = fixed.select("host", F.explode(above).alias("path"), F.col("chars").alias("gone"))
    deducted = deducted.groupBy("host", "path").agg(F.sum("gone").alias("gone"))
    outer = classes.where("outer").join(deducted, ["host", "path"], "left")
    outer = outer.withColumn("own", F.col("chars") - F.coalesce("gone", F.lit(0)))
    most = outer.groupBy("host").agg(F.max("own").alias("all_own"), F.max("chars").alias("all_chars"))
    left = F.col("all_own") > 0
    outer = outer.join(most, "host").withColumn("held", F.when(left, F.col("own")).otherwise(F.col("chars")))
    outer = outer.withColumn("all", F.when(left, F.col("all_own")).otherwise(F.col("all_chars")))
    fit = F.col("main") & (F.col("held") > 0)
    order = F.struct(
        fit.alias("fit"),
        F.when(fit, F.col("held")).otherwise((F.col("held") == F.col("all")).cast("long")).alias("worth"),
        F.when(fit, -F.col("depth")).otherwise(F.col("depth")).alias("depth"),
        F.col("path"),
    )
    return outer.groupBy("host").agg(F.max_by("path", order).alias("top")).join(tokens, "host", "full")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages``: its article's blocks, joined by newlines.

    A block's character references are decoded and its white space is one space each, trimmed. Left out are
    elements that are menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles
    or reader comments by their tag, class, id or role, and whole blocks of text that the host's pages share as their
    template. Headings, paragraphs, list items and table cells of the article stay, however many pages have them.

    Null and empty pages have an empty text. Rows without a url, or whose url has no host, are one host. Repeated
    rows give a result row each. A host of one page is its own template. Of other columns none is read.
    """
    top = templates(equivalence_classes(pages, id_col, url_col, html_col))
    # a host with a third of the pages is dealt out over SALTS tasks
    top = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = _named(pages, id_col, url_col, html_col).withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    rows = rows.join(top, ["host", "salt"], "left")
    kind = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "url", "html", "top", "fixed").mapInArrow(_texts, f"page_id {kind}, url string, text string")

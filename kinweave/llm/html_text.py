"""HTML extraction by equivalence-class template deduction.

A page is a list of tokens: element paths and texts at a path.  Over the pages of
a host every token has an occurrence vector (how often it stands in each page).
Tokens that share their vector form a class; classes of enough tokens and pages
are valid, and nest along the paths into the host's template (the approach of
Arasu and Garcia-Molina, SIGMOD 2003).  What is left are slots; the main text is
the slots of the content root, without those of menus, adverts and the like.

Vectors are never built: their sums of hashes per page decide about equality, so
a host of any size is one aggregation with partial sums in each task.  Equal pages
of a host count once.  An element is named by a hash of its parent's name and its
own label, so that pages of any depth are read in linear time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.url_filter import host_of
from kinweave.session import settle, ship_functions

ship_functions(__name__)

#: A class is valid from this many tokens, standing in this share of the host's pages.
MIN_TOKENS, MIN_SHARE = 2, 0.5
#: Share of a host's text that its content root holds at least.
ROOT_SHARE = 0.9
#: Pages of a host from which a repeated text counts as template, and the pages and their share that it takes inside an article.
MIN_PAGES, MIN_PAGES_INSIDE, MIN_SHARE_INSIDE = 3, 5, 0.9
#: Share of a page's text that its articles must hold to be its content.
HINT_SHARE = 0.5
#: Share of the largest article's text below which another article of the page is a teaser.
TEASER_SHARE = 0.25

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"\d+")
# Elements by their part in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template".split())
RAW = set("script style textarea title iframe noframes noembed xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike "
             "strong sub sup time tt u var wbr".split())
CONTAINER = set("body main article section div td center".split())
ENDS_OF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article section div main body html blockquote".split())
# What is not main text, by element, role, and name or beginning of a class or id.
BOILERPLATE = set("head nav header footer aside form button select script style noscript iframe template svg dialog menu textarea "
                  "title object canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
NAMES = set("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
            "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
            "promo promotion recommended related replies reply respond share sharing sidebar social sponsor sponsored "
            "subscribe toolbar topbar widget widgets".split())
STARTS = tuple("ad- ad_ ads- ads_ advert banner- comment- comments- comment_ comments_ cookie consent- footer- menu- nav- navbar- "
               "newsletter page-header page-footer promo- related- reader-comment share- sidebar side-bar site-header site-footer "
               "site-nav social- sponsor widget- user-comment".split())


# Beginnings of names that also mark boilerplate inside an article.
INSIDE = tuple("ad- ad_ ads- ads_ advert comment- comments- comment_ comments_ cookie newsletter promo- related- reader-comment share- "
               "sponsor user-comment".split())
#: Not boilerplate; in a form only; boilerplate.
MAIN, FORM, OFF = 0, 1, 2


def _is_boilerplate(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in BOILERPLATE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return bool(attributes) and name == "article" and any(c.startswith("comment") for c in attributes.get("class", "").lower().split())
    if attributes.get("role", "").lower() in ROLES:
        return True
    names = attributes.get("class", "").lower().split()
    if inside:  # an id there is often that of a heading or a term
        return any(c in NAMES or c.startswith(INSIDE) for c in names)
    return any(c in NAMES or c.startswith(STARTS) for c in [*names, *attributes.get("id", "").lower().split()])


def step(parent: int, label: str) -> int:
    """The name of an element: a hash of its parent's name and its label."""
    return xxhash.xxh64_intdigest(label, parent)


def text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, path ^ 1)


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


class Page:
    """The blocks of a page: (element, text, MAIN or OFF, number of its article or 0, in `main`), and its elements.

    `nodes` has for each element name [times, depth, is a container, parent], parents first.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str, int, int, bool]] = []
        self.nodes: dict[int, list[int]] = {}
        # Of each open element: name, hash, off, article, in main, place of the nearest block element.
        stack: list[tuple[str, int, int, int, bool, int]] = [("", 0, MAIN, 0, False, 0)]
        places: dict[str, list[int]] = {}  # open elements of a name
        scopes: list[int] = [0]
        articles = 0
        text: list[str] = []
        home: tuple[int, int, int, bool] | None = None

        def flush() -> None:
            nonlocal home
            if text:
                found = "".join(text)
                found = " ".join((html.unescape(found) if "&" in found else found).split())
                if found and home is not None:
                    self.blocks.append((home[0], found, *home[1:]))
                text.clear()
            home = None

        def add(raw: str) -> None:
            nonlocal home
            if raw:
                top = stack[-1]
                here = stack[top[5]]
                if home is not None and (home[0] != here[1] or home[1] != top[2]):
                    flush()
                if home is None:
                    home = (here[1], top[2], here[3], here[4])
                text.append(raw)

        def cut(k: int) -> None:
            for name, *_ in stack[k:]:
                places[name].pop()
                if name in SCOPE:
                    scopes.pop()
            del stack[k:]

        source = source or ""
        at = 0
        while True:
            begin = source.find("<", at)
            if begin < 0:
                add(source[at:])
                break
            tag = TAG.match(source, begin)
            if tag is None:  # a plain character
                add(source[at: begin + 1])
                at = begin + 1
                continue
            add(source[at:begin])
            at = tag.end()
            name = (tag["name"] or tag["name2"] or "").lower()
            if not name:
                continue
            if tag["close"] or tag["close2"]:
                if places.get(name):
                    k = places[name][-1]
                    if any(e[0] not in INLINE or e[2] for e in stack[k:]):
                        flush()
                    cut(k)
                continue
            if name == "br":
                add(" ")
                continue
            if name in HIDDEN:  # no block ends here
                at = self._past(source, name, at)
                continue
            if name not in INLINE:
                flush()
                ended = ENDS_OF.get(name)
                while ended:  # an open element of the kind ends here
                    k = max((places[e][-1] for e in ended if places.get(e)), default=0)
                    if k <= scopes[-1]:
                        break
                    cut(k)
                    if name != "tr" or stack[-1][0] != "tr":
                        break
            if name in VOID:
                continue
            rest = tag["rest"] or tag["rest2"] or ""
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if "=" in rest else {}
            label = name
            if attributes:
                label += DIGITS.sub("0", "".join(f".{c}" for c in attributes.get("class", "").split()[:2]) + (
                    f"#{attributes['id']}" if attributes.get("id") else ""))
            parent = stack[-1]
            path = step(parent[1], label)
            off = parent[2]
            if off != OFF and _is_boilerplate(name, attributes, parent[3] > 0):
                off = FORM if name == "form" else OFF
            if name == "article" and not parent[3]:
                articles += 1
            article = parent[3] or (articles if name == "article" else 0)
            if off != parent[2]:
                flush()
            node = self.nodes.setdefault(path, [0, len(stack), int(name in CONTAINER), parent[1]])
            node[0] += 1
            if name in RAW:
                at = self._past(source, name, at)
                continue
            if not rest.endswith("/") or name not in ("svg", "path", "use"):
                places.setdefault(name, []).append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
                stack.append((name, path, off, article, parent[4] or name == "main", parent[5] if name in INLINE else len(stack)))
        flush()
        # A form that holds most of the page is a wrapper.
        sizes = [sum(len(b[1]) for b in self.blocks if b[2] == k) for k in (MAIN, FORM)]
        form = MAIN if sizes[1] > sizes[0] else OFF
        self.blocks = [(*b[:2], form if b[2] == FORM else b[2], *b[3:]) for b in self.blocks]

    @staticmethod
    def _past(source: str, name: str, at: int) -> int:
        """The place after the end tag of an element whose content is not markup."""
        end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(source, at)
        return len(source) if end is None else end.end()


def _page_tokens(source: str | None) -> list[dict]:
    """The tokens of a page: (token, times, depth, container, characters of main text below it)."""
    page = Page(source)
    below = dict.fromkeys(page.nodes, 0)
    texts: dict[int, int] = {}
    total = 0
    for path, text, off, *_ in page.blocks:
        token = text_token(path, text)
        texts[token] = texts.get(token, 0) + 1
        if off == MAIN:
            total += len(text)
            if path in below:
                below[path] += len(text)
    for path in reversed(page.nodes):  # children come after their parents
        parent = page.nodes[path][3]
        if parent in below:
            below[parent] += below[path]
    out = [{"token": 0, "n": 1, "depth": 0, "container": 0, "chars": total}]
    out += [{"token": _signed(p), "n": n, "depth": d, "container": c, "chars": below[p]} for p, (n, d, c, _) in page.nodes.items()]
    out += [{"token": _signed(t), "n": n, "depth": -1, "container": 0, "chars": 0} for t, n in texts.items()]
    return out


TOKENS = "array<struct<token:long,n:int,depth:int,container:int,chars:long>>"
ARROW_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("depth", pa.int32()),
                                   ("container", pa.int32()), ("chars", pa.int64())]))


def templates(pages: DataFrame, url: str = "url", source: str = "html", min_tokens: int = MIN_TOKENS,
              min_share: float = MIN_SHARE, root_share: float = ROOT_SHARE) -> DataFrame:
    """One row per host: _kw_host, pages, tokens (of valid classes), inside (those frequent enough to go from an article), root.

    `pages` counts different pages; `root` is the token of the content root or null.
    """

    @F.arrow_udf(TOKENS)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_page_tokens(x.as_py()) for x in batch], ARROW_TOKENS)

    key = F.xxhash64(F.col(source))
    rows = pages.select(host_of(F.col(url)).alias("_kw_host"), key.alias("_kw_page"), cut(F.col(source)).alias("_kw_t"))
    rows = rows.select("_kw_host", "_kw_page", F.explode("_kw_t").alias("t")).select("_kw_host", "_kw_page", "t.*")
    part = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), "_kw_page", "n"), F.lit(1 << 30)))
    # Equal pages meet here, after their tokens were counted in each task; one row per different page and token is left.
    rows = rows.groupBy("_kw_host", "token", "_kw_page").agg(
        *[F.max(c).alias(c) for c in ("n", "depth", "container", "chars")])
    seen = rows.groupBy("_kw_host", "token").agg(
        F.count(F.lit(1)).alias("pages"), part(1).alias("a"), part(2).alias("b"), F.max("depth").alias("depth"),
        F.max("container").alias("container"), F.sum("chars").alias("chars"))
    seen = settle(seen.where((F.col("pages") > 1) | (F.col("depth") >= 0)))
    whole = seen.where((F.col("token") == 0) & (F.col("depth") == 0)).select(
        "_kw_host", F.col("pages").alias("host_pages"), F.col("chars").alias("host_chars"))
    frequent = seen.join(whole, "_kw_host").where(F.col("pages") >= min_share * F.col("host_pages"))
    classes = frequent.groupBy("_kw_host", "pages", "a", "b").agg(
        F.collect_list("token").alias("tokens"),  # at most 1 / min_share times the tokens of a page
        F.max(F.when((F.col("container") == 1) & (F.col("chars") >= root_share * F.col("host_chars")) & (F.col("host_chars") > 0),
                     F.struct("depth", "token"))).alias("root"),
        F.max("host_pages").alias("host_pages"))
    valid = classes.where(F.size("tokens") >= min_tokens)
    often = (F.col("pages") >= MIN_SHARE_INSIDE * F.col("host_pages")) & (F.col("host_pages") >= MIN_PAGES_INSIDE)
    return valid.groupBy("_kw_host").agg(
        F.max("host_pages").alias("pages"), F.flatten(F.collect_list("tokens")).alias("tokens"),
        F.flatten(F.collect_list(F.when(often, F.col("tokens")))).alias("inside"), F.max("root")["token"].alias("root"))


def main_blocks(source: str | None, pages: int, template: set[int], inside: set[int], root: int | None) -> list[str]:
    """The blocks of main text of a page, given its host's template.

    Texts of the template go, and what stands outside the host's content root.
    Of the rest, the page's articles are the content if they hold most of it, else
    its one `main`; small articles beside a large one are teasers.
    """
    page = Page(source)
    blocks = [b for b in page.blocks if b[2] == MAIN]
    if inside:
        blocks = [b for b in blocks if not b[3] or _signed(text_token(b[0], b[1])) not in inside]
    below: set[int] = set()
    if root is not None:
        for path, (_, _, _, parent) in page.nodes.items():
            if _signed(path) == root or parent in below:
                below.add(path)
    rest = [b for b in blocks if b[0] in below] or blocks
    if pages >= MIN_PAGES:
        rest = [b for b in rest if b[3] or b[4] or _signed(text_token(b[0], b[1])) not in template]
    sizes: dict[int, int] = {}
    for b in blocks:
        sizes[b[3]] = sizes.get(b[3], 0) + len(b[1])
    largest = max((n for k, n in sizes.items() if k), default=0)
    chosen = {k for k, n in sizes.items() if k and n >= TEASER_SHARE * largest}
    held = sum(sizes[k] for k in chosen)
    if chosen and held >= HINT_SHARE * (held + sum(len(b[1]) for b in rest if not b[3])):
        return [b[1] for b in blocks if b[3] in chosen]
    return [b[1] for b in blocks if b[4]] or [b[1] for b in rest]


def extract(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """`pages` with main_text: the slots of main text of every whole page, one block per line.

    The content root is the deepest container that holds nearly all text on the
    host's pages; texts that stand at one place on most pages are template.
    Articles narrow it down where they hold most of a page's text, else `main`;
    they lose what nearly all pages of the host repeat, menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments.  A form around most of
    a page is a wrapper.  Pages of any length and depth take time in proportion
    to their length.  Null and empty pages give an empty text;
    pages without a host form one host; repeated rows stay; a column of `pages`
    named main_text is replaced; an empty table gives an empty one.
    """
    pages = pages.drop("main_text")
    known = settle(templates(pages, url, source).withColumnRenamed("pages", "_kw_pages").withColumnRenamed(
        "tokens", "_kw_tokens").withColumnRenamed("inside", "_kw_inside").withColumnRenamed("root", "_kw_root"))

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sets: dict[str, tuple[set[int], set[int]]] = {}
        for sources, hosts, counts, tokens, often, roots in batches:
            out = []
            for i in range(len(sources)):
                host = hosts[i].as_py()
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = set(tokens[i].as_py() or ()), set(often[i].as_py() or ())
                out.append("\n".join(main_blocks(sources[i].as_py(), counts[i].as_py() or 0, *sets[host], roots[i].as_py())))
            yield pa.array(out, pa.string())

    named = pages.withColumn("_kw_h", host_of(F.col(url)))
    joined = named.join(known, named["_kw_h"] == known["_kw_host"], "left")
    return joined.select(*[named[c] for c in pages.columns], run(
        F.col(source), F.col("_kw_h"), F.col("_kw_pages"), F.col("_kw_tokens"), F.col("_kw_inside"), F.col("_kw_root")).alias("main_text"))

"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one reference page of it (the one whose length is nearest to the host's
median) by simple tree matching: two nodes match if their labels are equal, and the ordered children are
matched for the greatest total, where children with equal text count extra. A text node of the reference
that stands with the same text in at least `CONSTANT` of the host's pages is template; what varies is
content. Pages with the same content count once, so copies of an article don't turn it into template, and
a host needs `MIN_PAGES` different pages; with fewer, only the rules below apply.

Before that, elements that are never article text are cut off: scripts, styles, navigation, headers,
footers, sidebars, forms, and elements whose class, id or role says notice, advert, comments and the like.
The text is taken from every outermost `<article>`, or from the `<main>` around it (so that a heading or lead
beside the article stays) but for its blocks outside the article that are mostly links; without articles from
the largest `<main>`; otherwise from all of the body but blocks that are mostly links. Class and id names are
judged whole: `has-sidebar`, `related-work` or `notice-period` are no noise. Character references are decoded, white space inside a block
becomes one space, blocks are joined by one space in page order.

Edge cases: a null or empty page has an empty text; markup that isn't closed or doesn't nest is read as
browsers do in the main (a new block closes an open paragraph, unmatched end tags are skipped); elements
nested deeper than `DEPTH` are hung there; child lists too long for the matching table are matched
row by row (Hirschberg) after equal ends are paired; a reference page may have any length; pages without a host form one group; repeated rows get equal texts; an empty table gives no
rows; input columns named like an output column are replaced.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, materialise, raw_texts, slices
from .urls import host_of

MIN_PAGES = 5
CONSTANT = 0.9
DEPTH = 150
MAX_REFERENCE = 64_000       # characters of a reference that may be broadcast; longer ones are joined by a shuffle
SALTS = 64                   # parts that the pages of a host with a longer one are dealt to
MAX_CELLS = 1 << 20          # of a matching table that is kept whole
REMEMBERED = 500_000         # weights of subtree pairs a task remembers

# Fixed values of HTML: element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
               "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "html", "body", "div", "article", "section", "main"}
NEVER = set("head script style noscript template nav footer aside form button select input textarea iframe svg "
            "canvas object embed menu dialog audio video map title xmp noembed noframes".split())
NOISE = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads advert "
            "adverts advertisement adsense banner promo promotion sponsor sponsored notice notices alert cookie cookies "
            "consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related "
            "recommended comment comments reply replies disqus respond login signup widget pagination pager toolbar "
            "search skip byline".split())
# Words that name the place or build of a block in class and id names (`site-footer`, `ad-slot`).
PLACES = set("site page main global primary secondary top bottom left right inner outer list bar box block area item "
             "items link links container wrapper wrap slot section panel inline unit content toggle button post posts "
             "article articles stories js".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form",
         "menu", "menubar", "toolbar"}
KEPT = {"html", "body", "main", "article"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                       re.I)
HEADING = re.compile("h[1-6]")
END_OF = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}


def noisy_name(names: str) -> bool:
    """Whether a class or id says that an element is no article text: noise words make up one of its names, alone
    or with words of place (`cookie-banner`, `site-footer`; not `has-sidebar` or `notice-period`)."""
    for name in names.split():
        words = {w for w in re.split("[^a-z]+", name) if len(w) > 1}
        if words & NOISE and words <= NOISE | PLACES:
            return True
    return False


class Text:
    __slots__ = ("text", "hash")
    kids = ()

    def __init__(self, text: str):
        self.text = text
        self.hash = hash(" ".join(text.split()))


class Element:
    __slots__ = ("tag", "label", "kids", "noise", "depth", "shape", "hash", "texts")

    def __init__(self, tag: str, attributes: str, depth: int):
        self.tag, self.label, self.kids, self.depth = tag, tag, [], depth
        self.noise = tag in NEVER
        for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            value, name = "".join(values).lower(), name.lower()
            if name == "class":
                self.label = tag + "." + ".".join(sorted(set(re.split("[^a-z]+", value)) - {""}))
            if tag not in KEPT and (name == "hidden" or name == "role" and value.strip() in ROLES
                                    or name in ("class", "id") and noisy_name(value)):
                self.noise = True


def parse(page: str) -> Element:
    """Element tree of a page."""
    root = Element("#root", "", 0)
    stack, at, last = [root], 0, page.rfind(">")

    def add_text(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        stack[-1].kids.append(Text(text))

    while at < len(page):
        m = TOKEN.search(page, at) if at <= last or page.startswith("<!--", at) else None
        if m is None:
            comment = page.find("<!--", at)
            add_text(page[at:comment if comment >= 0 else len(page)])
            break
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            _close(stack, tag)
            continue
        _open(stack, tag, m[3] or m[6] or "")
        if tag in RAW:
            end = END_OF[tag].search(page, at)
            stop = end.start() if end else len(page)
            if tag in ("textarea", "title"):
                add_text(page[at:stop])
            at = stop
            if not end:
                break
    return root


def _open(stack: list[Element], tag: str, attributes: str) -> None:
    if tag in CLOSES_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag not in INLINE:
                break
    shut = CLOSED_BY.get(tag)
    if shut:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in shut:
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
    node = Element(tag, attributes, stack[-1].depth + 1)
    stack[-1].kids.append(node)
    if tag not in VOID and not attributes.endswith("/") and node.depth < DEPTH:
        stack.append(node)
    elif tag not in VOID and not attributes.endswith("/"):
        stack.append(stack[-1])  # too deep: what follows hangs here, its end tag pops this entry
        stack[-1] = _Alias(tag, stack[-2])


class _Alias(Element):
    """Stands on the stack for an element nested too deep; holds its ancestor's children."""

    __slots__ = ()

    def __init__(self, tag: str, above: Element):
        self.tag, self.label, self.kids, self.noise, self.depth = tag, tag, above.kids, False, above.depth


def _close(stack: list[Element], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if tag in INLINE and stack[k].tag not in INLINE:
            return


class Forest:
    """Shapes of pruned trees, numbered, and the remembered matching weights of pairs of shapes."""

    def __init__(self):
        self.numbers, self.shapes, self.sizes, self.memo = {}, [("#text", ())], [1], {}

    def prune(self, root: Element) -> None:
        """Cut noise and empty text; number shapes bottom-up."""
        order, stack = [], [(root, False)]
        while stack:
            node, inside = stack.pop()
            order.append((node, inside))
            inner = inside or node.tag in ("article", "main")
            stack += [(k, inner) for k in node.kids if isinstance(k, Element)]
        holds = set()
        for node, _ in reversed(order):
            if node.tag in ("article", "main") and not node.noise or any(id(k) in holds for k in node.kids):
                holds.add(id(node))
        for node, inside in reversed(order):
            inside, kids = inside or node.tag in ("article", "main"), []
            for k in node.kids:
                if isinstance(k, Text):
                    if not k.text.isspace() and k.text:
                        kids.append(k)
                elif k.tag == "header" and id(k) not in holds:  # of a page: noise; of an article: its headings are text
                    kids += headings(k) if inside else []
                elif not k.noise or id(k) in holds:
                    kids.append(k)
            node.kids = kids
            self._number(node)

    def _number(self, node: Element) -> None:
        key = (node.label, tuple(0 if isinstance(k, Text) else k.shape for k in node.kids))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.shapes)
            self.shapes.append(key)
            self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
        node.shape = number
        node.hash = hash((node.label, tuple(k.hash for k in node.kids)))
        node.texts = sum(1 if isinstance(k, Text) else k.texts for k in node.kids)

    def weight(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that two shapes have in common, in order, top down."""
        if a == b:
            return self.sizes[a]
        key = (a, b)
        found = self.memo.get(key)
        if found is None:
            (la, ka), (lb, kb) = self.shapes[a], self.shapes[b]
            found = 0
            if la == lb:
                row = [0] * (len(kb) + 1)
                if len(ka) * len(kb) > MAX_CELLS:
                    head, tail = _equal_ends(ka, kb)
                    inner = self._last_row(ka[head:len(ka) - tail], kb[head:len(kb) - tail])
                    row = [int(inner[-1]) + sum(self.sizes[k] for k in ka[:head] + ka[len(ka) - tail:])]
                else:
                    for x in ka:
                        up, left, new = row, 0, [0]
                        for j, y in enumerate(kb):
                            left = max(left, up[j + 1], up[j] + self.weight(x, y))
                            new.append(left)
                        row = new
                found = 1 + row[-1]
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            self.memo[key] = found
        return found

    def align(self, page: Element, reference: Element) -> list[tuple[Text, Text]]:
        """Pairs of matched text nodes."""
        out, stack = [], [(page, reference)]
        while stack:
            x, y = stack.pop()
            for a, b in self._match(x.kids, y.kids):
                if isinstance(a, Text):
                    out.append((a, b))
                elif a.texts and b.texts:
                    stack.append((a, b))
        return out

    def _match(self, xs: list, ys: list) -> list[tuple]:
        m, n = len(xs), len(ys)
        if not m or not n:
            return []
        if m * n > MAX_CELLS:
            head, tail = _equal_ends([(type(x), x.hash) for x in xs], [(type(y), y.hash) for y in ys])
            return [*zip(xs[:head], ys[:head]), *self._split(xs[head:m - tail], ys[head:n - tail]),
                    *zip(xs[m - tail:], ys[n - tail:])]
        xs_shape = [0 if isinstance(x, Text) else x.shape for x in xs]
        ys_shape = [0 if isinstance(y, Text) else y.shape for y in ys]
        ys_hash = [y.hash for y in ys]
        rows = [[0] * (n + 1)]
        for x, shape in zip(xs, xs_shape):
            up, left, new, own = rows[-1], 0, [0], x.hash
            extra = 1 if isinstance(x, Text) else x.texts
            for j in range(n):
                w = self.weight(shape, ys_shape[j])
                if w and ys_hash[j] == own:
                    w += extra
                left = max(left, up[j + 1], up[j] + w)
                new.append(left)
            rows.append(new)
        pairs, i, j = [], m, n
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        return pairs


    def _split(self, xs: list, ys: list) -> list[tuple]:
        """Hirschberg: the pairs of the best matching, in memory for two rows of the table."""
        if len(xs) * len(ys) <= MAX_CELLS:
            return self._match(xs, ys)
        if len(xs) == 1:
            gains = [int(self._last_row([_shape(xs[0])], [_shape(y)], [xs[0]], [y])[-1]) for y in ys]
            best = int(np.argmax(gains))
            return [(xs[0], ys[best])] if gains[best] else []
        half = len(xs) // 2
        top = self._last_row([*map(_shape, xs[:half])], [*map(_shape, ys)], xs[:half], ys)
        low, back = xs[half:][::-1], ys[::-1]
        bottom = self._last_row([*map(_shape, low)], [*map(_shape, back)], low, back)
        cut = int(np.argmax(top + bottom[::-1]))
        return self._split(xs[:half], ys[:cut]) + self._split(xs[half:], ys[cut:])

    def _last_row(self, ka, kb, xs: list = (), ys: list = ()) -> np.ndarray:
        """Last row of the matching table of two lists of shapes; with the nodes, equal ones count extra."""
        distinct, where = np.unique(np.array(kb, np.int64), return_inverse=True)
        hashes = np.array([y.hash for y in ys], np.int64)
        row, weights = np.zeros(len(kb) + 1, np.int64), {}
        for i, a in enumerate(ka):
            if a not in weights:
                if len(weights) * distinct.size > MAX_CELLS:
                    weights.clear()
                weights[a] = np.array([self.weight(a, b) for b in distinct.tolist()], np.int64)
            w = weights[a][where]
            if len(xs):
                w = w + (1 if isinstance(xs[i], Text) else xs[i].texts) * ((w > 0) & (hashes == xs[i].hash))
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
        return row


def _shape(node) -> int:
    return 0 if isinstance(node, Text) else node.shape


def _equal_ends(xs, ys) -> tuple[int, int]:
    """Lengths of the equal head and tail of two lists. Equal nodes weigh the most a node can, so pairing
    them loses nothing."""
    short = min(len(xs), len(ys))
    head = next((k for k in range(short) if xs[k] != ys[k]), short)
    tail = next((k for k in range(short - head) if xs[-1 - k] != ys[-1 - k]), short - head)
    return head, tail


def text_nodes(root: Element) -> list[Text]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Text):
            out.append(node)
        else:
            stack += reversed(node.kids)
    return out


def headings(root: Element) -> list[Element]:
    """The headings below an element, in page order, but those in noise."""
    out, stack = [], [*reversed(root.kids)]
    while stack:
        node = stack.pop()
        if isinstance(node, Text) or node.noise:
            continue
        if HEADING.fullmatch(node.tag):
            out.append(node)
        else:
            stack += reversed(node.kids)
    return out


def region(root: Element) -> list[tuple[Element, bool]]:
    """The parts of a page that hold its article, in page order, and whether all of a part is article: every
    outermost article with text, or the main element around it (False); without articles the largest main; else
    the whole page (False). What stands in noise (cards in a sidebar, comments) counts only if nothing else does,
    and then the largest alone."""
    articles, mains, stack = [], [], [(root, False, None)]
    while stack:
        node, noise, main = stack.pop()
        noise = noise or node.noise
        if node.tag == "article" and node.texts:
            articles.append((node, noise, main))
            continue
        if node.tag == "main":
            main = main or node
            mains.append((node, noise, main))
        stack += [(k, noise, main) for k in reversed(node.kids) if isinstance(k, Element)]

    def size(found) -> int:
        return sum(len(t.text) for t in text_nodes(found[0]))

    clean = [(main or node, main is None) for node, noise, main in articles if not noise]
    if clean:
        return [*{id(top): (top, whole) for top, whole in clean}.values()]
    if articles:
        return [(max(articles, key=size)[0], True)]
    if mains:
        return [(max([m for m in mains if not m[1]] or mains, key=size)[0], True)]
    return [(root, False)]


def blocks(root: Element, template: set[int]) -> list[str]:
    """Text blocks of the page's article parts without the text nodes whose id is in `template`. Outside of
    articles, blocks that are mostly links go, and so does noise that was kept for an article in it."""
    parts = region(root)
    out, pieces = [], []
    linked = whole = 0

    def flush() -> None:
        nonlocal linked, whole
        text = " ".join("".join(pieces).split())
        if text and 2 * linked <= whole:
            out.append(text)
        pieces.clear()
        linked = whole = 0

    stack: list = [(top, False, sure) for top, sure in reversed(parts)]
    tops = {id(top) for top, _ in parts}
    while stack:
        node, link, sure = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, Text):
            if id(node) not in template:
                pieces.append(node.text)
                size = len(node.text.strip())
                whole += size
                linked += size * (link and not sure)
        elif id(node) in tops or not node.noise:
            if node.tag not in INLINE:
                flush()
                stack.append((None, False, sure))
            sure = sure or node.tag == "article"
            stack += [(k, link or node.tag == "a", sure) for k in reversed(node.kids)]
    flush()
    return out


class Reader:
    """Parses pages and keeps the references of the hosts a task has met."""

    def __init__(self):
        self.forest, self.references = Forest(), {}

    def fresh(self) -> None:
        """Between pages: forget all shapes if there are too many."""
        if len(self.forest.shapes) > REMEMBERED or len(self.references) > 200:
            self.forest, self.references = Forest(), {}

    def page(self, source: str) -> Element:
        root = parse(source)
        self.forest.prune(root)
        return root

    def reference(self, source: str) -> tuple[Element, dict[int, int]]:
        """Tree of a reference page, and the number of each of its text nodes."""
        key = xxhash.xxh3_128_digest(source)
        if key not in self.references:
            tree = self.page(source)
            self.references[key] = tree, {id(t): k for k, t in enumerate(text_nodes(tree))}
        return self.references[key]

    def constant(self, root: Element, source: str) -> dict[int, int]:
        """Reference text node -> page text node (id), where both have the same text."""
        tree, numbers = self.reference(source)
        return {numbers[id(b)]: id(a) for a, b in self.forest.align(root, tree) if a.hash == b.hash}


def main_text(source: str, reference: str | None = None, template: list[int] | None = None,
              reader: Reader | None = None) -> str:
    """Main text of one page, given its host's reference page and the numbers of the template nodes."""
    reader = reader or Reader()
    reader.fresh()
    if not reference or not template:
        return " ".join(blocks(reader.page(source), set()))
    root = reader.page(source)
    same, known = reader.constant(root, reference), set(template)
    return " ".join(blocks(root, {at for k, at in same.items() if k in known}))


def host_references(pages: DataFrame, min_pages: int) -> DataFrame:
    """(host, reference): one page per host with at least `min_pages` pages."""
    sized = pages.select("host", F.length("page").alias("size"), F.xxhash64("page").alias("hash"))
    middle = (sized.where(F.col("size") > 0).groupBy("host")
              .agg(F.percentile_approx("size", 0.5, 100).alias("middle"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_pages))
    near = join_hot(sized, materialise(middle, "host-middle"), "host", "host-size").where(
        F.col("middle").isNotNull() & (F.col("size") > 0))
    chosen = near.groupBy("host").agg(F.min(F.struct(F.abs(F.col("size") - F.col("middle")).alias("d"),
                                                     "hash")).alias("best"))
    chosen = materialise(chosen.select(F.col("host").alias("_host"), F.col("best.hash").alias("_hash")), "host-chosen")
    found = pages.join(chosen, (F.xxhash64("page") == F.col("_hash")) & (F.col("host") == F.col("_host")))
    return found.groupBy("host").agg(F.min("page").alias("reference"))


def join_reference(pages: DataFrame, templates: DataFrame, host: str, reference: str, name: str) -> DataFrame:
    """Left join of pages to their host's row; long references travel by shuffle to `SALTS` parts of the pages."""
    long = F.length(reference) > MAX_REFERENCE
    rest = [c for c in templates.columns if c not in (host, reference)]
    if templates.where(long).isEmpty():
        return join_hot(pages, templates, host, name)
    brief = templates.select(host, *rest, F.when(~long, F.col(reference)).alias(reference), long.alias("_llm_long"))
    both = join_hot(pages, brief, host, name)
    near = both.where("not coalesce(_llm_long, false)").drop("_llm_long")
    salt = F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int")
    far = both.where("_llm_long").drop("_llm_long", reference).withColumn("_llm_salt", salt)
    copies = templates.where(long).select(host, reference, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_llm_salt"))
    far = far.join(copies.hint("shuffle_hash"), [host, "_llm_salt"]).drop("_llm_salt")
    return near.unionByName(far)


def host_templates(pages: DataFrame, min_pages: int, constant: float) -> DataFrame:
    """(host, reference, template): template holds the numbers of the reference's constant text nodes."""
    references = materialise(host_references(pages, min_pages), "host-references")

    def compare(batches):
        reader = Reader()
        for batch in batches:
            for part in slices(batch, "page"):
                content, same = [], []
                for page, ref in zip(raw_texts(part.column("page")), raw_texts(part.column("reference"))):
                    reader.fresh()
                    root = reader.page(page.decode())
                    content.append(xxhash.xxh3_128_digest("\n".join(t.text for t in text_nodes(root))))
                    same.append(list(reader.constant(root, ref.decode())))
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(content, pa.binary()),
                                                  pa.array(same, pa.list_(pa.int32()))], ["host", "content", "same"])

    joined = join_reference(pages, references, "host", "reference", "host-compare").where("reference is not null")
    seen = materialise(joined.mapInArrow(compare, "host string, content binary, same array<int>")
                       .dropDuplicates(["host", "content"]), "host-nodes")
    pages_of = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    nodes = seen.select("host", F.explode("same").alias("node")).groupBy("host", "node").agg(
        F.count(F.lit(1)).alias("k"))
    fixed = (nodes.join(pages_of, "host").where(F.col("k") >= constant * F.col("n"))
             .groupBy("host").agg(F.collect_list("node").alias("template")))
    return references.join(fixed, "host")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
            constant: float = CONSTANT) -> DataFrame:
    """`pages` with the column `text`, the page's main text."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    templates = materialise(host_templates(source, min_pages, constant), "host-templates").select(
        F.col("host").alias("_llm_host"), F.col("reference").alias("_llm_reference"),
        F.col("template").alias("_llm_template"))
    memory: dict[str, Reader] = {}

    @F.arrow_udf(T.StringType())
    def run(sources: pa.Array, references: pa.Array, known: pa.Array) -> pa.Array:
        reader = memory.setdefault("reader", Reader())
        out = []
        for start in range(0, len(sources), 64):
            for page, ref, template in zip(raw_texts(sources.slice(start, 64)), raw_texts(references.slice(start, 64)),
                                           known.slice(start, 64).to_pylist()):
                out.append(main_text(page.decode(), ref.decode(), template, reader))
        return pa.array(out, pa.string())

    hosted = pages.withColumn("_llm_host", host_of(F.col(url_col)))
    joined = join_reference(hosted, templates, "_llm_host", "_llm_reference", "host-extract")
    rest = [c for c in pages.columns if c != "text"]
    return joined.select(*rest, run(F.col(html_col), F.col("_llm_reference"), F.col("_llm_template")).alias("text"))

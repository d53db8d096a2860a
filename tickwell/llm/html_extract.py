"""Main-text extraction by union-free regular expressions over same-host token streams.

Inference: every page of each host is tokenised into tags and text, and tandem repeats are folded into repeated
groups. Streams of one shape are merged place by place, in each task and then between tasks, in any order; a host's
different shapes are aligned in the order of their hashes, by parts of the hash in three rounds. What only some
pages have becomes an optional group (or joins a neighbouring repeated group with the same content), and differing
texts become slots. The result is a wrapper: a regular expression of tags, constant texts, slots, (...)? and (...)+.

A text that all pages with its place have there, three unlike ones at least, is template, also inside of a repeated
group; slots and repeated groups of slots may be content. Words of a container's class or id only break ties: they count as furniture
unless the container holds an article, main or h1 element or nine tenths of the page's text.

Extraction: every page is tokenised whole. Template texts at their place are left out, and other blocks are kept or
left by one rule, from their own paths and the page's article root. That is the page's article or main element, else one of the roots that pages of its host agree on:
each page of a host votes with its own root (counts combined in each task), and a page takes the commonest root that
holds at least half of its own article text, or its own, so templates of one host don't decide about each other.
Roots are broadcast up to `broadcast_hosts` hosts and joined by host beyond that (adaptive execution splits a hot
host). Pages with null and host-less urls have nothing to do with each other and are read alone.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by one \\n in
page order. Scripts, styles, comments and markup never count. Defined cases: null or blank html gives an empty
text; null and host-less urls are judged by the page alone; repeated rows each come back; unclosed tags end where their
container ends; a self-closed or unclosed svg, iframe or the like is only its tag; a truncated page keeps what it has.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .url_filter import parts

#: Unlike pages that must have a place before its texts can be template.
LEAST = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_FURNITURE_TAGS = frozenset("nav footer aside button dialog menu head".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related reply replies respond share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What may stand after a furniture word in a class, as in ad-slot or cookie-box; another word makes it something else.
_AFTER = frozenset("area bar block body bottom box btn button buttons column container content footer frame header holder inner item items left link links list main outer panel right row section slot text title top unit wrap wrapper".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())


def _furniture(name: str) -> bool:
    """A class or id of furniture words alone, ending in one (but not has-sidebar), or followed by a word of layout."""
    w = [x for x in re.split(r"[^a-z]+", name) if x]
    if not w or w[0] in ("has", "with", "without", "no", "is"):
        return False
    return w[-1] in _FURNITURE_WORDS or (w[0] in _FURNITURE_WORDS and all(x in _FURNITURE_WORDS or x in _AFTER for x in w[1:]))


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """Name of a container for paths, and whether it is furniture by itself: 2 by its tag, role or being hidden,
    1 by a word of its class or id or as a form, which doesn't hold for a container of the article."""
    own, bad = tag, 2 if tag in _FURNITURE_TAGS else 1 if tag == "form" else 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            own += "." + re.sub(r"\d+", "", value)
            if tag not in ("body", "html", "article", "main") and any(_furniture(x) for x in value.split()):
                bad = max(bad, 1)
        elif name == "role":
            bad = 2 if value in _FURNITURE_ROLES else bad
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            bad = 2
    return own, bad


def blocks(html: str) -> list[tuple[str, str, bool, int]]:
    """(path, text, furniture, length of link text) of the page's blocks in order. Paths name the open containers.
    A container that is furniture by a word only is none if it holds an article, main or h1 element, or nine tenths
    of the page's unlinked text outside of certain furniture."""
    stack: list[tuple[str, str, int, int]] = []  # tag, label, furniture, number of the container
    out: list[tuple[str, str, bool, int, list[int]]] = []
    holding: set[int] = set()  # containers of an article, main or h1 element
    text: list[str] = []
    links = link_depth = opened = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            tags = {t for t, *_ in stack}
            bad = any(f == 2 for _, _, f, _ in stack) or ("header" in tags and not tags & {"article", "main"})
            out.append(("/".join(x for _, x, _, _ in stack), joined, bad, links, [k for _, _, f, k in stack if f == 1]))
        text.clear()
        links = 0

    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        if m[4] is not None:
            text.append(m[4])
            links += len(m[4]) if link_depth else 0
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in _RAW and not closing:
            # a self-closed element has no content; one that never ends is only its tag, unless what follows is code
            end = None if m[3].endswith("/") else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif not m[3].endswith("/") and tag in ("script", "style"):
                at = len(html)
            if tag not in ("script", "style"):
                flush()
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        if tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        if closing:
            spot = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if spot is not None:
                del stack[spot:]
                link_depth = 0
            continue
        if tag in _P_ENDERS and stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        if tag in ("article", "main", "h1") and not any(f == 2 for _, _, f, _ in stack):
            holding.update(k for *_, k in stack)
        stack.append((tag, *_label(tag, m[3] or ""), opened := opened + 1))
    flush()
    mass: Counter[int] = Counter()
    for _, t, bad, link, weak in out:
        if not bad and 2 * link <= len(t):
            mass.update(dict.fromkeys([0, *weak], len(t)))
    return [(p, t, bad or any(k not in holding and 10 * mass[k] < 9 * mass[0] for k in weak), link) for p, t, bad, link, weak in out]


# ---------------------------------------------------------------- wrapper inference


def stream(html: str) -> list:
    """Tokens of a page for alignment: (path of containers) steps and texts, with tandem repeats folded. Each has a
    fingerprint of the page's texts."""
    return _stream(blocks(html))


def _stream(found: list[tuple[str, str, bool, int]]) -> list:
    mark = hashlib.blake2b("\n".join(t for _, t, _, _ in found).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return fold([("b", path, bad, link, text, {text}, {mark}) for path, text, bad, link in found])


def _key(node) -> str:
    """What two nodes must share to be aligned: shape and paths, never texts."""
    if node[0] == "b":
        return "b" + node[1]
    return node[0] + "(" + "|".join(_key(x) for x in node[1]) + ")"


def fold(nodes: list, longest: int = 8) -> list:
    """Replace runs of equal groups (by shape) by one repeated group, shortest periods first."""
    for period in range(1, longest + 1):
        keys, out, i = [_key(x) for x in nodes], [], 0
        while i < len(nodes):
            n = 1
            while i + (n + 1) * period <= len(nodes) and keys[i : i + period] == keys[i + n * period : i + (n + 1) * period]:
                n += 1
            if n > 1:
                body = nodes[i : i + period]
                for k in range(1, n):
                    body = [_merge(x, y, False) for x, y in zip(body, nodes[i + k * period : i + (k + 1) * period], strict=True)]
                out.append(("+", body))
                i += n * period
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _merge(x, y, pages: bool):
    """Two nodes of one shape as one; differing texts become a slot (None). Of different pages, the texts that both
    have at the place are kept; within a page, all of them. Of the pages' fingerprints the LEAST smallest are kept, which
tell exactly whether there are so many unlike ones."""
    if x[0] == "b":
        texts, marks = x[5] & y[5] if pages else x[5] | y[5], set(sorted(x[6] | y[6])[:LEAST])
        return ("b", x[1], x[2] and y[2], max(x[3], y[3]), x[4] if x[4] == y[4] else None, texts, marks)
    return (x[0], [_merge(a, b, pages) for a, b in zip(x[1], y[1], strict=True)])


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised so that it also generates the page."""
    a, b = [_key(_bare(x)) for x in wrapper], [_key(_bare(x)) for x in page]
    out: list = []
    for kind, i, j, k, m in _opcodes(a, b):
        if kind == "equal":
            out += [_join(x, y) for x, y in zip(wrapper[i:j], page[k:m], strict=True)]
        else:
            for part in (wrapper[i:j], page[k:m]):
                out += [x if x[0] == "?" else ("?", [x]) for x in part]
    return out


def _opcodes(a: list[str], b: list[str], exact: int = 1_000_000) -> list[tuple[str, int, int, int, int]]:
    """Matching and differing stretches of two sequences. Pairs of streams whose lengths multiply to more than `exact`
    are matched in near-linear time: places whose keys occur once in both are anchors, the longest rising run of them
    holds, and matches grow from each anchor to both sides."""
    if len(a) * len(b) <= exact:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    once_a, once_b = ({x: i for i, x in enumerate(s) if n[x] == 1} for s, n in ((a, Counter(a)), (b, Counter(b))))
    pairs = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
    tails: list[int] = []
    best: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, k) in enumerate(pairs):  # longest rising run
        at = bisect_left(tails, k)
        before[n] = best[at - 1] if at else -1
        tails[at : at + 1], best[at : at + 1] = [k], [n]
    chain, n = [], best[-1] if best else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    out: list[tuple[str, int, int, int, int]] = []
    i = k = 0
    for x, y in [*reversed(chain), (len(a), len(b))]:
        if x < i or y < k:
            continue
        while i < x and k < y and a[i] == b[k]:  # forwards from the last match
            out.append(("equal", i, i + 1, k, k + 1))
            i, k = i + 1, k + 1
        back = 0
        while x - back > i and y - back > k and a[x - back - 1] == b[y - back - 1]:
            back += 1
        if x - back > i or y - back > k:
            out.append(("replace", i, x - back, k, y - back))
        stop = min(x + 1, len(a)), min(y + 1, len(b))
        if stop[0] > x - back:
            out.append(("equal", x - back, stop[0], y - back, stop[1]))
        i, k = stop
    return out


def _bare(node):
    """A node without the mark of being optional or repeated, for comparison."""
    while node[0] in "?+" and len(node[1]) == 1:
        node = node[1][0]
    return node


def _join(x, y):
    marks = {n[0] for n in (x, y) if n[0] in "?+" and len(n[1]) == 1}
    if x[0] == "?" and len(x[1]) == 1 and x[1][0][0] == "+":
        marks.add("+")
    body = _merge(_bare(x), _bare(y), True)
    if "+" in marks:
        body = ("+", [body])
    return ("?", [body]) if "?" in marks else body


def _leaves(nodes: list):
    for node in nodes:
        if node[0] == "b":
            yield node
        else:
            yield from _leaves(node[1])


def gather(shapes: dict[str, list], own: list) -> None:
    """Put a stream or wrapper to those of its shape."""
    shape = "|".join(map(_key, own))
    known = shapes.get(shape)
    shapes[shape] = own if known is None else [_merge(x, y, True) for x, y in zip(known, own, strict=True)]


def _hash(shape: str) -> int:
    return int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1


def joined(shapes: dict[str, list]) -> list:
    """The wrapper of all shapes, aligned in the order of their hashes."""
    wrapper: list | None = None
    for shape in sorted(shapes, key=lambda x: (_hash(x), x)):
        wrapper = shapes[shape] if wrapper is None else align(wrapper, shapes[shape])
    return wrapper or []


def infer(pages: list[str]) -> list:
    """The wrapper of a host's pages, in whatever order they come. Pages with the same texts count as one page."""
    shapes: dict[str, list] = {}
    for html in pages:
        if own := stream(html):
            gather(shapes, own)
    return joined(shapes)


def _written(nodes: list) -> str:
    return json.dumps(nodes, default=sorted)


def _read(body: str) -> list:
    def node(x):
        return (*x[:5], set(x[5]), set(x[6])) if x[0] == "b" else (x[0], [node(y) for y in x[1]])

    return [node(x) for x in json.loads(body)]


def fixed(wrapper: list) -> dict[str, list[str]]:
    """path -> texts that every page with the place has there, of places on at least LEAST unlike pages: the template."""
    out: dict[str, list[str]] = {}
    for _, path, _, _, _, texts, pages in _leaves(wrapper):
        if texts and len(pages) >= LEAST:
            out.setdefault(path, []).extend(sorted(texts))
    return out


def expression(nodes: list) -> str:
    """The wrapper as readable text: paths, #slot for a text slot, (...)? and (...)+."""
    return " ".join(
        f"{n[1]}:{'#slot' if n[4] is None else json.dumps(n[4], ensure_ascii=False)}" if n[0] == "b" else f"({expression(n[1])}){n[0]}" for n in nodes
    )


def article_root(found: list[tuple[str, bool, int, int]]) -> str:
    """Container of the article from (path, furniture, text length, link length): an article or main element if
    there is one outside of furniture, else the deepest container with most of the unlinked text."""
    good = [x for x in found if not x[1]]
    for wanted in ("article", "main"):
        if any(re.search(rf"(^|/){wanted}(\.|/|$)", p) for p, *_ in good):
            return wanted
    mass: dict[str, int] = {}
    for path, _, size, link in good:
        if 2 * link < size:
            steps = path.split("/")
            for k in range(len(steps)):
                mass["/".join(steps[: k + 1])] = mass.get("/".join(steps[: k + 1]), 0) + size
    total = max(mass.values(), default=0)
    return max((p for p, n in mass.items() if 10 * n >= 7 * total), key=lambda p: (p.count("/"), p), default="")


def is_article(path: str, bad: bool, size: int, link: int, root: str) -> bool:
    if bad or (2 * link > size and not re.search(r"(^|/)(p|h[1-6]|blockquote)(\.[^/]*)?$", path)):
        return False
    if root in ("article", "main"):
        return re.search(rf"(^|/){root}(\.|/|$)", path) is not None
    return path == root or path.startswith(root + "/") or not root


def page_root(found: list[tuple[str, bool, int, int]], roots: list[str] | None) -> str:
    """The page's own article or main element, else the first of its host's roots (most pages first) that holds at
    least half of the page's article text by the page's own root, else that own root."""
    own = article_root(found)
    if own in ("article", "main") or not roots:
        return own
    good = [(p, size) for p, bad, size, link in found if is_article(p, bad, size, link, own)]
    total = sum(size for _, size in good)
    return next((r for r in roots if 2 * sum(size for p, size in good if p == r or p.startswith(r + "/")) >= total > 0), own)


def main_text(html: str | None, told: dict | None) -> str:
    """The page's article text. `told` has the host's roots and the constant texts of its wrapper; they are left out
    unless nothing else is there."""
    found = blocks(html or "")
    told = told or {}
    root = page_root([(p, bad, len(t), link) for p, t, bad, link in found], told.get("roots"))
    kept = [(p, t) for p, t, bad, link in found if is_article(p, bad, len(t), link, root)]
    template = told.get("fixed") or {}
    return "\n".join(t for _, t in [x for x in kept if x[1] not in template.get(x[0], ())] or kept)


def surveyed(pages: DataFrame, most: int = 2000) -> DataFrame:
    """What each task found in its rows of pages(host, html), as rows of two kinds, combined in the task:
    (host, shape, body) for the merged streams of one shape, and (host, root, n) for the pages with an own root. A task
    holds up to `most` shapes before it writes them."""

    def rows(shapes: dict[str, dict[str, list]], counts: Counter[tuple[str, str]]) -> pa.RecordBatch:
        found = [(h, _hash(k), _written(x), None, None) for h, own in shapes.items() for k, x in own.items()]
        found += [(h, None, None, r, n) for (h, r), n in counts.items()]
        columns = zip(*found, strict=True) if found else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["host", "shape", "body", "root", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[str, dict[str, list]] = {}
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = blocks(html.as_py() or "")
                root = article_root([(p, bad, len(t), link) for p, t, bad, link in found])
                if root not in ("", "article", "main"):
                    counts[host, root] += 1
                if found:
                    gather(shapes.setdefault(host, {}), _stream(found))
                    if len(shapes[host]) > most or len(shapes) > most or len(counts) > most:
                        yield rows(shapes, counts)
                        shapes, counts = {}, Counter()
        yield rows(shapes, counts)

    return pages.select("host", "html").mapInArrow(run, "host string, shape long, body string, root string, n long")


def host_roots(survey: DataFrame) -> DataFrame:
    """(host, roots): the roots that at least two pages of the host have by themselves, most pages first."""
    counts = survey.filter("root IS NOT NULL").groupBy("host", "root").agg(F.sum("n").alias("n")).filter("n > 1")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "root")))
    return counts.groupBy("host").agg(F.transform(listed, lambda x: x["root"]).alias("roots"))


def wrappers(survey: DataFrame) -> DataFrame:
    """(host, wrapper, fixed): the inferred expression of each host and its constant texts by path, from all pages.
    Shapes are aligned in 4096 parts of a host, then in 64, then all, so a task gets a part's shapes, not a host's."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shapes: dict[str, list] = {}
        for body in group["body"]:
            gather(shapes, _read(body.as_py()))
        return pa.table({"host": [key[0].as_py()], "shape": [key[1].as_py()], "body": [_written(joined(shapes))]})

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(expression, found), pa.string()), pa.array([json.dumps(fixed(x)) for x in found], pa.string())], names=["host", "wrapper", "fixed"])

    rows = survey.filter("body IS NOT NULL").select("host", "shape", "body")
    for parts_of in (4096, 64, 1):
        rows = rows.groupBy("host", F.pmod("shape", F.lit(parts_of)).alias("part")).applyInArrow(run, "host string, shape long, body string")
    return rows.select("host", "body").mapInArrow(shown, "host string, wrapper string, fixed string")


def extract(pages: DataFrame, broadcast_hosts: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    source = pages.select("page_id", "url", "html", F.coalesce(parts(F.col("url"))[0], F.lit("")).alias("host"))
    survey = materialise(surveyed(source.filter("host <> ''")), "survey")
    roots = host_roots(survey).select("host", F.to_json("roots").alias("roots"))
    told = F.concat(F.lit('{"roots":'), F.coalesce("roots", F.lit("[]")), F.lit(',"fixed":'), F.coalesce("fixed", F.lit("{}")), F.lit("}"))
    hosts = wrappers(survey).join(roots, "host", "full").select("host", told.alias("told"))
    few = source.select("host").distinct().limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = source.join(F.broadcast(hosts) if few else hosts, "host", "left").select("page_id", "url", "html", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for html, told in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if told not in known:
                    if len(known) > 5000:
                        known = {None: None}
                    known[told] = json.loads(told)
                texts.append(main_text(html.as_py(), known[told]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = joined.mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

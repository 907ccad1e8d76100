"""HTML main-text extraction by equivalence-class template deduction."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import map_arrow, settle

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
REST = re.compile(r"(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: These make up paths; other elements only part or mark up text.
CONTAINERS = frozenset("html head body main article section div nav header footer aside form table ul ol dl figure details dialog fieldset select button menu datalist".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre figcaption address hr summary legend option".split())
#: Elements that aren't main text, and names of classes, ids and roles that small containers of other text have.
ASIDE = frozenset("head nav header footer aside dialog button select menu datalist".split())
NEVER_NAMED = frozenset("html body main article".split())
LISTS = frozenset("table ul ol dl".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert sidebar comment comments respond disqus "
    "newsletter subscribe share sharing social related breadcrumb breadcrumbs menu nav navigation navbar pagination pager popup modal footer header masthead form login signup search contentinfo complementary widget toolbar".split()
)
#: A name is one of ASIDE_NAMES with its parts only if the others are of these: "cookie-box" is, "related-work" isn't.
NEUTRAL_NAMES = frozenset("area bar block bottom box container content global holder inner item items left link links list main outer page panel right section site text top wrap wrapper".split())
PARTS = re.compile(r"[^a-z0-9]+")
#: Of containers alike beside each other the first ones are told apart, up to this many.
TOLD_APART = 8
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def parse(page: str):
    """The page as events: ("open", path, aside), ("close", path, aside), ("break",) and ("text", string, in a link).

    path has the containers above with their names, and ~2, ~3, ... where others
    like it come before it; aside tells whether one
    of them is an element that never holds main text. Closing tags without an open element are passed
    over; an element that is never closed ends with the one around it.
    """
    stack: list[tuple[str, str, bool]] = []  # tag, path, aside
    children: list[dict[str, int]] = [{}]  # of each open container, and of the page
    links, at, end = 0, 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            yield "text", page[at:stop], links > 0
        if not m:
            return
        at, name = m.end(), m[2]
        if not name:
            continue
        name = name.lower()
        rest = REST.match(page, at)  # a quote that is never closed: to the next >
        at = rest.end() if rest else page.find(">", at) + 1 or end
        attributes = page[m.end() : at - 1]
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                yield "break", "", False
            if name in CONTAINERS and any(t == name for t, _, _ in stack):
                while True:
                    tag, path, aside = stack.pop()
                    children.pop()
                    yield "close", path, aside
                    if tag == name:
                        break
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            after = page.find(">", close.end()) + 1 if close else end
            at = after or end
            continue
        if name == "br":
            yield "text", " ", False
        elif name == "a":
            links += 1
        if name in BLOCKS:
            yield "break", "", False
        if name in CONTAINERS:
            names = [PARTS.sub("-", p).strip("-") for _, *v in ATTRIBUTE.findall(attributes) for p in "".join(v).lower().split()] if attributes else []
            above, off = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            own = ".".join([name, *filter(None, names)])
            children[-1][own] = n = children[-1].get(own, 0) + 1
            path = f"{above}/{own}" if n == 1 else f"{above}/{own}~{min(n, TOLD_APART)}"
            aside = off or name in ASIDE
            yield "open", path, aside
            if attributes.endswith("/"):
                yield "close", path, aside
            else:
                stack.append((name, path, aside))
                children.append({})
    while stack:
        _, path, aside = stack.pop()
        yield "close", path, aside


def blocks(page: str):
    """(block, path, aside, words, words in links) in page order, with references decoded and white space joined."""
    now, links, path, aside = [], 0, "", False
    stack = [("", False)]
    for kind, s, flag in parse(page):
        if kind == "text":
            s = html.unescape(s)
            now.append(s)
            links += len(s.split()) if flag else 0
            continue
        if now:
            words = "".join(now).split()
            if words:
                yield " ".join(words), *stack[-1], len(words), min(links, len(words))
            now, links = [], 0
        if kind == "open":
            stack.append((s, flag))
        elif kind == "close" and len(stack) > 1:
            stack.pop()
    words = "".join(now).split()
    if words:
        yield " ".join(words), *stack[-1], len(words), min(links, len(words))


@lru_cache(maxsize=50_000)
def named_aside(path: str) -> tuple[str, ...]:
    """The containers of a path that a name, or being a form, would make aside."""
    out, at = [], ""
    for part in path.split("/")[1:]:
        at = f"{at}/{part}"
        name, *names = part.partition("~")[0].split(".")
        if name == "form" or (name not in NEVER_NAMED and any(aside_name(n) for n in names)):
            out.append(at)
    return tuple(out)


def aside_name(name: str) -> bool:
    parts = set(name.split("-"))
    return not ASIDE_NAMES.isdisjoint(parts) and parts <= ASIDE_NAMES | NEUTRAL_NAMES


def element(path: str) -> str:
    return re.split("[.~]", path.rpartition("/")[2])[0]


def within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def block_key(path: str, block: str) -> str:
    return f"{path}\0{xxhash.xxh3_64_hexdigest(block)}"


class Tokens:
    """What pages of a host have in common, counted in the tasks first.

    A token is a container's opening or closing tag in its path, or a whole
    block of text in its path; the page itself is the container of path "".
    Its occurrence vector over the host's pages is told by the number of
    pages, the number of occurrences and the XOR of hashes of (page,
    occurrences on it): equal vectors have equal ones. bits has one of 64 bits
    for each page's content, so that copies of one page don't make a template.
    words, linked and free_all (words not in links) are of all text in a
    container that isn't aside by its element; free is without named
    containers; asides counts the elements in it that are aside.
    """

    def __init__(self, flush: int = 200_000):
        self.held: dict[tuple[str, str], list[int]] = {}
        self.flush = flush

    def __call__(self, batch):
        for page_id, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            self.add(page_id, host, page or "")
        return self.finish() if len(self.held) > self.flush else []

    def add(self, page_id, host: str, page: str) -> None:
        seen: dict[str, list[int]] = {"<": [1, 0, 0, 0, 0, 0], ">": [1, 0, 0, 0, 0, 0]}
        for kind, path, aside in parse(page):
            if kind != "open" and kind != "close":
                continue
            if not aside:
                seen.setdefault(("<" if kind == "open" else ">") + path, [0, 0, 0, 0, 0, 0])[0] += 1
            elif kind == "open" and "<" + path.rpartition("/")[0] in seen:  # in an aside container it isn't
                while path:
                    path = path.rpartition("/")[0]
                    seen["<" + path][5] += 1
        for block, path, aside, words, linked in blocks(page):
            if aside:
                continue
            free = words - linked
            counts = (words, linked, 0 if named_aside(path) else free, free)
            got = seen.setdefault("#" + block_key(path, block), [0, 0, 0, 0, 0, 0])
            got[0] += 1
            while True:
                for i, n in enumerate(counts, 1):
                    got[i] += n
                if path is None:
                    break
                got = seen["<" + path]
                path = path.rpartition("/")[0] if path else None
        bit = 1 << (xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) % 63)
        for token, (n, *counts) in seen.items():
            mark = xxhash.xxh3_64_intdigest(f"{page_id}\0{n}") - (1 << 63)
            row = self.held.setdefault((host, token), [0] * 9)
            row[0] += 1
            row[1] += n
            row[2] ^= mark
            row[3] |= bit
            for i, x in enumerate(counts, 4):
                row[i] += x

    def finish(self):
        keys, rows = list(self.held), list(self.held.values())
        self.held = {}
        out = {"host": [k[0] for k in keys], "token": [k[1] for k in keys]}
        return out | {c: [r[i] for r in rows] for i, c in enumerate(("pages", "total", "vector", "bits", *COUNTS))}


COUNTS = ("words", "linked", "free", "free_all", "asides")


class Containers:
    """What is known of containers, of a host's template or of one page: path -> counts of COUNTS, less constant text, and with it (all)."""

    def __init__(self, counts: dict[str, dict[str, int]], every: dict[str, dict[str, int]]):
        self.counts, self.every = counts, every
        most = max((c["free_all"] for c in counts.values()), default=0)
        self.kept_names = {p for p, c in counts.items() if named_aside(p)[-1:] == (p,) and 2 * c["free_all"] > most}
        self.free = {p: c["free_all" if self.kept_names else "free"] for p, c in counts.items()}
        top = max(self.free.values(), default=0)
        #: Containers with more than half of all free words: each but the last holds the next.
        self.chain = sorted((p for p, n in self.free.items() if 2 * n > top), key=lambda p: (p.count("/"), p))
        self.main, self.plain = self.slot()

    def furniture(self, path: str) -> bool:
        """All of its text is in links, or template text."""
        c, every = self.counts[path], self.every[path]
        return every["words"] > 0 and (c["words"] == 0 or every["free_all"] == 0)

    def slot(self) -> tuple[str | None, bool]:
        """The main slot: the chain's first `article`, else its first `main`, else found by climbing from its end.

        Climbing goes on as long as the next container adds no furniture: no
        element that is aside, no container of links or template text only.
        plain tells that no element named it.
        """
        if not self.chain:
            return None, True
        for fits in (lambda p: element(p) == "article", lambda p: element(p) == "main" or "main" in p.rpartition("/")[2].partition("~")[0].split(".")):
            if named := [p for p in self.chain if fits(p)]:
                return named[0], False
        main = self.chain[-1]
        for above in self.chain[-2::-1]:
            if self.every[above]["asides"] > self.every[main]["asides"]:
                break
            if any(within(p, above) and not within(p, main) and not within(main, p) and self.furniture(p) for p in self.counts):
                break
            main = above
        return main, True


SLOTS = "h string, host string, main string, plain boolean, kept_names array<string>, dropped array<string>"


def choose_slot(pdf):
    """One host's template containers -> its main slot, and what goes from it."""
    import pandas as pd

    rows = pdf.to_dict("records")
    every = {r["path"]: {c: int(r[c]) for c in COUNTS} for r in rows}
    net = {r["path"]: {c: int(r[c]) - int(r[f"fixed_{c}"]) for c in COUNTS} for r in rows}
    of = Containers(net, every)
    root = next((r for r in rows if not r["path"]), None)
    dropped = []
    for r in rows:
        p = r["path"]
        if of.main is None or within(of.main, p):
            continue
        once = root is not None and all(r[c] == root[c] for c in ("pages", "total", "vector"))
        constant = every[p]["words"] > 0 and net[p]["words"] == 0
        linked = every[p]["linked"] > 0 and every[p]["free_all"] == 0 and (once or of.plain and not within(p, of.chain[-1]))
        if constant or linked:
            dropped.append(p)
    return pd.DataFrame([{"h": rows[0]["h"], "host": rows[0]["host"], "main": of.main, "plain": of.plain, "kept_names": sorted(of.kept_names), "dropped": dropped}])


def deduce_templates(pages: DataFrame, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, main, plain, kept_names, dropped, constants; for each host and, as host null, for all.

    Tokens on more than `share` of a host's pages, and of their different
    contents, are grouped by their occurrence vectors. A class is valid if it
    has an opening tag with its closing tag, the same number of times; tokens
    carry their paths, which nest valid classes into the template. What lies
    between is a slot, told by its container. The main slot lies around the
    deepest container with more than half of the free words (in no link and no
    template text) and reaches up to where menus, template text or elements
    that are aside would join it. A named container with most of the host's
    free words isn't aside (kept_names). dropped are containers in the slot
    all of whose text is template text, and those of links only that are part
    of the template, with the vector of the page itself. Where no article or
    main named the slot (plain), constants, template blocks by themselves, go
    as well, except parts of lists and tables. Hosts with fewer than
    least_pages pages have no vectors to speak of and take the template of all.
    """
    sums = [F.sum(c).alias(c) for c in ("pages", "total", *COUNTS)]
    marks = [F.bit_xor("vector").alias("vector"), F.bit_or("bits").alias("bits")]
    told = map_arrow(
        pages.select("page_id", "host", "html"),
        Tokens,
        "host string, token string, pages long, total long, vector long, bits long, " + ", ".join(f"{c} long" for c in COUNTS),
    )
    by_host = settle(told.groupBy("host", "token").agg(*sums, *marks))
    by_all = by_host.groupBy("token").agg(*sums, *marks).where("pages > 1")
    root = F.col("token") == "<"
    whole = by_host.where(root).select("host", F.col("pages").alias("n"), F.bit_count("bits").alias("contents"))
    n_all = by_host.where(root).agg(F.coalesce(F.sum("pages"), F.lit(0)), F.coalesce(F.bit_count(F.bit_or("bits")), F.lit(0))).first()
    frequent = by_host.join(whole.where(F.col("n") >= least_pages), "host").unionByName(
        by_all.withColumn("n", F.lit(n_all[0])).withColumn("contents", F.lit(n_all[1])).withColumn("host", F.lit(None).cast("string"))
    )
    frequent = settle(frequent.where(F.col("pages") > F.col("n") * share).withColumn("h", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("*"))))
    tag = F.col("token").substr(1, 1)
    path = F.expr("substring(token, 2)")
    paired = (
        frequent.where(tag != "#")
        .withColumn("path", path)
        .groupBy("h", "host", "pages", "total", "vector", "path")
        .agg(F.count("*").alias("tags"), *(F.sum(c).alias(c) for c in COUNTS))
        .where("tags = 2")
    )
    spread = (F.bit_count("bits") > F.col("contents") * share) & (F.bit_count("bits") >= least_pages)
    constant = settle(
        frequent.where((tag == "#") & spread).select(
            "h", path.alias("key"), F.split_part(path, F.lit("\0"), F.lit(1)).alias("at"), "pages", "vector", *(F.col(c).alias(f"fixed_{c}") for c in COUNTS)
        )
    )
    inside = (F.col("path") == F.col("at")) | F.col("at").startswith(F.concat("path", F.lit("/")))
    fixed = (
        paired.select("h", "path").join(constant.drop("pages", "vector"), "h").where(inside).groupBy("h", "path").agg(*(F.sum(f"fixed_{c}").alias(f"fixed_{c}") for c in COUNTS))
    )
    slots = settle(paired.join(fixed, ["h", "path"], "left").fillna(0, [f"fixed_{c}" for c in COUNTS]))
    hosts = slots.groupBy("h").applyInPandas(choose_slot, SLOTS)  # a host's template: no larger than a page
    hosts = settle(hosts)
    last = F.element_at(F.split(F.element_at(F.split("at", "/"), -1), "[.~]"), 1)
    alone = (
        constant.join(slots.select("h", F.col("path").alias("at"), "pages", "vector"), ["h", "at", "pages", "vector"])
        .join(hosts.where("plain").select("h"), "h", "left_semi")
        .where(~last.isin(*LISTS))
        .groupBy("h")
        .agg(F.collect_set("key").alias("constants"))
    )
    return hosts.join(alone, "h", "left").select("host", "main", "plain", "kept_names", "dropped", "constants")


class Template:
    """Of one host, of all or of a page: the main slot, and what is and isn't aside in it."""

    def __init__(self, main, plain, kept_names, dropped, constants):
        self.main, self.plain = main, plain
        self.kept_names, self.dropped, self.constants = (frozenset(x or ()) for x in (kept_names, dropped, constants))

    def holds(self, block: str, path: str) -> bool:
        if any(p not in self.kept_names for p in named_aside(path)):
            return False
        if self.constants and block_key(path, block) in self.constants:
            return False
        return not any(within(path, p) for p in self.dropped)

    def takes(self, path: str) -> bool:
        """In the slot, or by itself in a container around it."""
        return within(path, self.main) or (self.plain and within(self.main, path))

    def text(self, found: list) -> list[str]:
        """The blocks it takes of a page; none if its slot is told by its place only and has the smaller part of the free words."""
        if "~" in self.main:
            free = [(b[3] - b[4], within(b[1], self.main)) for b in found]
            if 2 * sum(n for n, own in free if own) < sum(n for n, _ in free):
                return []
        if not any(within(b[1], self.main) for b in found):
            return []
        return [b[0] for b in found if self.takes(b[1]) and self.holds(b[0], b[1])]


def own_template(found: list) -> Template:
    """What one page by itself tells: no constant text, but its containers with their words and links."""
    counts: dict[str, dict[str, int]] = {"": dict.fromkeys(COUNTS, 0)}
    for _, path, _, words, linked in found:
        free = words - linked
        add = {"words": words, "linked": linked, "free": 0 if named_aside(path) else free, "free_all": free}
        while True:
            c = counts.setdefault(path, dict.fromkeys(COUNTS, 0))
            for k, n in add.items():
                c[k] += n
            if not path:
                break
            path = path.rpartition("/")[0]
    of = Containers(counts, counts)
    return Template(of.main if of.main is not None else "", of.plain, of.kept_names, (), ())


def main_text(page: str | None, own: Template | None, general: Template | None) -> str:
    """The blocks of the host's main slot, or where the page has none, of that of all; else of the page's own."""
    if not page:
        return ""
    found = [b for b in blocks(page) if not b[2]]
    for template in (own, general) if own is None or own.main is not None else ():
        if template and template.main and (text := template.text(found)):
            return "\n".join(text)
    alone = own_template(found)
    if own:
        left = [b for b in found if own.holds(b[0], b[1])]
        if left:
            return "\n".join(own_template(left).text(left))
    return "\n".join(alone.text(found) or [b[0] for b in found if alone.holds(b[0], b[1])])


def extract_main_text(pages: DataFrame, broadcast_hosts: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every whole page.

    Templates are deduced per host over all its pages; a page then gives what
    its host's main slot holds, less template containers and what is aside in
    it. What is joined to the pages is one template a host: broadcast up to broadcast_hosts hosts, by a
    join on the host beyond that (a host with very many pages is split by the
    skew join). Null or empty html: empty text. Null url: as a host without a
    name. Repeated pages: one row each. Pages without containers: all their
    text that isn't aside. Further columns are ignored.
    """
    rows = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    templates = settle(deduce_templates(rows))
    general = templates.where("host is null").drop("host").first()
    general = tuple(general) if general else None
    of_host = templates.where("host is not null")
    if of_host.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        of_host = F.broadcast(of_host)

    def make():
        of_all = Template(*general) if general else None
        of = lru_cache(maxsize=256)(lambda *said: Template(*said))

        def step(batch):
            texts = []
            for page, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = of(*(tuple(x) if isinstance(x, list) else x for x in said.values())) if said and said["kept_names"] is not None else None
                texts.append(main_text(page, own, of_all))
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    said = F.struct("main", "plain", "kept_names", "dropped", "constants").alias("template")
    joined = rows.join(of_host, "host", "left").select("page_id", "url", "html", said)
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(joined, make, f"page_id {kind}, url string, text string, n_chars long")

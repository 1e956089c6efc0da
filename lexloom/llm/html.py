"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

A page is a stream of tags (name and class, digits as 0) and texts. Within a page, tandem repeats of any length fold into repeated groups. A host's
wrapper starts as its first page; each further stream is aligned with it: where both agree the node
stays, where only one has a run the run becomes an optional group, where repeated groups differ their bodies are aligned in turn, and all
text is a slot. A stretch of optional groups that repeat each other becomes one repeated group of optionals, so wrappers stay short
whatever pages hold, and a group of more than ``LOOSE`` symbols becomes a repeated choice of its different symbols. Streams met before are
skipped. The alignment is the longest common subsequence of nodes where its table has at most ``CELLS``
cells; longer stretches are first cut at nodes that both have once, in their longest common order, else into pieces along the diagonal, so
that pages of any number of tags take time in proportion.

Every page of every host takes part. Each task folds its pages into one wrapper for each host it meets; wrappers of one host then meet in two
steps (host and salt, then host), so no task holds a host's pages, and a host with a third of all pages is no larger than any other.
Aligning two wrappers is the same operation.

A second pass matches each page's symbols against its host's wrapper, by the position automaton of the expression, so that every block of
text (what stands between tags that break lines) has a slot. For each slot and container path it gathers how often the slot occurs, its
text and link text, and whether all pages have the same text there. Slots whose text is the same on three different pages or more are
template, slots that repeat and hold mostly link text are link groups; neither is main text. Of the other slots those in navigation, headers,
footers, asides, forms, scripts, adverts, notices and comments are left out by name (tag, or any word of class, role or id of any element
around), as such texts vary like main text does; a word on html or body counts nothing, nor one on an element that frames the page; which region is main
where slots leave a choice is decided for each page, as a host may have pages of several templates: the page's article or main element with
text, else of the page's containers the one that holds most of the text, by the host's sums.
Wrappers and slots are written to the shared folder by bucket of hosts (``HOSTS_A_BUCKET`` to one), each file with an index, and the passes over the
pages map the buckets and read the hosts they need, so html is never shuffled and nothing is broadcast.

Defined cases: null or empty html gives an empty text; a url without a host is a host of its own name (empty); repeated pages repeat;
pages of any length, with any number of tags, are read whole; elements nested deeper than ``DEPTH`` share the path of the one there (with a mark of
their own if they are left out by name); of regions with equal text the deeper, then the last by name is main; unclosed and stray tags are
tolerated; null ids pass through; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import keep, shared_dir, slices
from .mapped import Held, Shelf

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)",
    re.S | re.I,
)
CLASS = re.compile(r"\b(?:class|role|id)\s*=\s*[\"']?([^\s\"'>]+)", re.I)
DIGITS = re.compile(r"[0-9]+")
WORDS = re.compile(r"(?:^|(?<=[\s\"']))(?:class|role|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed lists: elements that hold others, elements that do not break a line of text, elements and class words outside main text.
CONTAINERS = frozenset("html body article main section div nav header footer aside form ul ol table menu dialog figure details fieldset".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button select option head title label".split())
OUTSIDE_WORD = re.compile(r"(?i)(?:^|[-_])(?:ads?|advert\w*|banner|nav\w*|menu|side-?bar|footer|header|comments?|cookies?|notices?|promo\w*|related|share|social|breadcrumbs?|popup|subscribe|newsletter|widget|search|login)(?:$|[-_])")
MAIN = ("article", "main")
#: Elements without an end, elements that another of the same names ends, and the mark of a path's part that is outside by a word.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {name: group for group in (frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"p"})) for name in group}
MARK = "\x1f"
CELLS, LOOSE, DEPTH, HOSTS_A_BUCKET, LEAST_BUCKETS, SALTS = 1 << 16, 256, 100, 2000, 16, 32
#: Occurrences of a node apart that a repeated unit's ends may be.
APART = 4
#: Compiled hosts that a task holds and matching states that a host holds (memory, not limits), and the different pages that show a text to be template.
COMPILED_HELD, STATES_HELD, SAME_ON = 1024, 4096, 3

Node = tuple  # ("s", symbol) | ("+", nodes) | ("?", nodes)
TEXT: Node = ("s", "#")
State = tuple  # (positions, {symbol: (positions with those before, state after)})


class Page:
    """Tokens of one page: symbols, and for each text its container path, the text, and whether a link holds it."""

    __slots__ = ("symbols", "texts", "places")

    def __init__(self, source: str) -> None:
        self.symbols: list[str] = []
        self.places: dict[int, int] = {}  # number of a text: its symbol's number
        self.texts: list[tuple[str, str, bool]] = []  # (path, text or "" for a line break, in a link)
        stack: list[tuple[str, str]] = []  # name and path
        open_names: dict[str, int] = {}
        heads: list[str] = []
        path, link = "", 0
        for match in TOKEN.finditer(source):
            raw, slash, name, attributes, text = match.groups()
            if text is not None:
                if text.isspace():
                    self.texts.append((path, " ", link > 0))
                    continue
                if not self.symbols or self.symbols[-1] != "#":
                    self.symbols.append("#")
                self.places[len(self.texts)] = len(self.symbols) - 1
                self.texts.append((path, text, link > 0))
                continue
            if name is None:
                continue
            name = name.lower()
            if name == "a":
                link = max(0, link + (-1 if slash else 1))
            found = CLASS.search(attributes) if attributes and not slash else None
            symbol = f"<{slash}{name}" + (f".{DIGITS.sub('0', found[1].lower())}" if found else "")
            self.symbols.append(symbol)
            if name not in INLINE:
                self.texts.append((path, "", link > 0))
            held = name in CONTAINERS or name in OUTSIDE
            if slash:
                if open_names.get(name):
                    while True:
                        ended = stack.pop()[0]
                        open_names[ended] -= 1
                        if ended == name:
                            break
                    path = stack[-1][1] if stack else ""
                continue
            if name not in INLINE and stack and stack[-1][0] not in CONTAINERS and (stack[-1][0] == "p" or name in ENDS.get(stack[-1][0], ())):
                open_names[stack.pop()[0]] -= 1  # its end is left out
                path = stack[-1][1] if stack else ""
            marked = bool(attributes) and name not in ("html", "body") and outside_by_word(attributes)
            if name not in VOID and (held or marked or open_names.get(name)):
                part = symbol[1:].replace("/", "_") + (MARK if marked else "")
                if len(stack) < DEPTH or (outside(part) and not outside(path.rpartition("/")[2])):
                    path = f"{path}/{part}" if stack else part
                stack.append((name, path))
                open_names[name] = open_names.get(name, 0) + 1
            if name in ("h1", "main"):
                heads.append(path)
        if MARK in "".join({p for p, _, _ in self.texts}):
            self.unframed(heads)

    def unframed(self, heads: list[str]) -> None:
        """Take the mark from elements that frame the page: no text is main without them, or they hold its h1 or main element and at least as much."""
        sums: dict[str, int] = {}
        for path, text, link in self.texts:
            if not link:
                sums[path] = sums.get(path, 0) + len(text.strip())
        frames: dict[str, str] = {}

        def plain(path: str) -> str:
            """The path without the marks of frames."""
            parts = path.split("/")
            return "/".join(frames.get("/".join(parts[: i + 1]), part) for i, part in enumerate(parts))

        mass: dict[str, int] = {}
        for path, size in sums.items():
            parts = path.split("/")
            for i, part in enumerate(parts):
                if part.endswith(MARK):
                    top = "/".join(parts[: i + 1])
                    mass[top] = mass.get(top, 0) + size
        least = sum(n for p, n in sums.items() if not any(outside(x) for x in p.split("/")))  # a frame holds as much
        for path in sorted((p for p, n in mass.items() if n >= max(least, 1)), key=lambda p: (p.count("/"), p)):
            above, _, part = path.rpartition("/")
            if any(outside(x) for x in plain(above).split("/")):
                continue
            open_ = sum(n for p, n in sums.items() if not any(outside(x) for x in plain(p).split("/")))
            frames[path] = part[:-1]
            inside = sum(n for p, n in sums.items() if not any(outside(x) for x in plain(p).split("/"))) - open_
            headed = any(h.startswith(path + "/") or h == path for h in heads)
            if not inside or not (open_ == 0 or (headed and inside >= open_)):
                del frames[path]
        if frames:
            self.texts = [(plain(p), text, link) for p, text, link in self.texts]

    def blocks(self) -> list[Block]:
        """Runs of text of one path without a line break."""
        out: list[Block] = []
        run: Block | None = None
        for number, (path, text, link) in enumerate(self.texts):
            if not text:
                run = None
                continue
            if run is None or run.path != path:
                run = Block(path, run is not None)
                out.append(run)
            run.texts.append(text)
            if number in self.places:
                run.sums[link] += len(text)
                if run.place is None:
                    run.place = self.places[number]
        return out


class Block:
    """A run of text: its container path, the number of its first text's symbol, characters of plain and of link text."""

    __slots__ = ("path", "glued", "place", "texts", "sums")

    def __init__(self, path: str, glued: bool) -> None:
        self.path, self.glued = path, glued  # glued: no line break before
        self.place: int | None = None
        self.texts: list[str] = []
        self.sums = [0, 0]

    def text(self) -> str:
        return " ".join("".join(self.texts).split())


class Automaton:
    """The positions of a wrapper and which may follow which, to match pages. Positions share the maps of what follows them."""

    __slots__ = ("symbols", "follow", "named", "states")

    def __init__(self, wrapper: list) -> None:
        self.symbols: list[str] = []
        self.follow: list[list[dict[str, list[int]]]] = []
        first, _, _ = self.sequence(wrapper)
        self.follow.append([])  # the start is the last state
        self.link([len(self.symbols)], first)
        self.states: dict[tuple[int, ...], State] = {}
        self.named: dict[str, list[int]] = {}
        for at, symbol in enumerate(self.symbols):
            self.named.setdefault(symbol, []).append(at)

    def link(self, sources: list[int], targets: list[int]) -> None:
        if sources and targets:
            shared: dict[str, list[int]] = {}
            for q in targets:
                shared.setdefault(self.symbols[q], []).append(q)
            for p in sources:
                self.follow[p].append(shared)

    def after(self, p: int, symbol: str) -> list[int]:
        return [q for own in self.follow[p] for q in own.get(symbol, ())]

    def sequence(self, nodes: list, free: bool = False) -> tuple[list[int], list[int], bool]:
        """First positions, last positions, whether nothing matches too; ``free``: all may follow all, which a link around says."""
        first: list[int] = []
        last: list[int] = []
        empty = True
        for kind, inner in nodes:
            if kind == "s":
                f = l = [len(self.symbols)]
                nothing = False
                self.symbols.append(inner)
                self.follow.append([])
            else:
                f, l, nothing = self.sequence(inner, kind == "+" and all(k == "?" for k, _ in inner))
                if kind == "+":
                    self.link(l, f)
                nothing = nothing or kind == "?"
            if not free:
                self.link(last, f)
            if empty:
                first += f
            if nothing:
                last += l
            else:
                last = list(l)
            empty = empty and nothing
        return first, last, empty

    def state(self, positions: tuple[int, ...]) -> State:
        """The positions that a page may be at, with the steps from there that were taken before."""
        if positions not in self.states:
            self.states[positions] = (positions, {})
        return self.states[positions]

    def step(self, now: State, symbol: str) -> tuple[dict[int, int] | None, State]:
        """Each position that follows with the one before it, and the state after; none for a symbol that the wrapper hasn't."""
        found: dict[int, int] = {}
        asked: set[int] = set()
        for p in now[0]:
            for own in self.follow[p]:
                if id(own) not in asked:
                    asked.add(id(own))
                    for q in own.get(symbol, ()):
                        found.setdefault(q, p)
        if not found:
            found = dict.fromkeys(self.named.get(symbol, ()), now[0][0])
        return (found, self.state(tuple(found))) if found else (None, now)

    def match(self, symbols: list[str]) -> list[int]:
        """The position of each symbol; -1 for one that the wrapper hasn't. Where no position follows, matching goes on at any of that symbol."""
        if len(self.states) > STATES_HELD:
            self.states.clear()
        now = self.state((len(self.symbols),))
        steps: list[dict[int, int] | None] = []
        for symbol in symbols:
            known = now[1].get(symbol)
            if known is None:
                known = now[1][symbol] = self.step(now, symbol)
            found, now = known
            steps.append(found)
        at = now[0][0]
        out = [-1] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            if (step := steps[i]) is not None:
                out[i] = at
                at = step[at]
        return out


def units(ids: np.ndarray) -> list[int]:
    """Lengths that a repeated unit may have: how far equal nodes are apart, ascending."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    apart = [(order[k:] - order[:-k])[own[k:] == own[:-k]] for k in range(1, min(APART, len(ids) - 1) + 1)]
    found = np.unique(np.concatenate(apart)) if apart else np.zeros(0, np.int64)
    return found[found <= len(ids) // 2].tolist()


def repeats(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, copies) of every tandem repeat of this unit length, left to right."""
    same = np.concatenate([[False], ids[:-size] == ids[size:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    enough = length >= size
    return list(zip(start[enough].tolist(), (length[enough] // size + 1).tolist(), strict=True))


def folded(nodes: list[Node]) -> list[Node]:
    """Tandem repeats as repeated groups, shortest units first; lone occurrences of a repeated unit are such groups too."""
    bodies: list[tuple] = []
    number: dict[Node, int] = {}
    again = True
    while again:
        again = False
        ids = np.array([number.setdefault(n, len(number)) for n in nodes], np.int64)
        for size in units(ids):
            if found := repeats(ids, size):
                at, out = 0, []
                for start, copies in found:
                    body = tuple(nodes[start : start + size])
                    out += nodes[at:start]
                    out.append(("+", body) if size > 1 or body[0][0] != "+" else body[0])
                    bodies.append(body)
                    at = start + copies * size
                nodes, again = out + nodes[at:], True
                break
    return absorbed(nodes, [("+", body) for body in dict.fromkeys(bodies)])


def absorbed(nodes: list[Node], groups: list[Node]) -> list[Node]:
    """Runs that one of the repeated groups accepts become that group."""
    if not groups:
        return nodes
    members = set(groups)
    free: dict[Node, Node] = {}  # a node: the first group of optionals that has it
    whole: dict[Node, dict[tuple, Node]] = {}  # a body's first node: the groups by body
    accepted: dict[Node, set[Node]] = {}
    for group in groups:
        if all(part[0] == "?" for part in group[1]):
            accepted[group] = {n for part in group[1] for n in part[1]}
            for n in accepted[group]:
                free.setdefault(n, group)
        else:
            whole.setdefault(group[1][0], {}).setdefault(group[1], group)
    sizes = {head: sorted({len(b) for b in bodies}) for head, bodies in whole.items()}
    out: list[Node] = []
    at = 0
    while at < len(nodes):
        node, start = nodes[at], at
        group = node if node[0] == "+" and node in members else None
        for size in sizes.get(node, ()) if group is None else ():
            if group := whole[node].get(tuple(nodes[at : at + size])):
                break
        group = group or free.get(node)
        if group is None:
            out.append(node)
            at += 1
            continue
        body, own = group[1], accepted.get(group)
        while at < len(nodes):
            if nodes[at] == group or (own is not None and nodes[at] in own):
                at += 1
            elif own is None and nodes[at] == body[0] and tuple(nodes[at : at + len(body)]) == body:
                at += len(body)
            else:
                break
        if any(n != TEXT for n in nodes[start:at]):  # a text alone is a slot, not a group
            out.append(group)
        else:
            out += nodes[start:at]
    return out


def symbols_of(nodes) -> list[str]:
    return [x for kind, inner in nodes for x in ([inner] if kind == "s" else symbols_of(inner))]


def loosened(node: Node) -> Node:
    """A group of more than ``LOOSE`` symbols becomes a repeated choice of its different symbols, so that a wrapper stays short."""
    own = symbols_of(node[1])
    return ("+", tuple(("?", (("s", x),)) for x in dict.fromkeys(own))) if len(own) > LOOSE else node


def alike(a: Node, b: Node) -> int:
    """How well two nodes match: 2 if equal, 1 for repeated groups with the same first node, else 0."""
    if a == b:
        return 2
    return int(a[0] == b[0] == "+" and bool(a[1]) and bool(b[1]) and a[1][0] == b[1][0])


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, in which the second ascends too."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for at, (_, j) in enumerate(pairs):
        spot = bisect_left(tails, j)
        if spot:
            before[at] = last[spot - 1]
        tails[spot : spot + 1] = [j]
        last[spot : spot + 1] = [at]
    out = []
    at = last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def tabled(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of the best common subsequence, by its table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            score = alike(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + score if score else 0)
    out: list[tuple[int, int]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        score = alike(a[i], b[j])
        if score and best[i][j] == best[i + 1][j + 1] + score:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def matched(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of alike nodes, ascending in both."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        wide, high = i_end - i, j_end - j
        if wide * high <= CELLS:
            out += [(i + x, j + y) for x, y in tabled(a[i:i_end], b[j:j_end])] if wide and high else []
            continue
        here, there = Counter(a[i:i_end]), Counter(b[j:j_end])
        spot = {n: y for y, n in enumerate(b[j:j_end], j) if there[n] == 1}
        anchors = ascending([(x, spot[n]) for x, n in enumerate(a[i:i_end], i) if here[n] == 1 and n in spot])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            open_ += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(edges, edges[1:], strict=False)]
        else:
            parts = -(-max(wide, high) // int(CELLS**0.5))
            cuts = [(i + wide * k // parts, j + high * k // parts) for k in range(parts + 1)]
            for (x, y), (p, q) in zip(cuts, cuts[1:], strict=False):
                out += [(x + u, y + v) for u, v in tabled(a[x:p], b[y:q])]
    return sorted(out)


def aligned(wrapper: list[Node], sample: list[Node]) -> list[Node]:
    """The smallest generalisation found of both."""
    sample = absorbed(sample, list(dict.fromkeys(n for n in wrapper if n[0] == "+")))
    wrapper = absorbed(wrapper, list(dict.fromkeys(n for n in sample if n[0] == "+")))
    if wrapper == sample:
        return wrapper

    def spread(nodes: list[Node], side: str) -> list[tuple[Node, str | None]]:
        return [pair for i, n in enumerate(nodes) for pair in ([(x, f"{side}{i}") for x in n[1]] if n[0] == "?" else [(n, None)])]

    left, right = spread(wrapper, "w"), spread(sample, "s")
    pairs = [*matched([n for n, _ in left], [n for n, _ in right]), (len(left), len(right))]
    out: list[tuple[Node, str | None]] = []
    i = j = 0
    for runs, (x, y) in enumerate(pairs):
        out += [(n, mark or f"a{runs}") for n, mark in left[i:x]]
        out += [(n, mark or f"b{runs}") for n, mark in right[j:y]]
        if x < len(left):
            (a, mark_a), (b, mark_b) = left[x], right[y]
            out.append((a if a == b else ("+", tuple(aligned(list(a[1]), list(b[1])))), mark_a or mark_b))
        i, j = x + 1, y + 1
    made: list[Node] = []
    for mark, run in groupby(out, key=lambda pair: pair[1]):
        nodes = tuple(n for n, _ in run)
        made += list(nodes) if mark is None else [loosened(("?", nodes))]
    return generalised(made)


def generalised(nodes: list[Node]) -> list[Node]:
    """Neighbouring optional and repeated groups whose nodes recur become one repeated group of optionals."""
    out: list[Node] = []
    for optional, run in groupby(nodes, key=lambda n: n[0] != "s"):
        items = list(run)
        if optional:
            parts = [x for n in items for x in (n[1] if n[0] == "?" else [n])]
            flat = [x for p in parts for x in ([y for o in p[1] for y in o[1]] if p[0] == "+" and all(o[0] == "?" for o in p[1]) else [p])]
            if len(set(flat)) < len(flat) and len(items) > 1:
                items = [loosened(("+", tuple(("?", (n,)) for n in dict.fromkeys(flat))))]
        out += items
    return out


class Host:
    """What is known of one host: its wrapper, and for each container path of its slots the pages, text and link text in it."""

    __slots__ = ("wrapper", "paths", "pages", "seen")

    def __init__(self) -> None:
        self.wrapper: list[Node] | None = None
        self.paths: dict[str, list[int]] = {}
        self.pages = 0
        self.seen: set[int] = set()

    def learn(self, page: Page) -> None:
        self.pages += 1
        mark = xxhash.xxh64_intdigest("\n".join(page.symbols))
        if mark not in self.seen:
            self.seen.add(mark)
            self.meet(folded([("s", s) for s in page.symbols]))
        own: dict[str, list[int]] = {}
        for path, text, link in page.texts:
            if text:
                sums = own.setdefault(path, [0, 0])
                sums[link] += len(text)
        for path, (plain, linked) in own.items():
            self.add(path, 1, plain, linked)

    def add(self, path: str, pages: int, plain: int, linked: int) -> None:
        sums = self.paths.setdefault(path, [0, 0, 0])
        for i, n in enumerate((pages, plain, linked)):
            sums[i] += n

    def meet(self, nodes: list[Node]) -> None:
        self.wrapper = nodes if self.wrapper is None else aligned(self.wrapper, nodes)

    def join(self, other: str) -> None:
        wrapper, paths, pages = json.loads(other)
        self.pages += pages
        for path, sums in paths.items():
            self.add(path, *sums)
        if wrapper is not None:
            self.meet([tupled(n) for n in wrapper])

    def packed(self) -> str:
        return json.dumps([self.wrapper, self.paths, self.pages])

    def main_paths(self) -> list[str]:
        """The container paths that are main text as far as names and sums tell."""
        return region(self.paths)


def region(paths: dict[str, list[int]], known: dict[str, list[int]] | None = None) -> list[str]:
    """Of paths with their pages, text and link text, those of main text; ``known``: the host's sums, where the paths are a page's."""
    open_ = {p: s for p, s in paths.items() if not any(outside(part) for part in p.split("/"))}
    for names in MAIN:
        inside = [p for p in open_ if any(part.split(".")[0] == names for part in p.split("/"))]
        if any(open_[p][1] for p in inside):
            return inside
    mass: dict[str, int] = {}
    for path, sums in open_.items():
        _, plain, linked = (known or {}).get(path, sums)
        parts = path.split("/")
        for depth in range(1, len(parts) + 1):
            top = "/".join(parts[:depth])
            mass[top] = mass.get(top, 0) + plain - linked
    if not mass:
        return list(open_)
    enough = 0.6 * max(mass.values())
    root = max((p for p, m in mass.items() if m >= enough), key=lambda p: (p.count("/"), mass[p], p))
    return [p for p in open_ if p == root or p.startswith(root + "/")]


class Slots:
    """What is known of the slots of a host's wrapper, each with the path of its texts: pages, occurrences, characters of text and of link
    text, the least and the greatest hash of its texts, and the least hashes of up to ``SAME_ON`` different pages."""

    __slots__ = ("slots",)

    def __init__(self) -> None:
        self.slots: dict[str, list] = {}

    def learn(self, page: Page, automaton: Automaton) -> None:
        own: dict[str, list] = {}
        blocks = page.blocks()
        mark = xxhash.xxh64_intdigest("\n".join(block.text() for block in blocks))
        for key, block in keyed(blocks, page, automaton):
            digest = xxhash.xxh64_intdigest(block.text())
            self.add(own, key, [1, 1, *block.sums, digest, digest, [mark]])
        for key, facts in own.items():
            self.add(self.slots, key, [1, *facts[1:]])

    @staticmethod
    def add(slots: dict[str, list], key: str, facts: list) -> None:
        known = slots.get(key)
        if known is None:
            slots[key] = facts
            return
        slots[key] = [*(a + b for a, b in zip(known[:4], facts[:4], strict=True)), min(known[4], facts[4]), max(known[5], facts[5]), sorted({*known[6], *facts[6]})[:SAME_ON]]

    def join(self, other: str) -> None:
        for key, facts in json.loads(other).items():
            self.add(self.slots, key, facts)

    def packed(self) -> str:
        return json.dumps(self.slots)

    def boilerplate(self) -> list[str]:
        """Slots that are template (the same on different pages) or repeated groups of links."""
        return [key for key, (pages, n, plain, linked, low, high, marks) in self.slots.items() if (low == high and len(marks) >= SAME_ON) or (n > pages and linked > plain)]

    def sums(self) -> dict[str, list[int]]:
        """Pages, text and link text of each path, without boilerplate."""
        left = Host()
        without = set(self.boilerplate())
        for key, (pages, _, plain, linked, *_) in self.slots.items():
            if key not in without:
                left.add(key.split(" ", 1)[1], pages, plain, linked)
        return left.paths


def keyed(blocks: list[Block], page: Page, automaton: Automaton) -> list[tuple[str, Block]]:
    """Blocks with a text, each with its slot and path."""
    positions = automaton.match(page.symbols)
    return [(f"{positions[b.place]} {b.path}", b) for b in blocks if b.place is not None]


def outside(part: str) -> bool:
    return part.endswith(MARK) or part.partition(".")[0] in OUTSIDE


def outside_by_word(attributes: str) -> bool:
    return any(OUTSIDE_WORD.search(word) for found in WORDS.finditer(attributes) for value in found.groups() if value for word in value.split())


def tupled(node: list) -> Node:
    return (node[0], node[1]) if node[0] == "s" else (node[0], tuple(tupled(n) for n in node[1]))


def shown(nodes: list[Node] | tuple) -> str:
    """The wrapper as an expression: tags as they are, # for a text slot, ( )+ and ( )? for groups."""
    return " ".join(f"{n[1]}>" if n[0] == "s" and n[1] != "#" else n[1] if n[0] == "s" else f"({shown(n[1])}){n[0]}" for n in nodes)


def host_of(url: str | None) -> str:
    match = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return match[1].lower() if match else ""


PARTIAL = "host string, salt int, wrapper string"


def decoded(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def gathered(pages: DataFrame, make: type, learner) -> DataFrame:
    """One row for each host: what all its pages (columns url and html) tell, packed. ``learner()`` gives a task's function of host, what is known, and page."""

    def each_task(batches):
        learn = learner()
        hosts: dict[str, Host | Slots] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for url, source in zip(decoded(part, "url"), decoded(part, "html"), strict=True):
                    name = host_of(url)
                    if name not in hosts:
                        hosts[name] = make()
                    learn(name, hosts[name], Page(source or ""))
                if len(hosts) > 4096:  # memory, not a limit: what is left out here meets in the next step
                    yield rows(hosts)
                    hosts.clear()
        yield rows(hosts)

    def rows(hosts: dict) -> pa.RecordBatch:
        packed = [h.packed() for h in hosts.values()]
        salts = [xxhash.xxh32_intdigest(p) % SALTS for p in packed]
        return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array(salts, pa.int32()), pa.array(packed, pa.string())], names=["host", "salt", "wrapper"])

    def together(table: pa.Table) -> pa.Table:
        host = make()
        for packed in sorted(table["wrapper"].to_pylist()):
            host.join(packed)
        return pa.table({"host": table["host"][:1].cast(pa.string()), "salt": pa.array([0], pa.int32()), "wrapper": pa.array([host.packed()], pa.string())})

    partial = pages.select("url", "html").mapInArrow(each_task, PARTIAL)
    return partial.groupBy("host", "salt").applyInArrow(together, PARTIAL).groupBy("host").applyInArrow(together, PARTIAL).drop("salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """One row for each host: the packed wrapper inferred from all its pages (columns url and html)."""
    return gathered(pages, Host, lambda: lambda name, host, page: host.learn(page))


def slots(pages: DataFrame, uri: str, buckets: int) -> DataFrame:
    """One row for each host: the packed slots that its pages fill in the stored wrapper."""

    def learner():
        known = Known(uri, "hosts", buckets, Automaton)
        return lambda name, own, page: own.learn(page, known[name])

    return gathered(pages, Slots, learner)


def bucket_of(host: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(host) % buckets


def key_of(host: str) -> int:
    return xxhash.xxh64_intdigest(host)


class Known:
    """Stored hosts by name, found in their bucket's index and compiled as they are met."""

    def __init__(self, uri: str, kind: str, buckets: int, compiled) -> None:
        self.stored, self.kind, self.buckets, self.compiled = Held(Shelf(uri), lambda raw: raw), kind, buckets, compiled
        self.ready: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.ready:
            own = self.stored[f"{self.kind}-{bucket_of(name, self.buckets)}"]
            at = int(np.searchsorted(own["key"], np.uint64(key_of(name))))
            while True:  # names of equal keys stand side by side
                host, kept = json.loads(own["json"][own["start"][at] : own["start"][at + 1]].tobytes())
                if host == name:
                    break
                at += 1
            if len(self.ready) >= COMPILED_HELD:
                self.ready.clear()
            self.ready[name] = self.compiled(kept)
        return self.ready[name]


def wrapper_of(packed: str) -> list:
    return json.loads(packed)[0] or []


def main_of(packed: str) -> list:
    own = Slots()
    own.join(packed)
    sums = own.sums()
    if not any(plain for path, (_, plain, _) in sums.items() if not any(outside(part) for part in path.split("/"))):
        return [[], {}]  # all pages say the same, so that is their text
    return [own.boilerplate(), sums]


def store(found: DataFrame, uri: str, buckets: int, kind: str = "hosts", kept=wrapper_of) -> None:
    """Write what is kept of the hosts' wrappers (or slots), one file with an index for each bucket of hosts."""

    def bucketed(batches):
        for batch in batches:
            own = [bucket_of(h, buckets) for h in decoded(batch, "host")]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1)], names=["bucket", "host", "wrapper"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted((key_of(name), json.dumps([name, kept(packed)]).encode()) for name, packed in zip(table["host"].to_pylist(), table["wrapper"].to_pylist(), strict=True))
        arrays = {
            "key": np.array([k for k, _ in rows], np.uint64),
            "start": np.cumsum([0, *(len(text) for _, text in rows)]),
            "json": np.frombuffer(b"".join(text for _, text in rows), np.uint8),
        }
        Shelf(uri).put(f"{kind}-{key[0].as_py()}", arrays)
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    rows = found.select("host", "wrapper").mapInArrow(bucketed, "bucket int, host string, wrapper string")
    rows.groupBy("bucket").applyInArrow(write, "n long").groupBy().sum("n").collect()


def learned(pages: DataFrame, folder: str) -> tuple[str, int]:
    """Infer and store the wrappers of all hosts; give the place of the stored ones and the number of buckets."""
    found = keep(wrappers(pages), folder, "found")
    uri, buckets = f"{folder}/wrappers", max(LEAST_BUCKETS, found.count() // HOSTS_A_BUCKET)
    store(found, uri, buckets)
    return uri, buckets


def main_text(page: Page, automaton: Automaton, boilerplate: set[str], known: dict[str, list[int]]) -> str:
    """The texts of main slots: references decoded, white space as one space, blocks joined by one space."""
    left = [block for key, block in keyed(page.blocks(), page, automaton) if key not in boilerplate]
    own = Host()
    for block in left:
        own.add(block.path, 1, *block.sums)
    main = set(region(own.paths, known))
    pieces = [piece for block in left if block.path in main for piece in ("" if block.glued else " ", *block.texts)]
    return " ".join(references.unescape("".join(pieces)).split())


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Match every page against the stored wrapper of its host, store what the slots hold, and take each page's main slots."""
    store(slots(pages, uri, buckets), uri, buckets, "slots", main_of)

    def each_task(batches):
        automata = Known(uri, "hosts", buckets, Automaton)
        decided = Known(uri, "slots", buckets, lambda own: (set(own[0]), own[1]))
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for url, source in zip(decoded(part, "url"), decoded(part, "html"), strict=True):
                    name = host_of(url)
                    out.append(main_text(Page(source or ""), automata[name], *decided[name]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each_task, EXTRACTED)


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, *learned(pages, shared_dir(spark)))

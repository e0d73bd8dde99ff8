"""Personal data: generators propose spans, boosted trees choose among them.

The base rules (e-mail, IP address, card and telephone number) always stand.
High-recall generators propose further spans, overlapping ones too: numbers in
telephone shapes without a plus, obfuscated e-mail addresses, addresses at hosts
without a dot, card-like numbers with other separators, IPv6-like groups. Boosted trees
score each by its format and its context; the threshold of a kind is calibrated
on held-out examples to the precision ASKED. Of the chosen spans the best scored
ones that overlap neither a base span nor each other are added.

The trees learn, on the driver and without any table, from examples that a
seeded generator writes; so nothing here depends on the data.

Positions are code points, ends exclusive. Defined results: null and empty
texts have no spans. Repeated documents each get a row. Other columns are not
read. A text of any length is scanned in linear time: numbers are first cut
into runs, e-mail addresses are expanded from their `@`, and groups from a pair
of colons.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow.llm import boosting, text as X

KINDS = ("email", "ip", "card", "phone")
#: Groups of spans that trees of their own choose among.
FURTHER = ("groups", "host")
ASKED = 0.99

#: Every match of the numeric rules lies in such a run.
_RUN = re.compile(r"\+?+[0-9][0-9 ().+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """The spans of the base rules, by kind and then start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out["email"].append(("email", start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)  # no address reaches over this sign
        at = text.find("@", max(free, at + 1))
    for first, last in runs if runs is not None else numeric_runs(text):
        for m in _IP.finditer(text, first, last):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(("ip", *m.span()))
        for m in _CARD.finditer(text, first, last):
            if m.end() - m.start() < 40 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out["card"].append(("card", *m.span()))
        for m in _PHONE.finditer(text, first, last):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out["phone"].append(("phone", *m.span()))
    return [s for k in KINDS for s in out[k]]


def numeric_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


_SHAPES = [
    ("phone", re.compile(r"(?<![0-9])\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])0[0-9]{2,4}[ /-][0-9]{4,8}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])[0-9]{10,11}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")),
]
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)


_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*+)(?![A-Za-z0-9@]|\.[A-Za-z0-9-])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX = frozenset("0123456789ABCDEFabcdef:")


def dotless(text: str) -> Iterator[Span]:
    """Addresses at a host without a dot; of a chain of them the last one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
        free = at + 1
        at = text.find("@", free)


def hex_groups(text: str) -> Iterator[Span]:
    """Runs of hexadecimal groups and colons with two colons at least, without groups that are cut from a word before."""
    m = _COLONS.search(text)
    while m:
        start, end = m.span()
        while start > 0 and text[start - 1] in _HEX:
            start -= 1
        while end < len(text) and text[end] in _HEX:
            end += 1
        after = end
        if start > 0 and text[start - 1].isalnum():
            start = text.index(":", start) + 1
        elif text[start] == ":" and text[start + 1] != ":":
            start += 1
        if text[end - 1] == ":" and text[end - 2] != ":":
            end -= 1
        if text.count(":", start, end) >= 2:
            yield "ip", start, end
        m = _COLONS.search(text, after)


def groups_fit(body: str) -> bool:
    """Whether it is an IPv6 address in hexadecimal groups."""
    if len(body) > 39 or body.count("::") > 1 or ":::" in body:
        return False
    groups = body.split(":")
    if "::" in body:
        named = [g for g in groups if g]
        return 1 <= len(named) <= 7 and all(len(g) <= 4 for g in named) and (groups[0] != "" or body.startswith("::")) and (groups[-1] != "" or body.endswith("::"))
    return len(groups) == 8 and all(1 <= len(g) <= 4 for g in groups)


def proposals(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """High-recall candidates of every kind; they may overlap."""
    found: set[Span] = set()
    for first, last in runs:
        if last - first >= 7:
            for kind, shape in _SHAPES:
                for m in shape.finditer(text, max(0, first - 1), last):
                    found.add((kind, *m.span()))
    low = text.lower()
    if any(sign in low for sign in ("[at]", "(at)", "[at)", "(at]")):
        found.update(("email", *m.span()) for m in _HIDDEN.finditer(text))
    found.update(dotless(text))
    found.update(hex_groups(text))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


#: Words that speak for or against a kind when they stand before a span.
_HINTS = {
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "whatsapp", "dial", "tél", "telefon", "llam"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "address", "ping", "gateway", "dns"),
    "email": ("mail", "contact", "write", "reach", "@"),
    "other": ("version", "isbn", "order", "invoice", "id", "no.", "page", "build", "release", "ref", "ticket", "#", "=", "section", "v"),
}
#: Hosts without a dot, and words behind an `@` that name none.
_HOSTS = ("localhost", "localdomain", "mailhost", "mail", "intranet", "gateway", "server", "router", "host", "exchange", "smtp", "nas", "workstation", "laptop", "desktop", "web", "db", "node")
_NO_HOSTS = ("latest", "next", "beta", "alpha", "canary", "stable", "main", "master", "head", "staticmethod", "property", "override", "home", "work", "the", "gmail")


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body = text[start:end]
    digits = [c for c in body if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    before, after = text[max(0, start - 28) : start].lower(), text[end : end + 2]
    near = before[-14:]
    parts = body.split(".")
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(digits)), float(len(groups)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(len(digits) >= 12 and luhn("".join(digits)) if digits and all(c in "0123456789" for c in digits) else 0), float(body.startswith("(") and ")" in body), float(body.count("-")), float(body.count(".")), float(body.count(" ")),
        float(len(set(digits))), float(bool(digits) and digits[0] == "0"), float(max((int(p) for p in parts if p.isdecimal() and len(p) < 6), default=-1)),
        float(before[-1:].isalnum()), float(before[-1:] in "#=$€£/_"), float(after[:1].isalnum()), float(after[:1] in "%€$/_"),
        *(float(any(re.search(rf"(?<![a-zé]){re.escape(w)}", before) for w in words)) for words in _HINTS.values()),
        *(float(any(w in near for w in words)) for words in (_HINTS["phone"], _HINTS["card"], _HINTS["other"])),
        float("at" in body.lower() and kind == "email"), float("dot" in body.lower()),
    ]


def further_features(text: str, span: Span) -> list[float]:
    """As features(), with what tells hosts without a dot and hexadecimal groups."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - 1) : start]
    local, _, host = body.partition("@")
    host = host.lower()
    fit = kind == "ip" and groups_fit(body)
    return features(text, span) + [
        float(body.count(":")), float(fit), float(sum(map(bool, body.split(":"))) if fit else 0), float("::" in body), float(before in ("[", "(")),
        float("@" in body), float(len(local) if host else 0), float(len(host)), float(host[:1].isdigit()), float(host.isdigit()), float(any(w.rstrip("0123456789") in _HOSTS for w in host.split("-"))), float(host in _NO_HOSTS), float(any(c.isalpha() for c in local) if host else 0),
    ]


def group(span: Span, text: str) -> str:
    """What a span's threshold goes by: its kind, or that it is of hexadecimal groups or has a host without a dot."""
    kind, start, end = span
    return "groups" if kind == "ip" and text.find(":", start, end) >= 0 else "host" if kind == "email" and text.find("@", start, end) >= 0 else kind


def examples(seed: int, n: int) -> list[tuple[str, Span, int]]:
    """Texts, a candidate each, and whether it is personal data, written by a seeded generator."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good: bool) -> str:
        body = r.choice("3456") + digits(14)
        check = next(str(c) for c in range(10) if luhn(body + str(c)))
        return body + (check if good else str((int(check) + r.randint(1, 9)) % 10))

    out = []
    while len(out) < n:
        hint = {k: r.choice(v) for k, v in _HINTS.items()}
        case = r.randrange(12)
        lead = " ".join(word() for _ in range(r.randint(1, 4)))
        if case == 0:
            s, kind, y = f"({digits(3)}) {digits(3)}-{digits(4)}", "phone", 1
            lead += r.choice(["", f" {hint['phone']}", f" {hint['phone']}:"])
        elif case == 1:
            s, kind, y = r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)}-{digits(7)}", digits(10)]), "phone", 1
            lead += f" {hint['phone']}" + r.choice(["", ":", " me at", " us on"])
        elif case == 2:
            s, kind, y = r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", digits(10), digits(11), f"{digits(3)} {digits(3)} {digits(3)}", f"0{digits(2)}/{digits(6)}"]), "phone", 0
            lead += r.choice([f" {hint['other']}", f" {hint['other']}:", ""])
        elif case == 3:
            s, kind, y = r.choice([f"{r.randint(1900, 2030)} {digits(4)} {digits(4)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)} {digits(4)}"]), "phone", 0
        elif case == 4:
            c = card(True)
            s, kind, y = r.choice(["{}.{}.{}.{}", "{}  {}  {}  {}", "{}--{}--{}--{}"]).format(c[:4], c[4:8], c[8:12], c[12:]), "card", 1
            lead += r.choice([f" {hint['card']}", f" {hint['card']}:", ""])
        elif case == 5:
            c = card(False)
            s, kind, y = r.choice([c, "{}.{}.{}.{}".format(c[:4], c[4:8], c[8:12], c[12:])]), "card", 0
            lead += r.choice([f" {hint['other']}", f" {hint['card']}", ""])
        elif case == 6:
            s, kind, y = digits(r.randint(13, 19)), "card", 0
            lead += r.choice([f" {hint['other']}", ""])
        elif case == 7:
            s, kind, y = ".".join(str(r.randint(256, 999) if k == r.randrange(4) else r.randint(0, 999)) for k in range(4)), "ip", 0
            lead += r.choice([f" {hint['other']}", ""])
        elif case == 8:
            s, kind, y = r.choice(["{} [at] {} [dot] {}", "{}(at){}.{}", "{} (at) {} (dot) {}", "{}[at]{}[dot]{}"]).format(word(), word(), r.choice(["com", "org", "net", "de", "fr"])), "email", 1
            lead += r.choice([f" {hint['email']}", ""])
        elif case == 9:
            s, kind, y = r.choice(["{} (at) {}. {}", "{} (at) {} . {}"]).format(word(), word(), word()), "email", 0
        elif case == 10:
            s, kind, y = f"{digits(3)}-{digits(3)}-{digits(4)}", "phone", 0
            lead += f" {hint['other']} "
        else:
            s, kind, y = r.choice([digits(10), digits(11)]), "phone", 0
        joint = r.choice([" ", " ", " ", "=", "#"]) if y == 0 else " "
        text = f"{lead}{joint}{s}{r.choice([' ', '.', ',', ''])}{word()}" if y else f"{lead}{joint}{s}{r.choice([' ', '.', ',', '%', '/'])}{word()}"
        start = len(lead) + len(joint)
        out.append((text, (kind, start, start + len(s)), y))
    return out


def further(seed: int, n: int) -> list[tuple[str, Span, int]]:
    """As examples(): addresses at hosts without a dot, IPv6 addresses, and what looks like them."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    hexes = lambda least=1: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(least, 4)))

    def address() -> str:
        """An IPv6 address, with or without a run of zeros left out."""
        first = r.choice(["2001", "2a02", "2600", "fe80", "fd00", hexes(3)])
        if r.random() < 0.3:
            return ":".join([first, *(hexes() for _ in range(7))])
        if r.random() < 0.1:
            return f"::{r.choice([1, hexes()])}"
        head, tail = [first, *(hexes() for _ in range(r.randint(0, 3)))], [hexes() for _ in range(r.randint(0, 3))]
        return f"{':'.join(head)}::{':'.join(tail)}"

    out = []
    while len(out) < n:
        case = r.randrange(8)
        lead = " ".join(word() for _ in range(r.randint(1, 4)))
        joint, tail, y = " ", r.choice([" ", ".", ",", ";", ")", "\n"]) + word(), 0
        if case in (0, 1):
            s, kind, y = address(), "ip", 1
            lead += r.choice([f" {r.choice(_HINTS['ip'])}", f" {r.choice(_HINTS['ip'])}:", "", ""])
            joint, tail = r.choice([(" ", tail), (" ", tail), ("[", "]:" + digits(4)), (" ", "/64 " + word()), (" (", ") " + word()), ("=", tail), (" ", "%eth0")])
            if s.startswith("::"):
                lead, joint, tail = f"{lead} {r.choice(_HINTS['ip'])}", " ", " " + word()
        elif case == 2:
            s, kind = r.choice(["{}:{}:{}", "{}:{}:{}:{}"]).format(*(f"{r.randint(0, 59):02d}" for _ in range(4))), "ip"
            lead += r.choice(["", " at", f" {r.choice(_HINTS['other'])}", f" {r.choice(_HINTS['ip'])}"])
        elif case == 3:
            s, kind = ":".join(f"{r.randrange(256):02x}" for _ in range(r.choice([6, 6, 16, 20]))), "ip"
            lead += r.choice(["", f" {r.choice(_HINTS['ip'])}", f" {r.choice(_HINTS['other'])}"])
        elif case == 4:
            s, kind = r.choice([f"::{r.randint(1, 9)}", f"{r.randint(0, 99)}::{r.randint(1, 9)}", "::", f"{r.randint(0, 9)}:{r.randint(0, 99)}:{r.randint(1, 9)}"]), "ip"
            joint, tail = r.choice([("[", "]"), ("[", "]"), (" ", " " + word())]) if s != "::" else (" ", " " + word())
        elif case == 5:
            # words in hexadecimal letters on both sides of colons, and too many or too long groups
            s, kind = r.choice([f"{r.choice(['add', 'face', 'bed', 'a', 'dead', 'cafe', 'b', 'fade'])}::{r.choice(['add', 'bad', 'feed', 'c', 'decade', 'beef'])}", ":".join(hexes() for _ in range(r.choice([3, 4, 5, 7, 9, 12]))), ":".join([hexes(), digits(6), hexes()])]), "ip"
        elif case == 6:
            name = r.choice([word(), f"{word()}.{word()}", f"{word()}{r.randint(1, 99)}", "root", "admin", "postmaster"])
            s, kind, y = f"{name}@{r.choice(_HOSTS)}{r.choice(['', '', digits(1), '-' + digits(2)])}", "email", 1
            lead += r.choice([f" {r.choice(_HINTS['email'][:4])}", f" {r.choice(_HINTS['email'][:4])}:", "", " to", " from"])
            joint, tail = r.choice([(" ", tail), (" ", tail), (" <", "> " + word()), (" ", ":~$ " + word())])
            if r.random() < 0.3:
                # a host of any name, where the words before speak of mail
                s, lead = f"{name}@{word()}{r.choice(['', digits(1)])}", f"{lead} {r.choice(_HINTS['email'][:4])}{r.choice(['', ':', ' to', ' me at'])}"
        else:
            s, kind = r.choice([f"{word()}@{r.choice(_NO_HOSTS)}", f"{word()}@{digits(r.randint(1, 3))}", f"{digits(2)}@{digits(2)}", f"{digits(2)}@{word()}", f".@{word()}", f"{word()}@{r.choice('ABCWX')}", f"{r.choice('ABCWX')}@{r.choice('ABCWX')}", f"{word()}@{word()}"]), "email"
            lead += r.choice(["", f" {r.choice(_HINTS['other'])}"])
        start = len(lead) + len(joint)
        out.append((lead + joint + s + tail, (kind, start, start + len(s)), y))
    return out


@cache
def model(rows: int = 6000) -> tuple[tuple[boosting.Trees, boosting.Trees], dict[str, float]]:
    """The trees of the numbers and obfuscated addresses and those of FURTHER, and for each group the least threshold whose held-out precision is ASKED."""
    trees, limits = [], {}
    for written, described, groups, seed in ((examples, features, KINDS, 11), (further, further_features, FURTHER, 13)):
        known = written(seed, rows)
        x, y = np.array([described(t, s) for t, s, _ in known]), np.array([float(v) for *_, v in known])
        trees.append(boosting.train(x, y, rounds=50, depth=4))
        held = written(seed + 1, rows // 2)
        x, y = np.array([described(t, s) for t, s, _ in held]), np.array([v for *_, v in held])
        p = trees[-1].predict(x)
        for name in groups:
            own = np.array([group(s, t) == name for t, s, _ in held])
            order = np.argsort(-p[own], kind="stable")
            good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            fine = np.flatnonzero(good >= ASKED)
            limits[name] = max(0.5, float(p[own][order][fine[-1]])) if len(fine) and y[own].any() else 2.0
    return (trees[0], trees[1]), limits


def find(texts: list[str | None], trees: tuple[boosting.Trees, boosting.Trees], limits: dict[str, float]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans (by kind, then start)."""
    base: list[list[Span]] = []
    asked: tuple[list[tuple[int, Span, str]], ...] = ([], [])
    rows: tuple[list[list[float]], ...] = ([], [])
    for k, text in enumerate(texts):
        text = text or ""
        runs = numeric_runs(text)
        base.append(base_spans(text, runs))
        taken = sorted((s, e) for _, s, e in base[-1])
        reach = list(accumulate((e for _, e in taken), max))
        for span in proposals(text, runs):
            if not _overlaps(taken, reach, span):
                name = group(span, text)
                late = name in FURTHER
                asked[late].append((k, span, name))
                rows[late].append((further_features if late else features)(text, span))
    extra: list[list[Span]] = [[] for _ in texts]
    places: list[list[tuple[int, int]]] = [[] for _ in texts]
    chosen: list[tuple[int, float, Span]] = []
    for own, named, described in zip(trees, asked, rows):
        if described:
            p = own.predict(np.array(described))
            chosen += [(k, -score, span) for (k, span, name), score in zip(named, p.tolist()) if score >= limits[name]]
    for k, _, span in sorted(chosen):
        # the spans chosen so far lie apart, so the last that begins before the end is the only one to meet
        at = bisect_left(places[k], (span[2], -1))
        if not at or places[k][at - 1][1] <= span[1]:
            places[k].insert(at, span[1:])
            extra[k].append(span)
    rank = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(b + e, key=lambda s: (rank[s[0]], s[1], s[2])) if e else b) for b, e in zip(base, extra)]


def _overlaps(taken: list[tuple[int, int]], reach: list[int], span: Span) -> bool:
    """Whether one of the taken places, in order, overlaps the span; reach has the greatest end so far at each."""
    at = bisect_left(taken, (span[2], -1))
    return at > 0 and reach[at - 1] > span[1]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping ones, replaced by its first kind in brackets."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, base and all (arrays of kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            found = find(batch.column(1).to_pylist(), *held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(b) for b, _ in found], kind), pa.array([named(a) for _, a in found], kind)], names=["key", "base", "all"])

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, base {spans}, all {spans}")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced; the column `length`, if there is one, gets the new number of code points."""
    held = docs.sparkSession.sparkContext.broadcast(model())
    length = length if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            new = [t if not spans else redacted(t, spans) for t, (_, spans) in zip(texts, find(texts, *held.value))]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length:
                n = batch.schema.get_field_index(length)
                same = batch.column(n).to_pylist()
                batch = batch.set_column(n, batch.schema.field(n), pa.array([k if a is b else len(b) for a, b, k in zip(texts, new, same)], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op2_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(X.table(spark, sf_dir, "documents"))
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(spell("base"), 256).alias("base_sha256"), spell("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))

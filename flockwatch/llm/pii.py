"""Personal data: generators propose spans, boosted trees on format and context select them.

Base spans follow four patterns exactly (email, ip, card, phone) and always stay. Further
generators, tuned to miss nothing, propose overlapping spans in other formats; trees that
are trained here on drawn examples, many of which only the words around them decide, score each by its format and by these words,
a logistic curve through held-out margins turns scores into probabilities, and each kind
has a threshold that keeps held-out precision at `PRECISION` or more.

Scale: no shuffle; the model is a few thousand numbers, trained once on the driver from a
fixed seed. Every pattern is walked in one pass, so a text of any length costs time in
proportion. Only texts that hold a digit, an at sign or two colons are looked at closely.

Defined results: a null or empty text has no spans; the digest is then that of no bytes.
Chosen spans that overlap a base span or an earlier chosen span of higher probability go. A task
holds a text and its spans whole. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame

from .boosting import Boosted, calibrate
from .common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
PRECISION = 0.97
SEED = 11

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+")
_plus = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]|::|[\[(] ?at ?[\])]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        host = _domain.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str):
    for m in _dotted.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield "ip", at, at + length
            at += length + 1


def base_spans(text: str) -> list[Span]:
    """The four base kinds, by start, then kind."""
    spans = list(_emails(text))
    if re.search("[0-9]", text):
        spans += _addresses(text)
        for m in _digits.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        for m in _plus.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


#: What proposes spans beside the base patterns.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,3}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z_:])(?=[0-9A-Fa-f:]{0,35}::)(?=:*[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){0,7}+(?:::)?(?![0-9A-Za-z_:])")),
    ("phone", re.compile(r"(?<![0-9.+/-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{2,5}[ .-][0-9]{2,5}(?:[ .-][0-9]{2,4})?(?![0-9]|[./-][0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z_.+/-])(?:[0-9]{10}|\([0-9]{2,5}\)[0-9]{5,8})(?![0-9A-Za-z_]|[./-][0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+")),
)

#: Words that speak for a kind, and words that speak against any.
HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "address", "server", "addr"),
    "card": ("card", "visa", "master", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth"),
}
AGAINST = ("md5", "checksum", "digest", "etag", "trace", "request", "version", "isbn", "order", "part", "page", "date", "price", "serial", "build", "commit", "sha", "uuid", "invoice", "no.")

#: How keys of well-known services begin.
ISSUED = ("sk-", "AKIA", "ghp_", "xoxb-")


def proposals(text: str) -> list[Span]:
    if not _trigger.search(text):
        return []
    found = {(kind, m.start(), m.end()): None for kind, pattern in GENERATORS for m in pattern.finditer(text)}
    return [s for s in found if s[0] != "ip" or _address(text[s[1] : s[2]])]


def _address(body: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(body))
    except ValueError:
        return False


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context, as numbers."""
    kind, start, end = span
    body, left, right = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    digits = [c for c in body if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[A-Za-z0-9]+", body)]
    n = len(body)
    return [
        ORDER[kind],
        n,
        len(digits),
        len(digits) / n,
        sum(c.isupper() for c in body) / n,
        sum(c.islower() for c in body) / n,
        sum(c in "0123456789abcdefABCDEF" for c in body) / n,
        len(groups),
        max(groups),
        groups[0],
        groups[-1],
        len(set(body)) / n,
        float(bool(digits) and luhn("".join(digits))),
        body.count("."),
        body.count("-"),
        float("(" in body),
        float(any(w in left for w in HINTS[kind])),
        float(any(w in left or w in right for w in AGAINST)),
        float(left.rstrip().endswith((":", "=", '"', "'"))),
        _kind_of(left[-1:]),
        _kind_of(right[:1]),
        _mod97(body) if kind == "iban" else 0.0,
        sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:])) / n,
        float(body.startswith(ISSUED)),
        float(groups == [8, 4, 4, 4, 12]),
        float(groups == [3, 2, 4]),
    ]


def _mod97(body: str) -> float:
    flat = body.replace(" ", "")
    return float(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1) if flat.isalnum() and flat.isascii() else 0.0


def examples(n: int = 6000, seed: int = SEED):
    """Drawn texts, each with one span and whether it is personal data."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "ti", "lo", "re", "mo", "st", "au", "ch", "el")) for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    hexes = lambda k, s="0123456789abcdef": "".join(r.choice(s) for _ in range(k))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def iban(valid):
        country, rest = r.choice(("DE", "FR", "ES", "GB", "IT")), number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        return f"{country}{check if valid else (check + r.randint(1, 90)) % 97:02d}{rest}"

    def short(groups):
        left = r.randint(1, groups - 1)
        return ":".join(hexes(r.randint(1, 4)) for _ in range(left)) + "::" + ":".join(hexes(r.randint(1, 4)) for _ in range(groups - left))

    def good(kind):
        return {
            "email": lambda: f"{r.choice((word(), word(), hexes(1, 'abcdef'), word() + '.' + words(8).replace(' ', '')[:46]))}{r.choice(' .')}(at){r.choice(' ').strip()}{word()}{r.choice(('.', ' (dot) '))}{r.choice(('com', 'org', 'net', 'de'))}".replace(" (at)", "(at)"),
            "ip": lambda: r.choice((":".join(hexes(4) for _ in range(8)), r.choice(("2001:db8:", "fe80::", "2a02:")) + f"{hexes(4)}:{hexes(2)}", short(r.randint(3, 6)), "fe80::" + hexes(r.randint(1, 4)), "2001:" + hexes(3) + "::" + hexes(r.randint(1, 4)))),
            "phone": lambda: r.choice(("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "{}{}{}", "({}){}{}")).format(number(3), number(3), number(4)),
            "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
            "iban": lambda: iban(True),
            "secret": lambda: r.choice((hexes(r.choice((32, 40, 64))), hexes(r.randint(24, 48), alnum), issued(), issued())),
        }[kind]()

    def issued():
        """A key whose first characters say who gave it out."""
        return r.choice(("sk-" + hexes(32, alnum), "AKIA" + hexes(16, alnum[:26] + "234567"), "ghp_" + hexes(36, alnum), "xoxb-" + number(11) + "-" + hexes(24, alnum)))

    def bad(kind):
        return {
            "email": lambda: f"{word()} (at) {word()}. {word()}",
            "ip": lambda: r.choice((":".join(number(2) for _ in range(8)), f"{hexes(1, 'abcdef')}::{hexes(1, 'abcdef')}", f"{hexes(3, 'abcdef')}::{hexes(4, 'abcdef')}", f"{number(2)}::{number(2)}")),
            "phone": lambda: r.choice((number(10), f"1{number(9)}", f"{number(2)}.{number(2)} {number(2)}.{number(2)}", f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)} {number(4)}", f"{number(4)} {number(2)} {number(2)}", f"{number(2)} {number(2)} {number(2)}", f"{number(3)}-{number(2)}-{number(4)}", f"{number(3)}-{number(2)}-{number(4)}")),
            "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
            "iban": lambda: r.choice((iban(False), f"AB{number(2)} {number(4)} {number(4)}")),
            "secret": lambda: r.choice((f"{word()}_{word()}_{word()}_{number(2)}", f"{word()}-{word()}-{word()}-{number(4)}", number(16), f"{word()}{word()}{word()}{word()}{number(1)}{word()}", hexes(r.choice((32, 40, 64))), "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), "-".join(hexes(k) for k in (8, 4, 4, 4, 12)))),
        }[kind]()

    #: how often words speak for personal data, and against what only looks like it; a few speak wrongly
    said_for, said_against, wrongly = {"ssn": 0.8, "secret": 0.95}, {"ssn": 0.9, "secret": 0.7}, 0.03
    kinds = list(dict.fromkeys(kind for kind, _ in GENERATORS))
    while n:
        kind, positive = r.choice(kinds), r.random() < 0.5
        body = good(kind) if positive else bad(kind)
        known = body.startswith(ISSUED)
        hinted = r.random() < (0.5 if known else said_for.get(kind, 0.6)) if positive else r.random() < wrongly
        lead = f"{r.choice(HINTS[kind])}{r.choice((':', ' =', ' is', ''))} " if hinted else ""
        if not positive and not hinted and r.random() < said_against.get(kind, 0.6):
            lead = f"{r.choice(AGAINST)} "
        quote = '"' if r.random() < 0.3 else ""
        before = f"{words(r.randint(2, 8))} {lead}{quote}"
        text = f"{before}{body}{quote}{r.choice(('.', ',', ' ', ''))} {words(3)}"
        spans = [s for s in proposals(text) if s[0] == kind and s[1] >= len(before) - 2]
        if spans:
            yield text, spans[0], positive
            n -= 1


class Selector:
    """The trained trees, their calibration and a threshold for each kind."""

    def __init__(self, n: int = 6000):
        drawn = list(examples(n))
        x = np.array([features(text, span) for text, span, _ in drawn])
        y = np.array([float(ok) for *_, ok in drawn])
        half = n // 2
        self.trees = Boosted().fit(x[:half], y[:half])
        margin, kind = self.trees.margin(x[half:]), x[half:, 0]
        self.slope, self.offset = calibrate(margin, y[half:])
        p = self._p(margin)
        self.threshold = {}
        for name, number in ORDER.items():
            own = kind == number
            if not own.any():
                continue
            order = np.argsort(-p[own], kind="stable")
            hits = np.cumsum(y[half:][own][order]) / np.arange(1, own.sum() + 1)
            last = np.flatnonzero(hits >= PRECISION)
            self.threshold[name] = max(0.5, float(p[own][order][last[-1]])) if len(last) else 1.1

    def _p(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))

    def chosen(self, text: str, base: list[Span]) -> list[Span]:
        """Proposed spans that pass and overlap neither base spans nor better ones."""
        held = Apart()
        for _, start, end in sorted(base, key=lambda s: s[1:]):
            held.add(start, end)
        found = [s for s in proposals(text) if held.free(s[1], s[2])]
        if not found:
            return []
        p = self._p(self.trees.margin(np.array([features(text, s) for s in found])))
        taken: list[Span] = []
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][1], ORDER[found[k][0]])):
            kind, start, end = found[k]
            if p[k] >= self.threshold.get(kind, 1.1) and held.free(start, end):
                held.add(start, end)
                taken.append(found[k])
        return taken


class Apart:
    """Stretches in their order, those that overlap as one; each question is a search by halves."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return (at == 0 or self.ends[at - 1] <= start) and (at == len(self.starts) or self.starts[at] >= end)

    def add(self, start: int, end: int) -> None:
        low, high = bisect_left(self.ends, start + 1), bisect_left(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kinds in it."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256 and spans (all of them)."""
    selector = Selector()

    def make():
        def work(texts):
            rows = []
            for raw in texts:
                text = raw.decode()
                base, more = [], []
                if _trigger.search(text):
                    base = base_spans(text)
                    more = selector.chosen(text, base)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            return list(zip(*rows))

        return work

    return map_texts(docs, list(keep), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)

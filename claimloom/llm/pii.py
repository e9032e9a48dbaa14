"""Personal data: candidate generators, boosted trees over format and context, calibrated thresholds.

Spans with a fixed form (e-mail addresses, IP addresses, payment cards, international phone numbers) are always
taken. High-recall generators then propose overlapping spans of further forms: national phone numbers (every window of
digit groups, so neighbours and leading figures hide none), mail addresses written out with "at" and "dot", secrets,
account and identity numbers, hardware and IPv6 addresses, dates of birth, street addresses. Boosted trees score each
candidate from its format and the text around it; the score is calibrated, and each kind is taken from the threshold
on at which examples reach ``PRECISION``. Of overlapping candidates the most probable stays. Names of people alone are no
kind: no form tells them from other words.

The trees are trained here from ``EXAMPLES`` labelled examples made by rule from a seed; that number bounds the
training set, which never depends on the corpus. Trees, calibration, thresholds and the report each have examples of
their own. Scoring is one pass over each partition, without a shuffle.

Defined results: a null or empty text has no spans; offsets count code points; a very long text is searched whole in
linear time; repeated rows are searched each; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, calibrate, threshold
from .common import lean, small

#: Kinds in the order in which spans that start together are listed; the first four have fixed forms.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "identity", "device", "birthdate", "street")
BASE = KINDS[:4]
EXAMPLES, SEED, PRECISION, CONTEXT = 9000, 11, 0.99, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match from inside a run of digits exists only where one from its start does, so looking behind loses none
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = sum(map(int, digits[-1::-2])), sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, leftmost and non-overlapping for each kind; failing matches are dropped."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[tuple]) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Runs of tokens that hold a digit; the generators look at nothing else but written-out addresses.
_ISLAND = re.compile(r"\S*+")
_NUMBER = re.compile(r"\(?[0-9](?:[0-9]|[ ().\-/](?=[0-9(). \-/]))*[0-9]")
_SECRET = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:[:\-][0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", re.I)
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9-]+)+", re.I)
#: Words that streets are named with, before or after the name, and names of months.
_STREET = re.compile(
    r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,? (?:[A-Z][\w'.-]{0,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place)\b\.?"
    r"|(?<![0-9A-Za-z])[0-9]{1,5}(?: ?bis)?,? (?:rue|avenue|boulevard|place|allée) (?:\w[\w'’-]{0,30} ){0,3}[A-ZÀ-Ý][\w'’-]{0,30}"
    r"|\b[A-ZÄÖÜ][\wäöüß-]{1,30}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?\b"
    r"|\b(?:Calle|calle|Avenida|Avda\.|Plaza|Paseo) (?:de |del |la |los ){0,2}[A-ZÁ-Ú]\w{1,30}(?: [A-ZÁ-Ú]\w{1,30})?,? (?:n[.º°]+ ?)?[0-9]{1,4}\b"
)
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
_DATE = re.compile(rf"(?<![0-9A-Za-z.])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)? (?:de )?(?:{_MONTH}) (?:de )?(?:19|20)[0-9]{{2}}|(?:{_MONTH}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})(?![0-9A-Za-z])")
_GROUP = re.compile(r"[0-9]+")


def _islands(text: str):
    """(start, end) of runs of tokens with a digit, single white space between."""
    m = _DIGIT.search(text)
    while m:
        at = m.start()
        start = at
        while start and not text[start - 1].isspace():
            start -= 1
        end = at
        while True:
            end = _ISLAND.match(text, end).end()
            after = _ISLAND.match(text, end + 1).end() if end < len(text) else end
            if after <= end + 1 or not _DIGIT.search(text, end + 1, after):
                break
            end = after
        yield start, end
        m = _DIGIT.search(text, end)


def _numbers(text: str, start: int, end: int):
    """Phone and identity numbers in a run of digits and separators: every window of its groups of a fitting size.

    Groups of one digit stand only first, and a window has at most fifteen digits: so a run of any length has a bounded
    number of windows for each of its groups.
    """
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    for k, (a, b) in enumerate(groups):
        first = a - 1 if a > start and text[a - 1] == "(" else a
        size = b - a
        for j in range(k, len(groups)):
            c, d = groups[j]
            if j > k:
                if d - c < 2:
                    break
                size += d - c
            if size > 15 or j - k > 6:
                break
            if size >= 7:
                yield first, d, "phone"
                if 8 <= size <= 12:
                    yield first, d, "identity"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping (start, end, kind) proposals; recall is what counts here."""
    found = set()
    for start, end in _islands(text):
        for m in _NUMBER.finditer(text, start, end):
            found.update(_numbers(text, *m.span()))
        for m in _SECRET.finditer(text, start, end):
            if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
                found.add((*m.span(), "secret"))
        for m in _IBAN.finditer(text, start, end):
            found.add((*m.span(), "account"))
        for m in _COLONS.finditer(text, start, end):
            found.add((*m.span(), "device"))
    for m in _AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _WRITTEN_DOMAIN.match(text, m.end())):
            found.add((start, d.end(), "email"))
    if _DIGIT.search(text):
        found.update((*m.span(), "street") for m in _STREET.finditer(text))
        found.update((*m.span(), "birthdate") for m in _DATE.finditer(text))
    return sorted(found)


#: Words before a span that speak for or against each kind, in the corpus's languages.
CUES = {
    "phone": ("tel", "phone", "call", "mobil", "fax", "cell", "whatsapp", "anruf", "rufnummer", "appel", "portable", "llam", "móvil", "sms", "contact"),
    "identity": ("ssn", "social security", "passport", "pasaporte", "passeport", "ausweis", "dni", "nif", "tax id", "steuer", "national id", "licen"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "key", "secret", "passw", "pwd", "api", "bearer", "auth", "credential", "kennwort", "contraseña", "clave"),
    "device": ("mac", "device", "ipv6", "ip ", "host", "address", "adapter"),
    "birthdate": ("born", "birth", "dob", "geboren", "geb.", "geburts", "né le", "née le", "naissance", "nacid", "nacimiento"),
    "street": ("address", "live", "lives at", "home", "resid", "adresse", "wohn", "habite", "domicil", "direcci", "vive en", "ship to", "deliver"),
    "email": ("mail", "contact", "write", "reach", "e-mail", "correo", "courriel", "kontakt"),
    "against": ("order", "invoice", "isbn", "issn", "version", "page", "price", "year", "no.", "figure", "table", "chapter", "part", "serial", "build", "commit", "sha", "doi", "total", "€", "$", "£", "date", "since", "from", "between", "http", "www", "/", "#", "ticket", "tracking", "lot"),
}


def _iban_ok(span: str) -> bool:
    packed = span.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


#: A digit close before a span, and close after one: the span may be part of a longer number.
_NEIGHBOUR, _AFTER = re.compile(r"[0-9][ ().\-/]{0,2}$"), re.compile(r"[ ().\-/]{0,2}[0-9]")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    n = len(span)
    digits = sum(c in "0123456789" for c in span)
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    groups = [len(x) for x in _GROUP.findall(span)]
    separators = {c for c in counts if not c.isalnum()}
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in span)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    near = before[-12:]
    return [
        *[float(kind == k) for k in KINDS], float(n), float(digits), float(letters), float(upper), entropy, switches / n,
        float(len(groups)), float(max(groups, default=0)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(len(separators)), float("." in separators), float("/" in separators), float("-" in separators), float(" " in separators), float("(" in separators),
        float(span[0] == "0"), float(span[:2] == "00"), float(span[0] in "12" and (groups or [0])[0] == 4), float(hexadecimal), float(groups == [3, 2, 4]),
        float(kind == "account" and _iban_ok(span)), float(len(set(groups[1:])) <= 1),
        *[float(any(w in before for w in words)) for words in CUES.values()],
        float(any(w in near for w in CUES.get(kind, ()))), float(any(w in near for w in CUES["against"])),
        float(before.rstrip()[-1:] in "=:\"'"), float(before[-1:] in "\"'"), float(text[end : end + 1] in "\"'"),
        float(before[-1:].isalnum() or before[-1:] in "_/#"), float(text[end : end + 1].isalnum()), float(bool(re.search(r"[\[({<]", span))),
        float(bool(re.search(r"[._0-9]", span.split(" ")[0]))), float(bool(re.search(r"\bdot\b", span, re.I))), float(bool(_NEIGHBOUR.search(text[max(0, start - 3) : start]))), float(bool(_AFTER.match(text, end))),
    ]


_FILL = ("the annual report of the region", "und die einheit der sache", "le texte de la page", "la casa de los niños", "on the thing of that", "results were shown in", "as written in the note")


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int]], str]:
    """A line with one span or two, the places that are personal in it (none for look-alikes), and their kind."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 9)))
    pick = lambda *x: rng.choice(x)()

    name = lambda: w().capitalize()
    month = lambda: rng.choice(_MONTH.split("|"))

    def date(year: int) -> str:
        day, number = rng.randint(1, 28), rng.randint(1, 12)
        return rng.choice((f"{year}-{number:02d}-{day:02d}", f"{day}.{number}.{year}", f"{day:02d}/{number:02d}/{year}", f"{day} {month()} {year}", f"{month()} {day}, {year}"))

    def iban() -> str:
        land, body = rng.choice(("DE", "FR", "ES", "GB", "NL")), d(rng.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        packed = f"{land}{check:02d}{body}"
        return packed if rng.random() < 0.5 else " ".join(packed[k : k + 4] for k in range(0, len(packed), 4))

    def mail() -> str:
        at, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "[dot]"), ("{at}", "."), (" {at} ", "{dot}"), (" <at> ", "."), (" [AT] ", " [DOT] "), (" [AT] ", "."), (" AT ", " DOT "), (" at ", ".")))
        return f"{w()}{rng.choice('._' if (at, dot) == (' at ', '.') else ('.', '', '_'))}{w()}{at}{w()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    positive = {
        "phone": lambda: pick(lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"00{d(2)} {d(2)} {d(7)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        "identity": lambda: pick(lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(9)}"),
        "account": iban,
        "secret": lambda: pick(lambda: h(32), lambda: h(40), lambda: h(64), lambda: b(rng.randint(20, 48)), lambda: f"sk-{b(32)}", lambda: f"AKIA{b(16).upper()}", lambda: f"ghp_{b(36)}"),
        "device": lambda: pick(lambda: ":".join(h(2) for _ in range(6)), lambda: ":".join(h(4) for _ in range(8)), lambda: f"{h(4)}:{h(4)}::{h(4)}:{h(4)}", lambda: "-".join(h(2).upper() for _ in range(6))),
        "email": mail,
        "birthdate": lambda: date(rng.randint(1930, 2015)),
        "street": lambda: pick(lambda: f"{rng.randint(1, 9999)} {name()} {rng.choice(('Street', 'St', 'Avenue', 'Ave', 'Road', 'Rd.', 'Lane', 'Drive'))}", lambda: f"{name()}{rng.choice(('straße', 'strasse', 'weg', 'platz', 'allee'))} {rng.randint(1, 300)}", lambda: f"{rng.randint(1, 300)} {rng.choice(('rue de la', 'rue', 'avenue de', 'boulevard'))} {name()}", lambda: f"{rng.choice(('Calle', 'Avenida de la', 'Plaza'))} {name()} {rng.randint(1, 200)}"),
    }
    negative = [
        lambda: f"{rng.randint(1900, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2035)}", lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2035)}",
        lambda: f"{rng.randint(1900, 2020)}-{rng.randint(1950, 2035)}", lambda: f"{rng.randint(1, 99)}.{d(3)}.{d(3)}", lambda: d(rng.randint(7, 16)), lambda: f"{rng.randint(1, 900)} {d(3)} {d(3)}",
        lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(4)}-{d(4)}", lambda: f"v{d(1)}.{d(2)}.{d(2)}-build{d(5)}", lambda: f"{rng.randint(0, 23):02d}:{d(2)}:{d(2)}", lambda: f"{w()}-{w()}-{rng.randint(1, 99)}-{w()}",
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{w()}{w()}{w()}{d(2)}", lambda: f"{w()} at {w()}", lambda: f"{w()} at the {w()}. The dot {w()}", lambda: f"10.{d(4)}/{w()}.{d(4)}.{d(5)}", lambda: f"{rng.randint(1, 9)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: date(rng.randint(1900, 2035)), lambda: date(rng.randint(1900, 2035)), lambda: f"{w()} at {w()}.com", lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(5, 12))), lambda: f"{rng.randint(1, 99)} {name()} {name()}", lambda: f"{name()} {rng.randint(1, 300)}",
        lambda: f"{w()}_{w()}_{d(4)}_{w()}", lambda: f"1{d(2)} {d(2)} 1{d(2)} {d(2)}",
    ]
    fill = rng.choice(_FILL)
    if rng.random() < 0.5:
        kind = rng.choice(list(positive))
        span = positive[kind]()
        bare = rng.random() < (0.5 if kind in ("phone", "email", "device", "account", "street") else 0.0) or (kind == "secret" and rng.random() < 0.3)
        cue = "" if bare else rng.choice(CUES[kind]) + rng.choice((": ", " ", " = ", ' = "', " is ", "="))
        start = len(fill) + 1 + len(cue)
        spans = [(start, start + len(span))]
        if kind == "phone" and rng.random() < 0.2:  # two numbers side by side, or a figure before one
            more = span[:-2] + d(2)
            spans.append((spans[0][1] + 1, spans[0][1] + 1 + len(more)))
            return f"{fill} {cue}{span} {more} {rng.choice(_FILL)}", spans, kind
        return f"{fill} {cue}{span}{'\"' if cue.endswith('\"') else ''} {rng.choice(_FILL)}", spans, kind
    cue = rng.choice((*CUES["against"], "", "", "")) + rng.choice((" ", ": ", " "))
    return f"{fill} {cue}{rng.choice(negative)()} {rng.choice(_FILL)}", [], ""


class Model:
    """The trees, their calibration, and the probability from which on each kind is taken."""

    def __init__(self, examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION):
        rng = random.Random(seed)
        x, y, kinds, lines = [], [], [], []
        for number in range(examples):
            line, personal, own = _example(rng)
            for start, end, kind in candidates(line):
                x.append(features(line, start, end, kind))
                # a candidate counts if it is of the kind, covers the span and hardly more
                y.append(float(kind == own and any(start <= a and end >= b and (end - start) - (b - a) <= 2 for a, b in personal)))
                kinds.append(KINDS.index(kind))
                lines.append(number % 10)
        x, y, kinds, lines = np.array(x), np.array(y), np.array(kinds), np.array(lines)
        grown, fitted, chosen, reported = lines < 6, (lines == 6) | (lines == 7), lines == 8, lines == 9
        self.trees = Boosted().fit(x[grown], y[grown])
        self.a, self.b = calibrate(self.trees.margin(x[fitted]), y[fitted])
        p = self._probability(self.trees.margin(x))
        self.least = [max(0.5, threshold(p[k], y[k], precision)) if (k := chosen & (kinds == n)).any() else 1.1 for n in range(len(KINDS))]
        taken = p >= np.array(self.least)[kinds]
        self.report = {"examples": len(y), "precision": float(y[reported & taken].mean()), "recall": float(taken[reported & (y > 0)].mean())}

    def _probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * margin + self.b)))

    def select(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
        """Candidates that pass their threshold and overlap neither ``taken`` nor a more probable one."""
        busy = sorted((a, b) for a, b, _ in taken)
        proposed = [c for c in candidates(text)]
        if busy:
            starts = np.array([a for a, _ in busy])
            ends = np.maximum.accumulate([b for _, b in busy])
            proposed = [c for c in proposed if not (k := int(np.searchsorted(starts, c[1], "left"))) or ends[k - 1] <= c[0]]
        if not proposed:
            return []
        p = self._probability(self.trees.margin(np.array([features(text, *c) for c in proposed])))
        good = sorted((-float(q), *c) for q, c in zip(p, proposed, strict=True) if q >= self.least[KINDS.index(c[2])])
        chosen: list[tuple] = []
        for q, a, b, kind in good:
            k = bisect.bisect_left(chosen, (b,))
            if not k or chosen[k - 1][1] <= a:  # the chosen are disjoint and in order
                bisect.insort(chosen, (a, b, kind, -q))
        return chosen


@lru_cache(maxsize=2)
def model(examples: int = EXAMPLES, seed: int = SEED) -> Model:
    return Model(examples, seed)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType()), T.StructField("base", T.BooleanType())])


def spans_of(text: str, trained: Model) -> list[dict]:
    base = base_spans(text)
    more = trained.select(text, base)
    every = [(a, b, kind, 1.0, True) for a, b, kind in base] + [(*x, False) for x in more]
    return [dict(zip(("start", "end", "kind", "probability", "base"), x, strict=True)) for x in in_order(every)]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]["start"], spans[k]["end"], spans[k]["kind"]
        k += 1
        while k < len(spans) and spans[k]["start"] < end:
            end = max(end, spans[k]["end"])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def find(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None, redact: bool = False, trained: Model | None = None) -> DataFrame:
    """The columns of ``keep``, then spans (array of kind, start, end, probability, base) and, if asked for, the redacted text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trained or model())
    keep = keep or {}
    kept_names = list(keep)
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    fields = [T.StructField("spans", T.ArrayType(_SPAN))] + [T.StructField("redacted", T.StringType())] * redact
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("base", pa.bool_())]))

    def work(batches):
        trained = shared.value
        for batch in small(batches):
            texts = batch["_text"].to_pylist()
            spans = [spans_of(x, trained) if x else [] for x in texts]
            more = [pa.array([redacted(x, s) if s else x for x, s in zip(texts, spans, strict=True)], pa.string())] if redact else []
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept_names], pa.array(spans, kind), *more], [*kept_names, "spans", *["redacted"] * redact])

    return rows.mapInArrow(work, T.StructType([*rows.drop("_text").schema.fields, *fields]))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

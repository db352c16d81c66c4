"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The base finds emails, IP addresses, card and phone numbers by pattern and check. The field reads
the tokens around digits, @ and spelt-out "at" or "dot" (signs or capitals in any case, plain words as a pair), scores every candidate segment of up to
LONGEST tokens and MOST_CHARS characters by features of the whole span (digit counts, checksums, shapes, borders, the word
before), and chooses boundaries and types together by dynamic programming. Its spans are added
where they touch no base span. A stretch without a trigger can only be outside, so it is skipped.

Weights come from maximum likelihood on generated sentences (fixed seed), in numpy; no table is
read for it.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of the longest segment.
LONGEST, MOST_CHARS = 8, 320
#: Tokens on each side of a trigger that belong to its stretch.
AROUND = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Not behind a digit: a later start in a run of digits can match only where its first can.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns as (start, kind, end), in order."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m.group())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    spans.sort()
    return spans


# --- the field -------------------------------------------------------------------------------

# Plain words fire in upper case, or as a pair: "at", one word, "dot".
_TRIGGER = re.compile(
    r"[0-9@]|[\[({<](?i:at|dot)[\])}>]|(?<=\s)(?:AT|DOT)(?=\s)"
    r"|(?<=\s)(?i:at)(?=\s+[A-Za-z0-9-]+(?:\s+(?i:dot)\s+|\s*[\[({<](?i:dot)[\])}>]\s*)[A-Za-z0-9])"
)
_TOKEN = re.compile(r"\S+")
_STRIP_LEFT, _STRIP_RIGHT = "\"'<>[]{};:,!?|*", "\"'<>[]{};:,!?|*."
_AT, _DOT = r"\s*(?:@|[\[({<](?i:at)[\])}>]|\s(?i:at)\s)\s*", r"\s*(?:\.|[\[({<](?i:dot)[\])}>]|\s(?i:dot)\s)\s*"
_SPELT_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}")
_PLAIN = re.compile(r"[^@\[({<]*\s(?:at|At)\s[^@\[({<]*")
_ENDINGS = frozenset("com org net edu gov int info biz io dev app eu co uk us ca au de at ch fr be nl es pt it pl se no dk fi ie in jp cn br mx".split())
_SPELT_IP = re.compile(r"[0-9]{1,3}(?:\s*(?:\.|[\[({<]\.[\])}>]|[\[({<]dot[\])}>])\s*[0-9]{1,3}){3}")
_CARD_SHAPE = re.compile(r"[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ ./_-]?)[0-9]{6}\2[0-9]{4,5}")
_PHONE_SHAPE = re.compile(r"(?:\+|00)?[0-9]{0,3}[ ./-]?\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3}[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{1,3})?")
_PHONE_GROUPED = re.compile(r"(?:(?:\+|00)?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_CUES = {
    "mail": 0, "email": 0, "e-mail": 0, "ip": 1, "address": 1, "server": 1, "host": 1, "card": 2, "visa": 2,
    "credit": 2, "karte": 2, "carte": 2, "tarjeta": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "telefon": 3,
    "téléphone": 3, "teléfono": 3, "mobile": 3,
}
N_FEATURES = 24
#: A token that carries an address on.
_GOES_ON = re.compile(r"[\[({<]?(?:dot|at)[\])}>]?", re.I)


def _bounds(token: re.Match) -> tuple[int, int]:
    """Start and end without the punctuation around the token."""
    raw, start, end = token.group(), token.start(), token.end()
    if raw[0] in "[({<" and raw[1:-1].lower() in ("at", "dot"):
        return start, end
    left = len(raw) - len(raw.lstrip(_STRIP_LEFT))
    right = len(raw) - len(raw.rstrip(_STRIP_RIGHT))
    if left + right >= len(raw):
        return start, end
    if raw.endswith(")") and "(" not in raw[left:]:
        right = max(right, 1)
    return start + left, end - right


def span_features(span: str, n_tokens: int, before: str, after: str) -> list[float]:
    """Features of a whole candidate span; the words before and behind it are context."""
    digits = _NOT_DIGIT.sub("", span)
    n, letters = len(digits), any(c.isalpha() for c in span)
    email, ip = _SPELT_EMAIL.fullmatch(span) is not None, _SPELT_IP.fullmatch(span) is not None
    card, phone = _CARD_SHAPE.fullmatch(span) is not None, _PHONE_SHAPE.fullmatch(span) is not None
    plain = email and _PLAIN.fullmatch(span) is not None
    cue = _CUES.get(before.strip(_STRIP_LEFT + ":.=").lower(), -1)
    edge = (span[0].isalnum() or span[0] in "+(") and span[-1].isalnum()
    return [
        1.0, float(n_tokens), email, "@" in span, ip, ip and all(int(p) <= 255 for p in re.findall("[0-9]+", span)),
        card, 14 <= n <= 19, 14 <= n <= 19 and luhn(digits), phone, _PHONE_GROUPED.fullmatch(span) is not None,
        phone and span[0] in "+0", 10 <= n <= 15, 7 <= n <= 9, n < 7, letters, not edge,
        cue == 0, cue == 1, cue == 2, cue == 3, letters and n > 0 and not email, _GOES_ON.fullmatch(after) is not None,
        plain and re.split(r"[\s.]", span)[-1].lower() not in _ENDINGS,
    ]


def near_triggers(text: str) -> Iterator[tuple[re.Match, bool] | None]:
    """Tokens from AROUND before to AROUND behind triggers, and whether each holds one; None behind every run of them. The
    rest of the text can only be outside."""
    hits = (m.start() for m in _TRIGGER.finditer(text))
    hit, end = next(hits, -1), 0
    while hit >= 0:
        quiet, seen = 0, False
        for token in _TOKEN.finditer(text, max(end, _back(text, hit, AROUND))):
            fired = False
            while 0 <= hit < token.end():
                fired, hit = True, next(hits, -1)
            yield token, fired
            end = token.end()
            seen, quiet = seen or fired, 0 if fired else quiet + 1
            if seen and quiet == AROUND:
                break
        yield None


def stretches(text: str) -> Iterator[list[re.Match]]:
    """The runs of tokens near triggers, as lists."""
    run: list[re.Match] = []
    for found in near_triggers(text):
        if found:
            run.append(found[0])
        else:
            yield run
            run = []


def _back(text: str, at: int, tokens: int) -> int:
    """Where the token that lies so many tokens before a place begins."""
    for _ in range(tokens + 1):
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        start = at
        while at > 0 and text[at - 1].isspace():
            at -= 1
        if at == 0:
            return start
    return start


def _fired(text: str, tokens: list[re.Match]) -> list[bool]:
    """Which tokens of a stretch hold a trigger."""
    fires, t = [False] * len(tokens), 0
    for hit in _TRIGGER.finditer(text, tokens[0].start()):
        while t < len(tokens) and tokens[t].end() <= hit.start():
            t += 1
        if t == len(tokens):
            break
        fires[t] = True
    return fires


class Lattice:
    """Candidate segments of one stretch: (first, last + 1, start, end) and their feature rows."""

    def __init__(self, text: str, tokens: list[re.Match]):
        self.n = len(tokens)
        bounds = [_bounds(t) for t in tokens]
        fires = _fired(text, tokens)
        self.segments, rows = [], []
        for i in range(self.n):
            start = bounds[i][0]
            before = tokens[i - 1].group() if i else ""
            any_fires = False
            for j in range(i, min(i + LONGEST, self.n)):
                any_fires = any_fires or fires[j]
                if j > i and "\n" in text[tokens[j - 1].end() : tokens[j].start()]:
                    break
                if any_fires and bounds[j][1] - start <= MOST_CHARS:
                    self.segments.append((i, j + 1, start, bounds[j][1]))
                    after = tokens[j + 1].group() if j + 1 < self.n else ""
                    rows.append(span_features(text[start : bounds[j][1]], j + 1 - i, before, after))
        self.features = np.asarray(rows, dtype=np.float64).reshape(len(rows), N_FEATURES)

    def ending(self, scores: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """By end: (begin, segment * kinds + kind, score)."""
        at: list[list[tuple[int, int, float]]] = [[] for _ in range(self.n + 1)]
        for s, (i, j, _, _) in enumerate(self.segments):
            for k in range(len(KINDS)):
                at[j].append((i, s * len(KINDS) + k, scores[s, k]))
        return at

    def best(self, weights: np.ndarray) -> list[Span]:
        """The best spans of a stretch that is held as a whole; decoded() gives the same without holding it."""
        at = self.ending(self.features @ weights)
        value, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1]
            for i, choice, score in at[j]:
                if value[i] + score > value[j]:
                    value[j], back[j] = value[i] + score, choice
        found, j = [], self.n
        while j:
            if back[j] < 0:
                j -= 1
                continue
            segment, kind = divmod(back[j], len(KINDS))
            i, _, start, end = self.segments[segment]
            found.append((start, kind, end))
            j = i
        return found[::-1]

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """Probability of every (segment, kind) by the forward-backward recursion."""
        scores = self.features @ weights
        at = self.ending(scores)
        forward = np.full(self.n + 1, -np.inf)
        backward = np.full(self.n + 1, -np.inf)
        forward[0] = backward[self.n] = 0.0
        for j in range(1, self.n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, _, s in at[j])])
        for j in range(self.n, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for i, _, s in at[j]:
                backward[i] = np.logaddexp(backward[i], backward[j] + s)
        p = np.zeros_like(scores)
        for s, (i, j, _, _) in enumerate(self.segments):
            p[s] = np.exp(forward[i] + scores[s] + backward[j] - forward[self.n])
        return p


# --- decoding --------------------------------------------------------------------------------

#: Tokens at which segments begin that are scored at once.
STARTS_AT_ONCE = 256
_AT_SIGN = re.compile(r"@|(?i:at)")
_DOT_SIGN = re.compile(r"\.|(?i:dot)")


def _plain_features(span: str, n_tokens: int, before: str, after: str) -> list[float] | None:
    """span_features of a span that no shape can fit, without trying them; None for others. An address needs an at sign, an IP address
    4 to 12 digits and 3 dots, a card or phone number 7 to 19 digits and no letters."""
    digits = _NOT_DIGIT.sub("", span)
    n, letters = len(digits), any(c.isalpha() for c in span)
    if _AT_SIGN.search(span) or (4 <= n <= 12 and len(_DOT_SIGN.findall(span)) >= 3) or (7 <= n <= 19 and not letters):
        return None
    cue = _CUES.get(before.strip(_STRIP_LEFT + ":.=").lower(), -1)
    edge = (span[0].isalnum() or span[0] in "+(") and span[-1].isalnum()
    return [
        1.0, float(n_tokens), 0.0, 0.0, 0.0, 0.0, 0.0, 14 <= n <= 19, 14 <= n <= 19 and luhn(digits), 0.0, 0.0, 0.0, 10 <= n <= 15, 7 <= n <= 9, n < 7, letters, not edge,
        cue == 0, cue == 1, cue == 2, cue == 3, letters and n > 0, _GOES_ON.fullmatch(after) is not None, 0.0,
    ]


#: A segment that scores above 0: first token, last token + 1, start, end, scores by kind.
Segment = tuple[int, int, int, int, list[float]]


def _worthy(text: str, weights: np.ndarray) -> Iterator[Segment | int]:
    """The segments that score above 0 for some kind, by first token, and between them the first token at which a later one can begin.

    No other segment is ever better than outside, as an outside token costs nothing. Tokens are held for a few hundred at once."""
    held: list[tuple[re.Match, int, int, bool]] = []
    first = begun = 0  # number of held[0]; tokens of this stretch before the first that is not done
    for found in near_triggers(text):
        if found:
            held.append((found[0], *_bounds(found[0]), found[1]))
            if len(held) - begun < STARTS_AT_ONCE + LONGEST:
                continue
        upto = len(held) - LONGEST if found else len(held)
        segments, rows = [], []
        for i in range(begun, upto):
            start, fired = held[i][1], False
            before = held[i - 1][0].group() if i else ""
            for j in range(i, min(i + LONGEST, len(held))):
                fired = fired or held[j][3]
                if j > i and "\n" in text[held[j - 1][0].end() : held[j][0].start()]:
                    break
                end = held[j][2]
                if fired and end - start <= MOST_CHARS:
                    span, after = text[start:end], held[j + 1][0].group() if j + 1 < len(held) else ""
                    rows.append(_plain_features(span, j + 1 - i, before, after) or span_features(span, j + 1 - i, before, after))
                    segments.append((first + i, first + j + 1, start, end))
        if rows:
            scores = np.asarray(rows, dtype=np.float64) @ weights
            for s in np.flatnonzero(scores.max(axis=1) > 0).tolist():
                yield *segments[s], scores[s].tolist()
        if found:
            # The token before the next start is its context.
            first, held, begun = first + upto - 1, held[upto - 1 :], 1
            yield first + begun
        else:
            first, held, begun = first + len(held) + LONGEST, [], 0
            yield first


def _settled(cluster: list[Segment]) -> Iterator[Span]:
    """The best spans of segments that overlap one another, by dynamic programming over their tokens."""
    begin, end = cluster[0][0], max(j for _, j, *_ in cluster)
    at: dict[int, list[Segment]] = {}
    for segment in cluster:
        at.setdefault(segment[1], []).append(segment)
    value: list[float] = [0.0] * (end - begin + 1)
    back: list[tuple[Segment, int] | None] = [None] * (end - begin + 1)
    for j in range(begin + 1, end + 1):
        value[j - begin] = value[j - begin - 1]
        for segment in at.get(j, ()):
            for kind, score in enumerate(segment[4]):
                if value[segment[0] - begin] + score > value[j - begin]:
                    value[j - begin], back[j - begin] = value[segment[0] - begin] + score, (segment, kind)
    found, j = [], end
    while j > begin:
        step = back[j - begin]
        if step is None:
            j -= 1
            continue
        found.append((step[0][2], step[1], step[0][3]))
        j = step[0][0]
    yield from found[::-1]


def decoded(text: str, weights: np.ndarray) -> Iterator[Span]:
    """The best spans of a text, boundaries and kinds together. Where no worthy segment crosses a token's start, what is before it is
    settled, so a table of numbers of any length is held for a few hundred tokens only."""
    cluster: list[Segment] = []
    reach = 0
    for found in _worthy(text, weights):
        begin = found if isinstance(found, int) else found[0]
        if cluster and begin >= reach:
            yield from _settled(cluster)
            cluster = []
        if not isinstance(found, int):
            cluster.append(found)
            reach = max(reach, found[1]) if len(cluster) > 1 else found[1]
    if cluster:
        yield from _settled(cluster)


# --- training --------------------------------------------------------------------------------


def _card_number(rng: random.Random, good: bool) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    check = next(d for d in "0123456789" if luhn(body + d))
    return body + (check if good else str((int(check) + rng.randint(1, 9)) % 10))


def _generated(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    word = lambda: "".join(rng.choice("abcdefghilmnorstuvé") for _ in range(rng.randint(2, 9)))
    number = lambda a, b: str(rng.randint(a, b))
    parts, spans, at = [], [], 0

    def add(piece: str, kind: int = -1) -> None:
        nonlocal at
        if kind >= 0:
            spans.append((at, kind, at + len(piece)))
        parts.append(piece)
        at += len(piece)

    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(1, 5)):
            add(word() + rng.choice(["", "", "", ".", ","]) + " ")
        kind = rng.choice([0, 1, 2, 3, -1, -1, -1])
        if kind >= 0 and rng.random() < 0.25:
            add(rng.choice([w for w, k in _CUES.items() if k == kind]) + rng.choice([": ", " "]))
        if kind == 0:
            name = word().replace("é", "e") + rng.choice(["", "." + number(1, 99), "_" + number(1, 99)])
            host = [word().replace("é", "e") + rng.choice(["", number(1, 9)]), rng.choice(["example", "mail", "site"]), rng.choice(["com", "org", "net", "de"])]
            a, d = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" AT ", " DOT "), ("(at)", "."), (" at ", " dot "), (" [AT] ", " [DOT] ")])
            add(name + a + d.join(host), 0)
        elif kind == 1:
            sep = rng.choice([".", ".", "[.]", "(dot)"])
            add(sep.join(number(0, 255) for _ in range(4)), 1)
        elif kind == 2:
            n = _card_number(rng, True)
            s = rng.choice(["", "", " ", "-", ".", "/"])
            add(s.join(n[i : i + 4] for i in range(0, 16, 4)), 2)
        elif kind == 3:
            a, b, c = number(200, 999), number(200, 999), f"{rng.randint(0, 9999):04}"
            add(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"001 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}", f"+1{a}{b}{c}"]), 3)
        elif rng.random() < 0.1:
            add(f"{word()} at {word()} dot {word()}".replace("é", "e"))
        else:
            hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([12, 20, 40])))
            key = "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(16))
            add(rng.choice([
                number(1, 2030), number(1900, 2030), f"{number(1, 99)}.{number(0, 9)}", f"{number(1, 9)}.{number(0, 20)}.{number(0, 20)}",
                f"{number(1990, 2030)}-0{number(1, 9)}-{number(10, 28)}", f'token = "{hexed}"', f"password={hexed}", key, f"@{word()}",
                _card_number(rng, False), f"{number(1, 12)}/{number(1, 28)}/{number(1990, 2030)}", f"{number(1, 999)},{number(100, 999)}",
                f"v{number(1, 9)}.{number(1, 9)}", f"{number(10, 99)} {number(10, 99)} {number(10, 99)}", f"{number(100000, 999999)}", f"({number(1, 99)})",
                f"{word()}{number(1, 99)}", f"{number(300, 999)}.{number(300, 999)}.{number(300, 999)}.{number(300, 999)}", f"{number(1, 99)}%", f"{number(10**19, 10**24)}",
            ]))
        add(rng.choice([" ", " ", ". ", ", "]))
    for _ in range(rng.randint(0, 4)):
        add(word() + " ")
    return "".join(parts), spans


@lru_cache(maxsize=2)
def trained(seed: int = 7, sentences: int = 500, epochs: int = 8, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights (feature by kind) by stochastic gradient ascent on the likelihood of generated sentences."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _generated(rng)
        gold = set(spans)
        for tokens in stretches(text):
            lattice = Lattice(text, tokens)
            truth = np.zeros((len(lattice.segments), len(KINDS)))
            for s, (_, _, start, end) in enumerate(lattice.segments):
                for k in range(len(KINDS)):
                    truth[s, k] = (start, k, end) in gold
            data.append((lattice, lattice.features.T @ truth))
    weights, squares = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for lattice, observed in data:
            gradient = observed - lattice.features.T @ lattice.expected(weights) - decay * weights
            squares += gradient * gradient
            weights += rate * gradient / np.sqrt(squares)
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the field adds; both in order."""
    base = base_spans(text)
    added, b, reach = [], 0, 0
    for start, kind, end in decoded(text, weights):
        while b < len(base) and base[b][0] < end:
            reach, b = max(reach, base[b][2]), b + 1
        if reach <= start:
            added.append((start, kind, end))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base counts by kind, base_sha256, spans (base and added), n_added.

    A null text is empty and has no spans; a null id stays null; repeated rows get a row each.
    Offsets are code points of the whole text. Other columns are never read."""
    weights = trained()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["t"]:
                base, added = all_spans(text, weights)
                counts = [0] * len(KINDS)
                for _, k, _ in base:
                    counts[k] += 1
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(sorted(base + added)), len(added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInPandas(scan, SCHEMA)


def redacted(text: str, weights: np.ndarray) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base, added = all_spans(text, weights)
    out, at = [], 0
    for start, kind, end in sorted(base + added):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

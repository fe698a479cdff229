"""Personal data: patterns propose spans, checks confirm them, words nearby adjust their score.

Kinds email, ip, card and phone are the base: their patterns with their checks
(parts of an address at most 255, Luhn, number of digits) decide alone, whatever
the score. The method adds kinds whose patterns are too weak alone: ``iban``
(mod 97), ``ssn``, ``short_card`` (13 to 15 digits, Luhn) and ``local_phone``.
Each proposal starts at its kind's score, a passed check raises it, and a word of
its kind within CONTEXT_CHARS before or after raises it once more; an added span
needs THRESHOLD. An added span that overlaps a base span or an earlier added one
is left out, so that base spans stay as they are.

Each pattern runs in time linear in the text: runs of digits or letters are tried
once from their start, never from each of their characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "short_card", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# Every run of digits with single spaces or hyphens between; the first digit starts it.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SHORT_CARD = re.compile(r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])")

START = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "short_card": 0.1, "local_phone": 0.5}
CHECKED = 0.4
NEARBY = 0.3
THRESHOLD = 0.6
CONTEXT_CHARS = 40
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "short_card": ("card", "amex", "diners", "credit", "payment"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
NEAR_WORD = re.compile(r"[^\W\d_]+")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        if place % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Letters count 10 to 35, the first four characters move to the end, the rest must be 1."""
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern finds them, from each @ backwards over its local part."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_PART.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        # Leading zeros do not count; a longer number is over 255, however long.
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19 and 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield m.span()


def _added(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a check confirmed it)."""
    for m in IBAN.finditer(text):
        yield "iban", *m.span(), mod97(m[0])
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span(), False
    for m in SHORT_CARD.finditer(text):
        if luhn(digits_of(m[0])):
            yield "short_card", *m.span(), True
    if "(" in text:
        for m in LOCAL_PHONE.finditer(text):
            yield "local_phone", *m.span(), False


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in NEAR_WORD.findall(near)}
    value = START[kind] + CHECKED * checked + NEARBY * any(w in words for w in CONTEXT[kind])
    return min(1.0, value)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; code points, end exclusive."""
    finders = (_emails, _ips, _cards, _phones)
    return [(k, *span) for k, finder in zip(BASE_KINDS, finders) for span in finder(text)]


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with their scores, by kind as listed in KINDS, then start."""
    base = base_spans(text)
    found = [(k, s, e, score(text, k, s, e, True)) for k, s, e in base]
    if not any(c in text for c in "0123456789"):
        return found
    covered = [(s, e) for _, s, e in base]
    for kind, s, e, checked in _added(text):
        if (checked or kind in ("ssn", "local_phone")) and all(e <= x or y <= s for x, y in covered):
            value = score(text, kind, s, e, checked)
            if value >= THRESHOLD:
                found.append((kind, s, e, value))
                covered.append((s, e))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def mask(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += (text[at:s], f"<{kind.upper()}>")
        at = max(at, e)
    return "".join(out) + text[at:]

"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
At an anchor a parser expands over the characters its kind allows and validates what it finds there.
Anchors come from left to right and none is parsed inside its kind's last match, so the base kinds
equal a leftmost search of the whole text, in linear time. Beyond the base kinds the method adds `userinfo` (credentials
in a URL), `account` (an IBAN whose check digits hold, with or without a cue, or an identifier behind a cue
word) and `secret` (a value behind a word for keys, tokens or passwords, or one of a known form). Cues are
found in any case; what may stand between a cue and its value is bounded, so white space costs nothing.

Defined results: a null text is empty and has no spans; offsets are code points; kinds are searched
independently, so spans of different kinds may overlap; repeated rows give repeated results; an empty
table gives no rows; texts of any length take time in proportion to it; columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "account", "secret")
FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_userinfo bigint, n_account bigint, n_secret bigint, n_spans bigint"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[A-Za-z0-9._~%!$&'*+,;=-]+@(?=[A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
GAP = r"[\s\"']{0,8}"
CUED = re.compile(rf"{GAP}(?:(?:no|nr|number|id)\b\.?)?{GAP}[:#=]?{GAP}((?=[A-Za-z0-9-]{{0,34}}[0-9])[A-Z0-9][A-Z0-9-]{{4,32}}[A-Z0-9])(?![A-Za-z0-9])", re.IGNORECASE)
VALUE = re.compile(rf"{GAP}(?:[:=]|is\b){GAP}([A-Za-z0-9._~+/=-]{{8,512}})")

DIGITS = "0123456789"
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("account", "iban", "passport", "ssn", "acct")
SECRETS = ("key", "token", "secret", "password", "passwd", "pwd", "bearer", "credential")
#: How issued keys of known services begin, and their forms.
ISSUED = {
    "akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])"),
    "ghp_": re.compile(r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xox": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,200}"),
    "eyj": re.compile(r"eyJ[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}"),
    "-----begin": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
}
LOWER = {c: c + 32 for c in range(65, 91)}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for text, kind in ([("@", "@"), ("+", "+")] + [(d, "digit") for d in DIGITS] + [(s, "scheme") for s in SCHEMES] + [(c, "cue") for c in CUES] + [(c, "secret") for c in SECRETS] + [(c, "issued") for c in ISSUED]):
        a.add_word(text, (kind, len(text)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around an at-sign: all local characters before it, the longest dotted domain behind it."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def ips_in(chain: re.Match) -> list[tuple[int, int]]:
    """Four numbers each of a chain of dotted numbers, from its start, where all are at most 255."""
    found, at, parts = [], chain.start(), chain[0].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append((at, at + size))
        at += size + 1
    return found


def card_in(text: str) -> bool:
    digits = only_digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    m = IBAN.match(text, at)
    while m and not iban_holds(m[0]) and len(m[0]) > 15:  # the longest run may have taken in what follows
        m = IBAN.match(text, at, m.end() - 1)
    return m.span() if m and iban_holds(m[0]) else None


def account_after(text: str, end: int) -> tuple[int, int] | None:
    """Behind a cue that ends at `end`: an identifier with a digit, but not an IBAN, which has its own anchors."""
    m = CUED.match(text, end)
    return m.span(1) if m else None


def secret_after(text: str, end: int) -> tuple[int, int] | None:
    """Behind a cue: `=`, `:` or `is`, and a value that is no word: it has digits and letters, or stands in quotes and has a digit."""
    m = VALUE.match(text, end)
    if not m:
        return None
    value = m[1].rstrip(".")
    digits = sum(c in DIGITS for c in value)
    quoted = text[m.start(1) - 1] in "\"'"
    return (m.start(1), m.start(1) + len(value)) if digits and (quoted or len(value) >= 12 and digits < len(value)) else None


def folded(text: str) -> str:
    """The text in lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


def find(text: str, machine: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = iban = 0  # where each kind's last match, or its region that was parsed, ends
    for end, (what, size) in machine.iter(folded(text)):
        start = end - size + 1
        if what == "digit":
            if start >= ip:
                chain = DOTTED.match(text, start)
                ip = chain.end()
                spans["ip"] += ips_in(chain)
            if start >= card and (m := CARD.match(text, start)):
                card = m.end()
                if card_in(m[0]):
                    spans["card"].append(m.span())
            if start - 2 >= iban and text[start - 1] in CAPITALS and text[start - 2] in CAPITALS and not (start > 2 and text[start - 3].isalnum()):
                if found := iban_at(text, start - 2):
                    spans["account"].append(found)
                    iban = found[1]
        elif what == "@":
            if found := email_at(text, start, email):
                spans["email"].append(found)
                email = found[1]
        elif what == "+":
            if start >= phone and (m := PHONE.match(text, start)):
                phone = m.end()
                if 8 <= len(only_digits(m[0])) <= 15:
                    spans["phone"].append(m.span())
        elif what == "scheme":
            if m := USERINFO.match(text, end + 1):
                spans["userinfo"].append((m.start(), m.end() - 1))
        elif what == "secret":
            if found := secret_after(text, end + 1):
                spans["secret"].append(found)
        elif what == "issued":
            if m := ISSUED[text[start : start + size].lower()].match(text, start):
                spans["secret"].append(m.span())
        elif found := account_after(text, end + 1):
            spans["account"].append(found)
    for kind in ("account", "secret"):
        spans[kind] = outermost(spans[kind])
    return spans


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, without repeats and those that lie inside others."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(set(spans[k])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row."""
    schema = common.arrow_schema(FOUND)

    def make():
        machine = automaton()

        def step(batch):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = find(text or "", machine)
                rows.append((doc, *(len(spans[k]) for k in BASE), hashlib.sha256(joined(spans, BASE).encode()).hexdigest(), joined(spans, KINDS), *(len(spans[k]) for k in KINDS[4:]), sum(map(len, spans.values()))))
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return step

    return common.map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), make, FOUND)

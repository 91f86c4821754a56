r"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds the anchors: at-signs, plus signs, schemes, digits and identifier
cues. Local parsers, each a bounded deterministic scan around an anchor, expand and validate the boundaries.

Base kinds, leftmost and non-overlapping within a kind (a match that fails validation is dropped, not retried):

* ``email``: local part left of an at-sign, dotted labels right of it;
* ``ip``: four dotted numbers, each at most 255;
* ``card``: digits with single spaces or hyphens between, 12 to 19 of them, passing Luhn;
* ``phone``: a plus sign, a digit, then digits and ``space ( ) . -``, ending in a digit; 9 to 15 digits.

Added kinds: ``url_auth`` (``user:password@`` behind a scheme), ``secret`` (the value behind a cue such as
``token =``, at least 16 characters with a digit; cues within a value count no more), ``iban`` (behind its cue, as long as its country says, checked
modulo 97).
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from effectflow.llm.common import per_row, plain_text, read

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_auth", "secret", "iban")
_RANK = {k: n for n, k in enumerate(KINDS)}

#: Cues that a secret or an account number follows (lower case; capitalised and upper-case forms count too).
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")
IBAN_CUES = ("iban",)
#: Characters of an account number by country: fixed values.
IBAN_LENGTHS = {
    code: size
    for size, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for code in codes.split()
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTH = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s:@/]+(?=@)")
_ASSIGN = re.compile(r"""["']?\s*+[=:]\s*+["']?""")
_VALUE = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
_IBAN = re.compile(r"\s*+[:=]?\s*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, (0, 1))
    found.add_word("@", (1, 1))
    found.add_word("+", (2, 1))
    found.add_word("://", (3, 3))
    for kind, cues in ((4, SECRET_CUES), (5, IBAN_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_ANCHORS = None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _iban_ok(value: str) -> bool:
    flat = value.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _iban_end(value: str) -> int | None:
    """Where the account number at the start of ``value`` ends: after its country's length, or with all of ``value``, or,
    for countries without a known length, before a space."""
    known = IBAN_LENGTHS.get(value[:2])
    places = [k for k, c in enumerate(value) if c != " "]
    ends = [places[known - 1] + 1] if known and known <= len(places) else []
    ends.append(len(value))
    if not known:
        ends += [k for k in range(len(value) - 1, 0, -1) if value[k] == " "]
    return next((end for end in ends if _iban_ok(value[:end])), None)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    global _ANCHORS
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    spans = []
    email_end = ip_next = card_next = phone_next = value_end = 0
    for end, (kind, size) in _ANCHORS.iter(text):
        at = end - size + 1
        if kind == 0:
            if at >= card_next:
                m = _CARD.match(text, at)
                if m:
                    card_next = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, m.end()))
                else:
                    card_next = at + 1
            if at >= ip_next:
                m = _IP.match(text, at)
                if m:
                    ip_next = m.end()
                    if all(map(_small, m[0].split("."))):
                        spans.append(("ip", at, m.end()))
                else:
                    ip_next = _DIGITS.match(text, at).end()
        elif kind == 1:
            start = at
            while start > email_end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans.append(("email", start, m.end()))
                email_end = m.end()
        elif kind == 2:
            if at >= phone_next and (m := _PHONE.match(text, at)):
                phone_next = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif kind == 3:
            if m := _AUTH.match(text, end + 1):
                spans.append(("url_auth", m.start(), m.end()))
        elif kind == 4:
            # a cue within a value has the rest of that value behind it: no value is read twice
            if (said := _ASSIGN.match(text, end + 1)) and said.end() >= value_end and (m := _VALUE.match(text, said.end())):
                value_end = m.end()
                if any(c.isdigit() for c in m[0]):
                    spans.append(("secret", m.start(), m.end()))
        elif (m := _IBAN.match(text, end + 1)) and (size := _iban_end(m[1])):
            spans.append(("iban", m.start(1), m.start(1) + size))
    return sorted(set(spans), key=lambda s: (s[1], _RANK[s[0]], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by ``<KIND>``; overlapping ones by the first's name."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans; very long texts are scanned whole in one pass, whose parsers read no part of a
    text more than a bounded number of times; repeated rows each get their row; spans that start together are in the order
    of kinds; an empty table gives an empty result; other columns fall away. No shuffle.
    """

    def row(key: int, text: str) -> tuple:
        spans = find_spans(text)
        base = [s for s in spans if s[0] in BASE_KINDS]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        return key, *counts, hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    return per_row(
        docs.select(id_col, plain_text(text_col).alias("text")), row,
        f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``documents`` with every span of their texts replaced; n_chars follows. Null texts stay null."""

    def row(key: int, text: str | None, lang: str, source: str, n_chars: int) -> tuple:
        if text and (spans := find_spans(text)):
            text = redact(text, spans)
            n_chars = len(text)
        return key, text, lang, source, n_chars

    return per_row(
        docs.select("doc_id", "text", "lang", "source", "n_chars"), row,
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of every whole text."""
    return personal_data(read(spark, sf_dir, "documents"))

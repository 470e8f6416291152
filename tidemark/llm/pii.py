"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
From an anchor a small deterministic parser for each kind expands to the boundaries of a candidate and validates it.
Parsers go through the anchors in order and never restart inside what they have consumed, so spans of a kind are
those of a leftmost non-overlapping scan.

Base kinds: email, ip, card (Luhn), phone. Added kinds: iban (mod-97 over the length of its country; in capitals
anywhere, in any case after the word), ssn and account (digits that follow a cue such as "account number" or "ssn is",
in any case), url_login (a scheme URL that carries user and password), secret (what a name such as token or password is
set to, keys with a known head, signed tokens, private keys). A value set to a name counts only if it looks made by
chance: letters and digits, long enough, no placeholder and no call.

Cases: null and empty texts have no spans. No pattern reads a stretch of text again for each anchor in it, so very long
texts take time in step with their length. Rows pass through as they come, so ties, repeated rows and other columns need
nothing special; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn", "account", "url_login", "secret"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
_IBAN_ANY = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LINK = r"(?:(?:is|was)[\x20:#=]++)?"
_SSN = re.compile(rf"[\x20:#=]*+(?:(?:number|no\.?)[\x20:#=]*+)?{_LINK}([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![0-9-])", re.I | re.A)
_ACCOUNT = re.compile(rf"(?:[\x20:#=]*+(?:number|no\.?|id)[\x20:#=]*+|[\x20:#=]++){_LINK}([0-9]{{6,17}})(?![0-9-]|\.[0-9])", re.I | re.A)
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9.-]+[A-Za-z0-9]")

#: Countries by the length of their account numbers; a code that is not here takes what looks like a number.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
        26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_IBAN = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])", re.I | re.A) for n in set(IBAN_LENGTHS.values())}

#: What follows the name of a secret: the rest of the name, a sign that sets it, a value in quotes or bare.
_SET = re.compile(
    r"""[A-Za-z0-9_.-]{0,24}["'\]]{0,2}[\x20\t]{0,4}(?::=|=>|[=:])[\x20\t]{0,4}(?:(["'`])(?P<quoted>[^\s"'`]++)\1|(?P<bare>[A-Za-z0-9+/_=.~-]++)(?![(\[{]))"""
)
_BEARER = re.compile(r"[\x20\t]{1,4}(?P<bare>[A-Za-z0-9+/_=.~-]++)")
#: Keys with a known head, by what the automaton finds of it.
_HEADED = {
    "akia": re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "asia": re.compile(r"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ghp_": re.compile(r"ghp_[A-Za-z0-9]{30,}+"),
    "gho_": re.compile(r"gho_[A-Za-z0-9]{30,}+"),
    "ghu_": re.compile(r"ghu_[A-Za-z0-9]{30,}+"),
    "ghs_": re.compile(r"ghs_[A-Za-z0-9]{30,}+"),
    "ghr_": re.compile(r"ghr_[A-Za-z0-9]{30,}+"),
    "github_pat_": re.compile(r"github_pat_[A-Za-z0-9_]{22,}+"),
    "glpat-": re.compile(r"glpat-[A-Za-z0-9_-]{20,}+"),
    "xox": re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}+"),
    "sk_live_": re.compile(r"sk_live_[A-Za-z0-9]{16,}+"),
    "rk_live_": re.compile(r"rk_live_[A-Za-z0-9]{16,}+"),
    "aiza": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "eyj": re.compile(r"eyJ[A-Za-z0-9_-]{6,}+\.eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]++"),
    "-----begin": re.compile(
        r"-----BEGIN (?P<name>(?:[A-Z0-9]{2,12}\x20){0,3}PRIVATE KEY)-----\s{0,4}(?:[A-Za-z-]{1,30}:\x20[^\n]{0,200}\n){0,4}[A-Za-z0-9+/=\s]*+(?:-----END (?P=name)-----)?+"
    ),
}

DIGITS = "0123456789"
#: In lower case; texts are searched without regard to case.
CUES = {
    "://": "scheme", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account",
    "token": "named", "secret": "named", "api_key": "named", "api-key": "named", "apikey": "named", "api key": "named", "access_key": "named",
    "accesskey": "named", "private_key": "named", "auth_key": "named", "password": "password", "passwd": "password", "passphrase": "password",
    "pwd": "password", "bearer": "bearer",
}
#: Least lengths of values: set to a name, set to a password in quotes, bare.
NAMED, PASSWORD, BARE_PASSWORD = 16, 6, 8
PLACEHOLDERS = ("${", "<", "{", "%", "$(")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+" + DIGITS:
        found.add_word(sign, (sign if sign in "@+" else "digit", 1))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    for head in _HEADED:
        found.add_word(head, (head, len(head)))
    found.make_automaton()
    return found


#: The digit sum of twice each digit.
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    """Whether the last of a string of ASCII digits is their check digit."""
    values = [int(d) for d in digits]
    return (sum(values[::-2]) + sum(DOUBLED[v] for v in values[-2::-2])) % 10 == 0


def mod_97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def folded(text: str) -> str:
    """``text`` in lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def spans_of(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end) in order of kind, then start."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = secret_end = set_end = 0
    for last, (kind, length) in automaton.iter(folded(text)):
        if kind == "digit":
            if last >= ip_end:
                ip_end, valid = _ip(text, last)
                if valid:
                    out.append((1, last, ip_end))
            if last >= card_end:
                card_end, valid = _card(text, last)
                if valid:
                    out.append((2, last, card_end))
            if last > 1 and text[last - 1].isupper() and (end := _iban(text, last - 2)):
                out.append((4, last - 2, end))
        elif kind == "@":
            start, end = _email(text, last, email_end)
            if end:
                out.append((0, start, end))
                email_end = end
        elif kind == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((3, last, phone_end))
        elif kind in _HEADED or kind in ("named", "password", "bearer"):
            first = last - length + 1
            if first >= (secret_end if kind in _HEADED else max(secret_end, set_end)):
                start, end, valid = _secret(text, kind, first, last + 1)
                set_end = max(set_end, end)
                if valid:
                    out.append((8, start, end))
                    secret_end = end
        else:
            out.extend(_cued(text, kind, last + 1))
    return sorted(set(out))


def _email(text: str, at: int, floor: int) -> tuple[int, int]:
    """Left over the local part, right over the labels; the end is 0 where there is none."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return start, m.end() if m else 0


def _ip(text: str, start: int) -> tuple[int, bool]:
    """The end of what the digits at ``start`` consume, and whether that is an address."""
    m = _IP.match(text, start)
    if not m:
        end = start + 1
        while end < len(text) and text[end] in DIGITS:
            end += 1
        return end, False
    return m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))


def _card(text: str, start: int) -> tuple[int, bool]:
    m = _CARD.match(text, start)
    if not m:
        return start + 1, False
    digits = m[0].replace(" ", "").replace("-", "")
    return m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _iban(text: str, start: int) -> int:
    """The end of the account number in capitals that begins at ``start`` with the code of a country, else 0."""
    length = IBAN_LENGTHS.get(text[start : start + 2])
    if not length or start and text[start - 1].isalnum():
        return 0
    m = _IBAN[length].match(text, start)
    return m.end() if m and m[0].isupper() and mod_97(m[0]) else 0


def _secret(text: str, kind: str, start: int, after: int) -> tuple[int, int, bool]:
    """Start and end of what the cue or head of ``kind`` at ``start`` consumes, and whether that is a secret."""
    if kind in _HEADED:
        before = text[start - 1] if start and kind != "-----begin" else " "
        inside = before.isalnum() or kind == "eyj" and before in "_-"
        m = None if inside else _HEADED[kind].match(text, start)
        return (start, m.end(), True) if m else (start, 0, False)
    m = (_BEARER if kind == "bearer" else _SET).match(text, after)
    if not m:
        return start, 0, False
    quoted = m.groupdict().get("quoted")
    value, at = (quoted, m.start("quoted")) if quoted else (m["bare"].rstrip("."), m.start("bare"))
    return at, at + len(value), by_chance(value, kind == "password", bool(quoted))


def by_chance(value: str, password: bool, quoted: bool) -> bool:
    """Whether a value set to a name looks like a secret and not like a word, a placeholder or code."""
    if len(set(value)) < 4 or value.startswith(PLACEHOLDERS):
        return False
    if password and quoted:
        return len(value) >= PASSWORD
    return len(value) >= (BARE_PASSWORD if password else NAMED) and any(c in DIGITS for c in value) and any(c.isalpha() for c in value)


def _cued(text: str, kind: str, after: int) -> list[tuple[int, int, int]]:
    if kind == "iban":
        for head in _IBAN_HEAD.finditer(text, after, after + 60):
            m = _IBAN.get(IBAN_LENGTHS.get(head[0][:2].upper()), _IBAN_ANY).match(text, head.start())
            if m and mod_97(m[0]):
                return [(4, m.start(), m.end())]
        return []
    if kind == "scheme":
        m = _LOGIN.match(text, after)
        return [(7, m.start(), m.end())] if m else []
    m = (_SSN if kind == "ssn" else _ACCOUNT).match(text, after)
    return [(5 if kind == "ssn" else 6, m.start(1), m.end(1))] if m else []


def find_pii(df: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with pii: array of (kind, start, end), code points, end exclusive."""
    kept = [c for c in (df.columns if keep is None else keep) if c != "pii"]
    needed = df.select(*kept, F.col(text).alias("_pii_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + ["pii array<struct<kind:string,start:int,end:int>>"])
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans_of(t, automaton)] for t in batch.column("_pii_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, spans)], [*kept, "pii"])

    return needed.mapInArrow(run, schema)


def mask_pii(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first rules."""
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            masked = []
            for t in batch.column(text).to_pylist():
                parts, at = [], 0
                for k, s, e in sorted(spans_of(t, automaton), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                        at = e
                masked.append(t if not parts else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(masked, pa.string()) if c == text else batch.column(c) for c in columns], columns)

    return df.mapInArrow(run, schema)


def joined_spans(pii, kinds: list[str]):
    """kind:start:end of the spans of ``kinds``, comma-joined, in the order of the list."""
    return F.array_join(F.transform(F.filter(pii, lambda s: s.kind.isin(kinds)), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

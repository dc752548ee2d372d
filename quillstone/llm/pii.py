"""Personal data by anchor expansion: an automaton finds cues, deterministic parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import arrow_limits

KINDS = ("email", "ip", "card", "phone", "url", "account", "iban", "key")
#: What parsers match at a place that an anchor gave; never searched for.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"://[^\s\"'<>]+")
#: Blanks are taken once and for all at each place, so that a run of them is read once.
VALUE = re.compile(r"[\x20\t]*+(?:(?:no|number|nr)\.?)?[\x20\t]*+[:=#]?[\x20\t]*+[\"']?([A-Za-z0-9][A-Za-z0-9_/+-]{5,})")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Public shapes of access keys, by the prefix that anchors them (fixed values).
KEYS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ASIA": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "gho_": re.compile(r"gho_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "ghs_": re.compile(r"ghs_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{20,}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{20,}"),
    "AIza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "sk-": re.compile(r"sk-[0-9A-Za-z_-]{20,}"),
    "eyJ": re.compile(r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"),
    "-----BEGIN ": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
}
#: The rest of a token's first part: where none begins at a place of it, none begins at a later one.
PART = re.compile(r"[0-9A-Za-z_-]*+")
#: Words before an account identifier or a secret.
CUES = (
    "account", "acct", "iban", "passport", "ssn", "token", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "secret", "user_id", "customer_id",
    "licence", "license", "access_key", "private_key", "client_secret", "credential", "bearer", "konto", "compte", "cuenta",
)

_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for kind, words in (("@", "@"), ("+", "+"), ("digit", "0123456789"), ("url", ["://"])):
            for w in words:
                auto.add_word(w, (kind, len(w)))
        for w in KEYS:
            auto.add_word(w, ("key " + w, len(w)))
        for w in CUES:
            for form in {w, w.upper(), w.capitalize()}:
                auto.add_word(form, ("cue", len(form)))
        auto.make_automaton()
        _automata.append(auto)
    return _automata[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(found: str) -> bool:
    """Whether the check digits fit: the letters as numbers, the first four places last, modulo 97."""
    plain = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind; starts and ends in code points, ends exclusive.

    Of each base kind (email, ip, card, phone) the leftmost non-overlapping matches of its pattern, less those that fail
    validation: every match of a kind holds an anchor (an at-sign, a digit, a plus sign) whose surroundings settle its
    start, so taking anchors from left to right, each from where the last match of its kind ended, gives those matches.
    The other kinds are beside them: url from schemes, account from identifier cues with a value that has a digit, iban where
    check digits fit, key from the prefixes of access keys.
    """
    out: list[tuple[str, int, int]] = []
    end, dead = dict.fromkeys(KINDS, 0), 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= end["ip"] and (at == end["ip"] or text[at - 1 : at] not in DIGITS) and (m := IP.match(text, at)):
                end["ip"] = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append(("ip", at, m.end()))
            if at >= end["card"] and (m := CARD.match(text, at)):
                end["card"] = m.end()
                if 12 <= len(found := _digits(m[0])) <= 19 and luhn(found):
                    out.append(("card", at, m.end()))
            if at >= end["iban"] + 2 and not text[max(0, at - 3) : at - 2].isalnum() and (m := IBAN.match(text, at - 2)) and iban(m[0]):
                end["iban"] = m.end()
                out.append(("iban", at - 2, m.end()))
        elif kind == "@":
            start = at
            while start > end["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                end["email"] = m.end()
                out.append(("email", start, m.end()))
        elif kind == "+":
            if at >= end["phone"] and (m := PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "url":
            start = at
            while start > end["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1  # a scheme begins with a letter
            if start < at and (m := URL.match(text, at)):
                end["url"] = m.end()
                if "@" in m[0] or "?" in m[0]:  # user information or query parameters: the parts that tell of a person
                    out.append(("url", start, m.end()))
        elif kind.startswith("key "):
            if at >= end["key"] and not (at < dead and kind == "key eyJ") and not text[max(0, at - 1) : at].isalnum():
                if m := KEYS[kind[4:]].match(text, at):
                    end["key"] = m.end()
                    out.append(("key", at, m.end()))
                elif kind == "key eyJ":
                    dead = PART.match(text, at).end()
        elif not (text[at - 1 : at].isalnum() or text[last + 1 : last + 2].isalnum()) and (m := VALUE.match(text, last + 1)):
            if m.start(1) >= end["account"] and any(c in DIGITS for c in m[1]):
                end["account"] = m.end(1)
                out.append(("account", m.start(1), m.end(1)))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = KINDS[:4]
    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "n_spans"]
    for batch in batches:
        rows = []
        for value in batch.column(1):
            spans = find_spans(value.as_py() or "")
            own = [s for s in spans if s[0] in base]
            counts = [sum(s[0] == k for s in own) for k in base]
            rows.append((*counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans), len(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def find_private(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans for each row of a table with doc_id and text.

    Counts and digest are over the base kinds; spans and n_spans are of all kinds. Each text is one pass of the automaton in one task.

    Edge cases: null and empty texts have no spans (the digest is that of the empty string); null ids and repeated rows
    pass through; texts of any length are read whole; other columns are ignored; an empty table gives an empty result.
    """
    arrow_limits(df.sparkSession)
    kind = dict(df.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return df.select("doc_id", "text").mapInArrow(_report, schema)

"""Personal data replaced by format-preserving pseudonyms (operator 5).

Found and validated: card numbers (13 to 19 digits, Luhn), social security
numbers, phone numbers, IPv4 addresses, dates (real calendar days; month first
with slashes and day first with dots, unless only the other order is a date), e-mail
addresses, IBANs (mod 97) and secret values of 32 or more hex digits given to a
token, key or secret. Other long digit groups that look like account numbers
(16 digits that fail Luhn) are replaced too, as numbers of that length. Cards and
accounts are sought in whole runs of digit groups, however many groups stand beside
them (``cards``); a card written in the usual groups goes before a phone number. Of another match that holds more than the value (a number or word
next to it) the part that is valid is replaced (``reading``), and if none is, the
search goes on from its next group. Not looked for: dates in words, IBANs in lower
case, IPv6 addresses.

A value is cut into its free parts, these are one number below ``n``, and a
keyed Feistel network permutes the numbers below ``n`` (cycle walking keeps it
in range); the result is written back in the same format: same length,
separators, letter case and kind of character, and valid in the same way (check
digits are set anew, dates stay dates). Equal values have equal pseudonyms in
every document and beside anything, different values of a format different ones.
The key and the reported places undo every row (``restore``). The key alone
(``reverse=True``) undoes it too, but for a card or account next to other digit
groups that happen to be read as a number together with its pseudonym.

The key is the setting ``spark.factsift.pii.key``, where the session has it, or an
argument; ``KEY`` is for tests.

The work is local to a row; nothing is shuffled. Null texts stay null, empty
ones empty; texts are read whole, in time linear in their length; null and repeated
doc_ids are rows like others; an empty table gives no rows. The query reads doc_id
and text only, ``pseudonymise`` keeps every column as it was but text and n_chars
(if there is one).
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common

KEY = b"change-me-per-corpus"
ROUNDS = 8
KINDS = ("email", "card", "account", "ssn", "phone", "ip", "date", "iban", "secret")
DAY_ZERO = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - DAY_ZERO + 1

# ---- fixed values: the formats looked for ---------------------------------------
FORMATS = re.compile(r"""
    (?P<email>(?<![\w.+-])[.+-]*\w[\wÀ-ÿ.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))
  | (?P<secret>(?i:(?:token|secret|api[_-]?key|key|password)["']?\s*[=:]\s*["']?)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
  | (?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
""", re.VERBOSE)
PHONE = re.compile(r"""
    (?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w+])\+[0-9]{8,15}(?![\w])
      |(?<![\w+])\+[0-9]{1,3}(?:[ ./-]?\([0-9]{1,5}\)|[ ./-][0-9]{1,8})(?:[ ./-]?[0-9]{2,8}){1,6}(?![\w]))
""", re.VERBOSE)
# digit groups of 13 or more digits in all, with single spaces or hyphens between
DIGITS = re.compile(r"(?<![\w+])[0-9](?:[ -]?[0-9]){12,}(?!\w)")

# characters of an account number by country, where it is fixed (ISO 13616)
IBAN_CHARS = {c: int(n) for n, names in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in names.split(",")}
# how cards are written in groups
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}

# every format has one of these in it
ANY = re.compile(r"[0-9@]|[a-f]{32}|[A-F]{32}")


# ---- the permutation ------------------------------------------------------------
@lru_cache(maxsize=100_000)
def permute(value: int, n: int, tweak: str, key: bytes = KEY, reverse: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1."""
    if n < 2:
        return value
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(i: int, x: int) -> int:
        digest = hmac.new(key, f"{tweak}/{n}/{i}/{x}".encode(), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") & mask if half <= 256 else int.from_bytes(
            hashlib.shake_256(digest).digest((half + 7) // 8), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if reverse:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ mixed(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ mixed(i, right)
        value = (left << half) | right
        if value < n:
            return value


def permute_chars(text: str, tweak: str, key: bytes, reverse: bool, extra: str = "") -> str:
    """Digits stay digits, letters letters of the same case; the rest stays.
    ``extra`` names characters that count as hex digits' letters."""
    alphabets = []
    for c in text:
        if extra and (c.isdigit() or c.lower() in "abcdef"):
            alphabets.append("0123456789abcdef" if extra == "lower" else "0123456789ABCDEF")
        elif "0" <= c <= "9":
            alphabets.append("0123456789")
        elif "a" <= c <= "z":
            alphabets.append("abcdefghijklmnopqrstuvwxyz")
        elif "A" <= c <= "Z":
            alphabets.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        elif "À" <= c <= "ÿ" and c.isalpha():
            alphabets.append("".join(x for x in map(chr, range(0xC0, 0x100)) if x.isalpha() and x.islower() == c.islower()))
        else:
            alphabets.append(c)
    value, n = 0, 1
    for c, a in zip(text, alphabets):
        value, n = value * len(a) + a.index(c), n * len(a)
    # the format is part of the tweak: formats never share a permutation
    shape = "".join(a[0] for a in alphabets)
    value = permute(value, n, f"{tweak}/{shape}", key, reverse)
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def luhn(digits: str) -> int:
    """The Luhn sum mod 10 (0: valid)."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def valid(kind: str, text: str) -> bool:
    """Whether an IBAN or phone number is one."""
    bare = "".join(c for c in text if c.isascii() and c.isalnum())
    if kind == "iban":
        return 15 <= len(bare) <= 34 and iban_rest(bare) == 1
    return 7 <= len(bare) <= (15 if text[0] == "+" else 16)


def cards(text: str, written: bool = False) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the cards and accounts in a run of digit groups.

    Taken in this order, from the left, where no number taken before lies: valid cards as
    they are written in groups, the whole run if valid, 16 digits that fail the check (in
    fours, undivided, or the whole run), other valid runs of groups, the longest first;
    ``written``: only the first of these."""
    runs = [m.span() for m in re.finditer(r"[0-9]+", text)]
    found: list[tuple] = []
    for i in range(len(runs)):
        digits = ""
        for j in range(i, len(runs)):
            digits += text[runs[j][0]:min(runs[j][1], runs[j][0] + 20)]
            n = len(digits)
            if n > 19:
                break
            if n < 13:
                continue
            usual, whole = tuple(b - a for a, b in runs[i:j + 1]) in CARD_GROUPS, j - i + 1 == len(runs)
            if luhn(digits) == 0:
                found.append((0, 0, i, j, "card") if usual else (1, 0, i, j, "card") if whole else (3, -n, i, j, "card"))
            elif n == 16 and (usual or whole):
                found.append((2, 0, i, j, "account"))
    used = [False] * len(runs)
    out = []
    for tier, _, i, j, kind in sorted(found):
        if not any(used[i:j + 1]) and not (written and tier):
            used[i:j + 1] = [True] * (j - i + 1)
            out.append((kind, runs[i][0], runs[j][1]))
    return sorted(out, key=lambda x: x[1])


def reading(kind: str, text: str) -> tuple[int, int] | None:
    """Where in a match the value is; None if no reading of it is valid.

    IBANs: the country's length, then others from the longest. Phone numbers:
    as many groups as a number can have."""
    if kind not in ("iban", "phone"):
        return 0, len(text)
    ends = [m.end() for m in re.finditer(r"[0-9A-Za-z]+", text)]
    if kind == "phone":
        ends = [b + (text[b:b + 1] == ")") for b in ends]
    ends.reverse()
    if kind == "iban":
        # the country's own length first
        ends.sort(key=lambda b: len(text[:b].replace(" ", "")) != IBAN_CHARS.get(text[:2]))
    return next(((0, b) for b in ends if valid(kind, text[:b])), None)


def pseudonym(kind: str, text: str, key: bytes = KEY, reverse: bool = False) -> str | None:
    """The pseudonym of a found value; None if it isn't valid."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind in ("card", "account"):
        if luhn(digits) == 0:
            body = permute_chars(digits[:-1], "card", key, reverse)
            return _refill(text, body + str(-luhn(body + "0") % 10))
        if len(digits) == 16:
            n = 9 * 10 ** 15      # numbers that fail the check, in order, without their check digit gaps
            index = int(digits[:-1]) * 9 + (int(digits[-1]) - 1 - (-luhn(digits[:-1] + "0") % 10)) % 10
            index = permute(index, n, "account", key, reverse)
            body, k = divmod(index, 9)
            body = f"{body:015d}"
            return _refill(text, body + str((k + 1 + (-luhn(body + "0") % 10)) % 10))
        return None
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        index = permute(index, 898 * 99 * 9999, "ssn", key, reverse)
        index, serial = divmod(index, 9999)
        area, group = divmod(index, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        if not valid(kind, text):
            return None
        plus = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        at = plus.end() if plus else 0      # a country code that is set apart stays
        return text[:at] + permute_chars(text[at:], "phone", key, reverse)
    if kind == "ip":
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = permute(sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts)), 1 << 32, "ip", key, reverse)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        sep = next(c for c in text if not c.isdigit())
        parts = text.split(sep)
        day_first, year_first = sep == ".", len(parts[0]) == 4
        # a month over 12 is a day: the other order, among the dates that show it too
        other = not year_first and int(parts[1 if day_first else 0]) > 12
        day_first ^= other
        y, m, d = parts if year_first else (parts[2], parts[1], parts[0]) if day_first else (parts[2], parts[0], parts[1])
        try:
            ordinal = datetime.date(int(y), int(m), int(d)).toordinal() - DAY_ZERO
        except ValueError:
            return None
        if not 0 <= ordinal < DAYS:
            return None
        while True:
            ordinal = permute(ordinal, DAYS, "date/other" if other else "date", key, reverse)
            new = datetime.date.fromordinal(DAY_ZERO + ordinal)
            if not other or new.day > 12:
                break
        if year_first:
            return new.isoformat().replace("-", sep)
        a, b = (new.day, new.month) if day_first else (new.month, new.day)
        return f"{a:02d}{sep}{b:02d}{sep}{new.year}"
    if kind == "email":
        user, domain = text.rsplit("@", 1)
        labels = domain.split(".")
        free = user + "@" + ".".join(labels[:-2]) if len(labels) > 2 else user
        return permute_chars(free, "email", key, reverse) + ("." if len(labels) > 2 else "@") + ".".join(labels[-2:])
    if kind == "iban":
        if not valid(kind, text):
            return None
        bare = text.replace(" ", "")
        body = permute_chars(bare[4:], "iban/" + bare[:2], key, reverse)
        bare = bare[:2] + f"{98 - iban_rest(bare[:2] + '00' + body):02d}" + body
        it = iter(bare)
        return "".join(c if c == " " else next(it) for c in text)
    at = re.search(r"[0-9a-fA-F]{32,}$", text).start()
    value = text[at:]
    return text[:at] + permute_chars(value, "secret", key, reverse, "upper" if re.search("[A-F]", value) else "lower")


def scan(formats: re.Pattern, text: str, pos: int, end: int, key: bytes, reverse: bool) -> list[tuple]:
    """``(start, end, kind, pseudonym)`` of the values of ``formats`` in a part of the text."""
    out = []
    while m := formats.search(text, pos, end):
        kind, match, start = m.lastgroup, m.group(), m.start()
        if kind == "email":
            match = match.rstrip(".-")
        span = reading(kind, match)
        new = pseudonym(kind, match[slice(*span)], key, reverse) if span else None
        if new is None:
            # go on from the match's next group
            pos = start + max(1, re.match(r"\W*[^\W_]*", match).end())
            continue
        pos = start + span[1]
        out.append((start + span[0], pos, kind, new))
    return out


def numbers(text: str, pos: int, end: int, key: bytes, reverse: bool, written: bool) -> list[tuple]:
    """The same of the cards and accounts; ``written``: only cards in the usual groups."""
    return [(m.start() + a, m.start() + b, kind, pseudonym(kind, text[m.start() + a:m.start() + b], key, reverse))
            for m in DIGITS.finditer(text, pos, end) for kind, a, b in cards(m.group(), written)]


def values(text: str, key: bytes, reverse: bool) -> list[tuple]:
    """``(start, end, kind, pseudonym)`` of a text's values, in order."""
    found: list[tuple] = []
    for step in (lambda a, b: scan(FORMATS, text, a, b, key, reverse),
                 lambda a, b: numbers(text, a, b, key, reverse, True),
                 lambda a, b: scan(PHONE, text, a, b, key, reverse),
                 lambda a, b: numbers(text, a, b, key, reverse, False)):
        # each in the parts that are left
        borders = zip([0, *(v[1] for v in found)], [*(v[0] for v in found), len(text)])
        found = sorted([*found, *(v for a, b in list(borders) for v in step(a, b))])
    return found


def replace(text: str | None, key: bytes = KEY, reverse: bool = False) -> tuple[str | None, list[tuple]]:
    """The text with pseudonyms, and ``(kind, start, end, new start, new end)`` of each."""
    if not text or not ANY.search(text):
        return text, []
    out, spans, at, grown = [], [], 0, 0
    for start, end, kind, new in values(text, key, reverse):
        out += [text[at:start], new]
        spans.append((kind, start, end, start + grown, start + grown + len(new)))
        at = end
        grown += len(new) - (end - start)
    return "".join([*out, text[at:]]) if spans else text, spans


def undo(text: str | None, spans: list[tuple], key: bytes = KEY) -> str | None:
    """The text that ``replace`` was given, from its text and spans."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, _, _, start, end in spans:
        out += [text[at:start], pseudonym(kind, text[start:end], key, True)]
        at = end
    return "".join([*out, text[at:]])


# ---- Spark ----------------------------------------------------------------------
def _key(spark: SparkSession, key: bytes | None) -> bytes:
    if key is not None:
        return key
    kept = spark.conf.get("spark.factsift.pii.key", None)
    return kept.encode() if kept else KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None, reverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; n_chars follows the text, if it is a column."""
    common.prepare(docs.sparkSession)
    key = _key(docs.sparkSession, key)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [replace(t, key, reverse)[0] for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, type=columns[at].type)
            if size is not None:
                kept = columns[size].to_pylist()
                columns[size] = pa.array([n if x == y else len(y) for n, x, y in zip(kept, old, new)], type=columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


REPORT = ("doc_id long, text string, n_found long, "
          "spans array<struct<kind:string,old_start:long,old_end:long,start:long,end:long>>")


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Per row the new text and where its pseudonyms are (and what they replaced)."""
    common.prepare(docs.sparkSession)
    key = _key(docs.sparkSession, key)
    span = pa.struct([("kind", pa.string()), *((x, pa.int64()) for x in ("old_start", "old_end", "start", "end"))])

    def run(batches):
        for b in batches:
            done = [replace(t, key) for t in b.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "old_start", "old_end", "start", "end"), s)) for s in found] for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in done], type=pa.string()),
                 pa.array([len(f) for f in spans], type=pa.int64()), pa.array(spans, type=pa.list_(span))],
                names=["doc_id", "text", "n_found", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, REPORT)


def restore(reported: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id, text`` as they were before ``report``."""
    common.prepare(reported.sparkSession)
    key = _key(reported.sparkSession, key)

    def run(batches):
        for b in batches:
            texts = [undo(t, [tuple(s.values()) for s in spans or ()], key)
                     for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return reported.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with pseudonyms, and how many of each kind."""
    found = report(common.table(spark, sf_dir, "documents"))

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).alias(f"n_{kind}")

    kinds = [of_kind(k) for k in KINDS]
    return found.select("doc_id", "text", "n_found", *kinds)

"""Personal data: keyed, format-preserving pseudonyms by a Feistel network.

Each value found is read as a number in the domain of its format (digits of a card, lower-case letters of a name,
days of a calendar) and permuted there by a balanced Feistel network whose rounds are keyed
hashes; a result outside the domain is permuted again until it is inside (cycle walking).  The same value
always becomes the same pseudonym under one key, in every document, and no two values share one.

Found: e-mail addresses (name permuted, domain kept), telephone numbers (the digits after the country code, which is
kept, so that a number is linked however it is written), card numbers of 13 to 19 digits and IBANs if their check
digits are right (and then right in the pseudonym too; other digits stay), IPv4 addresses,
social security numbers (valid parts only), valid dates (yyyy-mm-dd, yyyy/mm/dd and dd.mm.yyyy or
mm/dd/yyyy between 1900 and 2099, day for day), access key ids, and hex values given to a name such as
token or password.  Anything else stays as it is, byte for byte.

Inputs: any frame with a text column; other columns are kept.  Null stays null, empty stays empty, texts
are read whole, rows are never dropped.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_exact, table

ROUNDS = 8
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
UPPER32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FIRST, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
TEST_KEY = b"set a secret key of your own"
KEY_SETTING = "salescast.pseudonyms.key"  # of the session: the secret key; without it TEST_KEY, which is public
# The country calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = """20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58
60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98""".split()

FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[\w+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b[ \t]*[=:][ \t]*[\"']?)(?P<hex>[0-9a-fA-F]{8,})(?![0-9A-Za-z]))"
    r"|(?P<access>\bAKIA[A-Z0-9]{16}\b)"
    r"|(?P<ymd>(?<![\w.-])(?:19|20)\d\d(?P<s1>[-/])\d\d(?P=s1)\d\d(?![\w-]))"
    r"|(?P<dmy>(?<![\w.-])\d\d(?P<s2>[./])\d\d(?P=s2)(?:19|20)\d\d(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<![\w.])\+(?!1\D)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<iban>(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    , re.ASCII)
DIGIT = re.compile(r"[0-9@]")
HINTS = ("AKIA", "=", ":")  # what values without a digit or @ must have
KINDS = ("email", "secret", "access", "ymd", "dmy", "ip", "ssn", "phone", "iban", "card")


def luhn(digits: str) -> int:
    """The check sum of a card number; 0 for a valid one."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10


def card_in(s: str) -> tuple[int, int] | None:
    """Where in digits and separators a valid card number is: the longest run of groups, the first of equal ones."""
    groups = [m.span() for m in re.finditer(r"\d+", s)]
    best = None
    for i, (a, _) in enumerate(groups):
        for _, b in groups[i:]:
            digits = re.sub(r"\D", "", s[a:b])
            if 13 <= len(digits) <= 19 and luhn(digits) == 0 and (best is None or b - a > best[1] - best[0]):
                best = a, b
    return best


def mod97(iban: str) -> int:
    """1 for a valid IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """A keyed permutation of range(n) for every n, and what the formats make of it."""

    def __init__(self, key: bytes):
        self.key, self.known = blake2b(key, digest_size=32).digest(), {}

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        """The keyed permutation of range(n), or its inverse."""
        half = (max((n - 1).bit_length(), 2) + 1) // 2
        mask, size = (1 << half) - 1, (half + 7) // 8

        def f(r, v):
            return int.from_bytes(blake2b(f"{kind}|{n}|{r}|{v}".encode(), key=self.key, digest_size=size).digest(),
                                  "big") & mask

        while True:
            left, right = x >> half, x & mask
            for r in range(ROUNDS):
                if back:
                    left, right = right ^ f(ROUNDS - 1 - r, left), left
                else:
                    left, right = right, left ^ f(r, right)
            x = left << half | right
            if x < n:
                return x

    def walk(self, x: int, n: int, kind: str) -> int:
        """A permutation of range(n) that moves every value: one step along the keyed order, back in place."""
        return self.permute((self.permute(x, n, kind) + 1) % n, n, kind, back=True) if n > 1 else x

    def word(self, s: str, kind: str) -> str:
        """Every character within its own class: digits, lower-case and capital letters; the rest stays."""
        classes = [next((a for a in (DIGITS, LETTERS, LETTERS.upper()) if c in a), "") for c in s]
        n, x = 1, 0
        for c, a in zip(s, classes, strict=True):
            if a:
                n, x = n * len(a), x * len(a) + a.index(c)
        y, out = self.walk(x, n, f"{kind}:{''.join(a[:1] or '.' for a in classes)}"), []
        for c, a in zip(reversed(s), reversed(classes), strict=True):
            if a:
                y, k = divmod(y, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))

    def over(self, s: str, alphabet: str, kind: str) -> str:
        n, x = len(alphabet) ** len(s), 0
        for c in s:
            x = x * len(alphabet) + alphabet.index(c)
        y, out = self.walk(x, n, f"{kind}{len(s)}"), ""
        for _ in s:
            y, k = divmod(y, len(alphabet))
            out = alphabet[k] + out
        return out

    def into(self, digits: str, shape: str) -> str:
        """``shape`` with its digits, from the right, replaced by ``digits``."""
        left = list(digits)
        return "".join(reversed([left.pop() if c in DIGITS and left else c for c in reversed(shape)]))

    def of(self, kind: str, s: str) -> str:
        got = self.known.get((kind, s))
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[kind, s] = getattr(self, kind)(s)
        return got

    def email(self, s: str) -> str:
        name, domain = s.rsplit("@", 1)
        return f"{self.word(name, 'email')}@{domain}"

    def hex(self, s: str) -> str:
        return self.over(s.lower(), HEX, "hex") if s != s.upper() or s.isdigit() else self.over(s.lower(), HEX, "hex").upper()

    def access(self, s: str) -> str:
        return "AKIA" + self.over(s[4:], UPPER32, "access")

    def day(self, year: int, month: int, day: int):
        if not (1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]):
            return None
        return FIRST + timedelta(self.walk((date(year, month, day) - FIRST).days, DAYS, "day"))

    def ymd(self, s: str) -> str:
        d = self.day(int(s[:4]), int(s[5:7]), int(s[8:]))
        return d.strftime(f"%Y{s[4]}%m{s[4]}%d") if d else s

    def dmy(self, s: str) -> str:
        order = ("%d", "%m") if s[2] == "." else ("%m", "%d")
        a, b, y = int(s[:2]), int(s[3:5]), int(s[6:])
        d = self.day(y, b, a) if s[2] == "." else self.day(y, a, b)
        return d.strftime(f"{order[0]}{s[2]}{order[1]}{s[2]}%Y") if d else s

    def ip(self, s: str) -> str:
        x = 0
        for part in s.split("."):
            x = x << 8 | int(part)
        y = self.walk(x, 1 << 32, "ip")
        return ".".join(str(y >> k & 255) for k in (24, 16, 8, 0))

    def ssn(self, s: str) -> str:
        a, b, c = int(s[:3]), int(s[4:6]), int(s[7:])
        a -= 1 + (a > 666)  # areas 001-665 and 667-899
        y = self.walk((a * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, "ssn")
        y, c = divmod(y, 9999)
        a, b = divmod(y, 99)
        a += 1 + (a >= 665)
        return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"

    def phone(self, s: str) -> str:
        code = ""
        if s[0] == "+":
            digits = re.sub(r"\D", "", s)
            n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
            code = re.match(r"\+" + r"\D*\d" * n, s)[0]
        rest = s[len(code):]
        return code + self.into(self.over(re.sub(r"\D", "", rest), DIGITS, "phone"), rest)

    def card(self, s: str) -> str:
        """``s``, a valid card number."""
        digits = re.sub(r"\D", "", s)
        body = digits[0] + self.over(digits[1:-1], DIGITS, "card" + digits[0])  # the first digit is the kind of issuer
        return self.into(body + next(c for c in DIGITS if luhn(body + c) == 0), s)

    def iban(self, s: str) -> str:
        """``s``, a valid IBAN."""
        plain = s.replace(" ", "")
        body = self.word(plain[4:], "iban" + plain[:2])
        out = iter(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(out) for c in s)

    def text(self, text: str) -> tuple[str, int]:
        """``text`` with its personal data replaced, and how many values were."""
        n = 0
        # no value goes beyond a line, and most lines have none
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if not (DIGIT.search(line) or any(h in line for h in HINTS)):
                continue
            out, at, look = [], 0, 0
            while m := FOUND.search(line, look):
                kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
                a, b = m.span()
                if kind == "secret":
                    kind, a = "hex", m.start("hex")
                elif kind == "card":
                    found = card_in(m[0])
                    if found is None:
                        look = a + len(re.match(r"\d+", m[0])[0])
                        continue
                    a, b = a + found[0], a + found[1]
                elif kind == "iban" and mod97(m[0].replace(" ", "")) != 1:
                    look = a + 4
                    continue
                new = self.of(kind, line[a:b])
                n += new != line[a:b]
                out += [line[at:a], new]
                at = look = b
            lines[k] = "".join(out) + line[at:]
        return "\n".join(lines), n


def session_key(spark) -> bytes:
    """The secret key of the session's setting KEY_SETTING; TEST_KEY where it is unset, as in tests."""
    key = spark.conf.get(KEY_SETTING, None)
    return key.encode() if key else TEST_KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None, column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``column`` replaced under ``key`` (the session's if None); ``count`` names a column for the number of values."""
    schema = docs.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != count)
    keep = [f.name for f in schema if f.name != count]

    key = session_key(docs.sparkSession) if key is None else key

    def run(batches):
        p = Pseudonyms(key)
        for pdf in batches:
            got = [p.text(t) if t is not None else (None, 0) for t in pdf[column].astype(object)
                   .where(pdf[column].notna(), None)]
            out = pdf.assign(**{column: [t for t, _ in got]})
            if count:
                out[count] = pd.Series([n for _, n in got], dtype="int64", index=out.index)
            yield out

    return map_exact(docs.select(*keep), run, fields + (f", `{count}` long" if count else ""))


def op5_pseudonyms(spark, sf_dir):
    """Whole ``documents`` with their pseudonyms."""
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), count="n_values") \
        .select("doc_id", "text", F.col("n_values"))

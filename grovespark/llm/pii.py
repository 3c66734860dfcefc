"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern and validated (Luhn and mod-97 check digits,
octet ranges, groups of IPv6, calendar days); a keyed Feistel network then permutes each within the
set of values of its own format.  The permutation depends on the key and the format
alone, so equal values get equal pseudonyms in every document, different values get
different ones, and ``Pseudonyms.restore`` undoes it with the key.  What fails
validation stays as it is.

Rows are independent: one pass, no shuffle, nothing shared but the key.

Letters of any script are replaced within their own stretch of the code table and case.
The key is the caller's: whoever has it can restore the data.

Defined results: null text stays null with no findings; an empty text stays empty;
overlapping findings are resolved in the order of ``KINDS``, then by position; all
other text, columns and repeated rows stay untouched.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from grovespark.llm.common import batched, kept_columns, schema_of

ROUNDS = 10
KINDS = ("email", "secret", "iban", "card", "ip", "ipv6", "phone", "phone_abroad", "ssn", "date")

#: The shapes that are looked for.
LOCAL_PART = re.compile(r"[\w.%+-]{1,64}\Z")
DOMAIN = re.compile(r"(?:[^\W_]|-){1,63}(?:\.(?:[^\W_]|-){1,63}){0,8}\.[^\W\d_]{2,24}(?![^\W_]|-)")
SECRET = re.compile(r"""(?i)(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,4}[=:]\s{0,4}["']?([A-Za-z0-9+/_-]{8,256})""")
HEX = re.compile(r"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)")
IP = re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:(?=:))(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.]*[\w:])")
ABROAD = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d\)?){6,13}(?!\d)")
PHONE = re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\d)\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)")
SSN = re.compile(r"(?<![\d-])(?<!\d )\d{3}([- ])\d{2}\1\d{4}(?![\d-]| \d)")
DATE = re.compile(r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])")
ANYTHING = re.compile(r"[0-9@=:]").search
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


@functools.lru_cache(maxsize=4096)
def alphabet_of(c: str) -> str:
    """The characters that may take the place of ``c``: ASCII digits, ASCII letters, or letters and digits of its case among 128 neighbours."""
    if c.isascii():
        return "" if not c.isalnum() else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"
    if not c.isalnum():
        return ""
    begin = max(128, ord(c) & ~127)
    return "".join(x for x in map(chr, range(begin, begin + 128)) if x.isalnum() and x.isupper() == c.isupper() and x.isdigit() == c.isdigit())


class Feistel:
    """Keyed permutation of 0 .. size-1 for any size: two halves of a mixed radix, and walking on while outside."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def mix(self, tag: str, turn: int, half: int, size: int) -> int:
        data = f"{tag}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big") % size

    def once(self, value: int, size: int, tag: str, back: bool) -> int:
        low = math.isqrt(max(size - 1, 0)) + 1
        high = -(-size // low)
        a, b = divmod(value, low)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2 == 0:
                a = (a + sign * self.mix(tag, turn, b, high)) % high
            else:
                b = (b + sign * self.mix(tag, turn, a, low)) % low
        return a * low + b

    def permute(self, value: int, size: int, tag: str, member: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """Within the values for which ``member`` holds; value must be one."""
        while True:
            value = self.once(value, size, tag, back)
            if value < size and member(value):
                return value


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def permute(self, value: int, size: int, tag: str, member: Callable[[int], bool] = lambda v: True) -> int:
        return self.feistel.permute(value, size, tag, member, self.back)

    def shaped(self, value: str, tag: str, alphabet: str = "", member: Callable[[str], bool] | None = None) -> str:
        """Letters and digits within their own class and place; case and everything else stays.

        ``alphabet`` names the characters, if all of the value comes from fewer;
        ``member`` tells which results there may be.
        """
        sets = [(alphabet if c.isascii() and c.isalnum() else "") if alphabet else alphabet_of(c) for c in value]
        number, size = 0, 1
        for c, own in zip(value, sets, strict=True):
            if own:
                number, size = number * len(own) + own.index(c.lower() if c.isascii() else c), size * len(own)
        tag += "".join("." if not own else "h" if alphabet else "9" if own[0] == "0" else own[0] for own in sets)
        fits = (lambda v: member(self.written(v, value, sets, alphabet))) if member else (lambda v: True)
        return self.written(self.permute(number, size, tag, fits), value, sets, alphabet)

    @staticmethod
    def written(number: int, value: str, sets: list[str], alphabet: str) -> str:
        out = []
        for c, own in zip(reversed(value), reversed(sets), strict=True):
            if own:
                number, k = divmod(number, len(own))
                c = own[k].upper() if c.isascii() and (value.isupper() if alphabet else c.isupper()) else own[k]
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def refill(value: str, digits: str) -> str:
        """The digits, in order, in the places of the value's digits."""
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in value)

    def email(self, value: str) -> str:
        name, _, ending = value.rpartition(".")
        return f"{self.shaped(name, 'email')}.{ending}"

    def secret(self, value: str) -> str:
        one_case = value in (value.lower(), value.upper())
        return self.shaped(value, "secret", "0123456789abcdef" if one_case and re.fullmatch(r"[0-9a-fA-F]{16,}", value) else "")

    def iban(self, value: str) -> str | None:
        """In one piece or in groups of four; both get the same pseudonym."""
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        inner = self.shaped(plain[4:], "iban" + plain[:2])
        new = iter(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + inner):02d}{inner}")
        return "".join(c if c == " " else next(new) for c in value)

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn(digits) % 10 or not digits.strip("0"):
            return None
        n, zero = len(digits) - 1, digits[0] == "0"
        inner = self.permute(int(digits[:-1]), 10**n, f"card{n}", lambda v: (v < 10 ** (n - 1)) == zero and v > 0)
        text = f"{inner:0{n}d}"
        return self.refill(value, text + str(-luhn(text + "0") % 10))

    def ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        number = self.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ip")
        return ".".join(map(str, number.to_bytes(4, "big")))

    def ipv6(self, value: str) -> str | None:
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        letters = any(c.isalpha() for c in value)
        if not any(c.isdigit() for c in value):  # rather a name in some programming language
            return None
        if letters and value not in (value.lower(), value.upper()):
            value = value.lower()
        return self.shaped(value, "ipv6", "0123456789abcdef", lambda new: any(c.isalpha() for c in new) == letters and any(c.isdigit() for c in new))

    def phone_abroad(self, value: str) -> str | None:
        """The country's code stays: what stands apart, or else two digits."""
        digits, head = re.sub(r"\D", "", value), re.match(r"\+(\d{1,3})(?=[ .(-])", value)
        code = len(head[1]) if head else 2
        if not 8 <= len(digits) <= 15:
            return None
        n, zero = len(digits) - code, digits[code] == "0"
        number = self.permute(int(digits[code:]), 10**n, f"abroad{digits[:code]}.{n}", lambda v: (v < 10 ** (n - 1)) == zero)
        return self.refill(value, digits[:code] + f"{number:0{n}d}")

    def phone(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        own = digits[-10:]
        usual = lambda v: v // 10**9 >= 2 and v // 10**6 % 10 >= 2  # noqa: E731  area and exchange begin with 2 to 9
        kind = usual(int(own))
        number = self.permute(int(own), 10**10, "phone", lambda v: usual(v) == kind)
        return self.refill(value, digits[:-10] + f"{number:010d}")

    def ssn(self, value: str) -> str | None:
        valid = lambda v: 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
        number = int(re.sub(r"\D", "", value))
        return self.refill(value, f"{self.permute(number, 10**9, 'ssn', valid):09d}") if valid(number) else None

    def date(self, value: str) -> str | None:
        parts = re.split(r"\D", value)
        year, month, day = map(int, parts if len(parts[0]) == 4 else reversed(parts))
        swapped = month > 12 and "/" in value
        if swapped:
            month, day = day, month
        try:
            ordinal = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            return None
        # month first only where the day could not be a month, and one digit where there was one: then it reads back alike
        short = [len(x) == 1 for x in parts[:2]]

        def shown(v: int) -> list[int]:
            d = datetime.date.fromordinal(FIRST_DAY + v)
            return [d.month, d.day, d.year] if swapped else [d.day, d.month, d.year]

        def alike(v: int) -> bool:
            first, second, _ = shown(v)
            return (not swapped or second > 12) and (not short[0] or first < 10) and (not short[1] or second < 10)

        number = self.permute(ordinal - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", alike)
        if "-" in value:
            return datetime.date.fromordinal(FIRST_DAY + number).isoformat()
        mark = "/" if "/" in value else "."
        return mark.join(f"{v:0{len(old)}d}" for v, old in zip(shown(number), parts, strict=True))

    def candidates(self, text: str) -> Iterator[tuple[str, int, int]]:
        at = text.find("@")
        while at >= 0:
            before, after = LOCAL_PART.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1)
            if before and after:
                yield "email", before.start(), after.end()
            at = text.find("@", at + 1)
        for m in SECRET.finditer(text):
            yield "secret", *m.span(1)
        for m in HEX.finditer(text):
            yield "secret", *m.span()
        for kind, pattern in (("iban", IBAN), ("card", CARD), ("ip", IP), ("ipv6", IPV6), ("phone", PHONE), ("phone_abroad", ABROAD), ("ssn", SSN), ("date", DATE)):
            for m in pattern.finditer(text):
                yield kind, *m.span()

    def replace(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kinds replaced, in order of place."""
        if not text or not ANYTHING(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []
        for kind, start, end in self.candidates(text):
            if all(end <= a or start >= b for a, b, _, _ in taken):
                new = getattr(self, kind)(text[start:end])
                if new is not None:
                    taken.append((start, end, kind, new))
        out, last = [], 0
        for start, end, _, new in sorted(taken):
            out += [text[last:start], new]
            last = end
        return "".join([*out, text[last:]]), [kind for _, _, kind, _ in sorted(taken)]

    def restore(self, text: str | None) -> str | None:
        """Undo ``replace``; needs the same key."""
        undo = Pseudonyms.__new__(Pseudonyms)
        undo.feistel, undo.back = self.feistel, True
        return undo.replace(text)[0]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: str = "kinds") -> DataFrame:
    """``keep`` columns, the text with pseudonyms, and what was replaced, in order, called ``kinds``; these take the place of kept columns of their name."""
    own = kept_columns(keep, (text, kinds))
    kept = batched(docs).select(*own, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = Pseudonyms(key)
        for batch in batches:
            found = [work.replace(t) for t in batch[text]]
            yield batch[own].assign(**{text: [t for t, _ in found], kinds: [k for _, k in found]})

    return kept.mapInPandas(run, f"{schema_of(kept, own)}`{text}` string, `{kinds}` array<string>")

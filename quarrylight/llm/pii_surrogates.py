"""Surrogates for personal data: detected entities are replaced by keyed ones of the same type and format.

Numbers and addresses are enciphered within their format: a keyed Feistel network permutes all strings of a type and
shape, so equal entities get equal surrogates everywhere (coreference) and different ones different surrogates, without a
table. Names are drawn by a keyed hash from names of the same gender and script; such draws can collide, so the
corpus's distinct name words are checked and losers drawn again until all are distinct. Where a corpus has more given
names than the lists can tell apart, syllables follow the listed name, as many as the count needs. Names that a text
introduces (with a title, a known given name before a surname, or words as "signed by" before two or three capitalised
ones) are also replaced where they stand alone in it. Spelling does not part what is one entity: e-mail addresses go by
their lower case, telephone numbers by their digits, MAC and IPv6 addresses by their value.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarrylight.llm.shared import fresh, kept_columns, sliced, staged, text_of

KINDS = ("email", "ipv4", "ipv6", "mac", "iban", "ssn", "card", "phone", "number", "person")

# Given names by script and gender, titles by gender.
GIVEN = {
    ("latin", "f"): "Aisha Akiko Amina Ana Ananya Anna Camille Carmen Clara Elena Elizabeth Emily Emma Fatima Hannah Ingrid Isabelle Julia Julie Karen Katharina Laura Layla Lena Lucia Margaret Maria Marie Marta Mary Mei Nancy Nina Nora Olga Paula Petra Pilar Priya Rosa Sabine Sara Sarah Sofia Sophie Susan Teresa Ursula Vera Yuki Zainab".split(),
    ("latin", "m"): "Adrian Ahmed Ali Anton Arjun Bruno Carlos Charles Daniel David Erik Felix George Hans Hassan Hiroshi Hugo Ibrahim Ivan Jacques James Javier Jean John Jonas Juan Kenji Klaus Leo Louis Luis Lukas Marco Martin Michael Miguel Mohammed Muhammad Omar Oscar Paul Pedro Peter Pierre Rahul Raj Richard Robert Sergei Stefan Thomas Victor Wei William Yusuf".split(),
    ("latin", "x"): "Alex Andrea Chris Dominique Jamie Jordan Kim Lee Morgan Robin Sam Taylor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Кирилл Олег Павел Степан".split(),
    ("cyrillic", "x"): "Саша Женя Валя".split(),
    ("han", "f"): "芳 娜 敏 静 丽 艳 娟 霞 秀英 桂英".split(),
    ("han", "m"): "伟 强 磊 军 勇 杰 涛 明 建国 志强".split(),
    ("han", "x"): "文 华 宁 平".split(),
}
TITLES = {"f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Señora", "Sra", "г-жа"), "m": ("Mr", "Monsieur", "Herr", "Señor", "Sr", "г-н"), "x": ("Dr", "Prof")}
HAN_TITLES = {"女士": "f", "小姐": "f", "先生": "m"}
HAN_SURNAMES = "王李张刘陈杨黄赵周吴徐孙马朱胡郭何林高罗"
_SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"], "han": list(HAN_SURNAMES)}

_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_OF_GIVEN = {n.lower(): (s, g) for (s, g), ns in GIVEN.items() for n in ns}
_WORD = r"[^\W\d_a-zа-я][\w'’-]+"
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})(\.?[  ])({_WORD}(?:[  ]{_WORD}){{0,2}})")
#: A word before a capitalised one, which may be a given name before a surname.
_BEFORE_NAME = re.compile(rf"(?<!\w)([^\W\d_a-zа-я]\w*)(?=[\x20\xa0]({_WORD})(?!\w))")
#: What stands before a person's name, and words that make what follows no person. Fixed values.
_CUES = (r"Dear", r"[Ss]igned by", r"[Ww]ritten by", r"[Mm]y name is", r"(?:[Ff]ull )?[Nn]ame:", r"Contact:", r"Author:", r"Attn:", r"Patient:", r"Customer:", r"Employee:", r"Applicant:")
_NO_PERSON = frozenset("All Association Bank Board Church City Club Colleagues College Committee Company Council Court Customer Department Director Editor Foundation Friends Group Hiring Hospital Hotel Human Inc Institute International Ltd Madam Manager Members Ministry Museum New North Office Parents Resources Sales School Service Services Sir South Street Support Team The Technical University Valued".split())
_CUED = re.compile(rf"(?<!\w)(?:{'|'.join(_CUES)})[\x20\xa0]({_WORD}(?:[\x20\xa0]{_WORD}){{1,2}})(?!\w)")
_CAPITALISED = re.compile(r"(?<![\w-])[^\W\d_a-zа-я][\w'’-]+")
_KNOWN = frozenset(n for (s, _), ns in GIVEN.items() if s != "han" for n in ns)
_HAN = re.compile(rf"([{HAN_SURNAMES}])([一-鿿]{{0,2}})({'|'.join(HAN_TITLES)})")
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9.+_-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_MAC = re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:.])")
#: Digits with what may stand between them, however long; :func:`_digit_spans` parts them.
_DIGITS = re.compile(r"(?:(?<![\w.,+-])|(?<=[.,])(?<!\d\.))[+(]?\(?\d++(?:[ ().-]{1,3}+\d++)*+")
_PIECE = re.compile(r"\d[\d-]*\d|\d")
_IPV4 = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")
# Country codes of two digits; those that begin otherwise have three, +1 and +7 one.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def luhn_digit(digits: str) -> int:
    """The check digit that makes ``digits`` and it pass."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


class Cipher:
    """Keyed permutations of [0, n) and of the strings of a shape."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def draw(self, tweak: str, value: str, n: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}\0{value}".encode(), key=self.key, digest_size=16).digest(), "little") % n

    def permute(self, tweak: str, x: int, n: int, rounds: int = 8) -> int:
        """A Feistel network on the bits that n needs, walked until it falls below n."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in range(rounds):
                left, right = right, left ^ self.draw(f"{tweak}/{n}/{r}", str(right), 1 << half)
            x = left << half | right
            if x < n:
                return x

    def string(self, tweak: str, s: str, classes: tuple[str, ...] = _CLASSES) -> str:
        """``s`` with each character of a class replaced by one of it; others stay. A permutation of all strings of that shape."""
        at = [(i, next((c for c in classes if ch in c), None)) for i, ch in enumerate(s)]
        x, n = 0, 1
        for i, c in at:
            if c:
                x, n = x * len(c) + c.index(s[i]), n * len(c)
        if n == 1:
            return s
        shape = "".join(str(classes.index(c)) if c else s[i] for i, c in at)
        x = self.permute(f"{tweak}/{shape}", x, n)
        out = list(s)
        for i, c in reversed(at):
            if c:
                x, d = divmod(x, len(c))
                out[i] = c[d]
        return "".join(out)


def _fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _address(cipher: Cipher, s: str) -> str:
    x = int.from_bytes(bytes(map(int, s.split("."))), "big")
    for first, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24)):
        if x >> bits == first >> bits:  # private and local nets stay what they are
            x = first + cipher.permute(f"ipv4/{bits}", x - first, 1 << bits)
            break
    else:
        while True:
            x = cipher.permute("ipv4", x, 1 << 32)
            if not any(x >> b == f >> b for f, b in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24))):
                break
    return ".".join(map(str, x.to_bytes(4, "big")))


# Nets whose addresses stay in them (first address, bits of a place in it), narrower ones first: link-local, documentation, multicast, private.
_NETS6 = ((0xFE80 << 112, 64), (0x20010DB8 << 96, 96), (0xFE80 << 112, 118), (0xFF00 << 112, 120), (0xFC00 << 112, 121), (0, 128))


def _long_address(cipher: Cipher, s: str) -> str:
    """An IPv6 address's surrogate goes by its value; it is written as ``s``: with all zeros if a group of ``s`` has leading ones, else short."""
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:  # no address at all
        low = cipher.string("ipv6", s.lower(), ("0123456789abcdef",))
    else:
        of = lambda v: next(i for i, (first, bits) in enumerate(_NETS6) if v >> bits == first >> bits)
        net = of(x)
        first, bits = _NETS6[net]
        while True:
            x = first + cipher.permute(f"ipv6/{net}", x - first, 1 << bits)
            if of(x) == net:
                break
        new = ipaddress.IPv6Address(x)
        groups = s.split(":")
        low = new.exploded if any(len(g) > 1 and g[0] == "0" for g in groups) else new.compressed
    return low.upper() if s.isupper() else low


def surrogate(cipher: Cipher, kind: str, s: str) -> str:
    """For all kinds but 'person'."""
    if kind == "email":
        low = s.lower()
        name, _, domain = low.partition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2] == "example" else 1  # reserved names stay reserved; others become so behind their last label
        own = cipher.string("email/domain", ".".join(labels[:-kept]), _CLASSES[:2])
        new = f"{cipher.string('email/name', name, _CLASSES[:2])}@{'.'.join([*([own] if own else []), *labels[-kept:]])}"
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, s, strict=True)) + (".example" if kept == 1 else "")
    if kind == "ipv4":
        return _address(cipher, s)
    if kind == "ipv6":
        return _long_address(cipher, s)
    if kind == "mac":
        it = iter(cipher.string(kind, "".join(c for c in s.lower() if c.isalnum()), ("0123456789abcdef",)))
        new = "".join(next(it) if c.isalnum() else c for c in s)
        return new.upper() if s.isupper() else new
    if kind == "iban":
        bare = s.replace(" ", "")
        body = cipher.string(kind, bare[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
        it = iter(f"{bare[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)
    digits = "".join(c for c in s if c.isdigit())
    if kind == "card":  # valid ones stay valid, others invalid by as much
        off = (int(digits[-1]) - luhn_digit(digits[:-1])) % 10
        body = cipher.string(kind, digits[:-1])
        return _fill(s, f"{body}{(luhn_digit(body) + off) % 10}")
    if kind == "phone" and s.lstrip("(").startswith("+"):  # the country stays
        country = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3
        return _fill(s, digits[:country] + cipher.string(kind, digits[country:]))
    return _fill(s, cipher.string("ssn" if kind == "ssn" else "digits", digits))


def _digit_kind(s: str) -> str | None:
    digits = [c for c in s if c.isdigit()]
    n, plain = len(digits), s.isdigit()
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s):
        return "ssn"
    if 13 <= n <= 19 and (plain or re.fullmatch(r"\d{4}(?:[ -]\d{2,6}){2,4}", s)):
        return "card"
    if s[0] in "+(" and 8 <= n <= 15 or not plain and 9 <= n <= 13 and re.fullmatch(r"\(?\d{2,4}\)?[ .-]?\d{2,4}[ .-]\d{2,5}(?:[ .-]\d{2,5})?", s):
        return "phone"
    return "number" if plain and 9 <= n <= 26 else None


def _luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def _joined_kind(s: str, apart: bool) -> str | None:
    """The kind of pieces that stand beside other digits: brackets match, a card has one separator, a date is no phone."""
    if s.count("(") != s.count(")") or not apart:
        return None
    kind = _digit_kind(s)
    if kind == "card" and len({c for c in s if not c.isdigit()}) > 1 or kind == "phone" and re.match(r"(?:19|20)\d\d[.-]", s):
        return None
    return kind


def _digit_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Cards, phones and other numbers. Digits that are not one entity as a whole are parted (never at a hyphen) so that most digits belong to entities, those of valid cards and social security numbers counting more."""
    for m in _DIGITS.finditer(text):
        s, at = m[0], m.start()
        if re.match(r"\w", text[m.end() : m.end() + 1]):  # the last digits belong to a word
            end = len(s)
            while end and s[end - 1].isdigit():
                end -= 1
            s = s[:end].rstrip(" ().+-")
        if sum(c.isdigit() for c in s) < 9:
            continue
        # behind a point, or a comma with a digit before it, digits may be the rest of a number
        tied = at > 0 and (text[at - 1] == "." or text[at - 1] == "," and text[max(0, at - 2) : at - 1].isdigit())

        def told(x: str, kind: str | None, first: bool) -> str | None:
            if first and tied and (kind == "number" or kind == "card" and x.isdigit() and not _luhn(x) or kind == "phone" and not set("-(") & set(x)):  # noqa: B023
                return None
            return kind

        if kind := told(s, _digit_kind(s), True):
            yield at, at + len(s), kind
            continue
        pieces = [p.span() for p in _PIECE.finditer(s)]
        # best[i]: weight of the pieces from i on, and the entity that starts there
        best: list[tuple[float, int, tuple[int, int, str] | None]] = [(0.0, 0, None)] * (len(pieces) + 1)
        for i in range(len(pieces) - 1, -1, -1):
            a = pieces[i][0]
            best[i] = (best[i + 1][0], i + 1, None)
            lead = 0 if i == 0 else a - (s[a - 1] == "(")
            digits = 0
            for j in range(i, len(pieces)):
                b = pieces[j][1]
                digits += sum(c.isdigit() for c in s[pieces[j][0] : b])
                if digits > 19 and j > i:
                    break
                for start in {lead, a}:
                    x = s[start:b]
                    if j == i and start == a:
                        kind = _digit_kind(x)
                    else:
                        kind = _joined_kind(x, s[start - 1 : start] != "." and not re.match(r"\.\d", s[b : b + 2])) if digits >= 8 else None
                    if kind := told(x, kind, i == 0):
                        strong = kind == "ssn" or kind == "card" and _luhn("".join(c for c in x if c.isdigit()))
                        weight = digits * (1.75 if strong else 1.01 if kind == "card" else 1.0) + best[j + 1][0]
                        if weight > best[i][0] or weight == best[i][0] and best[i][2] is not None and start < best[i][2][0]:
                            best[i] = (weight, j + 1, (start, b, kind))
        i = 0
        while i < len(pieces):
            _, i, entity = best[i]
            if entity:
                yield at + entity[0], at + entity[1], entity[2]


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Does none of ``taken``, ascending and apart, meet the span?"""
    i = bisect.bisect(taken, (start, sys.maxsize))
    return (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end)


def _lone_capitals(text: str, start: int, end: int) -> bool:
    """Are the words of the span upper case, and the words before and after it not? A heading's words are no names."""
    if not text[start:end].isupper():
        return False
    before = re.search(r"(\w+)\W*$", text[max(0, start - 40) : start])
    after = re.match(r"\W*(\w+)", text[end : end + 40])
    return any(x is not None and not x[1].isdigit() for x in (before, after)) and not any(x is not None and x[1].isupper() for x in (before, after))


def persons(text: str) -> list[list[tuple[int, int, str, str]]]:
    """For each person named in ``text`` the words: (start, end, role, word); role: script/gender or script/surname.

    Names with a title, a known given name or a cue come first, in text order; they give their words' roles, which hold wherever
    a word stands alone in the text or is named without its title.
    """
    titled = [(m.start(3), m.end(3)) for m in _TITLED.finditer(text)]
    spans, at = list(titled), -1
    for m in _BEFORE_NAME.finditer(text):
        if m[1] in _KNOWN or m[1].isupper() and m[1].capitalize() in _KNOWN and _lone_capitals(text, m.start(), m.end(2)):
            if m.start() < at:  # several given names in a row are one person's
                spans[-1] = (spans[-1][0], m.end(2))
                at = m.end(2)
            elif _free(titled, m.start(), m.end(2)):
                spans.append((m.start(), m.end(2)))
                at = m.end(2)
    seen = sorted(spans)
    spans += [m.span(1) for m in _CUED.finditer(text) if _free(seen, *m.span(1)) and not _NO_PERSON & set(re.split("[\x20\xa0]", m[1]))]
    if not text.isascii():
        spans += [(m.start(1), m.end(2)) for m in _HAN.finditer(text)]
    found = [name_words(text, a, b) for a, b in sorted(spans)]
    if not found:
        return []
    roles: dict[str, str] = {}
    for _, _, role, word in (w for words in found for w in words):
        if roles.get(word.lower(), "/x").endswith("/x"):
            roles[word.lower()] = role
    told = [[(a, b, role if role.endswith("/surname") else roles[word.lower()], word) for a, b, role, word in words] for words in found]
    alone = {w: roles[w.lower()] for words in found for _, _, role, w in words if not role.startswith("han/") and len(w) > 2}
    full = {"".join(w for _, _, _, w in words): words for words in told if words[0][2].startswith("han/") and len(words) > 1}
    taken = sorted((words[0][0], words[-1][1]) for words in found)
    for m in _CAPITALISED.finditer(text):
        word = m[0] if m[0] in alone else re.split("['’]", m[0], maxsplit=1)[0]  # a possessive
        if word in alone and _free(taken, m.start(), m.start() + len(word)):
            told.append([(m.start(), m.start() + len(word), alone[word], word)])
    for n in sorted({len(x) for x in full}, reverse=True):
        for i in range(len(text) - n + 1):
            if (words := full.get(text[i : i + n])) and _free(taken, i, i + n):
                told.append([(a - words[0][0] + i, b - words[0][0] + i, role, w) for a, b, role, w in words])
                bisect.insort(taken, (i, i + n))
    return told


def detect(text: str, people: list[list[tuple[int, int, str, str]]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in text order without overlaps; earlier kinds of KINDS win. ``people``: :func:`persons` of the text, if known."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if text.count(".") >= 3:
        found += [(*m.span(), "ipv4") for m in _IPV4.finditer(text)]
    if ":" in text or "-" in text:
        found += [(*m.span(), "mac") for m in _MAC.finditer(text)]
        found += [(*m.span(), "ipv6") for m in _IPV6.finditer(text) if m[0].count(":") == 7 or "::" in m[0]]
    found += [(*m.span(), "iban") for m in _IBAN.finditer(text)]
    found += _digit_spans(text)
    found += [(words[0][0], words[-1][1], "person") for words in (persons(text) if people is None else people)]
    found.sort(key=lambda x: (KINDS.index(x[2]), x[0]))
    kept: list[tuple[int, int, str]] = []
    for span in found:
        i = bisect.bisect(kept, span)
        if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or kept[i][0] >= span[1]):
            kept.insert(i, span)
    return kept


def script_of(word: str) -> str:
    return "han" if "一" <= word[0] <= "鿿" else "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def name_words(text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
    """(start, end, role, word) of a person's words; role: script/gender for given names, script/surname for the last word."""
    name, out = text[start:end], []
    if script_of(name) == "han":
        gender = next((g for t, g in HAN_TITLES.items() if text.startswith(t, end)), "x")
        out.append((start, start + 1, "han/surname", name[0]))
        if len(name) > 1:
            out.append((start + 1, end, f"han/{gender}", name[1:]))
        return out
    before = re.search(r"(\w[\w-]*)\.?[  ]$", text[max(0, start - 12) : start])
    words = list(re.finditer(r"[^  ]+", name))
    for i, m in enumerate(words):
        script = script_of(m[0])
        if i == len(words) - 1:
            role = f"{script}/surname"
        else:
            titled = _GENDER.get(before[1] if before else "", "x")
            gender = titled if titled != "x" else _OF_GIVEN.get(m[0].lower(), ("", "x"))[1]
            role = f"{script}/{gender}"
        out.append((start + m.start(), start + m.end(), role, m[0]))
    return out


def _spelled(table: list[str], x: int, syllables: int) -> str:
    out = ""
    for _ in range(syllables):
        x, i = divmod(x, len(table))
        out += table[i]
    return out


def drawn(cipher: Cipher, role: str, word: str, tries: int, syllables: dict[str, int]) -> str:
    """The surrogate of a name's word (without regard to case) on try ``tries``. ``syllables``: of surnames, and of what follows given names, by role."""
    script, kind = role.split("/")
    low = word.lower()
    if kind == "surname":
        if script == "han":
            x = cipher.draw(f"{role}/{tries}", low, len(HAN_SURNAMES))
            out = HAN_SURNAMES[(x + tries) % len(HAN_SURNAMES)] + (HAN_SURNAMES[tries % len(HAN_SURNAMES)] if tries > 4 else "")
        else:
            table = _SYLLABLES[script]
            n = syllables["surname"]
            out = _spelled(table, cipher.draw(f"{role}/{tries}", low, len(table) ** n), n).capitalize()
    else:
        names = GIVEN[script, kind]
        out = names[cipher.draw(f"{role}/{tries}", low, len(names))]
        joint = "-" if script != "han" else ""
        if tries > 2:  # the list is short: a second name makes it distinct
            out += joint + names[cipher.draw(f"{role}/{tries}/b", low, len(names))]
        if n := syllables.get(role, 0):
            table = _SYLLABLES[script]
            out += joint + _spelled(table, cipher.draw(f"{role}/{tries}/c", low, len(table) ** n), n).capitalize()
    if out.lower() == low:
        return drawn(cipher, role, word, tries + 101, syllables)
    return out.upper() if word.isupper() and len(word) > 1 and script != "han" else out


def check_names(docs: DataFrame, key: bytes, text: str = "text", most: int = 100_000, rounds: int = 60) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """(tries of the name words whose first draw collides, syllables of surnames and of what follows given names).

    The distinct name words of all texts stay in a table; each round draws, keeps the first of equal surrogates and lets the
    others draw again. Names are made so long that few collide, whatever the corpus; should more than ``most`` need a
    second draw, or some still collide after ``rounds``, all are made a syllable longer and drawn anew. (Han surnames
    don't grow; there are no more of them than the list has, and ``most`` is at least that.)
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = {(r, w.lower()) for t in b.column(0).to_pylist() for words in persons(t) for _, _, r, w in words}
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in words], pa.string()), pa.array([w for _, w in words], pa.string())], names=["role", "word"])

    words = staged(docs.select(text_of(text)).mapInArrow(extract, "role string, word string").distinct(), "name-words").withColumn("tries", F.lit(0))
    counts = {r["role"]: r["count"] for r in words.groupBy("role").count().collect()}  # a row for each script and gender
    n = sum(counts.values())
    syllables = {"surname": 3}
    while 65 ** syllables["surname"] * 2_000 < n * n:
        syllables["surname"] += 1
    for role, count in counts.items():
        script, kind = role.split("/")
        if kind == "surname":
            continue
        names, table = len(GIVEN[script, kind]), len(_SYLLABLES[script])
        if 4 * count > names + names * names:
            syllables[role] = 1
            while names * table ** syllables[role] * 2_000 < count * count:
                syllables[role] += 1
    if not n:
        return {}, syllables
    while (again := _settled(words, Cipher(key), syllables, rounds)) is None or again.count() > max(most, len(HAN_SURNAMES)):
        syllables = {"surname": 0} | {role: 0 for role in counts if not role.endswith("/surname")} | syllables
        syllables = {role: x + 1 for role, x in syllables.items()}
    return {(r["role"], r["word"]): r["tries"] for r in again.select("role", "word", "tries").collect()}, syllables


def _settled(words: DataFrame, cipher: Cipher, syllables: dict[str, int], rounds: int) -> DataFrame | None:
    """role, word and tries of the ``words`` that need another draw than the first; none if some still collide after ``rounds``."""

    @arrow_udf("string")
    def draw(role: pa.Array, word: pa.Array, tries: pa.Array) -> pa.Array:
        return pa.array([drawn(cipher, *x, syllables).lower() for x in zip(role.to_pylist(), word.to_pylist(), tries.to_pylist(), strict=True)], pa.string())

    # words that lost keep their place behind those that settled before
    place = Window.partitionBy(F.split("role", "/")[0], F.col("role").endswith("surname"), "got").orderBy("tries", "role", "word")
    for _ in range(rounds):
        judged = words.withColumn("got", draw("role", "word", "tries")).withColumn("at", F.row_number().over(place))
        words = staged(judged.select("role", "word", (F.col("tries") + (F.col("at") > 1).cast("int")).alias("tries"), (F.col("at") > 1).alias("lost")), "name-tries")
        if not words.where("lost").count():
            return words.where("tries > 0")
        words = words.drop("lost")
    return None


def replace(docs: DataFrame, key: bytes = b"quarrylight", text: str = "text") -> DataFrame:
    """``docs`` with its ``text`` rewritten, and entities: array<struct<kind, start, end>> of the places in the new text.

    A null text stays null and has no entities; an empty text stays empty; repeated rows get equal results; an empty
    table gives no rows. Texts are read twice (names are checked first) and never shuffled. A column named
    entities is replaced.
    """
    tries, syllables = check_names(docs, key, text)
    kept = kept_columns(docs, "entities")
    (own,) = fresh(docs, "_rewritten")

    @arrow_udf("struct<text: string, entities: array<struct<kind: string, start: int, end: int>>>")
    def rewrite(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cipher = Cipher(key)
        kind = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in texts:
            rows = []
            for x in batch:
                t = x.as_py()
                new, spans = rewritten(cipher, t or "", tries, syllables)
                rows.append({"text": None if t is None else new, "entities": [{"kind": k, "start": s, "end": e} for s, e, k in spans]})
            yield pa.array(rows, kind)

    made = docs.select(*kept, rewrite(F.col(text)).alias(own))
    return made.select(*[F.col(f"{own}.text").alias(c) if c == text else F.col(c) for c in kept], F.col(f"{own}.entities").alias("entities"))


def rewritten(cipher: Cipher, text: str, tries: dict[tuple[str, str], int], syllables: dict[str, int]) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at, length = [], [], 0, 0
    people = persons(text)
    words_at = {(words[0][0], words[-1][1]): words for words in people}
    for start, end, kind in detect(text, people):
        if kind == "person":
            new, here = "", start
            for s, e, role, word in words_at[start, end]:
                new += text[here:s] + drawn(cipher, role, word, tries.get((role, word.lower()), 0), syllables)
                here = e
            new += text[here:end]
        else:
            new = surrogate(cipher, kind, text[start:end])
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]), spans

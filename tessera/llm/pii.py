"""Personal data: detection, and keyed surrogates of the same type, script, gender and format."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts, prepare

#: The production key is a parameter; the default serves tests and examples.
DEFAULT_KEY = b"surrogate-key"
ROUNDS = 8
#: Surrogates of an entity's own shape tried in a document before longer ones are taken.
TRIES = 64

_TITLE_F = "Mrs|Ms|Miss|Madam|Mme|Mlle|Madame|Frau|Sra|Srta|Señora|Doña|Г-жа|г-жа|Κα|Κυρία"
_TITLE_M = "Mr|Sir|Herr|Monsieur|Sr|Señor|Don|Г-н|г-н|Κος|Κύριος"
_TITLE_N = "Dr|Prof|Professor|Doktor|Dra"
#: Marks that stand on letters, as in decomposed Latin or in Indic scripts, as a regex class's content.
_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTER = rf"(?:[^\W\d_]|[{_MARKS}])"
_NAME = rf"[^\W\d_a-zà-öø-ÿа-яα-ω]{_LETTER}+(?:-{_LETTER}+)?"

_H = "[0-9A-Fa-f]{1,4}"
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Detectors in order of priority: type, regex, the group that is replaced (0: all of it).
DETECTORS = [
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----((?:[^-]|-(?!----))+)-----END [A-Z ]{0,40}PRIVATE KEY-----"), 1),
    ("secret", re.compile(r"(?<=://)[^\s/:@\"'<>]{1,64}:([^\s/@\"'<>]{3,128})@(?=[\w\[])"), 1),
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w-])"), 0),
    ("secret", re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|bearer|client[_-]?secret|private[_-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"',;<>]{6,})"), 1),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)([0-9A-Z]{16})\b"), 1),
    ("secret", re.compile(r"\b(?:gh[pousr]_|github_pat_|sk-|pk_live_|sk_live_|xox[abprs]-|AIza|glpat-|hf_)([A-Za-z0-9_-]{16,})"), 1),
    ("secret", re.compile(r"(?<![\w-])eyJ[\w-]{8,}\.([\w-]{8,}\.[\w-]{8,})"), 1),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("card", re.compile(r"(?<![\w.+-])(?:\d[ -]?){12,18}\d(?![\w-])"), 0),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0),
    ("ipv6", re.compile(rf"(?<!\w)(?:(?:{_H}:){{6}}(?:{_V4}|{_H}:{_H})|(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,5}}{_V4}|{_H}(?::{_H}){{0,6}})?)(?!\w|:[0-9A-Fa-f:]|\.\d)"), 0),
    ("ipv4", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), 0),
    ("mac", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])"), 0),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"), 0),
    ("person_f", re.compile(rf"\b(?:{_TITLE_F})\.? ({_NAME}(?: {_NAME})?)"), 1),
    ("person_m", re.compile(rf"\b(?:{_TITLE_M})\.? ({_NAME}(?: {_NAME})?)"), 1),
    ("person", re.compile(rf"\b(?:{_TITLE_N})\.? ({_NAME}(?: {_NAME})?)"), 1),
]

#: What a text must hold for a detector to be tried: any of the strings, or so many digits (fixed values).
TITLES = {"person_f": _TITLE_F.split("|"), "person_m": _TITLE_M.split("|"), "person": _TITLE_N.split("|")}
NEEDS = {"private_key": ["-----BEGIN"], "email": ["@"], "mac": [":", "-"], "ipv6": [":"]} | TITLES
DIGITS = {"iban": 2, "card": 13, "ssn": 9, "ipv4": 4, "phone": 7}
SECRETS = ["=", ":", "AKIA", "ASIA", "gh", "sk", "pk_live_", "xox", "AIza", "glpat-", "hf_", "eyJ"]
_GROUP_BEFORE = re.compile(r"(?:(?<![^\W_])[0-9A-Fa-f]{1,4}|:):\Z")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = str.maketrans("", "", "0123456789")


class Entity(NamedTuple):
    type: str
    start: int
    end: int
    text: str


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: Groups that cards and bank accounts are printed in: a number in these needs no valid check digit (fixed values).
_CARD_GROUPS = re.compile(r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?:[ -]\d{3})?")
_IBAN_GROUPS = re.compile(r"[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?")


def _is_card(text: str, digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and (luhn(digits) or _CARD_GROUPS.fullmatch(text) is not None)


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return _IBAN_GROUPS.fullmatch(text) is not None or 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _is_ipv6(text: str, start: int, found: str) -> bool:
    """Whether it is a valid address with any digit (``::`` alone names nobody), not the rest of a longer row of groups."""
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return found != "::" and not _GROUP_BEFORE.search(text, max(0, start - 6), start)


class _Spans:
    """Entities by place, none overlapping."""

    def __init__(self):
        self.starts: list[int] = []
        self.rows: list[Entity] = []

    def put(self, e: Entity) -> None:
        at = bisect_left(self.starts, e.end)
        if not at or self.rows[at - 1].end <= e.start:
            self.starts.insert(at, e.start)
            self.rows.insert(at, e)


def detect(text: str | None) -> list[Entity]:
    """Entities of a text by place, none overlapping: earlier detectors win.

    Cards and bank accounts need a valid check number or their printed groups. Persons are found by a title, or by a given name
    and a surname of the lists; further mentions of their full names, and of single parts that the text does not use as a
    word in lower case too, are found as well.
    """
    if not text:
        return []
    spans = _Spans()
    digits_here = len(text) - len(text.translate(_NO_DIGIT)) if _DIGIT.search(text) else 0
    for kind, rx, group in DETECTORS:
        if kind in DIGITS and digits_here < DIGITS[kind] or not any(x in text for x in NEEDS.get(kind, SECRETS if kind == "secret" else [""])):
            continue
        for m in rx.finditer(text):
            a, b = m.span(group)
            digits = re.sub(r"\D", "", m[group])
            if kind == "card" and not _is_card(m[group], digits) or kind == "iban" and not _is_iban(m[group]):
                continue
            if kind == "ipv6" and not _is_ipv6(text, a, m[group]):
                continue
            if kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            spans.put(Entity(kind, a, b, m[group]))
    for m in _CAPITALS.finditer(text):
        kind = _GENDER.get(m[1])
        if kind and m[2] in _SURNAMES:
            spans.put(Entity(kind, m.start(1), m.end(2), text[m.start(1) : m.end(2)]))
    people = {}
    for e in spans.rows:
        if e.type.startswith("person"):
            for part in _WORD.findall(e.text):
                people.setdefault(canonical(e.type, part), e.type)
    if people:
        words = [(m.start(), m.end(), m[0]) for m in _WHOLE.finditer(text)]
        lower = {p.lower() for p in people}
        usual = {w for _, _, w in words if w in lower}
        people = {p: k for p, k in people.items() if len(p) > 2 or ord(p[0]) >= 0x2E80}
        names = [people.get(canonical("person", w)) for _, _, w in words]
        for i, (a, b, w) in enumerate(words):
            if names[i]:
                follows = i + 1 < len(words) and names[i + 1] and text[b : words[i + 1][0]] == " "
                leads = i and names[i - 1] and text[words[i - 1][1] : a] == " "
                if follows or leads or w.lower() == w or w.lower() not in usual:
                    spans.put(Entity(names[i], a, b, w))
    return spans.rows


def _rounds(value: int, half: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A Feistel network over 2 * half bits, or its inverse."""
    mask, width = (1 << half) - 1, (half + 7) // 8
    left, right = value >> half, value & mask
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        said = f"{tweak}|{size}|{i}|{left if back else right}".encode("utf-8", "surrogatepass")
        noise = int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=min(64, max(8, width))).digest() * (width // 64 + 1), "big") & mask
        left, right = (right ^ noise, left) if back else (right, left ^ noise)
    return (left << half) | right


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network over the next even number of bits, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        value = _rounds(value, half, size, key, tweak, back)
        if value < size:
            return value


def derange(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) that leaves no value in its place, unless there is but one: a single cycle."""
    return permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, back=True) if size > 1 else value


#: Given names by gender, and surnames, by script (fixed values). A surname's feminine form has its own list.
GIVEN_F = [
    "Anna Maria Laura Julia Sara Elena Sofia Clara Emma Eva Lena Paula Marta Lucia Carla Nina Olivia Amelia Sophia Isabella Mia Ella Victoria Amanda Jessica Angela Linda Barbara Patricia Sandra Monica Veronica Diana Teresa Silvia Petra Sabrina Claudia Martina",
    "Alice Mary Jane Susan Karen Helen Nancy Betty Margaret Dorothy Ruth Sharon Carol Emily Charlotte Chloe Lucy Sophie Claire Marie Camille Brigitte Nicole Isabel Carmen Pilar Heidi Ingrid Elizabeth Jennifer Michelle Kimberly Deborah Rachel Catherine",
    "Анна Елена Ольга Татьяна Ирина Светлана Екатерина Людмила Галина Марина Нина Вера Надежда Полина",
    "Мария Наталья Юлия Анастасия Виктория Ксения Дарья Евгения Валерия София Лидия",
]
GIVEN_M = [
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Edward Brian Ronald Kevin Jason Peter Henry Jack Oliver Harry Hans Klaus Jürgen Wolfgang Stefan Uwe Karl Friedrich Pierre Jean Louis François Philippe Luis Carlos Juan José Miguel Pedro Antonio Diego Pablo Sergio",
    "Александр Сергей Владимир Андрей Алексей Дмитрий Михаил Иван Николай Павел Виктор Юрий Олег Игорь Борис Максим",
]
SURNAMES = [
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Thompson Robinson Clark Lewis Walker Hall Allen Young Wright Hill Scott Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Bauer Koch Richter Klein Wolf Schröder Neumann Martin Bernard Dubois Durand Leroy Moreau Fournier Girard Lambert Fernández González Rodríguez López Martínez Sánchez Pérez Gómez",
    "García Molina Ortega Vega Peña Silva Rivera Herrera Medina Mendoza Costa Rossa",
    "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев",
    "Иванова Смирнова Кузнецова Попова Васильева Петрова Соколова Михайлова Новикова Фёдорова Морозова Волкова Алексеева Лебедева Семёнова Егорова Павлова Козлова Степанова Николаева",
]
#: A listed name's list, by its family's name for the key, and its place there; feminine surnames follow the masculine ones.
_PLACE = {w: (f"given_f{i}", n, names.split()) for i, names in enumerate(GIVEN_F) for n, w in enumerate(names.split())}
_PLACE |= {w: (f"given_m{i}", n, names.split()) for i, names in enumerate(GIVEN_M) for n, w in enumerate(names.split())}
_PLACE |= {w: (f"surname{min(i, 2)}", n, names.split()) for i, names in enumerate(SURNAMES) for n, w in enumerate(names.split())}
_GENDER = {w: "person_f" for names in GIVEN_F for w in names.split()} | {w: "person_m" for names in GIVEN_M for w in names.split()}
_SURNAMES = {w for names in SURNAMES for w in names.split()}
_CAPITALS = re.compile(r"(?<!\w)([A-ZА-Я][a-zß-ÿа-яё]+)(?= ([A-ZА-Я][a-zß-ÿа-яё]+)(?!\w))")

#: Letters by script and kind, the same number of upper-case ones following by rule (fixed values).
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS = {c: a for a in ALPHABETS for c in a}
_WORD = re.compile(f"{_LETTER}+")
_WHOLE = re.compile(rf"(?<!\w){_LETTER}+(?!\w)")
_KANJI = "".join(map(chr, range(0x4E00, 0x9FA0)))
_KANA = "".join(map(chr, range(0x30A1, 0x30FB)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_HANGUL = "".join(map(chr, range(0xAC00, 0xD7A4)))
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


@lru_cache(4096)
def _block(char: str) -> str:
    """The letters of a letter's script and case among the 128 code points around it."""
    like = unicodedata.category(char), unicodedata.name(char, "").split(" ")[0]
    around = map(chr, range(ord(char) & ~127, (ord(char) | 127) + 1))
    return "".join(c for c in around if (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]) == like)


def _alphabet(char: str, names: bool) -> str:
    """The characters that may stand for one: of its case and, in names, of its script and kind; else only itself."""
    if char in _DIGITS:
        return _DIGITS
    if not names:
        return _LOWER if char in _LOWER else _UPPER if char in _UPPER else char
    low = char.lower()
    if low in _CLASS:
        kind = _CLASS[low]
        kind = kind if char == low else kind.upper()
        return kind if char in kind and len(kind) == len(_CLASS[low]) else _block(char)
    for block in (_KANJI, _KANA, _HIRAGANA, _HANGUL):
        if block[0] <= char <= block[-1]:
            return block
    return _block(char) if char.isalpha() else char


def _spell(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """A keyed permutation of the strings whose characters come from the alphabets, none in its place."""
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = derange(value, size, key, f"{tweak}|{'|'.join(map(_shape, alphabets))}")
    out = []
    for a in reversed(alphabets):
        value, at = divmod(value, len(a))
        out.append(a[at])
    return "".join(reversed(out))


def _shape(alphabet: str) -> str:
    return alphabet if len(alphabet) == 1 else f"{alphabet[0]}{len(alphabet)}"


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity: spacing and, for addresses, case are format only."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "iban", "phone", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", text)
    if kind == "ipv6":
        return f"{int(ipaddress.IPv6Address(text)):032x}"
    if kind == "mac":
        return re.sub(r"[:-]", "", text).lower()
    if kind.startswith("person") and len(text) > 1 and text.isupper():
        return text[0] + text[1:].lower()
    return text


#: Address blocks that are not public (fixed values): an address keeps its block.
_BLOCKS = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10")]


def _ipv4(plain: str, key: bytes, tweak: str) -> str:
    address = ipaddress.IPv4Address(plain)
    for block in _BLOCKS:
        if address in block:
            size = block.num_addresses
            return str(block[permute(int(address) % size, size, key, f"{tweak}|{block}")])
    value, public = int(address), address.is_global
    while True:
        value = permute(value, 1 << 32, key, tweak)
        new = ipaddress.IPv4Address(value)
        if new.is_global == public and new.is_multicast == address.is_multicast and not any(new in b for b in _BLOCKS):
            return str(new)


def _ipv6(plain: str, text: str, key: bytes, tweak: str, whole: bool) -> str:
    """An address with zero groups and leading zeros in the same places, written as the mention is; of any shape if ``whole``."""
    groups = [int(plain[i : i + 4], 16) for i in range(0, 32, 4)]
    if whole:
        return ipaddress.IPv6Address(permute(int(plain, 16), 1 << 128, key, f"{tweak}|whole")).exploded
    mapped = groups[:6] == [0, 0, 0, 0, 0, 0xFFFF]
    if mapped:
        new = int(ipaddress.IPv4Address(_ipv4(str(ipaddress.IPv4Address(int(plain[24:], 16))), key, tweak.replace("ipv6", "ipv4", 1))))
        groups[6:] = new >> 16, new & 0xFFFF
    else:
        lows = [16 ** (len(f"{g:x}") - 1) if g > 15 else 1 for g in groups]
        value, size = 0, 1
        for g, low in zip(groups, lows):
            span = 16 * low - low if g else 1
            value, size = value * span + (g - low if g else 0), size * span
        value = permute(value, size, key, f"{tweak}|{[len(f'{g:x}') if g else 0 for g in groups]}")
        for i in range(7, -1, -1):
            if groups[i]:
                value, at = divmod(value, 15 * lows[i])
                groups[i] = lows[i] + at
    head, dotted = re.fullmatch(r"(.*?)((?:\d+\.){3}\d+)?", text).groups()
    front, _, back = head.partition("::") if "::" in head else (head, "", "")
    n = len([x for x in back.split(":") if x]) + 2 * bool(dotted)
    out, i, upto = [], 0, 8 - n if "::" in head else 8
    for part in re.split(r"(::|:)", head):
        if part == "::":
            i = upto
        if not part or part[0] == ":":
            out.append(part)
            continue
        new = f"{groups[i]:0{len(part)}x}"
        out.append(new.upper() if re.search("[A-F]", part) else new)
        i += 1
    return "".join(out) + (str(ipaddress.IPv4Address(groups[6] << 16 | groups[7])) if dotted else "")


def _longer(n: int, alphabet: str, key: bytes, tweak: str) -> str:
    """A keyed string of n characters."""
    noise = int.from_bytes(hashlib.shake_256(key + f"|longer|{tweak}".encode("utf-8", "surrogatepass")).digest(2 * n + 8), "big")
    out = []
    for _ in range(n):
        noise, at = divmod(noise, len(alphabet))
        out.append(alphabet[at])
    return "".join(out)


def _name(plain: str, key: bytes, tweak: str) -> str:
    """The stand-in of one part of a name: of its list if it is listed, else of its letters' shape and off the lists."""
    if plain in _PLACE:
        family, at, names = _PLACE[plain]
        return names[derange(at, len(names), key, f"{tweak}|{family}")]
    alphabets = [_alphabet(c, True) for c in plain]
    if len(plain) > 2 and ord(plain[-1]) < 0x3000:  # the last letter, under any marks
        last = next((i for i in range(len(plain) - 1, -1, -1) if plain[i].isalpha()), len(plain) - 1)
        alphabets[last] = plain[last]
    new = _spell(plain, alphabets, key, tweak)
    while new in _PLACE:  # walks on among the names of this shape that no list holds
        new = _spell(new, alphabets, key, tweak)
    return new


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a mention, or of one part of a name: the same for every mention of its entity, another for any other.

    It is a permutation of the entities of the same type and shape that leaves none in its place, so no two meet. Kept as
    they are: country code and the reserved 555 exchange of phones, leading digit and check of cards, class of addresses,
    top-level domains, country of bank accounts, zeros of IPv6 addresses; a listed name's script, gender and kind, the places
    of vowels and consonants and the last letter (gender) of any other, and upper case. From TRIES on, names, mail addresses and secrets get longer ones at each attempt, and addresses and
    phones are drawn from all of their type.
    """
    plain = canonical(kind, text)
    more = max(0, attempt - TRIES + 1)
    tweak = f"{'person' if kind.startswith('person') else kind}|{attempt}"
    if kind in ("ipv4", "ipv6", "mac"):
        if kind == "ipv4":
            return str(ipaddress.IPv4Address(permute(int(ipaddress.IPv4Address(plain)), 1 << 32, key, f"{tweak}|whole"))) if more else _ipv4(plain, key, tweak)
        if kind == "ipv6":
            return _ipv6(plain, text, key, tweak, more > 0)
        new = _spell(plain, [_HEX] * len(plain), key, tweak)
    elif kind == "card":
        check = luhn(plain)
        body = plain[1:-1] if check else plain[1:]
        new = plain[0] + _spell(body, [_DIGITS] * len(body), key, f"{tweak}|{plain[0]}|{check}")
        if check:
            new += next(d for d in _DIGITS if luhn(new + d))
    elif kind == "phone":
        code = None if more else re.match(r"\+\d{1,3}(?=[ (.-])", text)
        head = re.sub(r"\D", "", code[0]) if code else ""
        body = plain[1 + len(head) :] if code else plain.lstrip("+")
        lead = "+" if plain.startswith("+") else ""
        keep = re.fullmatch(r"(\d{3})555(\d{4})", body)
        if keep:
            mixed = _spell(keep[1] + keep[2], ["23456789"] * (keep[1][0] in "23456789") + [_DIGITS] * (7 - (keep[1][0] in "23456789")), key, f"{tweak}|{head}|555")
            new = lead + head + mixed[:3] + "555" + mixed[3:]
        else:
            new = lead + head + _spell(body, [_DIGITS] * len(body), key, f"{tweak}|{head}")
    elif kind == "iban":
        rest = plain[4:]
        body = _spell(rest, [_alphabet(c, False) for c in rest], key, f"{tweak}|{plain[:2]}")
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        new = f"{plain[:2]}{98 - number % 97:02d}{body}"
    elif kind == "email":
        local, _, domain = plain.rpartition("@")
        name, dot, top = domain.rpartition(".")
        mixed = local + "@" + name
        new = _spell(mixed, [_alphabet(c, False) for c in mixed], key, f"{tweak}|{top}") + dot + top
        return _longer(more, _LOWER, key, f"{tweak}|{plain}") + "".join(c.upper() if p.isupper() else c for p, c in zip(text, new))
    elif kind.startswith("person"):
        new = _name(plain, key, tweak)
        tail = next((_alphabet(c.lower(), True) for c in reversed(plain) if c.isalpha()), _LOWER)
        new += _longer(more, tail if len(tail) > 1 else _LOWER, key, f"{tweak}|{plain}")
        return new.upper() if plain != text else new
    elif re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", plain):
        new = _spell(plain, [_HEX] * len(plain), key, tweak)
        while new.isdigit():  # a permutation walks on until it is back among strings with letters
            new = _spell(new, [_HEX] * len(plain), key, tweak)
        if more:
            return new + _longer(more, _HEX, key, f"{tweak}|{plain}")
    else:
        new = _spell(plain, [_alphabet(c, False) for c in plain], key, tweak)
        if plain == text:
            return new + _longer(more, _LOWER, key, f"{tweak}|{plain}")
    out, it = [], iter(new.lstrip("+"))
    for p in text:
        out.append((lambda c: c.upper() if p.isupper() else c)(next(it, "")) if p.isalnum() else p)
    return "".join(out)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """(text with surrogates, entities as type, start and end in the new text and the original, and their count of tries).

    The parts of a name are entities of their own, so that a surname alone follows the full name. Collision check: a
    surrogate that equals an original of the document, its own included, is drawn again with the next tweak, and so is
    one that equals another entity's surrogate, so entities of the document stay apart. Longer surrogates end this
    where all of an entity's own shape are taken or there is but one.
    """
    found = detect(text)
    if not found:
        return text, []
    units = [[(m.start(), m.end(), m[0]) for m in _WORD.finditer(e.text)] if e.type.startswith("person") else [(0, len(e.text), e.text)] for e in found]
    whole = {canonical(e.type, t) for e, parts in zip(found, units) for _, _, t in parts} | {t for parts in units for _, _, t in parts}
    given: dict[tuple[str, str], int] = {}
    used: dict[str, tuple[str, str]] = {}

    def stand_in(kind: str, said: str) -> tuple[str, int]:
        who = ("person" if kind.startswith("person") else kind, canonical(kind, said))
        attempt = given.get(who, 0)
        new = surrogate(kind, said, key, attempt)
        if who not in given:
            while new in whole or canonical(kind, new) in whole or used.get(canonical(kind, new), who) != who:
                attempt += 1
                new = surrogate(kind, said, key, attempt)
            given[who] = attempt
            used[canonical(kind, new)] = who
        return new, attempt

    out, spans, at, size = [], [], 0, 0
    for e, parts in zip(found, units):
        new, tries, upto = "", 0, 0
        for a, b, said in parts:
            one, attempt = stand_in(e.type, said)
            new, tries, upto = new + e.text[upto:a] + one, max(tries, attempt), b
        new += e.text[upto:]
        out += [text[at : e.start], new]
        size += e.start - at
        spans.append({"type": e.type, "start": size, "end": size + len(new), "from": e.start, "upto": e.end, "tries": tries})
        size, at = size + len(new), e.end
    return "".join([*out, text[at:]]), spans


ENTITY = "struct<type:string,start:int,`end`:int,`from`:int,upto:int,tries:int>"


def replace_pii(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """(doc_id, text, entities) for every row of docs: texts with surrogates, and where they stand.

    First draws depend on the key and the entity only, so mentions agree across documents and executors without any
    exchange, and distinct entities get distinct ones everywhere. Only where a draw collides inside a document is the entity
    drawn again there: its mentions still agree in that document, but may differ from those elsewhere. Null texts stay null, empty ones empty; texts without entities are unchanged; repeated rows get equal results.
    Very long texts are read whole, in time that grows with their length; their names meet as in short ones.
    """
    secret = hmac.new(key, b"surrogates", "sha256").digest()

    def make():
        def fn(ids, texts):
            done = [pseudonymise(t, secret) for t in texts]
            return ids, [d[0] for d in done], [d[1] for d in done]

        return fn

    prepare(docs.sparkSession)
    return map_texts(docs, f"doc_id long, text string, entities array<{ENTITY}>", make, ["doc_id", "text"])

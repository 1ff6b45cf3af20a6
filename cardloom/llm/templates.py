"""Template tokens of texts: words, and placeholders for numbers, measures, units and names, as arrays.

A token stands between white space; characters of scripts that put no space between words are tokens of their own. What
lies outside its first and last letter or digit is cut off, and tokens without either are left out. The value of a token is a hash of its
lower-cased characters; all tokens of a batch of texts are found and hashed at once, by sums over powers of an odd number.

* ``NUMBER``: digits and no letter (``3,000``, ``2+2``), or a number word; ``MEASURE``: letters behind a digit (``5kg``, ``1st``).
* ``UNIT``: a unit of measure directly behind a number. The same word elsewhere is a word.
* ``NAME``: two characters or more with a capital first, but for function words. At the start of a sentence that may be a word as
  well, and a text in small letters has no names, so windows are read in several ways (see ``decontaminate``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

WORD, NUMBER, NAME, UNIT, MEASURE, NONE = range(6)
#: Characters handled at a time; longer texts are cut at white space.
CHUNK = 1 << 17

# Prefixes, symbols and names that units are built from, and units without prefixes.
_PREFIX = {"": "", "k": "kilo", "h": "hecto", "d": "deci", "c": "centi", "m": "milli", "n": "nano", "g": "giga", "t": "tera"}
_SYMBOL = "m g l s b w v a j n pa hz bit byte mol cal wh m/s m/h m² m³ m2 m3".split()
_NAME = "meter metre mètre metro gram gramme gramm gramo liter litre litro second seconde sekunde segundo watt volt ampere joule newton pascal hertz byte bit mole calorie kalorie caloría".split()
_OTHER = (
    "inch inches in foot feet ft yard yd mile mi ounce oz pound lb ton tonne stone gallon gal quart pint cup acre hectare hektar hectárea barrel "
    "minute min minuto hour hr h heure hora stunde day d jour día tag week semaine semana woche month mois mes monat year yr an année año jahr decade century "
    "cent dollar euro pound yen won franc peso peseta mark percent pourcent prozent degree degré grado grad celsius fahrenheit kelvin km/h mph kmh knot dozen"
).split()
UNITS = frozenset([*(p + y for p in _PREFIX for y in _SYMBOL), *(x + s for x in (*(p + y for p in _PREFIX.values() for y in _NAME), *_OTHER) for s in ("", "s", "n", "e", "es"))])

# Words that open sentences and are no names.
FUNCTION_WORDS = frozenset(
    "the an this that these those what which who whom whose when where why how if in on at by to of for from with as and or but so then there here "
    "is are was were do does did can could will would should may he she it we they you his her its our their my your not no after before while during each every "
    "le la les un une des el los las uno una der die das ein eine qué que quel quelle wie was wer wo wann cuál quién dónde cuándo comment pourquoi warum".split()
)

# Number words from two on; words for one are articles in three of the four languages.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split()
)

# ---------------------------------------------------------------- characters

_SPACE, _LETTER, _DIGIT, _UPPER, _ALONE, _CLOSER, _STOP = (1 << i for i in range(7))
#: First and last characters of scripts without spaces between words.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
_BASE, _CODE_POINTS = 0x9E3779B97F4A7C15, 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.zeros(_CODE_POINTS, np.uint8), np.arange(_CODE_POINTS, dtype=np.uint64)
    for i in range(_CODE_POINTS):
        c = chr(i)
        if c.isalnum():
            kind[i] = _LETTER | (_UPPER if c.isupper() or c.istitle() else 0) if c.isalpha() else _DIGIT
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
        elif c.isspace():
            kind[i] = _SPACE
    for a, b in _UNSPACED:
        kind[a : b + 1] |= np.where(kind[a : b + 1] & (_LETTER | _DIGIT), _ALONE, 0).astype(np.uint8)
    kind[[ord(c) for c in "\"'”’»)]"]] |= _CLOSER
    kind[[ord(c) for c in ".!?…。！？"]] |= _STOP
    return kind, lower


_KIND, _LOWER = _tables()


class Powers:
    """Powers of a number and of its inverse, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            more = np.ones(2 * n, np.uint64)
            more[1:] = self.base
            self.up = np.multiply.accumulate(more)
            more[1:] = pow(self.base, -1, 1 << 64)
            self.down = np.multiply.accumulate(more)
        return self.up[:n], self.down[:n]


_OF_CHARACTERS, _OF_TOKENS = Powers(_BASE), Powers(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


def value_of(word: str) -> int:
    """The value of a lower-case token."""
    return int(_raw([word])[0][0])


def _raw(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, kind (no units yet), whether a sentence ends with it, and text number, of all tokens between white space."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    n = len(points)
    if n and points.max() >= _CODE_POINTS:
        plain = np.minimum(points, _CODE_POINTS - 1)
        kind = np.where(points < _CODE_POINTS, _KIND[plain], np.where(points < 0x20000, _LETTER, _LETTER | _ALONE)).astype(np.uint8)
        low = np.where(points < _CODE_POINTS, _LOWER[plain], points)
    else:
        kind, low = _KIND[points], _LOWER[points]
    inner, alone = (kind & _SPACE) == 0, (kind & _ALONE) != 0
    edge = np.empty(n + 1, bool)  # a token may begin, or one ends, before this character
    edge[[0, n]] = True
    edge[1:n] = ~(inner[:-1] & inner[1:]) | alone[:-1] | alone[1:]
    starts, ends = np.flatnonzero(inner & edge[:-1]), np.flatnonzero(inner & edge[1:]) + 1
    is_core = (kind & (_LETTER | _DIGIT)) != 0
    core, so_far = np.flatnonzero(is_core), _sums(is_core.astype(np.int32))
    some = so_far[ends] > so_far[starts]
    core = np.append(core, 0)
    first, last = core[so_far[starts]], core[so_far[ends] - 1]
    letters = _sums(((kind & _LETTER) != 0).astype(np.int32))
    has_letter = letters[ends] > letters[starts]
    up, down = _OF_CHARACTERS.to(n + 1)
    sums = _sums((low + np.uint64(1)) * up[:n])
    a, b = np.where(some, first, starts), np.where(some, last + 1, ends)  # a token without letter and digit is hashed as it stands: an operator
    value = mixed((sums[b] - sums[a]) * down[a])
    at = kind[first]
    what = np.where(has_letter, np.where(at & _DIGIT, MEASURE, np.where((at & _UPPER != 0) & (last > first), NAME, WORD)), NUMBER)
    what = np.where(some, what, NONE).astype(np.int8)
    told = (kind & (_SPACE | _CLOSER)) == 0
    said, until = np.append(np.flatnonzero(told), 0), _sums(told.astype(np.int32))
    stop = (until[ends] > until[starts]) & ((kind[said[until[ends] - 1]] & _STOP) != 0)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return value, what, stop, np.searchsorted(bounds, starts, "right")


def _pieces(text: str) -> list[str]:
    """The text cut at white space into pieces of about CHUNK characters."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        while to < len(text) and not text[to].isspace():
            to += 1
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


PLACEHOLDER = mixed(np.arange(1, 7, dtype=np.uint64) * np.uint64(_BASE))


@dataclass
class Tokens:
    """``value`` and ``kind`` of each token, whether it starts a sentence, its text's number, and ``ends``: where its text's tokens end.

    ``signs`` is the sum of what stands between a token and the next without letter or digit, ``n_signs`` how many these are.
    """

    value: np.ndarray
    kind: np.ndarray
    initial: np.ndarray
    text: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    signs: np.ndarray
    n_signs: np.ndarray

    def windows(self, hashed: np.ndarray, n: int) -> np.ndarray:
        """A hash of every ``n`` neighbouring values of ``hashed``."""
        up, down = _OF_TOKENS.to(len(hashed) + 1)
        sums = _sums(hashed * up[:-1])
        return mixed((sums[n:] - sums[:-n]) * down[: len(hashed) + 1 - n] + np.uint64(n))

    def masked(self, hashed: np.ndarray, n: int, mask: int, as_value: np.uint64) -> np.ndarray:
        """:meth:`windows` with the tokens at the bits of ``mask`` read as ``as_value``."""
        up, down = _OF_TOKENS.to(len(hashed) + 1)
        sums, m = _sums(hashed * up[:-1]), len(hashed) + 1 - n
        total = sums[n:] - sums[:-n]
        for k in range(n):
            if mask >> k & 1:
                total = total + (as_value - hashed[k : k + m]) * up[k : k + m]
        return mixed(total * down[:m] + np.uint64(n))

    def readings(self) -> list[np.ndarray]:
        """Placeholders of three readings: no names; names within sentences; names everywhere."""
        plain = (self.kind == NUMBER) | (self.kind == UNIT) | (self.kind == MEASURE)
        name = self.kind == NAME
        return [plain, plain | (name & ~self.initial), plain | name]

    def template(self, slot: np.ndarray, opening: bool = False) -> np.ndarray:
        """Hashes of the template tokens. ``opening``: names that open a sentence have a placeholder of their own."""
        kind = np.where(self.initial & (self.kind == NAME), NONE, self.kind) if opening else self.kind
        return np.where(slot, PLACEHOLDER[kind], self.value)


def tokens_of(texts: list[str]) -> Tokens:
    """All tokens of some texts, in their order."""
    found, some, first, chars = [], [], 0, 0

    def take(parts: list[str], number: int, same: bool) -> None:
        value, kind, stop, text = _raw(parts)
        found.append((value, kind, stop, np.full(len(text), number) if same else text + number))

    for i, t in enumerate(texts):
        if some and chars + len(t) > CHUNK:
            take(some, first, False)
            some, first, chars = [], i, 0
        if len(t) > CHUNK:
            for p in _pieces(t):
                take([p], i, True)
            some, first, chars = [], i + 1, 0
        else:
            some.append(t)
            chars += len(t)
    if some:
        take(some, first, False)
    value, kind, stop, text = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int8, bool, np.int64)))
    initial = np.ones(len(text), bool)
    initial[1:] = stop[:-1] | (text[1:] != text[:-1])
    kept = kind != NONE
    sums, marks, at = _sums(np.where(kept, 0, value).astype(np.uint64)), _sums((~kept).astype(np.int64)), np.flatnonzero(kept)
    until = np.append(at[1:], len(kept))[: len(at)]
    signs, n_signs = sums[until] - sums[at], marks[until] - marks[at]
    value, kind, initial, text = value[kept], kind[kept], initial[kept], text[kept]
    named = np.flatnonzero(kind == NAME)
    kind[named[np.isin(value[named], _FUNCTION_VALUES)]] = WORD
    kind[np.isin(value, _NUMBER_VALUES) & ((kind == WORD) | (kind == NAME))] = NUMBER
    after = 1 + np.flatnonzero((kind[:-1] == NUMBER) & (text[1:] == text[:-1]))
    kind[after[np.isin(value[after], _UNIT_VALUES) & ((kind[after] == WORD) | (kind[after] == NAME))]] = UNIT
    counts = np.bincount(text, minlength=len(texts))
    return Tokens(value, kind, initial, text, np.repeat(np.cumsum(counts), counts), counts, signs, n_signs)


_UNIT_VALUES, _FUNCTION_VALUES, _NUMBER_VALUES = (np.unique(_raw(sorted(x))[0]) for x in (UNITS, FUNCTION_WORDS, NUMBER_WORDS))

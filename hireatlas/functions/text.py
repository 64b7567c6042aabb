"""Text normalisation and tag lists."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from hireatlas.rules import BLANK_WORDS

WHITESPACE = " \t\n\r\x0b\x0c\u00a0"


def strip(c: Column | str) -> Column:
    """Trim every kind of white space at both ends (plain ``trim`` only drops spaces)."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def filled(c: Column | str) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def usable(c: Column | str) -> Column:
    """Like :func:`filled`, but the spelled-out nulls count as blank too."""
    text = filled(c)
    return F.when(~F.lower(text).isin(BLANK_WORDS), text)


def pick_first(*candidates: Column | str) -> Column:
    """First candidate with text in it, trimmed; empty text when there is none."""
    return F.coalesce(*[filled(c) for c in candidates], F.lit(""))


def fold_nordic(c: Column | str) -> Column:
    """Lower-case, trimmed, with the three Nordic vowels folded: the key for city comparisons."""
    return F.translate(F.lower(strip(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))), "äöå", "aoa")


# Letters and signs whose ASCII form no decomposition gives, as `sign form` pairs.
_LATIN = "ß ss Æ AE æ ae Œ OE œ oe Þ Th þ th Ø O ø o Đ D đ d Ð D ð d Ł L ł l ı i"
_GREEK = (
    "Α A Β B Γ G Δ D Ε E Ζ Z Η E Θ Th Ι I Κ K Λ L Μ M Ν N Ξ X Ο O Π P Ρ R Σ S Τ T Υ U Φ Ph Χ Kh Ψ Ps Ω O "
    "α a β b γ g δ d ε e ζ z η e θ th ι i κ k λ l μ m ν n ξ x ο o π p ρ r σ s ς s τ t υ u φ ph χ kh ψ ps ω o"
)
_CYRILLIC = (
    "А A Б B В V Г G Д D Е E Ж Zh З Z И I Й I К K Л L М M Н N О O П P Р R С S Т T У U Ф F Х Kh Ц Ts Ч Ch Ш Sh Щ Shch Ъ ' Ы Y Ь ' Э E Ю Iu Я Ia "
    "а a б b в v г g д d е e ж zh з z и i й i к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ъ ' ы y ь ' э e ю iu я ia "
    "Ё Io ё io Є Ie є ie І I і i Ї Yi ї yi Ј J ј j Љ Lj љ lj Њ Nj њ nj Ђ Dj ђ dj Ћ Tsh ћ tsh Џ Dzh џ dzh Ґ G ґ g"
)
_SIGNS = "‘ ' ’ ' ‚ , “ \" ” \" „ \" – - — -- … ... € EUR № No ™ (tm) © (c) ® (r) « << » >> ° deg"
#: Blocks that are looked up: letters and signs of Latin scripts, Greek, Cyrillic, punctuation, currency, letter-like signs, ligatures, full width.
_BLOCKS = {
    "latin": [(0xA0, 0x250), (0x1E00, 0x1F00)],
    "greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "cyrillic": [(0x400, 0x530)],
    "signs": [(0x2000, 0x20C0), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)],
}


def _ascii_table() -> tuple[str, str, dict[str, dict[str, str]]]:
    """Characters with a one-letter form, those forms, and per block the characters with a longer form.

    A character has the form listed above, else that of its compatibility decomposition without combining marks.
    """
    pairs = f"{_LATIN} {_GREEK} {_CYRILLIC} {_SIGNS}".split(" ")
    listed = dict(zip(pairs[::2], pairs[1::2]))

    def form(char: str) -> str | None:
        if char in listed:
            return listed[char]
        parts = [p for p in unicodedata.normalize("NFKD", char) if not unicodedata.combining(p)]
        plain = [p if p.isascii() else listed.get(p) for p in parts]
        return None if not plain or None in plain else "".join(plain)

    single, base, several = [], [], {}
    for block, ranges in _BLOCKS.items():
        for char in (chr(point) for low, high in ranges for point in range(low, high)):
            plain = form(char)
            if plain and len(plain) == 1:
                single.append(char)
                base.append(plain)
            elif plain:
                several.setdefault(block, {})[char] = plain
    return "".join(single), "".join(base), several


_SINGLE, _BASE, _SEVERAL = _ascii_table()


def _block_pattern(block: str) -> str:
    return "[" + "".join(f"\\u{low:04X}-\\u{high - 1:04X}" for low, high in _BLOCKS[block]) + "]"


def to_ascii(c: Column) -> Column:
    """Transliterate Latin, Greek and Cyrillic letters, common signs and compatibility forms to ASCII; other scripts stay as they are.

    Plain ASCII is passed through after one look; a block's longer forms are replaced only where the text has characters of that block.
    """
    out = F.translate(c, _SINGLE, _BASE)
    for block, forms in _SEVERAL.items():
        longer = out
        for char, plain in forms.items():
            longer = F.replace(longer, F.lit(char), F.lit(plain))
        out = F.when(c.rlike(_block_pattern(block)), longer).otherwise(out)
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(c)


def ordered_tags(c: Column | str) -> Column:
    """Tags from ``,``/``;`` text: lower-case, trimmed, distinct, in order of first appearance."""
    column = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.replace(F.coalesce(column, F.lit("")), F.lit(";"), F.lit(",")), ",")
    return clean_tags(parts)


def clean_tags(parts: Column) -> Column:
    """The same clean-up for a tag column that already is an array."""
    cleaned = F.transform(parts, lambda p: F.lower(strip(p)))
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def sorted_tags(c: Column | str) -> Column:
    return F.array_sort(ordered_tags(c))


def literal_array(values) -> Column:
    """A string array literal that keeps its type when it is empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words) -> Column:
    """True when the text holds at least one of the words as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def detect_tags(text: Column, rules: dict[str, list[str]]) -> Column:
    """Tags whose rule has a keyword inside a short text, in rule order; `keywords.tags_at` reads long ones once."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(contains_any(lowered, [w.lower() for w in words]), F.lit(tag)) for tag, words in rules.items()]
    return F.array_compact(F.array(*hits)) if hits else literal_array([])


def snippets(text: Column, lowered: Column, keywords, limit: int, window: int = 80) -> Column:
    """Distinct excerpts around the first hit of each of a few keywords, in keyword order, at most ``limit``.

    `keywords.snippets_at` takes the places of any number of keywords from one pass over the text.
    """

    def excerpt(word: str) -> Column:
        at = F.instr(lowered, F.lit(word))
        first = F.greatest(at - F.lit(window), F.lit(1))
        last = F.least(F.length(text), at - F.lit(1) + F.lit(window))
        return F.when(at > 0, strip(F.substring(text, first, last - first + F.lit(1))))

    found = F.array_compact(F.array(*[F.nullif(excerpt(word), F.lit("")) for word in keywords]))
    return F.slice(F.array_distinct(found), 1, limit)

"""Text repair, normalisation and labels as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

from viario.config import UNKNOWN_CORRIDOR

# The words that the replacement character broke, in order of repair.
BROKEN = "\ufffd"
LEADING_REPAIR = (BROKEN + r"+a\b", "ía")
WORD_REPAIRS = [
    (r"\bV" + BROKEN + "+a", "Vía"),
    ("T" + BROKEN + "+nel", "Túnel"),
    ("Crist" + BROKEN + "+bal", "Cristóbal"),
    ("r" + BROKEN + "+o", "río"),
    (BROKEN + "+XITO", "ÉXITO"),
    ("DO" + BROKEN + "+A", "DOÑA"),
]
# Character classes of the cell rules.
REPLACEMENT_CHARS = r"[\uFFFD\uFFFE\uFFFF]"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
FOREIGN_CHARS = r"[^\x09\x0A\x0D\x20-\x7E\u00A0-\u024F\u2000-\u206F\u20A0-\u20CF]"
WRAPPED = r"""(?U)\A[\s\x1C-\x1F]*(?:"([^"]*)"|'([^']*)')[\s\x1C-\x1F]*\z"""
EDGE_SPACE = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
])
# Letters without a decomposition, and their Latin spelling.
SPELLED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "—": "--", "…": "...",
}
SINGLE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ı": "i", "º": "o", "ª": "a", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
    "¿": "?", "¡": "!", "\u00a0": " ",
}

# Greek and Cyrillic letters in Latin spelling; hard and soft signs are not spelled.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω",
                 "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщыэюяієїґђћљњџјѕ",
                    "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch y e iu ia i ie yi g d c lj nj dzh j dz".split()))
SIGNS = {"ъ": "", "ь": "", "Ъ": "", "Ь": ""}


def _other_scripts() -> dict[str, str]:
    """Both alphabets in both cases, and their letters with marks, which lose these."""
    table = {**GREEK, **CYRILLIC}
    table.update({k.upper(): v.capitalize() for k, v in list(table.items()) if len(k.upper()) == 1})
    for code in (*range(0x0370, 0x0400), *range(0x0400, 0x0500)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and chr(code) not in table and base in table:
            table[chr(code)] = table[base]
    return {**table, **SIGNS}


OTHER_SCRIPTS = _other_scripts()


def _base_letters() -> dict[str, str]:
    """Accented Latin letters whose canonical decomposition is one ASCII letter plus marks."""
    letters = {}
    for code in range(0x00C0, 0x0250):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and first.isascii():
            letters[chr(code)] = first
    return letters


BASE_LETTERS = _base_letters()


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def spell_other_scripts(c: Column) -> Column:
    """Greek and Cyrillic in Latin letters; texts without such letters are not touched."""
    single = {k: v for k, v in OTHER_SCRIPTS.items() if len(v) == 1}
    dropped = "".join(k for k, v in OTHER_SCRIPTS.items() if not v)
    several = {k: v for k, v in OTHER_SCRIPTS.items() if len(v) > 1}
    plain = F.translate(c, "".join(single) + dropped, "".join(single.values()))
    spelled = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), several.items(), plain)
    return F.when(c.rlike(r"[\x{370}-\x{4FF}]"), spelled).otherwise(c)


def strip(c: Column) -> Column:
    """Remove any Unicode white space at both ends."""
    return F.btrim(c, F.lit(EDGE_SPACE))


def without_marks(c: Column) -> Column:
    """Accented letters become plain ones; other characters stay."""
    return F.regexp_replace(_translate(c, BASE_LETTERS), r"\p{Mn}", "")


def to_ascii(c: Column) -> Column:
    """Latin text in ASCII; what has no Latin spelling is dropped."""
    spelled = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SPELLED.items(), c)
    return F.regexp_replace(_translate(spelled, BASE_LETTERS | SINGLE), r"[^\x00-\x7F]", "")


def to_latin(c: Column) -> Column:
    """Latin, Greek and Cyrillic text in ASCII; of other scripts letters and digits stay, without their marks."""
    spelled = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SPELLED.items(), spell_other_scripts(c))
    plain = _translate(spelled, BASE_LETTERS | SINGLE)
    return F.regexp_replace(plain, r"[^\x00-\x7F\p{L}\p{N}]|\p{M}", "")


def snake_case(name: str) -> str:
    """A column name in ASCII snake case."""
    table = str.maketrans(BASE_LETTERS | SINGLE | SPELLED | OTHER_SCRIPTS)
    plain = unicodedata.normalize("NFKD", name.translate(table)).encode("ascii", "ignore").decode()
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in plain.lower()).split()
    return "_".join(words)


def repair_words(c: Column, *, leading: bool = True, drop_rest: bool = True) -> Column:
    """Restore known words broken by U+FFFD; texts without it are not touched."""
    repairs = ([LEADING_REPAIR] if leading else []) + WORD_REPAIRS
    fixed = reduce(lambda x, kv: F.regexp_replace(x, "(?U)" + kv[0], kv[1]), repairs, c)
    if drop_rest:
        fixed = F.replace(fixed, F.lit(BROKEN), F.lit(""))
    return F.when(c.contains(BROKEN), fixed).otherwise(c)


def drop_replacement_chars(c: Column) -> Column:
    return F.regexp_replace(c, REPLACEMENT_CHARS, "")


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CHARS, "")


def drop_foreign_chars(c: Column) -> Column:
    return F.regexp_replace(c, FOREIGN_CHARS, "")


def unwrap_quotes(c: Column) -> Column:
    """Take off one pair of equal quotes around the text unless it is also inside."""
    return F.regexp_replace(c, WRAPPED, "$1$2")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def clean_text(c: Column) -> Column:
    """All cell rules in order; null becomes the empty text.

    What the rules on replacement and control characters delete is outside the kept
    character ranges too, so one pass over the text does for all three."""
    steps = [
        lambda x: repair_words(x, leading=False, drop_rest=False),
        drop_foreign_chars, unwrap_quotes, collapse_spaces, strip,
    ]
    return F.coalesce(reduce(lambda x, step: step(x), steps, c.cast("string")), F.lit(""))


def text_changed(before: Column, after: Column) -> Column:
    """Whether cleaning changed the cell; a null cell never counts."""
    return F.coalesce(before.cast("string") != after, F.lit(False))


def removed_characters(before: Column, after: Column) -> Column:
    """Code points that are in the first text and no longer in the second, sorted."""
    gone = F.array_except(F.split(before, ""), F.split(after, ""))
    def code_point(ch: Column) -> Column:
        digits = F.hex(F.ascii(ch))
        return F.concat(F.lit("U+"), F.repeat(F.lit("0"), 4 - F.length(digits)), digits)

    named = F.transform(F.filter(gone, lambda ch: ch != ""), code_point)
    return F.array_sort(F.array_distinct(named))


def blank_to_null(c: Column) -> Column:
    """White space or nothing but quotes becomes null."""
    return F.when(c.rlike(r'(?U)\A\s*"*\s*\z'), F.lit(None)).otherwise(c)


def area_key(c: Column) -> Column:
    """Spelling-independent key of an area name: Latin, Greek and Cyrillic letters in ASCII,
    letters and digits of other scripts as they are, in lower case and without marks."""
    plain = F.regexp_replace(F.lower(to_latin(F.coalesce(c.cast("string"), F.lit("")))), "-", " ")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def corridor_label(c: Column) -> Column:
    """Upper-case corridor name without accents, signs and leading numbers."""
    letters = F.regexp_replace(without_marks(F.lower(c.cast("string"))), r"(?U)[^a-z0-9\s]", "")
    label = F.upper(strip(F.regexp_replace(letters, r"(?U)\A[0-9\s]+", "")))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(UNKNOWN_CORRIDOR))


def commune_code(c: Column) -> Column:
    """The digits of a code with at least two places."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(F.length(digits) > 0, padded)


def safe_name(c: Column) -> Column:
    """A label that can be a file name."""
    # Characters with a replacement of their own.
    plain = F.translate(c.cast("string"), " /\\áéíóúÁÉÍÓÚñÑ", "___aeiouAEIOUnN")
    return F.regexp_replace(plain, r"[^\p{L}\p{N}_]", "")

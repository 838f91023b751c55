"""Text expressions: normalising, tokens, labels, sizes."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of ECMAScript, and the pattern of a token.
_OTHER_WHITE = r"\t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WHITE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{_WHITE}]"
TOKEN = rf"[\p{{L}}\p{{N}}]+(?:[.,:/_-][\p{{L}}\p{{N}}]+)*|[^{_WHITE}]"
# The same for Java, which then keeps no places to come back to; and two ranges that leave over white space and
# rare characters, so that most characters are passed by after one comparison.
_TOKEN = TOKEN.replace("]+", "]++").replace(")*", ")*+")
_RARE = r"[^\x21-\x9F\x{A1}-\x{167F}]"


@F.arrow_udf(StringType())
def _nfkc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A few texts at a time are Python strings, however many are in a batch."""
    for p in parts:
        some = [pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in p.slice(low, 64).to_pylist()], pa.string()) for low in range(0, len(p), 64)]
        yield pa.concat_arrays(some) if some else pa.array([], pa.string())


def normalize(text: Column, nfkc: bool = False) -> Column:
    """White space collapsed to one space and trimmed. With ``nfkc``, compatibility forms are folded
    first; only texts with a character outside ASCII are sent to Python for it."""
    if nfkc:
        other = text.rlike(r"[^\x00-\x7F]")
        text = F.when(other, _nfkc(F.when(other, text))).otherwise(text)
    # A single space stays as it is, so most texts match nowhere.
    return F.trim(F.regexp_replace(text, f"{_RARE}(?:(?<= )(?={_RARE}){SPACE}++|(?<! )(?<=[{_OTHER_WHITE}]){SPACE}*+)", " "))


def tokens(text: Column) -> Column:
    """Words with inner marks kept (12.5, a-b), and each other sign that isn't white space."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long")


@functools.cache
def accented_letters() -> tuple[str, str]:
    """Two parallel strings: every character that decomposes into one other and combining marks
    (U+0300 to U+036F), and what it then is."""
    pairs = []
    for code in range(0xA0, 0x30000):
        if 0xAC00 <= code <= 0xDFFF:
            continue  # Hangul syllables, surrogates
        left = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(code)))
        if len(left) == 1 and left != chr(code):
            pairs.append((chr(code), left))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Accents taken off, as by canonical decomposition and dropping the combining marks; letters that
    don't decompose (such as o with a stroke) stay."""
    return F.regexp_replace(F.translate(text, *accented_letters()), r"[\x{300}-\x{36F}]", "")


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB; one decimal from KB on."""
    def at(unit: str, power: int) -> Column:
        return F.concat(F.format_number(size / F.lit(1024.0**power), 1), F.lit(f" {unit}"))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, at("KB", 1)).when(size < 1024**3, at("MB", 2)).otherwise(at("GB", 3))
    )


def plain_marks(text: Column) -> Column:
    """Dashes, ellipsis and quotes in plain form; texts without any stay as they are."""
    return F.when(text.rlike(r"[\x{2013}-\x{2026}]"), F.translate(F.regexp_replace(text, "…", "..."), "–—―‘’‚“”„", "---'''\"\"\"")).otherwise(text)


def latin1_fold(text: Column, mode: str = "mark", plain: Column | None = None) -> Column:
    """Dashes, ellipsis and quotes in plain form; of what is then outside Latin-1, ``mark`` leaves a
    question mark, ``drop`` nothing, and ``ascii`` first removes accents and then drops all non-ASCII.
    ``plain`` is ``plain_marks`` of the text, where it is there already."""
    plain = plain_marks(text) if plain is None else plain
    if mode == "ascii":  # accents that stand alone aren't ASCII, and go with the rest
        return F.regexp_replace(F.when(plain.rlike(r"[^\x00-\x7F]"), F.translate(plain, *accented_letters())).otherwise(plain), r"[^\x20-\x7E]", "")
    # Most characters are told by the first range.
    return F.regexp_replace(plain, r"[^\x20-\x7E](?<![\x09\x0A\x0D\x{A0}-\x{FF}])", "?" if mode == "mark" else "")


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from two nested SHA-256 over padded keys."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def output_name(number: Column, stem: Column, suffix: str) -> Column:
    """``001-name<suffix>``: the place of an output, in three digits or more, and its name."""
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("-"), stem, F.lit(suffix))


# The patterns of letter-spaced texts, and the words of bold and italic fonts.
LETTER_SPACED, CAPITAL_PAIR = r"^(\S ){2,}\S$", r"^\p{Lu} \p{Lu}$"
BOLD, ITALIC = "bold|black|heavy|semibold|demi", "italic|oblique"


def is_letter_spaced(text: Column) -> Column:
    """Whether a text is three or more single signs parted by single spaces, or two capital letters so."""
    return F.coalesce(text.rlike(LETTER_SPACED) | text.rlike(CAPITAL_PAIR), F.lit(False))


# Words of font names, words that rule them out, and the font that stands for them; of
# several the last counts, without any the first name does.
FONTS = [
    ("", None, "Arial"),
    (r"times|serif(?!-)|georgia|garamond|cambria|roman", "sans", "Times New Roman"),
    (r"courier|mono", None, "Courier New"),
    (r"calibri", None, "Calibri"),
    (r"verdana", None, "Verdana"),
    (r"tahoma", None, "Tahoma"),
]


def font_class(name: Column, family: Column) -> Column:
    """``font``, ``bold`` and ``italic`` as told by a font's name and family."""
    words = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(family, F.lit(""))))
    font = F.lit(None).cast("string")
    for pattern, unless, label in FONTS:
        met = words.rlike(pattern) if unless is None else words.rlike(pattern) & ~words.rlike(unless)
        font = F.when(met, label).otherwise(font)
    return F.struct(font.alias("font"), words.rlike(BOLD).alias("bold"), words.rlike(ITALIC).alias("italic"))


def setting_labels(settings: Column, labels: list[tuple[str, str]]) -> Column:
    """Labels of the settings (a map from name to on or off) that are on, in the order of ``labels``."""
    return F.array_compact(F.array(*(F.when(F.coalesce(settings[name], F.lit(False)), F.lit(label)) for name, label in labels)))


def canonical_json(text: Column) -> Column:
    """A JSON text in one spelling: a variant keeps the fields of its objects sorted by name, at any depth, so
    texts that differ in the order of fields or in white space come out alike. Nulls stay; of numbers that are
    equal, 1.0 and 1 come out alike. What isn't JSON, or names a field twice, is null."""
    return F.to_json(F.try_parse_json(text))

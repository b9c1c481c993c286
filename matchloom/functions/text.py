"""Text normalisation, blocking-key parts and token sets as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Word lists and patterns that results depend on.  Every operator keeps its own list.
HONORIFICS = ("shri", "sri", "shree", "m/s", "ms", "dr", "doctor", "prof", "the")
LEGAL_NAME = (
    "pvt\\.?\\s*ltd\\.?|private\\s+limited|private\\s+ltd\\.?|p\\.?\\s*ltd\\.?|llp|llc|inc\\.?|corp\\.?|corporation|incorporated|"
    "limited|ltd\\.?|co\\.?|company|enterprises?|industries|industry|group|holding|holdings|trading|traders?|distributors?|"
    "solutions?|technologies|technology|tech|services?|international|intl\\.?|plc|gmbh|s\\.a\\.s|s\\.a\\.|sarl|sas|eurl|srl|"
    "proprietorship|proprietor|prop\\.?|& sons|and sons|brothers|bros\\.?"
)
LEGAL_KEYS = (
    "pvt\\.?\\s*ltd\\.?|private\\s+limited|private\\s+ltd\\.?|p\\.?\\s*ltd\\.?|llp|llc|inc\\.?|corp\\.?|corporation|limited|ltd\\.?|"
    "co\\.?|company|enterprises?|industries|industry|group|holdings?|trading|traders?|distributors?|solutions?|technologies|"
    "technology|tech|services?|international|intl\\.?|plc|gmbh|s\\.a\\.s|s\\.a\\.|sarl|sas|eurl|srl|proprietorship|proprietor|"
    "prop\\.?|& sons|and sons|brothers|bros\\.?|pllc|associates?|association|foundation|trust"
)
LEGAL_DIAGNOSTIC = (
    "pvt\\.?\\s*ltd\\.?|private\\s+limited|private\\s+ltd\\.?|p\\.?\\s*ltd\\.?|llp|llc|inc\\.?|corp\\.?|corporation|limited|ltd\\.?|"
    "co\\.?|company|enterprises?|industries|industry|group|holdings?|trading|traders?|distributors?|solutions?|technologies|"
    "technology|tech|services?|international|intl\\.?|s\\.a\\.s|s\\.a\\.|sarl|sas|eurl|srl|proprietorship|proprietor|"
    "prop\\.?|& sons|and sons|brothers|bros\\.?|pllc|plc|associates?|association|foundation|trust|school|college|"
    "hospital|clinic|center|centre"
)
LEGAL_MARKERS = "pvt|private|limited|ltd|llp|llc|inc|corp|sas|sarl|eurl|srl"
LEGAL_SUFFIX = (
    "inc|incorporated|llc|limited liability company|ltd|limited|corp|corporation|co|company|gmbh|sa|srl|bv|sl|oy|ab|pvt|plc"
)
UNIT_WORDS = "suite|ste|apt|apartment|unit|floor|fl|room|rm|bldg|building|dept|box|p\\.?o\\.?\\s*box"
CARDINALS = "n|s|e|w|ne|nw|se|sw|north|south|east|west"
ADDRESS_WORDS = (
    ("\\bct\\.?\\b", "court"),
    ("\\brd\\.?\\b", "road"),
    ("\\bst\\.?\\b", "street"),
    ("\\bdr\\.?\\b", "drive"),
    ("\\bpl\\.?\\b", "place"),
    ("\\bave\\.?\\b|\\bav\\.?\\b", "avenue"),
    ("\\bblvd\\.?\\b", "boulevard"),
    ("\\bln\\.?\\b", "lane"),
    ("\\bcir\\.?\\b", "circle"),
    ("\\bpkwy\\.?\\b", "parkway"),
    ("\\bhwy\\.?\\b", "highway"),
    ("\\bflr\\.?\\b|\\bfl\\.?\\b", "floor"),
    ("\\bapt\\.?\\b", "apartment"),
    ("\\bste\\.?\\b", "suite"),
    ("\\bbldg\\.?\\b", "building"),
    ("\\bh\\.?\\s*no\\.?\\b", "house number"),
    ("\\bplot\\.?\\s*no\\.?\\b", "plot number"),
    ("\\bflat\\.?\\s*no\\.?\\b", "flat"),
    ("\\bnagar\\b|\\bng\\.?\\b", "nagar"),
    ("\\bm\\.?\\s*g\\.?\\b", "mahatma gandhi"),
    ("&", "and"),
    ("\\bno\\.?\\b|\\bnos\\.?\\b", "number"),
)
KEY_ADDRESS_WORDS = (
    ("\\bct\\b", "court"),
    ("\\brd\\b", "road"),
    ("\\bst\\b", "street"),
    ("\\bdr\\b", "drive"),
    ("\\bpl\\b", "place"),
    ("\\bflr\\b|\\bfl\\b", "floor"),
    ("\\bave\\b|\\bav\\b", "avenue"),
    ("\\bblvd\\b", "boulevard"),
    ("\\bln\\b", "lane"),
    ("\\bhno\\b", "house"),
    ("\\bapt\\b", "apartment"),
)


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Non-ASCII code points of the Latin blocks and full-width forms, by compatibility decomposition."""
    one, to, many, gone = [], [], [], []
    for point in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF01, 0xFF5F)]:
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(char), to.append(plain)
        elif plain:
            many.append((char, plain))
        else:
            gone.append(char)
    return "".join(one), "".join(to), many


_FROM, _TO, _MANY = _fold_table()


def ascii_fold(x: Column) -> Column:
    """Compatibility decomposition to ASCII; what has no ASCII form goes.

    JVM-side for Latin letters, punctuation and full-width forms; letters of other blocks are
    dropped here, as they have no ASCII part (``udfs.ascii_fold_exact`` follows Unicode for every block).
    """
    for char, plain in _MANY:
        x = F.replace(x, F.lit(char), F.lit(plain))
    return F.regexp_replace(F.translate(x, _FROM, _TO), "[^\\x00-\\x7F]", "")


def text(x: Column) -> Column:
    """Null as ''."""
    return F.coalesce(x, F.lit(""))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "^\\s+", ""), "\\s+$", "")


def rewrite(x: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites: later rules see what earlier ones made."""
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    return x


def normalize_text(x: Column, address: bool = False, fold: bool = True) -> Column:
    """ASCII, lower case, address words written out on demand, punctuation and white space as single spaces."""
    x = F.lower(ascii_fold(text(x)) if fold else text(x))
    if address:
        x = rewrite(strip(x), ADDRESS_WORDS)
    return collapse(F.regexp_replace(x, "[^\\w\\s]", " "))


def normalize_name(x: Column) -> Column:
    """Normal text without one leading honorific and without legal forms."""
    x = F.regexp_replace(normalize_text(x), "^(" + "|".join(HONORIFICS) + ")\\b\\s*", "")
    return collapse(F.regexp_replace(x, f"\\b({LEGAL_NAME})\\b", " "))


def normalize_address(x: Column) -> Column:
    """Normal text with address words written out."""
    return normalize_text(x, address=True)


def normalize_country(x: Column) -> Column:
    """Lower case without outer white space; 'unknown' if null."""
    return F.coalesce(F.lower(strip(x)), F.lit("unknown"))


def key_name(x: Column) -> Column:
    """The name form of blocking keys: accents stay, honorific and legal forms go before punctuation does."""
    x = F.regexp_replace(F.lower(text(x)), "^(" + "|".join(HONORIFICS) + ")\\b\\s*", "")
    x = F.regexp_replace(x, f"(?U)\\b({LEGAL_KEYS})\\b", " ")
    return collapse(F.regexp_replace(x, "(?U)[^\\w\\s]", " "))


def key_address(x: Column) -> Column:
    """The address form of blocking keys."""
    return collapse(F.regexp_replace(rewrite(F.lower(text(x)), KEY_ADDRESS_WORDS), "(?U)[^\\w\\s]", " "))


def key_country(x: Column) -> Column:
    """The country form of blocking keys: '' if null."""
    return F.lower(strip(text(x)))


def sort_key(name: Column, country: Column) -> Column:
    """Country and name without punctuation or white space, for sorted neighbourhoods."""
    compact = F.regexp_replace(F.regexp_replace(F.lower(text(name)), "(?U)[^\\w\\s]", " "), "\\s+", "")
    return F.concat(key_country(country), F.lit("|"), compact)


def combined_text(name: Column, address: Column, weight: int = 2) -> Column:
    """The normal name ``weight`` times and the normal address, blanks left out."""
    return F.concat_ws(" ", *[F.nullif(name, F.lit(""))] * weight, F.nullif(address, F.lit("")))


def tokens(x: Column) -> Column:
    """Words between white space, in order."""
    return F.filter(F.split(x, "\\s+"), lambda t: t != "")


def grams(x: Column, n: int) -> Column:
    """Distinct substrings of n characters; none in shorter texts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1)))
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(x, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )


def word_grams(words: Column, n: int = 2) -> Column:
    """Distinct runs of n words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(
        F.size(words) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))
    ).otherwise(F.array().cast("array<string>"))


def without_legal(x: Column) -> Column:
    """Lower-case name without the legal suffix list; inner spaces stay."""
    return strip(F.regexp_replace(x, f"(?i)\\b({LEGAL_SUFFIX})\\b", ""))


def alnum(x: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(x, "[^\\p{L}\\p{N}]", "")


def catalog_fields(x: Column) -> dict[str, Column]:
    """Item name, value, unit and description (or the first three bullet points) of a product text."""
    field = lambda key: strip(F.regexp_extract(x, f"(?i){key}:\\s*(.*)", 1))
    bullets = F.slice(F.regexp_extract_all(x, F.lit("(?i)Bullet Point\\s*\\d*:\\s*(.*)"), F.lit(1)), 1, 3)
    described = strip(F.regexp_extract(x, "(?is)Product Description:\\s*(.*?)(?=\\n\\w+:|$)", 1))
    return {
        "item_name": field("Item Name"),
        "item_value": field("Value"),
        "item_unit": field("Units?"),
        "item_text": F.when(described != "", described).otherwise(F.array_join(bullets, " ")),
    }


#: The code points that are dropped from product texts.
EMOJI = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF),
    (0x2700, 0x27BF), (0x1F900, 0x1F9FF), (0x2600, 0x26FF), (0x2B00, 0x2BFF),
)


def without_emoji(x: Column) -> Column:
    """Without the emoji and pictograph ranges."""
    return F.regexp_replace(x, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI) + "]+", "")


def _field(x: Column, key: str) -> Column:
    return F.lower(strip(F.regexp_extract(x, f"(?id){key}:\\s*(.*)", 1)))


def product_text(x: Column) -> Column:
    """Three lines (units, value, item name) of a product text, lower-cased; a null text gives the empty one."""
    plain = without_emoji(x)
    lines = [F.concat(F.lit(f"{k}: "), _field(plain, k)) for k in ("Units", "Value", "Item Name")]
    return F.coalesce(F.array_join(F.array(*lines), "\n"), F.lit(""))


def product_text_described(x: Column, spelled: Callable[[Column], Column] = lambda c: c) -> Column:
    """Item name, value and units, then the description, or else up to three bullet points; null counts as empty.

    ``spelled`` writes numbers as words before the fields are taken.  With it "Bullet Point 1" isn't numbered any
    longer, so that bullet points are found only without it.
    """
    plain = spelled(without_emoji(F.coalesce(x, F.lit(""))))
    lines = [F.concat(F.lit(f"{k}: "), _field(plain, k)) for k in ("Item Name", "Value", "Units")]
    pattern = "(?isd)Product Description:\\s*(.*?)(?=\\n\\w+:|\\n?\\z)"
    bullets = F.slice(F.regexp_extract_all(plain, F.lit("(?id)Bullet Point \\d+:\\s*(.*)"), F.lit(1)), 1, 3)
    bullets = F.transform(bullets, lambda b, i: F.concat(F.lit("Bullet Points "), (i + 1).cast("string"), F.lit(": "), F.lower(strip(b))))
    described = F.array(F.concat(F.lit("Description: "), F.lower(strip(F.regexp_extract(plain, pattern, 1)))))
    return F.array_join(F.concat(F.array(*lines), F.when(plain.rlike(pattern), described).otherwise(bullets)), "\n")

"""Text expressions of the line corpus and the pattern texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark wiki or web markup, kept punctuation, and the corpus limits.
MARKUP = ("|", "{{", "]]", "http", "==", "<", ">")
PUNCTUATION = ".,:;!?()\"'/%#&+*=@-«»—–№₽"
LINE_LENGTH, LEAST_LETTERS, LEAST_SHARE = (4, 120), 3, 0.6
SPACES = "[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{85}\\x{1680}]+"


def sentences(text: Column) -> Column:
    """Pieces between sentence ends and line ends, empty ones included."""
    return F.split(text, "[.!?\\n]+")


def has_markup(text: Column) -> Column:
    out = F.lit(False)
    for m in MARKUP:
        out = out | F.contains(text, F.lit(m))
    return out


def clean_line(text: Column) -> Column:
    """Letters, digits and kept punctuation, white space collapsed; NULL if nothing is left."""
    kept = F.regexp_replace(text, "[^\\p{L}\\p{N} .,:;!?()\"'/%#&+*=@«»—–№₽-]", "")
    return F.nullif(F.btrim(F.regexp_replace(kept, SPACES, " ")), F.lit(""))


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^\\p{L}]", ""))


def script_share(text: Column, script: str) -> Column:
    """Share of a text's letters in a script's alphabet; 0 without letters."""
    alphabet = {"latin": "[^A-Za-z]", "cyrillic": "[^А-яЁё]"}[script]
    return F.coalesce(F.try_divide(F.char_length(F.regexp_replace(text, alphabet, "")), letters(text)), F.lit(0.0))


def dominant_script(text: Column) -> Column:
    """The script with the larger share; ties go to Cyrillic, no share at all to NULL."""
    c, l = script_share(text, "cyrillic"), script_share(text, "latin")
    return F.when((c >= l) & (c > 0), "cyrillic").when(l > 0, "latin")


def line_usable(text: Column, script: str = "latin") -> Column:
    n = F.char_length(text)
    return n.between(*LINE_LENGTH) & (letters(text) >= LEAST_LETTERS) & (script_share(text, script) >= LEAST_SHARE)


def supported_only(text: Column, ranges: Column) -> Column:
    """Characters within the ranges (lo, hi), joined again on single spaces."""
    kept = F.filter(F.split(text, ""), lambda c: (c == " ") | F.exists(ranges, lambda r: F.ascii(c).between(r["lo"], r["hi"])))
    return F.btrim(F.regexp_replace(F.array_join(kept, ""), " +", " "))


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere (unlike initcap, which looks for spaces)."""
    spaced = F.transform(F.split(text, "(?<=\\P{L})"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
    return F.array_join(spaced, "")


def case_roll(text: Column, u: Column) -> Column:
    """Upper case for the first 32 % of the draws, title case up to 47 %, else unchanged."""
    return F.when(u < 0.32, F.upper(text)).when(u < 0.47, title_case(text)).otherwise(text)


def price(amount: Column, signed: Column) -> Column:
    """Thousands grouped by spaces, with a rouble sign where asked."""
    grouped = F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" "))
    return F.when(signed, F.concat(grouped, F.lit(" ₽"))).otherwise(grouped)


def dimensions(separator: Column, parts: Column) -> Column:
    """Two or three integers joined by a separator."""
    return F.concat_ws("", F.get(parts, F.lit(0)).cast("string"), separator, F.get(parts, F.lit(1)).cast("string"), F.when(F.size(parts) > 2, F.concat(separator, F.get(parts, F.lit(2)).cast("string"))))


def phone(digits: Column) -> Column:
    """+7 ddd ddd-dd-dd from ten digits."""
    return F.concat(F.lit("+7 "), F.substring(digits, 1, 3), F.lit(" "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 2), F.lit("-"), F.substring(digits, 9, 2))


def date_text(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.make_date(year, month, day), "dd.MM.yyyy")


def article_code(picks: Column, letters_: Column) -> Column:
    """Groups of capital letters or digits: picks are arrays of integers, letters_ says which groups are letters."""
    groups = F.transform(picks, lambda g, i: F.array_join(F.transform(g, lambda k: F.when(F.get(letters_, i), F.char(65 + k % 26)).otherwise((k % 10).cast("string"))), ""))
    return F.array_join(groups, " ")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+?)(?:\\.[^./]*)?$", 1)

"""Readability as columns: no Python per row, no shuffle before the first sum."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities, from the standard library's table; and the characters that numbers 128 to 159 stand for.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
LEGACY = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}

#: Parts of a page that hold no prose, with all that is in them.
NO_PROSE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"

#: Fixed patterns of the word, sentence and markup rules.
ODD = r"\t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK, ODD_BLANK = f"[ {ODD}]", f"[{ODD}]"
WORD = r"[A-Za-z][A-Za-z’'\-]*|\p{Nd}[\p{Nd},.]*"
SENTENCE_END = "([.!?])[ ]+([A-Z0-9\"“‘])"
MARK = "\x01"


def strip_markup(c: Column, templates: bool = True) -> Column:
    """Text of an HTML fragment: comments, scripts and styles out, template holes out, tags to spaces,
    entities decoded, blanks folded."""
    c = F.regexp_replace(c, NO_PROSE, " ")
    if templates:
        c = F.regexp_replace(c, r"\$\{[^}]*\}", "")
    return fold_blanks(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")))


def decode_entities(c: Column) -> Column:
    """Named entities (a few also without their semicolon) and decimal and hexadecimal ones; all else stays.

    The text is cut at its ampersands, and each piece starts with at most one entity. Numbers outside Unicode and
    surrogates become U+FFFD, 128 to 159 read as Windows-1252.
    """
    table = lambda m: F.from_json(F.lit(json.dumps(m)), "map<string,string>")  # noqa: E731  one constant
    named, bare, legacy = table(NAMED), table(BARE), table(LEGACY)

    def char(n: Column) -> Column:
        wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(wrong, F.lit("\ufffd")).when(n.between(128, 159), F.try_element_at(legacy, n.cast("string"))).otherwise(plain)

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        short = F.regexp_extract(p, "^(" + "|".join(sorted(BARE, key=lambda n: (-len(n), n))) + ")", 1)
        dec, hexa = F.regexp_extract(p, r"^#0*([0-9]{1,9})", 1), F.regexp_extract(p, r"^#[xX]0*([0-9A-Fa-f]{1,8})", 1)
        number = F.coalesce(F.nullif(dec, F.lit("")).cast("long"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("long"))
        after = F.regexp_replace(p, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", "")
        known = F.try_element_at(named, name)
        return (
            F.when(number.isNotNull(), F.concat(char(number), after))
            .when((name != "") & known.isNotNull(), F.concat(known, F.substr(p, F.length(name) + 2)))
            .when(short != "", F.concat(F.try_element_at(bare, short), F.substr(p, F.length(short) + 1)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(c, "&")
    decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def fold_blanks(c: Column) -> Column:
    """Runs of blanks, and blanks other than the plain one, to one plain blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{BLANK}{{2,}}|{ODD_BLANK}", " "))


def sentences(c: Column) -> Column:
    """Sentences of a text with folded blanks. Every cut sits between two visible signs, so no
    piece is blank; an empty text gives one empty piece."""
    return F.split(F.regexp_replace(c, SENTENCE_END, "$1" + MARK + "$2"), MARK)


#: Fixed: vowels to one sign, the other letters to another.
_LETTERS, _SIGNS = "aeiouybcdfghjklmnpqrstvwxz", "aaaaaa...................."


def is_word(c: Column) -> Column:
    """A token that starts with a letter; the other tokens are numbers."""
    code = F.ascii(c)
    return code.between(65, 90) | code.between(97, 122)


def letters(c: Column) -> Column:
    """Lower-case letters of a word token, whose only other signs are apostrophes and hyphens."""
    return F.lower(F.translate(c, "’'-", ""))


def vowel_groups(w: Column) -> Column:
    """Runs of vowels: each run's start is one ``.a`` pair of the sign string."""
    signs = F.concat(F.lit("."), F.translate(w, _LETTERS, _SIGNS))
    return F.length(signs) - F.length(F.replace(signs, F.lit(".a"), F.lit("a")))


def syllables_of(w: Column, groups: Column) -> Column:
    """Vowel groups, less a silent final e, at least 1; 0 without letters."""
    silent = (groups > 1) & w.endswith("e") & ~w.endswith("le")
    return F.when(w == "", 0).when(silent, groups - 1).otherwise(F.greatest(groups, F.lit(1)))


def syllables(c: Column) -> Column:
    """Syllables of a word token or of a part of one."""
    w = letters(c)
    return syllables_of(w, vowel_groups(w))

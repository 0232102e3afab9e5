"""Column functions on text. All but those named exact_* are built-in expressions, evaluated in the JVM."""

from __future__ import annotations


import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as Unicode text handling knows them; Java's \s and \R know fewer.
#: Single Latin signs are one lookup for the JVM and a range before the rest spares the other ones, so that most letters
#: are told from white space by two tests; LINE_END begins with its class for the same reason.
SPACE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029](?:(?<=\r)\n)?"
#: The same signs as SPACE, and those cut off both ends of a line that is shown.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BULLETS = " •▪●\t-"
#: Letters by which a text counts as Vietnamese (fixed value).
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯạảãàáặẳẵằắậẩẫầấẹẻẽèéệểễềếịỉĩìíọỏõòóộổỗồốợởỡờớụủũùúựửữừứỵỷỹỳý"


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def source_lines(text: Column) -> Column:
    """Stripped lines that are not empty, in order. They are numbered from 1 wherever lines are cited."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != "")


def normalized_source(text: Column) -> Column:
    """The numbered lines as one text; null where there is none, which callers reject."""
    joined = F.array_join(source_lines(text), "\n")
    return F.when(joined != "", joined)


def indexed_prompt(text: Column) -> Column:
    """The numbered lines, each behind its number in four digits: [L0001] ..."""
    return F.array_join(F.transform(source_lines(text), lambda x, i: F.concat(F.lit("[L"), F.when(i < 9999, F.lpad((i + 1).cast("string"), 4, "0")).otherwise((i + 1).cast("string")), F.lit("] "), x)), "\n")


def display_lines(text: Column) -> Column:
    """Lines that are not blank, with white space collapsed and bullets, dashes and blanks cut off both ends; some may be left empty."""
    full = F.filter(F.split(text, LINE_END, -1), lambda x: strip(x) != "")
    return F.transform(full, lambda x: F.btrim(F.regexp_replace(x, f"[{SPACE}]+", " "), F.lit(BULLETS)))


def fold_text(value: str) -> str:
    """Case-folded text without combining marks after compatibility decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters that fold to another one, those; then characters that fold to nothing."""
    pairs, gone = [], []
    for code in range(128, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        f = fold_text(c)
        if f != c and len(f) == 1:
            pairs.append((c, f))
        elif not f:
            gone.append(c)
    return "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """fold_text in the JVM: a table over the basic plane, made from the rule at first use, and ß and the Latin ligatures.
    Characters that fold to several others but for these keep their form; exact_fold has no such exception. Only texts
    with other characters than ASCII pay for the table."""
    out = F.translate(F.lower(text), *_fold_table())
    for c in "ßﬀﬁﬂﬃﬄﬅﬆ":
        out = F.replace(out, F.lit(c), F.lit(fold_text(c)))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)


def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fold_text(x))


def _valued(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def exact_fold(text: Column) -> Column:
    """fold_text of any text, in Arrow batches."""
    return F.pandas_udf(_folded, "string")(text)


def exact_value(text: Column) -> Column:
    """Composed compatibility form, case-folded, white space collapsed; accents stay. In Arrow batches."""
    return F.pandas_udf(_valued, "string")(text)


def _valued_text(x: str) -> str:
    return unicodedata.normalize("NFKC", x).casefold()


@lru_cache(maxsize=1)
def _value_tables() -> tuple[str, str, tuple]:
    """Characters of the basic plane whose value is one other character, their values, and (character, value) of the
    others whose value is two or three ASCII characters, fractions and ligatures above all. Made from the rule at first use."""
    one, more = [], []
    for code in range(128, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        v = _valued_text(c)
        if v != c.lower() and len(v) == 1:
            one.append((c, v))
        elif v != c.lower() and 1 < len(v) <= 3 and v.isascii() and v.isalnum() and code < 0x2190 or 0xFB00 <= code <= 0xFB06:
            more.append((c, v))
    return "".join(c for c, _ in one), "".join(v for _, v in one), tuple(more)


#: Characters that a value may change beyond their case: all but those of plain Latin texts and of composed Vietnamese ones.
_ODD = r"[\u00A0\u00A8\u00AA\u00AF\u00B2-\u00B5\u00B8-\u00BA\u00BC-\u00BE\u00DF\u0130-\u0149\u017F\u01C4-\u01CC\u01F1-\u01F3\u0250-\u1E9F\u1F00-\uFFFF]"


def value(text: Column) -> Column:
    """exact_value in the JVM, for texts in composed form: compatibility characters of the basic plane by a table, lower
    case, white space collapsed. Only texts that hold such a character pay for it; characters with values of over three
    letters keep their form."""
    one, values, more = _value_tables()
    wide = F.translate(text, one, values)
    for c, v in more:
        wide = F.replace(wide, F.lit(c), F.lit(v))
    return collapse(F.lower(F.when(text.rlike(_ODD), wide).otherwise(text)))


def folded_words(text: Column) -> Column:
    """Folded text with white space collapsed."""
    return collapse(fold(text))


def rag_tokens(text: Column) -> Column:
    """Distinct runs of three or more of a-z 0-9 + # . in the folded text."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("[a-z0-9+#.]{3,}"), F.lit(0)))


#: Words that lexical overlap leaves out (fixed value). Accented ones never match a folded token.
STOP_WORDS = (
    "and the with for from that this you your our are will các và cho của với trong được một những ứng viên công việc yêu cầu mô tả "
    "job candidate experience skill skills"
).split()


def overlap_tokens(text: Column) -> Column:
    """Distinct tokens that begin with a Latin letter and go on with two or more of letters, digits and _ + # . -, without stop words."""
    found = F.regexp_extract_all(fold(text), F.lit(r"(?U)[a-zA-ZÀ-ỹ][\w+#.-]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


#: VIETNAMESE as a class that tells Latin letters by one lookup, as SPACE.
_VIETNAMESE = "".join(c for c in VIETNAMESE if c < "\u0100") + r"[\u0100-\u1eff&&[" + "".join(c for c in VIETNAMESE if c >= "\u0100") + "]]"


def detected_language(text: Column) -> Column:
    """vi if a Vietnamese letter occurs, else en; null for a text without letters."""
    return F.when(text.rlike(r"\p{L}"), F.when(text.rlike(f"[{_VIETNAMESE}]"), "vi").otherwise("en"))


CONTACT_MARKS = ("@", "gmail", "github.com/", "linkedin.com/", "facebook.com/")


def is_contact_line(text: Column) -> Column:
    """A line with a Vietnamese telephone number or a mark of an address."""

    def marked(low: Column) -> Column:
        out = low.contains(CONTACT_MARKS[0])
        for mark in CONTACT_MARKS[1:]:
            out = out | low.contains(mark)
        return out

    # the first sign alone sets most places aside
    return text.rlike(r"(?U)(?=[+80])(?<!\d)(?:\+?84|0)[\d\s().-]{7,18}(?!\d)") | F.transform(F.array(F.lower(text)), marked)[0]


def round1(number: Column) -> Column:
    """One decimal, halves to even, as reports round."""
    return F.bround(number, 1)


def clamp(number: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high)))


def participant_code(text: Column) -> Column:
    return F.left(strip(text), F.lit(80))


def file_stem(text: Column) -> Column:
    """A safe file name: other characters as one underscore, 60 characters at most, cv if nothing is left."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit(60)), F.lit("")), F.lit("cv"))


def identifier_hash(secret: str, identifier: Column) -> Column:
    return F.sha2(F.concat(F.lit(secret), identifier), 256)


def percent(number: Column) -> Column:
    return F.format_string("%.2f%%", number * 100)


def n_words(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)))


def has_words(text: Column, least: int) -> Column:
    """Whether a text has so many words or more; no more of it is read."""
    return text.rlike(f"^[{SPACE}]*(?:[^{SPACE}]++[{SPACE}]++){{{least - 1}}}[^{SPACE}]")


def replaced(text: Column, pattern: str, by) -> Column:
    """text with each match m of a pattern as by(m): the pieces between matches and what became of the matches, in turn."""

    def build(x: Column) -> Column:
        pieces, hits = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        ends = F.concat(F.transform(hits, by), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(pieces, ends, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        return F.when(x.rlike(pattern), joined).otherwise(x)

    return F.transform(F.array(text), build)[0]  # a lambda's variable is evaluated once

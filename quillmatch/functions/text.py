"""Text functions of the matcher, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never identify a question, as the matching results depend on them.
STOP_WORDS = (
    "a an the of and or to in on for with is are was were be been being which who whom whose what when where why how that this these those it its "
    "as at by from not no yes can will would should could may might must have has had do does did about into over under between within both each other than "
    "then there here them they their you your we our i me my he him his her hers us if so such only also more most least less very just than too again "
    "further once because while during before after above below up down out off s t "
    "और का की के में पर से को है हैं हो एक यह यह वह इसके उनकी उसके लिए साथ तक भी नहीं बहुत सबसे कौन सा कौन कि जो तो या को constructor"
).split(" ")
# Words that a phrase for verbatim search leaves out.
STEM_SKIP = (
    "a an the of and or to in on for with is are was were be been being which who what when where how that this these those it as at by from not no can "
    "will should may must have has had do does about into between within each other than then there here they you we i me my he her us s t "
    "उत्तर प्रश्न कौन क्या में से है हैं का की के"
).split(" ")
# Characters that one spelling replaces, and the blanks that count as white space.
CURLY, STRAIGHT = "‘’‛“”", "'''\"\""
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DEVANAGARI, LATIN = "[\u0900-\u097f]", "[A-Za-z]"
MARKS = "[✓✔✅√●⦿⬤]"


def plain_blanks(text: Column) -> Column:
    """Every blank as a space."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def normalize(text: Column, keep_marks: bool = False) -> Column:
    """Lower case, without printed numbers and without anything but letters, digits and single spaces.

    Numbers go wherever they stand before ) . or :, so 3.14 leaves 14. Combining marks go too unless keep_marks.
    """
    kept = r"[^\p{L}\p{N}\p{M}\s]" if keep_marks else r"[^\p{L}\p{N}\s]"
    out = F.regexp_replace(plain_blanks(F.lower(F.coalesce(text, F.lit("")))), r"\(?\s*[0-9]{1,3}\s*[).:]\s*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, kept, " "), r"\s+", " "))


def tokens(text: Column, keep_marks: bool = False) -> Column:
    """Words of two characters or more that are no stop words, in order, repeats included."""
    return F.filter(F.split(normalize(text, keep_marks), " "), lambda w: (F.length(w) >= 2) & ~w.isin(list(dict.fromkeys(STOP_WORDS))))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the normalised text without its spaces."""
    tight = F.replace(normalize(text), F.lit(" "), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(tight) - 1, F.lit(1))), lambda i: F.substring(tight, i, F.lit(2)))
    return F.when(F.length(tight) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def overlap(a: Column, b: Column) -> Column:
    """Common share of the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(F.least(F.size(a), F.size(b)) > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def tidy_lines(text: Column) -> Column:
    """Straight quotes, ASCII digits, single spaces and trimmed lines; blank lines stay."""
    out = F.translate(F.coalesce(text, F.lit("")), CURLY + DIGITS + "\r", STRAIGHT + "0123456789" * 3)
    lines = F.transform(F.split(plain_blanks(F.translate(out, "\t", " ")), "\n"), lambda x: F.trim(F.regexp_replace(x, " {2,}", " ")))
    return F.array_join(lines, "\n")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def latin_share(text: Column) -> Column:
    latin, both = count_of(text, LATIN), count_of(text, LATIN) + count_of(text, DEVANAGARI)
    return F.when(both > 0, latin / both).otherwise(F.lit(0.0))


def script(text: Column) -> Column:
    return F.when(count_of(text, DEVANAGARI) > count_of(text, LATIN), "hi").otherwise("en")


def has_hindi(text: Column) -> Column:
    """Whether a page carries Hindi at all: eight Devanagari characters or more."""
    return count_of(text, DEVANAGARI) >= 8


def hindi_badness(text: Column) -> Column:
    """Share of Devanagari words that begin with a dependent sign or are one lone consonant; null where there is too little to tell."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[ऀ-ॿ]+"), F.lit(0))
    bad = F.filter(
        words,
        lambda w: w.rlike(r"^[ँ-ः़ऽा-ॏ॑-ॗ]") | ((F.length(w) == 1) & ~w.rlike(r"^[ऄ-औॐ०-९]")),
    )
    enough = (count_of(text, DEVANAGARI) >= 40) & (F.size(words) >= 20)
    return F.when(enough, F.size(bad) / F.size(words))


def join_devanagari(text: Column) -> Column:
    """Clusters that were split at the halant, and hu-verbs split from their last vowel, as one word again."""
    out = F.regexp_replace(text, r"(?<=[क-ह]्)\s+(?=[क-ह])", "")
    return F.regexp_replace(out, r"(^|[^ऀ-ॿ])(हु)\s+([एआई])(?![क-हा-्])", "$1$2$3")


def options_line(line: Column) -> Column:
    """Whether a line lists options by number: two marks, or a short line that begins with one."""
    hits = F.regexp_count(line, F.lit(r"\(\s*[0-9]{1,3}\s*\)|\b[0-9]{1,3}\s*[)]"))
    return (hits >= 2) | ((hits >= 1) & line.rlike(r"^\s*[(\[]?[0-9]{1,3}[)\]]?\s+\S") & (F.length(line) < 90))


def marked_answer(blob: Column) -> Column:
    """The letter, or else the number in brackets, that stands before a tick or filled mark; empty if none."""
    letter = F.upper(F.regexp_extract(blob, r"([A-Ha-h])\s*[).:]\s*" + MARKS, 1))
    number = F.regexp_extract(blob, r"\(\s*([0-9]{1,2})\s*\)\s*" + MARKS, 1)
    return F.when(letter != "", letter).otherwise(number)


def stems(normal: Column, length: int = 3, most: int = 10) -> Column:
    """The first phrases of neighbouring content words."""
    words = F.filter(F.split(normal, " "), lambda w: (F.length(w) > 2) & ~w.isin(list(dict.fromkeys(STEM_SKIP))) & ~w.rlike("^[0-9]+$"))
    count = F.least(F.size(words) - length + 1, F.lit(most))
    made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, length), " "))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def without_number(text: Column) -> Column:
    """The text without a question number before it."""
    return F.trim(F.regexp_replace(text, r"^\s*[0-9]{1,3}\s*[).:\-]\s*", ""))


def untable(text: Column) -> Column:
    """Markdown table rows as `number - answer`; rules between rows become empty lines."""

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_extract(line, r"^\s*\|(.+)\|\s*$", 1), r"\|"), lambda c: F.trim(c))
        made = F.concat(F.get(cells, 0), F.lit(" - "), F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), " "))
        return (
            F.when(~line.rlike(r"^\s*\|(.+)\|\s*$") | (F.size(cells) < 2), line)
            .when(F.forall(cells, lambda c: c.rlike("^:?-{2,}:?$")), "")
            .when(~F.get(cells, 0).rlike("^[0-9]{1,3}$"), line)
            .otherwise(made)
        )

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), row), "\n")


def preview(text: Column, most: int = 90) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def letter_of(number: Column) -> Column:
    """1 to 8 as A to H; null beyond."""
    return F.when(number.between(1, 8), F.char(64 + number))


def version_key(name: Column, pattern: str = r"([0-9]+)") -> Column:
    """The numbers of a name as an array, which sorts number by number, and of two that begin alike the shorter first; null for a null name.

    The pattern's first group tells a number; numbers of more than nine digits count as the greatest of nine.
    """
    return F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) > 9, 999_999_999).otherwise(x.try_cast("int")))

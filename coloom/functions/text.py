"""Column expressions that pull structure out of case-report text.

Everything here is a built-in expression, so extraction stays inside one
narrow stage: no Python worker, no shuffle.  Keywords are found by plain substring
search, which is cheaper than a regular expression and also sees words that
overlap.  Digits are written out because full-width ones are accepted too and
folded to ASCII before casting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from coloom.functions import vocab

DIGIT = "[0-9０-９]"
# The characters Unicode counts as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# One alternation with an optional year keeps the mentions in text order and
# reads a full date once.  The tail is a range: a bare second number is a day,
# and one followed by 月 is a month.
DATE_MENTION = (
    f"(?:({DIGIT}{{4}})年)?({DIGIT}{{1,2}})月({DIGIT}{{1,2}})日"
    f"(?:[至\\-—~](?:({DIGIT}{{1,2}})月)?({DIGIT}{{1,2}})日?(?![0-9０-９月]))?"
)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.trim(text, F.lit(SPACES))


def prefix(text: Column, n: int | None) -> Column:
    """The first ``n`` characters, or the whole text without ``n``."""
    return text if n is None else F.substring(text, 1, n)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    expr = text.contains(words[0])
    for w in words[1:]:
        expr = expr | text.contains(w)
    return expr


def first_number(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, as INT; NULL if none does."""
    return F.coalesce(
        *[
            ascii_digits(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))).try_cast("int")
            for p in patterns
        ]
    )


def keyword_classes(text: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """Sorted array of the classes with at least one keyword in ``text``."""
    hits = [F.when(contains_any(text, words), F.lit(name)) for name, words in classes.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def venue_types(text: Column, venues: Mapping[str, Sequence[str]] = vocab.VENUES) -> Column:
    return keyword_classes(text, venues)


def transport_codes(text: Column, words: Mapping[str, str] = vocab.TRANSPORTS) -> Column:
    by_code: dict[str, list[str]] = {}
    for word, code in words.items():
        by_code.setdefault(code, []).append(word)
    return keyword_classes(text, by_code)


def symptom_terms(text: Column, terms: Sequence[str] = vocab.SYMPTOMS) -> Column:
    return keyword_classes(text, {t: [t] for t in terms})


def symptom_classes(
    text: Column, classes: Mapping[str, Sequence[str]] = vocab.STAT_SYMPTOMS
) -> Column:
    return keyword_classes(text, classes)


def event_type(
    text: Column,
    cascade: Sequence[tuple[int, Sequence[str]]] = tuple(vocab.EVENT_CASCADE),
    other: int = vocab.EVENT_OTHER,
) -> Column:
    """Class of the first keyword list that hits; list order is the priority."""
    expr = None
    for code, words in cascade:
        hit = contains_any(text, words)
        expr = F.when(hit, F.lit(code)) if expr is None else expr.when(hit, F.lit(code))
    return expr.otherwise(F.lit(other)).cast("int")


def sentences(text: Column, terminators: str = vocab.TERMINATORS, min_chars: int = 3) -> Column:
    """Terminated sentences, stripped; an unterminated tail is not a sentence.

    The text is cut after every terminator, which is several times cheaper than
    collecting matches.
    """
    parts = F.split(text, f"(?<=[{terminators}])")
    whole = F.filter(
        parts, lambda s: F.right(s, F.lit(1)).isin(list(terminators)) & (F.length(s) > 1)
    )
    return F.filter(F.transform(whole, strip), lambda s: F.length(s) >= min_chars)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(ascii_digits(F.concat_ws("-", year, month, day)), "y-M-d")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, or null."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(month.between(1, 12) & (day > 0) & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def date_mentions(text: Column, year: int = vocab.DEFAULT_YEAR) -> Column:
    """Dates in text order; a range gives its first and last day.

    A date without a year gets ``year``.  A mention with an impossible calendar
    date is dropped.  A single date is listed once.
    """

    def number(digits: Column) -> Column:
        return F.coalesce(digits.try_cast("int"), ascii_digits(digits).try_cast("int"))

    def parts(mention: Column) -> Column:
        # As the pattern has it: [y年]m月d日, then maybe a mark and [m月]d[日].
        first = F.substring_index(mention, "日", 1)
        last = F.substring_index(F.substr(mention, F.length(first) + 3), "日", 1)
        months = F.substring_index(first, "月", 1)
        return F.struct(
            F.when(months.contains("年"), number(F.substring_index(months, "年", 1))).otherwise(F.lit(year)).alias("y"),
            number(F.substring_index(months, "年", -1)).alias("m"),
            number(F.substring_index(first, "月", -1)).alias("d"),
            F.when(last.contains("月"), number(F.substring_index(last, "月", 1))).alias("m2"),
            F.when(last != "", number(F.substring_index(last, "月", -1))).alias("d2"),
        )

    def read(p: Column) -> Column:
        start = _date(p["y"], p["m"], p["d"])
        end = _date(p["y"], F.coalesce(p["m2"], p["m"]), p["d2"])
        return F.when(p["d2"].isNull(), F.array(start)).otherwise(F.array(start, end))

    found = F.transform(F.regexp_extract_all(text, F.lit(DATE_MENTION), F.lit(0)), parts)
    whole = F.filter(F.transform(found, read), lambda ds: ~F.exists(ds, lambda d: d.isNull()))
    return F.when(text.contains("月"), F.flatten(whole)).otherwise(F.array().cast("array<date>"))


def all_dates(text: Column, year: int = vocab.DEFAULT_YEAR, as_coded: bool = False) -> Column:
    """Every date of a case text, duplicates kept, range ends not included.

    ``as_coded=True`` counts a date with a year twice: once under ``year`` and
    once under its own, which is how the published record counts came about.
    """
    short = f"({DIGIT}{{1,2}})月({DIGIT}{{1,2}})日"
    full = f"({DIGIT}{{4}})年({DIGIT}{{1,2}})月({DIGIT}{{1,2}})日"
    if as_coded:
        shorts = F.transform(
            F.regexp_extract_all(text, F.lit(short), F.lit(0)),
            lambda m: _ymd(
                F.lit(str(year)), F.regexp_extract(m, short, 1), F.regexp_extract(m, short, 2)
            ),
        )
        fulls = F.transform(
            F.regexp_extract_all(text, F.lit(full), F.lit(0)),
            lambda m: _ymd(
                F.regexp_extract(m, full, 1),
                F.regexp_extract(m, full, 2),
                F.regexp_extract(m, full, 3),
            ),
        )
        return F.array_compact(F.concat(shorts, fulls))
    either = f"(?:({DIGIT}{{4}})年)?{short}"
    return F.array_compact(
        F.transform(
            F.regexp_extract_all(text, F.lit(either), F.lit(0)),
            lambda m: _ymd(
                F.coalesce(
                    F.nullif(F.regexp_extract(m, either, 1), F.lit("")), F.lit(str(year))
                ),
                F.regexp_extract(m, either, 2),
                F.regexp_extract(m, either, 3),
            ),
        )
    )


# -- case attributes ----------------------------------------------------------


def case_number(text: Column, chars: int | None = None) -> Column:
    """Case number, four patterns in turn; ``chars`` looks at the start only."""
    head = prefix(text, chars)
    patterns = [
        f"第({DIGIT}+)号确诊病例",
        f"第({DIGIT}+)号",
        f"病例({DIGIT}+)",
        f"确诊({DIGIT}+)",
    ]
    return F.coalesce(
        *[ascii_digits(F.nullif(F.regexp_extract(head, p, 1), F.lit(""))) for p in patterns]
    )


def age(text: Column, chars: int | None = None) -> Column:
    return first_number(prefix(text, chars), [f"(?U)({DIGIT}+)\\s*岁"])


def age_statistics(text: Column, chars: int | None = None) -> Column:
    return first_number(
        prefix(text, chars), [f"({DIGIT}+)岁", f"年龄({DIGIT}+)", f"约({DIGIT}+)岁"]
    )


def gender(text: Column, male: str = "M", female: str = "F", chars: int | None = None) -> Column:
    """By the word that comes first in the text.

    With ``chars``, as published: from the start only, where the male word wins
    when both occur.
    """
    if chars is not None:
        head = prefix(text, chars)
        return F.when(head.contains("男"), male).when(head.contains("女"), female)
    m, f = F.instr(text, "男"), F.instr(text, "女")
    return F.when((m > 0) & ((f == 0) | (m < f)), male).when(f > 0, female)


def hotspot_flag(text: Column, words: Sequence[str] = tuple(vocab.HOTSPOT_WORDS)) -> Column:
    return contains_any(text, words)


def asymptomatic_flag(
    text: Column, words: Sequence[str] = tuple(vocab.ASYMPTOMATIC_WORDS)
) -> Column:
    return contains_any(text, words)


# -- labels -------------------------------------------------------------------


def province_label(name: Column, labels: Mapping[str, str] = vocab.PROVINCE_EN, chars: int | None = None) -> Column:
    """English name of the first known province in ``name``; else the remainder, or its start."""
    expr = F.when(name.isNull() | (name == ""), F.lit("Unknown"))
    for cn, en in labels.items():
        expr = expr.when(name.contains(cn), F.lit(en))
    rest = prefix(strip(F.regexp_replace(name, "省|市|自治区|确诊.*", "")), chars)
    return expr.otherwise(F.coalesce(F.nullif(rest, F.lit("")), F.lit("Unknown")))


def venue_label(name: Column, labels: Mapping[str, str] = vocab.VENUE_EN, chars: int | None = None) -> Column:
    expr = F.when(name.isin(list(labels.values())), name)
    for cn, en in labels.items():
        expr = expr.when(name == cn, F.lit(en))
    return expr.otherwise(prefix(name, chars))

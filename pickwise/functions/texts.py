"""Column functions over text: normal forms, tokens, titles, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading articles of sort titles.
ARTICLES = ("the", "a", "an")


def normalise(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space to a space, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def compact(text: Column) -> Column:
    return F.replace(normalise(text), F.lit(" "), F.lit(""))


def sort_key(title: Column, articles: tuple[str, ...] = ARTICLES) -> Column:
    """The title without a leading article, whatever its case."""
    return F.regexp_replace(title, rf"^(?i:{'|'.join(sorted(articles, key=len, reverse=True))}) ", "")


def sort_title(title: Column, articles: tuple[str, ...] = ARTICLES) -> Column:
    """The leading article moved behind: "The Night" -> "Night, The"."""
    pattern = rf"^((?i:{'|'.join(sorted(articles, key=len, reverse=True))})) (.*)$"
    return F.regexp_replace(title, pattern, "$2, $1")


def significant(word: Column) -> Column:
    return (F.length(word) >= 4) & ~word.rlike(r"^[0-9]+$")


def subsequence(letters: Column, text: Column) -> Column:
    """Whether the letters stand in the text in this order, with anything between; no letters: they do not."""
    found = lambda at, ch: F.call_function("locate", ch, text, at)  # noqa: E731  0: not found; from a place of 0, never
    step = lambda at, ch: F.when(found(at, ch) > 0, found(at, ch) + 1).otherwise(F.lit(0)).cast("int")
    signs = F.filter(F.split(letters, ""), lambda ch: ch != "")
    return (F.length(letters) > 0) & (F.aggregate(signs, F.lit(1), step) > 0)


def reason_base(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


# What is blotted out, in this order; group 1 stays.
SECRETS = (
    r"(?i)(\bauthorization\s*:\s*bearer\s+)[^\s,;]{1,512}",
    r"(?i)(\b(?:x-api-key|api-key|x-auth-token)\s*:\s*)[^\s,;]{1,512}",
    r"(?i)(\b[a-z][a-z0-9+.-]*://)[^/@\s]{1,512}@",
    r"(?i)(\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|callback[_-]?token|password|passwd|secret|token)\s*[=:]\s*)[^\s&;,]{1,512}",
)
MARKER = "[REDACTED]"


def redact(text: Column, known: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The text with secrets blotted out, and how many there were: known values first, the longest before its parts, then
    bearer tokens, secret headers, names in addresses and values of telling names."""
    n = F.lit(0)
    for value in sorted({v for v in known if v}, key=lambda v: (-len(v), v)):
        n = n + (F.length(text) - F.length(F.replace(text, F.lit(value), F.lit("")))) / len(value)
        text = F.replace(text, F.lit(value), F.lit(MARKER))
    for pattern in SECRETS:
        n = n + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, "$1" + MARKER + ("@" if pattern.endswith("@") else ""))
    return text, F.coalesce(n.cast("long"), F.lit(0))


def parse_title(filename: Column) -> tuple[Column, Column, Column]:
    """title, year, copy number of names like "Some Film (1999) 2.jpg"; null where the name has another form."""
    pattern = r"^(.+?) \((\d{4})\)(?:[ _-]*\(?(\d+)\)?)?\.[A-Za-z0-9]+$"
    part = lambda k: F.nullif(F.regexp_extract(filename, pattern, k), F.lit(""))
    return part(1), part(2).cast("int"), part(3).cast("int")


def parse_resolution(text: Column) -> tuple[Column, Column]:
    """width and height of texts like "1920x1080"; null where it is no such text."""
    p = F.split(F.lower(text), "x")
    part = lambda i: F.when((F.size(p) == 2) & p[i].rlike("^[0-9]+$"), p[i].try_cast("int"))
    return part(0), part(1)


def container(path: Column) -> Column:
    """A file's kind by its ending, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)), F.lit(""))


# Number words, and the words that stand before a season's number.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ODD_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
DESIGNATORS = ("season", "book", "part", "chapter", "volume", "vol")
LAST_SEASONS = ("final season", "last season", "the final season", "the last season")
ROMAN = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")


def number_words(number: int) -> list[str]:
    """The English words of 0 to 999."""
    hundreds, rest = divmod(number, 100)
    head = [ONES[hundreds], "hundred"] if hundreds else []
    if rest >= 20:
        return [*head, TENS[rest // 10 - 2], *([ONES[rest % 10]] if rest % 10 else [])]
    return [*head, *([ONES[rest]] if rest or not hundreds else [])]


def season_forms(number: int) -> list[str]:
    """The ways a number stands in a season's name: digits, ordinal digits, words, ordinal words, Roman digits; words to 999, Roman digits to 3999."""
    ending = "th" if number % 100 in range(10, 21) else {1: "st", 2: "nd", 3: "rd"}.get(number % 10, "th")
    forms = [str(number), f"{number}{ending}"]
    if 0 <= number <= 999:
        *head, tail = number_words(number)
        ordinal = ODD_ORDINALS.get(tail, f"{tail[:-1]}ieth" if tail in TENS else f"{tail}th")
        forms += [" ".join([*head, tail]), " ".join([*head, ordinal])]
    if 0 < number <= 3999:
        digits = [int(d) for d in f"{number:04d}"]
        forms.append("".join(ROMAN[d].translate(str.maketrans("ivx", signs)) for d, signs in zip(digits, ("m??", "cdm", "xlc", "ivx"), strict=True)))
    return forms


def says(text: Column, phrases: list[str]) -> Column:
    """Whether the text is one of these phrases, spaces set aside."""
    return F.coalesce(compact(text).isin(*sorted({p.replace(" ", "") for p in phrases})), F.lit(False))


def season_text(text: Column, number: int) -> Column:
    """Whether the whole text names that season, or the last one; nulls do not."""
    forms = season_forms(number)
    phrases = [f"{d} {f}" for d in DESIGNATORS for f in forms] + [f"{f} season" for f in forms] + [f"s{number}", f"s{number:02d}"]
    return says(text, phrases) | F.coalesce(normalise(text).isin(*LAST_SEASONS), F.lit(False))


def season_edition(text: Column, number: int) -> Column:
    """Whether the whole text names that season's complete edition."""
    forms = season_forms(number)
    return says(text, [f"{the}complete {x}" for the in ("", "the ") for f in forms for x in (f"{f} season", f"season {f}")])


def parse_tv_name(filename: Column) -> tuple[Column, Column]:
    """title and season of artwork names of series: "Name-show.jpg" has no season, "Name-season02.jpg" has; null where the name has another form."""
    pattern = r"^(.+?)-(?:show|season(\d+))\.[A-Za-z0-9]+$"
    part = lambda k: F.nullif(F.regexp_extract(filename, pattern, k), F.lit(""))
    return part(1), part(2).try_cast("int")


def escape_like(text: str) -> str:
    """A search text with LIKE's own signs escaped by a backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")

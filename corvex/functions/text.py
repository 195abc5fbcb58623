"""Text expressions. All are built-in column functions; white space and letters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it, in the syntax that Java and RE2 share.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"

# Words that keyword search leaves out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might shall this that these those it its i you we he she they not no can also as if"
).split()

# Phrases of a generated answer that declines, and those that the evaluation counts.
ANSWER_DECLINES = ["couldn't find that", "not in the documentation", "not covered in the documentation", "cannot find that", "no information about", "not mentioned in the documentation"]
SCORED_DECLINES = ["couldn't find", "not in the documentation", "not covered", "cannot find", "no response", "fin_not_configured", "don't have information"]


def let(c: Column, f) -> Column:
    """f of c, which is computed once: what a lambda function names from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, WS), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def tokens(c: Column) -> Column:
    """Keyword tokens: camelCase broken, lower case, split at other than word characters and hyphens.

    A hyphenated word gives its parts and then itself; hyphens at the ends go; stop-words and
    single characters are dropped last.
    """
    broken = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    raw = F.split(F.lower(broken), r"[^\p{L}\p{N}_\-]+")
    parts = F.flatten(F.transform(raw, lambda t: F.when(F.contains(t, F.lit("-")), F.array_append(F.split(t, "-"), t)).otherwise(F.array(t))))
    bare = F.when(F.contains(c, F.lit("-")), F.transform(parts, lambda t: F.btrim(t, F.lit("-")))).otherwise(raw)  # most texts have none
    return F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def slug(c: Column, empty: str) -> Column:
    """Lower case, every run of other than a-z0-9 one hyphen, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", empty).otherwise(s)


def identifier(c: Column) -> Column:
    """Letters and digits of any script in lower case, runs of others one hyphen, never a digit first."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "default").when(F.substring(s, 1, 1).rlike(r"\p{N}"), F.concat(F.lit("item-"), s)).otherwise(s)


def preview(c: Column, n: int = 100) -> Column:
    """The first n characters, and three dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def says_any(c: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases is in the text, whatever its case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def question(c: Column) -> Column:
    """Quotes off the ends of a stripped reply, and a question mark at its end."""
    bare = F.btrim(strip(c), F.lit('"'))
    return F.when(F.endswith(bare, F.lit("?")), bare).otherwise(F.concat(bare, F.lit("?")))


def flat_json(c: Column) -> Column:
    """The first {...} without braces inside."""
    return F.regexp_extract(c, r"(?s)\{[^{}]*\}", 0)


def first_array(c: Column) -> Column:
    """The shortest [...] from the first bracket on."""
    return F.regexp_extract(c, r"(?s)\[.*?\]", 0)


def widest_array(c: Column) -> Column:
    """From the first [ to the last ]."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def secure_filename(c: Column) -> Column:
    """A file's name without folders: white space to underscores, other than A-Za-z0-9_.- dropped, no dots or underscores at the ends."""
    s = F.regexp_replace(c, r"[/\\]", " ")
    s = F.regexp_replace(strip(s), WS, "_")
    return F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9_.\-]", ""), r"^[._]+|[._]+$", "")


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def crawl_progress(done: Column, at_most: Column) -> Column:
    share = F.lit(0.05) + done.cast("double") / F.greatest(at_most, F.lit(1)) * F.lit(0.35)
    return F.round(F.least(share, F.lit(0.40)), 2)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def base64(c: Column) -> Column:
    """On one line: the built-in function breaks lines."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))

"""Text column functions (all JVM-side expressions, no Python per row)."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern of a default bag-of-words vectorizer (two or
# more word characters), written with Unicode classes so that Java and RE2
# regexes agree.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Inline markup that may appear inside Medline titles and
# abstracts and is dropped (the text between the tags is kept).
INLINE_TAGS = ("i", "b", "u", "sup", "sub", "DispFormula")
INLINE_MARKUP_PATTERN = r"</?(?:i|b|u|sup|sub|DispFormula|mml:[A-Za-z]+)(?:\s[^<>]*)?/?>"

HREF_PATTERN = r'href="(.+?)"'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    text = resources.files("topicscope.resources").joinpath("stopwords_en.txt").read_text(encoding="utf-8")
    return tuple(w.strip() for w in text.splitlines() if w.strip() and not w.startswith("#"))


def stop_word_list(stop_words: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    if stop_words is None:
        return ()
    if isinstance(stop_words, str):
        if stop_words != "english":
            raise ValueError(f"unknown stop word list {stop_words!r}")
        return english_stop_words()
    return tuple(stop_words)


def combine_text(
    title: Column | str,
    abstract: Column | str,
    keywords_major: Column | str,
    keywords_minor: Column | str,
    include_title: bool = True,
    include_abstract: bool = True,
    include_keywords_major: bool = False,
    include_keywords_minor: bool = False,
) -> Column:
    """``title + ' ' + abstract + ' ' + majors + ' ' + minors``; excluded parts are
    empty strings, so there are always three separators."""
    empty = F.lit("")
    parts = [
        F.coalesce(_c(title), empty) if include_title else empty,
        F.coalesce(_c(abstract), empty) if include_abstract else empty,
        F.coalesce(F.array_join(_c(keywords_major), " "), empty) if include_keywords_major else empty,
        F.coalesce(F.array_join(_c(keywords_minor), " "), empty) if include_keywords_minor else empty,
    ]
    return F.concat_ws(" ", *parts)


def strip_inline_markup(text: Column | str) -> Column:
    """Drop inline tags (italic, bold, sub/superscript, MathML, formulas), trim."""
    return F.trim(F.regexp_replace(_c(text), INLINE_MARKUP_PATTERN, ""))


def tokenize(text: Column | str) -> Column:
    """Lower-cased tokens of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def remove_stop_words(tokens: Column | str, stop_words) -> Column:
    words = stop_word_list(stop_words)
    if not words:
        return _c(tokens)
    # IN with a literal list becomes a hash-set lookup (InSet) after optimisation
    return F.filter(_c(tokens), lambda t: ~t.isin(list(words)))


def ngrams(tokens: Column | str, lo: int = 1, hi: int = 1) -> Column:
    """All n-grams for n in [lo, hi], words joined by a space; grouped by n, then
    by position (the order a bag-of-words analyzer emits them).

    ``tokens`` should be a column reference: the lambda reads it once per
    n-gram, and an unmaterialised expression would be recomputed each time.
    """
    if lo < 1 or hi < lo:
        raise ValueError(f"invalid n-gram range ({lo}, {hi})")
    t = _c(tokens)
    pieces = []
    for n in range(lo, hi + 1):
        if n == 1:
            pieces.append(t)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), _gram_of(t, n))
        pieces.append(F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def _gram_of(t: Column, n: int):
    # a one-argument lambda (a second argument would be bound to the index)
    return lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")


def extract_hrefs(html: Column | str) -> Column:
    """Every ``href="..."`` target in a directory-listing page."""
    return F.regexp_extract_all(_c(html), F.lit(HREF_PATTERN), 1)


def file_stem(path: Column | str) -> Column:
    """Base name up to its first dot (``a/b/pubmed23n0001.xml.gz`` -> ``pubmed23n0001``)."""
    return F.substring_index(F.element_at(F.split(_c(path), "/"), -1), ".", 1)


def split_flagged(keywords: Column | str, flag_field: str = "flag", value_field: str = "value") -> tuple[Column, Column]:
    """(major, minor) keyword texts: major when the flag is ``Y``; an absent flag
    counts as minor; NULL texts are dropped."""
    kw = F.coalesce(_c(keywords), F.array())
    major = F.transform(
        F.filter(kw, lambda k: (k[flag_field] == "Y") & k[value_field].isNotNull()), lambda k: k[value_field]
    )
    minor = F.transform(
        F.filter(kw, lambda k: (F.coalesce(k[flag_field], F.lit("N")) != "Y") & k[value_field].isNotNull()),
        lambda k: k[value_field],
    )
    return major, minor

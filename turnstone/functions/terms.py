"""Search terms: tokens, their stems and grams, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.rules import TermRules
from turnstone.functions.text import nfkc, replace_all


def normalise(text: Column, rules: TermRules) -> Column:
    return replace_all(F.lower(nfkc(text) if rules.nfkc else text), rules.compounds)


def tokens(text: Column, rules: TermRules) -> Column:
    return F.regexp_extract_all(text, F.lit(rules.token_pattern), F.lit(0))


def _stems(token: Column, rules: TermRules) -> Column:
    """The token, and what is left of it without the first listed suffix that it ends in, if that is long enough."""
    if not rules.suffixes:
        return F.array(token)
    suffix = F.lit(None).cast("string")
    for s in reversed(rules.suffixes):
        suffix = F.when(F.endswith(token, F.lit(s)), F.lit(s)).otherwise(suffix)
    root = F.left(token, F.length(token) - F.length(suffix))
    # the class is tested last: few tokens come so far
    long_enough = suffix.isNotNull() & (F.length(root) >= rules.min_root) & token.rlike(f"^(?:{rules.stem_class})$")
    return F.when(long_enough, F.array(token, root)).otherwise(F.array(token))


def variants(text: Column, rules: TermRules) -> Column:
    """Distinct tokens and stems; stop words are dropped as tokens, not as stems."""
    found = F.array_distinct(tokens(normalise(text, rules), rules))
    if rules.stopwords:
        found = F.array_except(found, F.array(*map(F.lit, rules.stopwords)))
    return F.array_distinct(F.flatten(F.transform(found, lambda t: _stems(t, rules))))


def exact_of(found: Column) -> Column:
    return F.transform(found, lambda v: F.concat(F.lit("w"), v))


def grams_of(found: Column, rules: TermRules) -> Column:
    if not rules.ngrams:
        return F.array().cast("array<string>")
    letters = F.filter(found, lambda v: v.rlike(f"^(?:{rules.stem_class})$"))

    def grams(width: int, mark: str) -> Column:
        enough = F.filter(letters, lambda v: F.length(v) >= width)
        return F.flatten(F.transform(enough, lambda v: F.transform(F.sequence(F.lit(1), F.length(v) - (width - 1)), lambda k: F.concat(F.lit(mark), F.substring(v, k, F.lit(width))))))

    return F.array_distinct(F.concat(grams(2, "b"), grams(3, "t")))


def search_terms(text: Column, rules: TermRules = TermRules()) -> Column:
    """struct(exact, ngram): sorted distinct terms."""
    found = variants(text, rules)
    return F.struct(F.sort_array(exact_of(found)).alias("exact"), F.sort_array(grams_of(found, rules)).alias("ngram"))


def term_set(text: Column, rules: TermRules = TermRules()) -> Column:
    """All terms of a text in one array."""
    found = variants(text, rules)
    return F.array_union(exact_of(found), grams_of(found, rules))


def ablations(text: Column, rules: TermRules = TermRules()) -> Column:
    """Queries that lack one token of the raw text each: distinct, in order, none without terms."""
    raw = tokens(text, rules)
    n = F.size(raw)
    all_but = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.concat(F.slice(raw, F.lit(1), k - 1), F.slice(raw, k + 1, n)), " "))
    found = F.array_distinct(F.when(n > 0, all_but).otherwise(F.array().cast("array<string>")))
    # without NFKC here: a token that is one before it is one after it
    plain = TermRules(**{**rules.__dict__, "nfkc": False})
    return F.filter(found, lambda q: (F.length(q) > 0) & (F.size(variants(q, plain)) > 0))

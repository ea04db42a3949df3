"""Rule-based tags of chunks, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.rules import TagRules
from turnstone.functions.text import contains_any, nfkc, replace_all


def _canonical(text: Column, rules: TagRules) -> Column:
    return nfkc(text) if rules.nfkc else text


def _spaceless(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def number_pattern(rules: TagRules) -> str:
    return rf"(?U)(?<!\d)(\d{{2,4}})\s*\Q{rules.number_unit}\E"


def _labels(*columns: Column) -> Column:
    """The labels that aren't null, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*columns)))


def _or_default(found: Column, default: str) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def topics(text: Column, rules: TagRules = TagRules()) -> Column:
    """Topics any of whose keywords stand in the text, spaces aside; then the exercise topic."""
    whole = replace_all(_canonical(text, rules), rules.compounds)
    compact = _spaceless(whole)
    listed = [F.when(contains_any(compact, [w.replace(" ", "") for w in words]), F.lit(name)) for name, words in rules.topics]
    exercise = F.when(whole.rlike(number_pattern(rules)) | contains_any(whole, rules.exercise_words), F.lit(rules.exercise_topic))
    return _or_default(_labels(*listed, exercise), rules.default_topic)


def content_types(text: Column, speakers: Column, rules: TagRules = TagRules()) -> Column:
    """Content types by keyword on the raw text; a dialogue has two speakers or more."""
    found = []
    for name, words in rules.content_types:
        test = contains_any(text, words)
        if name == rules.numbered_type:
            test = test | text.rlike(number_pattern(rules))
        found.append(F.when(test, F.lit(name)))
        if name == rules.dialogue_after:
            found.append(F.when(F.size(speakers) >= 2, F.lit(rules.dialogue_type)))
    return _or_default(_labels(*found), rules.default_type)


def terms(text: Column, rules: TagRules = TagRules()) -> Column:
    """Terms of the dictionary that stand in the text, spaces aside, in the order of the dictionary."""
    compact = _spaceless(_canonical(text, rules))
    return _labels(*(F.when(F.contains(compact, F.lit(t.replace(" ", ""))), F.lit(t)) for t in rules.terms))


def question_numbers(text: Column, rules: TagRules = TagRules()) -> Column:
    """Distinct numbers of two to four digits before the unit, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(number_pattern(rules)), F.lit(1)), lambda n: n.cast("int"))))

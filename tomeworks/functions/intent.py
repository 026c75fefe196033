"""Query intent by keyword lists, tried in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.functions.text import contains_any, strip, text_or_empty

IntentWords = Sequence[tuple[str, Sequence[str]]]


def classify_intent(query: Column, words: IntentWords = K.INTENT_WORDS) -> Column:
    text = F.lower(strip(text_or_empty(query)))
    out = F.when(text == "", K.GENERAL_INTENT)
    for intent, keywords in words:
        out = out.when(contains_any(text, keywords), intent)
    return out.otherwise(K.GENERAL_INTENT)


def normalize_intent(upstream: Column, words: IntentWords = K.INTENT_WORDS) -> Column:
    value = F.lower(strip(text_or_empty(upstream)))
    known = [intent for intent, _ in words]
    return F.when(value.isin(known), value).otherwise(K.GENERAL_INTENT)


def resolve_intent(upstream: Column, query: Column, words: IntentWords = K.INTENT_WORDS) -> Column:
    """The upstream intent when it is a known one other than ``general``, else the keyword rules."""
    given = normalize_intent(upstream, words)
    return F.when(given != K.GENERAL_INTENT, given).otherwise(classify_intent(query, words))

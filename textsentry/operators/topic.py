"""Topics by weighted vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog.topics import TOPICS, Topic
from textsentry.functions.text import blank, count_of, let, round4, rx, strip, text_of, word_count

SCORE = "struct<topic:string,score:double,matched_terms:array<string>>"


def _equal(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


class TopicClassifier:
    def __init__(self, topics: Iterable[Topic] | None = None, threshold: float = 0.15):
        self.topics = list(topics or TOPICS)
        self.threshold = threshold
        terms = [{x.lower().strip() for x in (*t.keywords, *t.phrases)} for t in self.topics]
        self.rarity = {x: math.log(len(self.topics) / sum(x in s for s in terms)) + 1 for s in terms for x in s}

    def _scored(self, topic: Topic, text: Column, tokens: Column, n: Column) -> tuple[Column, Column]:
        """(score, terms found by name)."""
        raw, found = F.lit(0.0), []
        for term, phrase in [*((k.lower().strip(), False) for k in topic.keywords), *((p.lower().strip(), True) for p in topic.phrases)]:
            # phrases and keywords with a blank are looked for in the text, other keywords among its tokens
            count = count_of(text, term) if phrase or " " in term else _equal(tokens, term)
            bonus = 2.0 if phrase else 1.5 if " " in term else 1.0
            raw = raw + F.when(count > 0, count / n * self.rarity[term] * bonus).otherwise(0.0)
            found.append(F.when(count > 0, term))
        return F.greatest(F.least(1.0 - F.exp(-2.0 * (raw * topic.boost)), F.lit(1.0)), F.lit(0.0)), F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))

    def classify(self, text: Column, allowed: Iterable[str] | None = None) -> Column:
        """struct(is_on_topic, detected_topics, confidence): topics from the threshold on, best first, equals in the vocabulary's order.

        Without ``allowed`` any detected topic is on topic; an empty ``allowed``
        allows none.  Blank and null texts are off topic.
        """
        low = strip(F.lower(text_of(text)))
        tokens = F.regexp_extract_all(low, F.lit(rx(r"[a-z0-9]+(?:[-'][a-z0-9]+)*")), 0)
        singles = sorted({k.lower().strip() for t in self.topics for k in t.keywords})
        parts = F.struct(low.alias("low"), F.filter(tokens, lambda x: x.isin(singles)).alias("tokens"), word_count(low).alias("n"), blank(text_of(text)).alias("blank"))
        return let(let(parts, self._detected), lambda d: self.judged(d, allowed))

    def _detected(self, p: Column) -> Column:
        low, tokens, n = p["low"], p["tokens"], p["n"]
        rows = []
        for i, t in enumerate(self.topics):
            score, terms = self._scored(t, low, tokens, n)
            rows.append(let(round4(score), lambda s: F.struct((-s).alias("less"), F.lit(i).alias("number"), F.lit(t.name).alias("topic"), s.alias("score"), terms.alias("matched_terms"))))
        found = F.filter(F.array_sort(F.array(*rows)), lambda r: (F.size(r["matched_terms"]) > 0) & (r["score"] >= self.threshold))
        return F.when(p["blank"], F.array().cast(f"array<{SCORE}>")).otherwise(F.transform(found, lambda r: F.struct(r["topic"].alias("topic"), r["score"].alias("score"), r["matched_terms"].alias("matched_terms")).cast(SCORE)))

    @staticmethod
    def judged(detected: Column, allowed: Iterable[str] | None = None) -> Column:
        """The result for given ``detected_topics``."""
        if allowed is None:
            on = F.size(detected) > 0
        else:
            names = [a.lower() for a in allowed]
            on = F.exists(detected, lambda r: F.lower(r["topic"]).isin(names)) if names else F.lit(False)
        return F.struct(on.alias("is_on_topic"), detected.alias("detected_topics"), F.coalesce(F.get(detected, F.lit(0))["score"], F.lit(0.0)).alias("confidence"))

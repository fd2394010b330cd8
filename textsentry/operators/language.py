"""Language by function words, without a model or Python on the executors.

The share of a language is that of its function words among the distinct words
of the text, over all languages.  There is no claim to equal any other
detector's probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.functions.text import let, round4, rx, text_of

CANDIDATE = "struct<language:string,probability:double>"

WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from at an or not you have which his they we were their has been would there when who will more if out so what about into than them can only other new some could time these two may then do first any my now such like over",
    "fr": "le la les de des du et un une en est que qui dans pour par sur avec pas au aux ce cette il elle ne se son sa ses plus ou nous vous ils mais comme être sont été avoir leur très fait même tout sans",
    "de": "der die das und den dem des ein eine einer einem ist nicht mit von zu im auf für als auch es sich er sie wir ihr dass bei aus nach wie oder aber noch nur wenn werden wird war hat haben sind kann zum zur über vor",
    "es": "el la los las de del y un una en es que por para con no se su sus al lo como más pero o este esta fue ha son está muy también entre cuando sin sobre todo ser hay nos ya desde porque",
    "it": "il lo la i gli le di del della e un una in è che per con non si su da al come più ma o questo questa sono ha anche essere nel dei delle alla molto tra quando senza",
    "pt": "o a os as de do da dos das e um uma em é que por para com não se seu sua ao como mais mas ou este esta foi são também entre quando sem sobre ser há nos já",
    "nl": "de het een en van in is dat op te met voor zijn niet aan er om ook als bij maar door over hij ze wij uit nog naar dan wel worden wordt werd heeft hebben kan",
}


class LanguageDetector:
    """``allowed``: codes, in any case; none or an empty list is no restriction."""

    def __init__(self, allowed: Iterable[str] | None = None, words: dict[str, str] | None = None):
        self.allowed = sorted({a.strip().lower() for a in allowed or ()})
        self.words = {k: v.split() for k, v in (words or WORDS).items()}

    def detect(self, text: Column) -> Column:
        """struct(language, confidence, is_allowed, candidates by probability, equals by code).

        Texts without a function word of any language are ``unknown`` with
        confidence 0; blank and null texts have a null language and are allowed.
        """
        low = F.lower(text_of(text))
        empty = ~F.coalesce(low.rlike(rx(r"\S")), F.lit(False))
        return let(F.struct(self._candidates(low).alias("candidates"), empty.alias("empty")), self._result)

    def _candidates(self, low: Column) -> Column:
        found = F.array_distinct(F.filter(F.split(low, rx(r"[^\p{L}]+")), lambda w: w != ""))
        names = sorted(self.words)
        hits = let(found, lambda f: F.struct(*[F.size(F.array_intersect(f, F.array(*map(F.lit, self.words[k])))).alias(k) for k in names]))

        def rows(h: Column) -> Column:
            total = F.greatest(sum((h[k] for k in names), F.lit(0)), F.lit(1))
            return F.array(*[F.struct((-round4(h[k] / total)).alias("less"), F.lit(k).alias("language"), round4(h[k] / total).alias("probability")) for k in names])

        return F.transform(F.array_sort(F.filter(let(hits, rows), lambda r: r["probability"] > 0)), lambda r: F.struct(r["language"].alias("language"), r["probability"].alias("probability")).cast(CANDIDATE))

    def _result(self, p: Column) -> Column:
        candidates = p["candidates"]
        top = F.get(candidates, F.lit(0))
        language = F.when(~p["empty"], F.coalesce(top["language"], F.lit("unknown")))
        ok = self.accepts(language)
        return F.struct(language.alias("language"), F.coalesce(top["probability"], F.lit(0.0)).alias("confidence"), ok.alias("is_allowed"), candidates.alias("candidates"))

    def accepts(self, language: Column) -> Column:
        return F.coalesce(language.isin(self.allowed), F.lit(True)) if self.allowed else F.lit(True)

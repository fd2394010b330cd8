"""Redaction of detected spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.functions.text import blocks, clusters, let, piece, text_of
from textsentry.operators.pii import PIIDetector
from textsentry.types import REDACTION, STRATEGIES, chosen


class Redactor:
    """Default strategy, strategies by entity type, mask character and length of the hash."""

    def __init__(self, strategy: str = "replace", by_type: dict[str, str] | None = None, mask: str = "*", hash_length: int = 8):
        self.strategy = chosen(strategy, STRATEGIES, "strategy")
        self.by_type = {k: chosen(v, STRATEGIES, "strategy") for k, v in (by_type or {}).items()}
        self.mask, self.hash_length = mask, hash_length

    def _strategy(self, entity_type: Column, override: str | None) -> Column:
        if override is not None:
            return F.lit(chosen(override, STRATEGIES, "strategy"))
        out = F.lit(self.strategy)
        for k, v in self.by_type.items():
            out = F.when(entity_type == k, v).otherwise(out)
        return out

    def _replacement(self, text: Column, entity_type: Column, strategy: Column) -> Column:
        return (
            F.when(strategy == "mask", F.repeat(F.lit(self.mask), F.length(text)))
            .when(strategy == "hash", F.concat(F.lit("["), F.substring(F.sha2(text, 256), 1, self.hash_length), F.lit("]")))
            .when(strategy == "replace", F.concat(F.lit("["), entity_type, F.lit("]")))
            .otherwise("")
        )

    def redact(self, text: Column, detections: Column, strategy: str | None = None) -> Column:
        """struct(original_text, redacted_text, redactions): spans are replaced from the right.

        At one start the longer goes first; a span that reaches into one
        already replaced is left out.  The strategy of the call wins over that
        of the type, which wins over the default.  A null text is empty.
        """
        return let(F.struct(text_of(text).alias("text"), detections.alias("found")), lambda x: self._redacted(x["text"], x["found"], strategy))

    def _redacted(self, text: Column, detections: Column, strategy: str | None) -> Column:
        order = F.array_sort(F.transform(detections, lambda d, i: F.struct(d["start"].alias("start"), (d["end"] - d["start"]).alias("size"), (-i).alias("number"), d["end"].alias("end"), d.alias("d"))))

        def detail(d: Column) -> Column:
            how = self._strategy(d["entity_type"], strategy)
            return F.struct(d["entity_type"].alias("entity_type"), d["text"].alias("original"), self._replacement(d["text"], d["entity_type"], how).alias("replacement"), d["start"].alias("start"), d["end"].alias("end"), how.alias("strategy")).cast(REDACTION)

        none = F.array().cast(f"array<{REDACTION}>")
        state = F.struct(F.lit(2147483647).alias("last"), none.alias("done"))

        def step(s: Column, x: Column) -> Column:
            put = F.struct(x["start"].alias("last"), F.concat(F.array(detail(x["d"])), s["done"]).alias("done"))
            return F.when(x["end"] > s["last"], s).otherwise(put)

        def of(run: Column) -> Column:
            return F.when(F.size(run) == 1, F.transform(run, lambda x: detail(x["d"]))).otherwise(F.aggregate(F.reverse(run), state, step)["done"])

        def whole(p: Column) -> Column:
            parts, done, size = p["blocks"], p["done"], F.size(p["done"])
            # what stands before each replacement, and what follows the last
            put = F.transform(done, lambda d, i: F.concat(piece(parts, F.when(i == 0, 0).otherwise(F.get(done, i - 1)["end"]), d["start"]), d["replacement"]))
            rest = F.when(size > 0, piece(parts, F.get(done, size - 1)["end"], p["size"])).otherwise(text)
            return F.struct(text.alias("original_text"), F.concat(F.array_join(put, ""), rest).alias("redacted_text"), done.alias("redactions"))

        done = F.flatten(F.transform(clusters(order), of))
        some = let(F.struct(blocks(text).alias("blocks"), done.alias("done"), F.length(text).alias("size")), whole)
        plain = F.struct(text.alias("original_text"), text.alias("redacted_text"), none.alias("redactions"))
        return F.when(F.size(detections) > 0, some).otherwise(plain)


def redact_pii(text: Column, strategy: str = "replace") -> Column:
    """All patterns, one strategy."""
    return Redactor().redact(text, PIIDetector().detect(text), strategy)

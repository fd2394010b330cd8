"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from texts of that
language.  A text belongs to the language whose dictionary compresses it to
the fewest bytes; the relative lead over the second is the margin.  A text
with a margin below ``min_margin`` is marked ``rejected``.  Only languages that
use the script of most of the text's letters are tried, or all where none does:
another script's dictionary has nothing to copy from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import tidied, unit_hash

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: A long text is compressed in blocks, so that its own past does not replace the dictionary.
BLOCK = 8192


def fit_dictionaries(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", texts_per_lang: int = 60, dict_bytes: int = 65536, most_langs: int = 2000) -> dict[str, bytes]:
    """Dictionaries of all languages from a bounded sample: about twice ``texts_per_lang`` whole texts of each.

    Texts are drawn by a hash of key and text, equal rows once.  Each gives an
    equal share of the dictionary, cut from its middle.  Rows with a null
    language or a null or empty text are left out; no rows give no dictionary.
    More than ``most_langs`` languages, counted before anything is collected,
    are an error.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).where("g is not null and length(t) > 0")
    counted = docs.groupBy("g").count()
    counts = counted.limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["g"], min(1.0, 2.0 * texts_per_lang / r["count"]))])
    drawn = docs.where(unit_hash(F.col("k"), F.xxhash64("t"), seed=8) < F.element_at(share, F.col("g"))).distinct()
    by: dict[str, list[bytes]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["g"], r["k"], r["t"])):
        by.setdefault(r["g"], []).append(letters(r["t"]))
    out = {}
    for g, texts in by.items():
        cut = b""
        for left, t in zip(range(len(texts), 0, -1), sorted(texts, key=len)):
            piece = max(1, (dict_bytes - len(cut)) // left)
            a = max(0, (len(t) - piece) // 2)
            cut += t[a : a + piece]
        out[g] = cut
    return out


def letters(text: str) -> bytes:
    """Lower-cased letters, with one space for whatever stands between them."""
    return _OTHER.sub(" ", text.lower()).encode()


#: First bytes of UTF-8 at which another script begins: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and Thai, Georgian and others, kana, Han, Hangul, rest.
_SCRIPTS = [0x00, 0xCD, 0xD0, 0xD4, 0xD6, 0xD8, 0xE0, 0xE1, 0xE3, 0xE4, 0xEA, 0xEE]
_SCRIPT = np.searchsorted(_SCRIPTS, np.arange(256), "right") - 1


def scripts(data: bytes) -> np.ndarray:
    """Number of letters by script in what :func:`letters` gives."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n[0x20] = 0
    n[0x80:0xC0] = 0
    return np.bincount(_SCRIPT, n, len(_SCRIPTS))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        self.langs = sorted(dictionaries)
        self.by = [zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionaries[g], dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for g in self.langs]
        # a language uses a script in which one letter in twenty of its dictionary is
        uses = np.array([scripts(dictionaries[g]) for g in self.langs]).reshape(len(self.langs), len(_SCRIPTS))
        uses = uses >= np.maximum(1, uses.sum(axis=1, keepdims=True) / 20)
        self.tried = [np.flatnonzero(u).tolist() if u.any() else list(range(len(self.langs))) for u in uses.T]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the relative lead of the best over the second, 1 if only one is tried."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = letters(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        tried = self.tried[int(scripts(data).argmax())]
        sizes = sorted((sum(len(self.by[i].compress(b)) for b in blocks), self.langs[i]) for i in tried)
        return sizes[0][1], 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, keep: tuple[str | Column, ...] = ("doc_id",), text: str = "text", level: int = 3, min_margin: float = 0.02) -> DataFrame:
    """The ``keep`` columns, ``lang_pred``, ``score`` in [0, 1] and ``rejected``.

    ``score`` is the margin, scaled so that a lead of a quarter is 1.  Null
    texts and texts without a letter are ``und`` with score 0 and rejected;
    equal sizes go to the first language by name.  Long texts count whole.
    """
    held = docs.select(*keep)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    names = [*held.columns, "lang_pred", "score", "rejected"]
    schema = held.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries, level)
        for batch in batches:
            got = [classify(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            langs, margins = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array([min(1.0, 4 * m) for m in margins], pa.float64()), pa.array([m < min_margin or g == UNKNOWN for g, m in got], pa.bool_())], names=names)

    return rows.mapInArrow(tidied(run), schema)

"""Language identification by compression.

For every language a raw-content dictionary is filled with pieces of its texts. A text is
lower-cased, stripped of all but letters and cut into pieces; each piece is compressed with
each dictionary, and the language with the smallest total wins. A narrow margin is rejected,
and so is a less narrow one if a coder without any dictionary does as well, that is if the
text is in none of the languages. A text without letters is rejected.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from viario.llm.words import kept
from viario.operators.small import join_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
SAMPLE_TEXTS = 400          # texts per language that may fill its dictionary
DICTIONARY_BYTES = 120_000
PIECE_BYTES = 4_000
LEVEL, MIN_MATCH = 3, 4
SAMPLE_CHARS = 6_000        # of a text in a dictionary
MIN_MARGIN = 0.03           # of the smallest size
NONE_MARGIN = 0.05          # where no dictionary helps
CLOSE = 0.02                # margins below are looked at again
FILLERS, FILLER_BYTES = 24, 400
SHARPNESS = 60.0
_LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower case, letters only, one space between words, a word said again and again once."""
    return " ".join(word for word, _ in groupby(_OTHER.sub(" ", text.lower()).split())).encode()


def learn_dictionaries(documents: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS,
                       size: int = DICTIONARY_BYTES, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """The dictionary of each language, from a bounded sample of different texts.

    The sample (`texts` per language, the first `chars` characters of each, at most `size`
    bytes in all) is the texts with the smallest hashes, so copies count once and any order of
    rows gives the same sample. Only keys below a bound that leaves about as many as are
    wanted are moved, so a frequent language is no task's burden. Rows without text, letters or
    language are left out; no rows give no languages.
    """
    labelled = documents.where(F.col(lang).isNotNull() & F.col(text).rlike(_LETTER))
    own = labelled.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))
    # 8 standard deviations more than wanted, and a tenth for the error of the count
    share = F.lit(1.1 * (texts + 8 * math.sqrt(texts) + 8)) / F.col("n")
    bound = F.when(share < 1, F.lit(float(-(1 << 63))) + share * F.lit(2.0**64)).otherwise(F.lit(2.0**63))
    near = join_groups(own.select("lang", "key"), sizes.select("lang", bound.alias("bound")), ["lang"], "inner")
    keys = near.where(F.col("key").cast("double") <= F.col("bound")).select("lang", "key").distinct()
    first = Window.partitionBy("lang").orderBy("key")
    chosen = keys.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= texts)
    rows = join_groups(own, chosen, ["lang", "key"], "inner").groupBy("lang", "rank").agg(
        F.min(F.substring("text", 1, chars)).alias("text"))
    found: dict[str, bytearray] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.lang, r["rank"])):
        own = found.setdefault(row.lang, bytearray())
        own += normal(row.text)[:max(0, size - len(own))] + b" "
    return {name: bytes(own) for name, own in sorted(found.items()) if len(own) >= 8}


class _Sizes:
    """Compressed sizes of a text under every language; made inside a task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders, self.fillers = [], []
        for data in dictionaries.values():
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            code = zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress
            step = max(1, len(data) // FILLERS)
            own = [data[i:i + FILLER_BYTES] for i in range(0, len(data), step)]
            self.coders.append(code)
            plain = zstandard.ZstdCompressor(compression_params=params).compress
            self.fillers.append((plain, [(f, len(plain(f))) for f in own]))
        self.plain = zstandard.ZstdCompressor(compression_params=params).compress

    def __call__(self, text: bytes) -> list[float]:
        pieces = [text[i:i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        return [float(sum(len(code(p)) for p in pieces)) for code in self.coders]

    def unaided(self, text: bytes) -> float:
        """The size without any dictionary."""
        return float(sum(len(self.plain(text[i:i + PIECE_BYTES])) for i in range(0, len(text), PIECE_BYTES)))

    def again(self, text: bytes) -> list[float]:
        """What the pieces add to the size of known texts of each language, on average."""
        pieces = [text[i:i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        return [sum(len(code(f + p)) - n for p in pieces for f, n in own) / len(own)
                for code, own in self.fillers]


def identify(documents: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
             keep: list[str] | None = None, min_margin: float = MIN_MARGIN, none_margin: float = NONE_MARGIN) -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1), margin and rejected, one row per document.

    Whole texts are compressed. Null, empty and letterless texts get `und`, score 0 and are
    rejected, as is every text if no language was learned. Margins below `min_margin` are rejected,
    and those below `none_margin` if no dictionary makes the text shorter than it is without. Equal sizes take the first
    language by name, margin 0, rejected. Only the text column decides.
    """
    names = list(dictionaries)
    keep = kept(documents, keep, text, ("lang_pred", "score", "margin", "rejected"))
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"),
                            F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)).alias("__letters"))
    schema = rows.drop("__text", "__letters").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)

    def verdict(sizes: _Sizes, value: str | None, letters: bool) -> tuple[str, float, float, bool]:
        if not letters or not names:
            return UNKNOWN, 0.0, 0.0, True
        plain = normal(value)
        size = sizes(plain)
        best, second = sorted([*size, math.inf])[:2]
        known = best
        if second - best < CLOSE * best:  # sizes are whole bytes: short texts often tie
            size = [a + b for a, b in zip(size, sizes.again(plain))]
            best, second = sorted(size)[:2]
        margin = min(1.0, (second - best) / best)
        score = 1.0 / sum(math.exp(max(-700.0, SHARPNESS * (best - s) / best)) for s in size)
        narrow = margin < min_margin or (margin < none_margin and sizes.unaided(plain) <= known)
        return names[size.index(best)], score, margin, narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(dictionaries)
        for batch in batches:
            found = [verdict(sizes, v.as_py(), ok.as_py())
                     for v, ok in zip(batch.column("__text"), batch.column("__letters"))]
            columns = [batch.column(i) for i in range(len(keep))]
            for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())):
                columns.append(pa.array([f[i] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "margin", "rejected"])

    return rows.mapInArrow(run, schema)

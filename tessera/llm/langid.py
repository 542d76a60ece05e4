"""Language identification by compression: each language's raw-content zstandard dictionary encodes the text; the
smallest code wins, and narrow margins are marked as rejected."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import window_of, with_arrow

#: Bound of the sample that dictionaries are made of: texts for each language, and characters of each, from a place by its hash on.
SAMPLE_TEXTS, SAMPLE_CHARS = 64, 2000
#: Bytes that are encoded at a time; a text's code is the sum over all its parts.
PART = 2048
LEVEL, NARROW = 9, 0.01
UNKNOWN = "und"
GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
NOT_LETTERS, LETTER = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]")


def letters(text: str) -> bytes:
    """Lower-case words of letters alone, with a space before, between and after them."""
    return (" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def endings(data: bytes) -> bytes:
    """The text's endings from every place on, or of a longer text from some, end to end: a few thousand bytes from a few."""
    return b"".join(data[a:] for a in range(0, len(data), 1 + len(data) ** 2 // 8000))


def dictionaries(train: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, bytes]:
    """For each language the letters of a bounded sample: the text of the smallest hash in each of SAMPLE_TEXTS hash slots.

    Of a longer text, SAMPLE_CHARS characters count from a place that its hash gives, anywhere in it.
    Null languages and texts are left out. Slots keep a common language from gathering in one task.
    """
    h = F.xxhash64(text)
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang"), F.pmod(h, F.lit(SAMPLE_TEXTS)).alias("slot")).agg(F.min_by(window_of(F.col(text), F.shiftright(h, 8), SAMPLE_CHARS), h).alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in rows.orderBy("lang", "slot").collect():
        out.setdefault(r["lang"], []).append(letters(r["text"]))
    return {k: b"".join(v) for k, v in out.items() if any(len(x) > 2 for x in v)}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.names, self.codecs = list(content), []
        # short matches count in short words
        how = z.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        for data in content.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.codecs.append(z.ZstdCompressor(dict_data=d, compression_params=how))

    def guess(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score (0: the two best codes are as long; 1: the second is 10 % longer or more), margin, rejected."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(text)
        parts = [data[i : i + PART] for i in range(0, len(data), PART)]
        # codes of texts too short to compress are as long: then those of the text's endings, which are long enough, decide
        size = [sum(len(c.compress(p)) for p in parts) for c in self.codecs]
        again = endings(data) if size.count(min(size)) > 1 else b""
        sizes = sorted((n, len(c.compress(again)), i) for i, (n, c) in enumerate(zip(size, self.codecs, strict=True)))
        best = sizes[0][0]
        margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
        return self.names[sizes[0][2]], min(1.0, 10 * margin), margin, margin < NARROW


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the language (GUESS columns) of each whole text.

    Null texts and texts without a letter: ``und``, score 0, rejected. Among equal codes the
    shorter one of the text's endings wins, then the language that sorts first.
    Without any learned language everything is ``und``. Repeated rows get equal results; columns named like a new one
    are replaced; an empty table gives an empty result.
    """

    def make():
        model = Classifier(content)

        def step(batch: pa.RecordBatch) -> list:
            rows = [model.guess(x) for x in batch.column(text).to_pylist()]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in GUESS]

        return step

    return with_arrow(docs, GUESS, make, text, keep)

"""Language identification by compression.

Text compresses best next to text of its own language.  Each language gets a
few raw-content zstandard dictionaries from a bounded sample of labelled rows.
A document is cut into blocks, each block is compressed with the dictionaries
of every language, and the language with the smallest sum over all blocks is
chosen.  If the runner-up is nearly as small, the document can be rejected.

Blocks keep the dictionary in play over the whole of a long text, which would
otherwise become its own model after some kilobytes.  The head of each block is
held against several small dictionaries a language too: in a short text the mean
over them resolves what one size in whole bytes can't.  One formula holds for texts of every length.  Case, digits and
punctuation carry no language and are taken away first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import apart, as_one, quoted, without

#: The answer for a text that is null or has no letter.
UNDETERMINED = "und"

#: A stretch of letters; what a text without any of them is in can't be told.
LETTER = r"\p{L}"


_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters_only(text: str) -> str:
    """Lower-cased words of letters with one space between them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """For each language, the most common first, its large dictionary and its small ones."""

    languages: tuple[str, ...]
    large: tuple[bytes, ...]
    small: tuple[tuple[bytes, ...], ...]
    level: int = 6
    block: int = 8192
    head: int = 200


def fit_languages(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 384,
    slice_chars: int = 512,
    parts: int = 6,
    level: int = 6,
    block: int = 8192,
    head: int = 200,
) -> LanguageModel:
    """Dictionaries from at most ``sample`` slices of ``slice_chars`` characters a language.

    That is the bound of what is gathered: with the defaults about 200 KB a
    language, whatever the size of the table.  The sample is one text, the
    smallest by hash, of each of ``sample`` hash ranges, so reruns agree and
    copies of a text count once; partial aggregation leaves at most ``sample``
    texts a language and task to shuffle.  Half of the slices make the large
    dictionary, all of them are dealt to ``parts`` small ones, for the first
    ``head`` bytes of each block.  A slice stands anywhere in its text, by hash.  Rows with null text or language, and texts without
    letters, are left out.
    """
    text, lang = F.col(quoted(text_col)), F.col(quoted(lang_col)).cast("string")
    at = F.pmod(F.xxhash64("text", F.lit("slice")), F.greatest(F.length("text") - slice_chars + 1, F.lit(1))).cast("int") + 1
    drawn = (
        labelled.select(lang.alias("lang"), text.alias("text"))
        .filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
        .select("lang", F.xxhash64("text").alias("h"), F.substring("text", at, F.lit(slice_chars)).alias("slice"))
        .groupBy("lang", F.pmod("h", F.lit(sample)).alias("range"))
        .agg(F.min_by("slice", "h").alias("slice"), F.count("*").alias("n"))
    )
    slices: dict[str, list[tuple[int, str]]] = {}
    texts: Counter[str] = Counter()
    for row in drawn.collect():
        slices.setdefault(row["lang"], []).append((row["range"], letters_only(row["slice"])))
        texts[row["lang"]] += row["n"]
    languages = tuple(sorted(slices, key=lambda lang: (-texts[lang], lang)))
    large, small = [], []
    for lang in languages:
        ordered = [s for _, s in sorted(slices[lang])]
        large.append(_content(ordered[::2]))
        small.append(tuple(_content(ordered[k::parts]) for k in range(parts) if k < len(ordered)))
    most = max(map(len, small), default=0)
    small = [(own * most)[:most] for own in small]  # a language with few texts repeats them, so that sums compare
    return LanguageModel(languages, tuple(large), tuple(small), level, block, head)


def _content(slices: list[str]) -> bytes:
    """A dictionary has eight bytes at least."""
    return "\n".join(slices).encode().ljust(8)


class _Scorer:
    """Compressors of a model; built once a task."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.large = [self._compressor(c) for c in model.large]
        self.small = [[self._compressor(c) for c in own] for own in model.small]

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.model.level)
        return zstandard.ZstdCompressor(level=self.model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        """Bytes over all blocks of the text, by language: with the large dictionary, and the mean over the small ones for the heads of blocks, times the number of these."""
        data, step = letters_only(text).encode(), self.model.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        heads = [b[: self.model.head] for b in blocks]
        parts = max(map(len, self.small), default=1)
        return [parts * sum(len(large.compress(b)) for b in blocks) + sum(len(c.compress(b)) for c in small for b in heads) for large, small in zip(self.large, self.small, strict=True)]

    def judge(self, text: str) -> tuple[str, float]:
        """The language and the margin to the runner-up, 0 to 1.

        Equal sizes go to the language of which more texts were labelled, with margin 0.
        """
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        return self.model.languages[best], (min(others) - sizes[best]) / min(others) if others else 1.0


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = 0.0) -> DataFrame:
    """``docs`` with lang_pred, score and lang_rejected.

    ``score`` is the margin: how much smaller, as a share, the text is in its
    language than in the runner-up.  ``lang_rejected`` holds where the score is
    below ``min_margin``, or no language could be told: null text and text
    without letters give ``und`` and score 0, as does a model without
    languages.  A model of one language gives score 1.  Every other text gets
    a language, however short; long texts are judged as a whole.  Only the
    text is looked at.  Repeated rows get equal answers; input columns with the
    name of a computed one are dropped; an empty table gives no rows.
    """
    keep = without(docs, ("lang_pred", "score", "lang_rejected"))
    text = F.col(quoted(text_col))
    judged = F.when(text.rlike(LETTER), text) if model.languages else F.lit(None).cast("string")
    rows = docs.select(as_one(keep), judged.alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = [(UNDETERMINED, 0.0) if t is None else scorer.judge(t) for t in (x.as_py() for x in batch.column(1))]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < min_margin)
    return rows.mapInArrow(judge, schema).select(*apart(keep), "lang_pred", "score", rejected.alias("lang_rejected"))

"""Language ID by compression.

Every language has a zstandard raw-content dictionary: pieces of a bounded number of labelled documents (PIECES pieces
of PIECE_CHARS characters; a hash of the id chooses the documents and where a piece begins). A text is lower-cased, freed of ASCII signs and
digits and cut into blocks; all its blocks are compressed with each dictionary, and the language with the smallest sum
wins. The margin is the saving against the second, as a share of the second's size; where the bytes saved are fewer than
min_margin of that size by more than what rounding to whole bytes can hide (ROUNDING), the text is marked as rejected.

Defined cases: a null or empty text, or one without letters, is `und` with score 0 and rejected; null languages and
null ids aren't learned from; with no labelled document every text is `und`; of tied languages the one with more
labelled documents comes first; repeated rows are judged alike; texts of any length are compressed whole, block by
block; an empty table gives an empty result; columns that aren't named stay as they are in classify.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table

PIECES, PIECE_CHARS = 256, 512
LEVEL, BLOCK = 6, 2048
MIN_MARGIN = 0.002
#: Bytes of a difference of sizes that rounding can hide.
ROUNDING = 0.5
_SIGNS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \n")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _SIGNS)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, the language with most documents first. The result is bounded by the number
    of languages times PIECES * PIECE_CHARS characters."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()}
    if not counts:
        return {}
    order = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 4 * PIECES / n) * (1 << 30)))])
    first = F.pmod(F.xxhash64(id_col, F.lit(13)), F.greatest(F.length(text_col) - PIECE_CHARS, F.lit(0)) + 1).cast("int") + 1
    piece = F.col(text_col).substr(first, F.lit(PIECE_CHARS))
    few = rows.select(lang_col, piece.alias("piece"), order.alias("o"), F.col(id_col).alias("id")).where(F.col("o") <= share[F.col(lang_col)])
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy(lang_col).orderBy("o", "id", "piece"))).where(F.col("r") <= PIECES)
    pieces: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    for lang, piece, r in ranked.select(lang_col, "piece", "r").collect():
        pieces[lang].append((r, piece))
    return {lang: b" ".join(plain(p) for _, p in sorted(found)) for lang, found in pieces.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN):
        self.by, self.min_margin = [], min_margin
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the text is rejected."""
        if not text or not self.by or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        raw = plain(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, max(1, len(raw)), BLOCK)]
        sizes = [(sum(len(c.compress(b)) for b in blocks), k, lang) for k, (lang, c) in enumerate(self.by)]
        best, *rest = sorted(sizes)
        margin = (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0
        score = 1 / sum(math.exp(-25 * (s - best[0]) / best[0]) for s, *_ in sizes)
        narrow = bool(rest) and rest[0][0] - best[0] < self.min_margin * rest[0][0] - ROUNDING
        return best[2], score, margin, narrow


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with <prefix>pred, <prefix>score, <prefix>margin and <prefix>rejected, which replace columns of these names."""
    names = [f"{prefix}{n}" for n in ("pred", "score", "margin", "rejected")]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries, min_margin)
        for b in batches:
            got = [judge(t.as_py()) for t in b.column(text_col)]
            more = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double", "boolean")))]
    return map_batches(docs, run, ", ".join(kinds))


def fold(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit(docs.where(fold("doc_id", 4) != 2))
    return classify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected")
    )


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}

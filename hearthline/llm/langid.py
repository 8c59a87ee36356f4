"""Language identification by compression: the language whose raw-content dictionary shrinks a text most.

A zstandard dictionary per language is filled from a bounded, hash-chosen sample of labelled
documents (at most `per_language` of them, extracts of `size` characters in all; both are parameters,
and all languages together have at most 32 MB). Case is folded. Every whole text is then compressed with each dictionary, in blocks of a fixed
size whose compressed sizes are summed: a dictionary saves so much a block, and the margin does not shrink
with a text's length. Margins narrower than `min_margin` are marked `rejected`: so are texts that are null or have no letter (`und`).

Rows with a null or empty language teach nothing; with nothing learned every text is `und`. Ties go
to the first language in alphabetical order and are rejected. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import materialise

UNDETERMINED = "und"
#: Characters that the dictionaries of all languages have together, at most: 64 K each for up to 512 languages.
TOTAL = 1 << 25
#: Sampled ids are broadcast up to this number, else joined by shuffle; either way the same texts are read.
MOST_SENT = 1 << 17
BLOCK_BYTES = 1 << 14


def sample_texts(labelled: DataFrame, per_language: int, size: int, buckets: int = 32) -> dict[str, list[str]]:
    """At most per_language extracts of each language, in hash order, of size characters in all (as many of
    each text). Ids are chosen first, from narrow rows dealt over buckets, so that a dominant language makes
    no hot task; only chosen texts are read. With many languages size shrinks, so that all have at most TOTAL."""
    known = labelled.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    dealt = known.select("doc_id", "lang", order.alias("h"), F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(buckets)).alias("b"))
    turn = F.row_number().over(Window.partitionBy("lang", "b").orderBy("h", "doc_id"))
    chosen = dealt.withColumn("turn", turn).filter(F.col("turn") <= max(1, per_language // buckets)).select("doc_id", "lang").distinct()
    chosen = materialise(chosen)
    number = chosen.groupBy("lang").agg(F.count("*").alias("number"))
    languages = number.agg(F.count("*")).first()[0]
    share = F.greatest(F.lit(1), F.floor(F.lit(min(size, TOTAL // max(1, languages))) / F.col("number"))).cast("int").alias("share")
    wanted = chosen.join(number, "lang").select("doc_id", "lang", share)
    # per_language rows of three short columns for each of so many languages at most are sent to all tasks.
    wanted = F.broadcast(wanted) if languages * per_language <= MOST_SENT else wanted
    start = F.pmod(order, F.greatest(F.lit(1), F.length("text") - F.col("share"))).cast("int") + 1
    texts = known.join(wanted, ["doc_id", "lang"]).select("doc_id", "lang", F.substr(F.col("text"), start, F.col("share")).alias("text"))
    out: dict[str, list[str]] = {}
    for row in texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id").toLocalIterator():
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def dictionaries(labelled: DataFrame, per_language: int = 256, size: int = 1 << 16) -> dict[str, bytes]:
    """Raw dictionary content of each language: its sampled extracts, at most size bytes."""
    return {lang: b"\n".join(t.lower().encode() for t in texts)[-size:] for lang, texts in sorted(sample_texts(labelled, per_language, size).items())}


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """Compressors of all learned languages. Texts that tie are compressed again, at a level that finds
    shorter matches and each block four times over: a text of few bytes is else stored as it is, whatever
    the dictionary holds."""

    def __init__(self, learned: dict[str, bytes], level: int, min_margin: float, tie_level: int = 19):
        self.langs = sorted(learned)
        self.packers, self.finer = ([compressor(learned[x], k) for x in self.langs] for k in (level, tie_level))
        self.min_margin = min_margin

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, relative margin of the second-best size, whether it is rejected)."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        data = text.lower().encode()
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        lang, margin = self.best(blocks, self.packers)
        if margin <= self.min_margin:
            lang, margin = self.best([(b + b"\n") * 4 for b in blocks], self.finer)
        return lang, margin, margin <= self.min_margin

    def best(self, blocks: list[bytes], packers: list[zstandard.ZstdCompressor]) -> tuple[str, float]:
        sizes = [sum(len(p.compress(b)) for b in blocks) for p in packers]
        k = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != k), default=sum(map(len, blocks)) + sizes[k])
        return self.langs[k], min(1.0, max(0.0, (second - sizes[k]) / second))


def identify(docs: DataFrame, learned: dict[str, bytes], level: int = 6, min_margin: float = 0.001) -> DataFrame:
    """doc_id, lang_pred, score (the margin), rejected for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(learned, level, min_margin)
        for batch in batches:
            told = [judge(value.as_py()) for value in batch.column("text")]
            preds, scores, rejected = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, learned: dict[str, bytes], level: int = 6, min_margin: float = 0.001) -> DataFrame:
    """The rows whose language is told with a margin, with all their columns; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(learned, level, min_margin)
        for batch in batches:
            yield batch.filter(pa.array([not judge(value.as_py())[2] for value in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_fold(doc_id: str, fold: int = 1, folds: int = 3) -> Column:
    """Whether crc32 of the id's text falls in the fold that is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))

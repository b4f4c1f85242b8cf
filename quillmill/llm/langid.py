"""Language identification by compression.

Each language is a raw-content zstandard dictionary, cut from labelled texts.
A text, reduced to its letters in lower case, is compressed block by block with
every dictionary; the language whose dictionary gives the fewest bytes wins,
and the text is rejected when the runner-up comes within ``margin`` of it.
Blocks keep a long text from becoming its own dictionary, and every block
counts. A quick level settles most texts; those with a small lead are judged
again, whole, at a thorough level with shorter blocks.

Texts that are null or hold no letter are ``und``, with score 0, and rejected.
Ties go to the language that sorts first. Repeated rows give repeated rows;
rows without a language label take no part in fitting, repeated texts teach
once, and long ones in pieces. Every language that labels a text with a letter
gets a dictionary. With no labelled text at all every row is ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column_of, give_back, slices, written

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> str:
    """The text's words in lower case, joined by single blanks."""
    return _OTHER.sub(" ", text).strip().lower()


@dataclass
class LanguageModel:
    """Dictionaries by language; ``passes`` are (level, block bytes, lead that settles it)."""

    dictionaries: dict[str, bytes]
    passes: tuple[tuple[int, int, float], ...] = ((3, 4096, 0.05), (12, 1024, 0.0))
    ready: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "ready": {}}  # compressors belong to one process

    def compressors(self, level: int) -> list:
        if level not in self.ready:
            import zstandard

            own = self.ready[level] = []
            for lang in sorted(self.dictionaries):
                data = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=level)
                own.append((lang, zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return self.ready[level]

    def sizes(self, data: bytes, level: int, block: int) -> list[tuple[int, str]]:
        """Compressed bytes of all blocks by language, fewest first."""
        blocks = [data[i : i + block] for i in range(0, len(data), block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.compressors(level))

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected); the score grows with the winner's lead over the runner-up."""
        data = letters(text or "")
        if not self.dictionaries or not any(map(str.isalpha, data)):
            return UNDETERMINED, 0.0, True
        data, lang, lead = data.encode(), "", 1.0
        for level, block, settled in self.passes:
            ranked = self.sizes(data, level, block)
            lang = ranked[0][1]
            if len(ranked) > 1:
                lead = (ranked[1][0] - ranked[0][0]) / max(ranked[1][0], 1)
            if lead >= settled:
                break
        return lang, 1 / (1 + math.exp(-40 * lead)), lead < margin


def fit_languages(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", dictionary_bytes: int = 112_640, sample_pieces: int = 400, piece_chars: int = 3_520) -> LanguageModel:
    """Cut one dictionary per language from a bounded sample of labelled texts.

    Whole texts are cut into pieces of ``piece_chars`` characters. The sample
    is the ``sample_pieces`` different pieces of each language with the
    smallest hashes, so it does not matter how often a text occurs, how long it
    is or under which id. A dictionary takes them in that order, reduced to
    their letters, until it has ``dictionary_bytes``.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch], wanted: set[tuple[str, int]] | None = None) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            langs = column_of(batch, "lang").to_pylist()
            for first, texts in slices(column_of(batch, "text")):
                found: dict[tuple[str, int], str] = {}
                for at, text in enumerate(texts, first):
                    for a in range(0, len(text), piece_chars):
                        piece = text[a : a + piece_chars]
                        key = langs[at], xxhash.xxh3_64_intdigest(piece.encode()) - 2**63
                        if key not in found and (wanted is None or key in wanted) and _LETTER.search(piece):
                            found[key] = piece if wanted else ""
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.string())], names=["lang", "h", "piece"])
        give_back()

    schema = "lang string, h long, piece string"
    keys = written(known.mapInArrow(pieces, schema).select("lang", "h").distinct(), "pieces")
    # only the part of the hash range that holds a language's sample is ranked, however many pieces it has
    counts = keys.groupBy("lang").count().collect()  # one row a language
    shares = spark.createDataFrame([(r["lang"], min(1.0, 4 * sample_pieces / r["count"])) for r in counts], "lang string, share double")
    near = keys.join(F.broadcast(shares), "lang").where((F.col("share") >= 1) | (F.col("h") <= (F.col("share") * 2.0**64 - 2.0**63).cast("long")))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_pieces)
    chosen = {(r["lang"], r["h"]) for r in ranked.select("lang", "h").collect()}  # at most ``sample_pieces`` a language
    found = known.mapInArrow(lambda b: pieces(b, chosen), schema).groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect() if chosen else []
    texts: dict[str, list[tuple]] = {}
    for r in found:
        texts.setdefault(r["lang"], []).append((r["h"], letters(r["piece"]).encode()))
    out = {lang: b"\n".join(t for _, t in sorted(some) if t)[:dictionary_bytes] for lang, some in texts.items()}
    return LanguageModel({lang: data for lang, data in out.items() if data})


def identify(docs: DataFrame, model: LanguageModel, *, margin: float = 0.001, text_column: str = "text", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The id, the columns in ``keep`` (but those named like a result), ``lang_pred``, ``score`` and ``rejected`` for every row."""
    kept = [id_column, *(c for c in keep or [] if c not in (id_column, *["lang_pred", "score", "rejected"]))]
    text = text_column if text_column in kept else "__text"
    rows = docs.select(*kept, *([] if text in kept else [F.col(text_column).alias(text)]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few dictionaries of fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(t, margin) for _, texts in slices(column_of(batch, text)) for t in texts]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(judge, f"{fields}, lang_pred string, score double, rejected boolean")

"""Phrases whose words belong together, per language.

Method: Rabin-Karp fingerprints.  Prefix polynomials over a slice's normalised words hash every
word sequence in one subtraction.  Lengths are counted one after the other: tasks add up the
fingerprints of their sequences, a shuffle sums them, and those with enough occurrences enter a
bit field of bounded size; a longer sequence is only counted where the field has both of its
shorter ends (a phrase is never more frequent than its parts).  A last scan points at the
occurrences whose fingerprints are frequent, reads the phrases there from the text, and counts
by text: fingerprints that collide part there, and those that only looked frequent fall below
the limit.  So counts are exact whatever the hashes do, and only frequent phrases become text.

A-Z becomes a-z; texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into words at spaces
and tabs; no phrase crosses a piece.  Null text: empty.  Null language: 'und'.  Rows count one by
one, repeated ones too.  No frequent phrase and an empty table give no rows.  Other columns are left
aside.  A language is a group only of sums and of a top list, which tasks shorten first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import batches as B
from wordloom.llm.fields import Tally, bit_field, field_bits, member
from wordloom.session import written

MAX_WORDS = 4
MIN_COUNT = 30
CONTAINED_PERCENT = 80
SCORE_SCALE = 2_000_000
TOP = 2_000
NO_LANGUAGE = "und"
COUNT_BYTES = 900_000  # text bytes hashed at once beside the keys that are added up

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Sequences:
    """Words of a slice of texts, one space after each, and the prefix polynomial over them."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = B.text_bytes(part.column("text"))
        first, last, _ = B.word_spans(data, offsets, _GAP)
        sizes = last - first
        self.count = len(first)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.data = np.full(int(self.end[-1]) + 1 if self.count else 0, 32, np.uint8)
        letters = np.arange(int(sizes.sum()))
        shift = np.repeat(np.arange(self.count), sizes)
        self.data[letters + shift] = _LOWER[data[~_GAP[data]]]
        text = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(first, offsets)))
        piece = np.cumsum(_CUT[data])[first]
        self.breaks = np.cumsum((np.diff(piece, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        codes = part.column("lang").dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.lang = np.asarray(codes.indices)[text]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.seed = seeds[self.lang] if self.count else np.zeros(0, np.uint64)
        self.sums = B.prefix_hashes(self.data)

    def fingerprints(self, n: int) -> np.ndarray:
        """Of the n words from each word on; the last n - 1 words have none."""
        a, b = self.start[: max(0, self.count - n + 1)], self.end[n - 1 :]
        down = B.powers(len(self.data) + 1)[1]
        return B.mix(B.mix((self.sums[b] - self.sums[a]) * down[a] + (b - a).astype(np.uint64)) + self.seed[: len(a)])

    def frequent(self, fields: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, fingerprints) by length, one length more than `fields` has: those within a piece
        whose shorter ends are in the fields.  A length that has a field is cut down by it."""
        ends = np.ones(self.count, bool)
        for n in range(1, len(fields) + 2):
            whole = self.breaks[: self.count - n + 1] == self.breaks[n - 1 :] if self.count >= n else np.zeros(0, bool)
            at = np.flatnonzero(whole & (ends if n == 1 else ends[:-1] & ends[1:])) if len(whole) else np.zeros(0, np.int64)
            prints = self.fingerprints(n)[at]
            if n <= len(fields):
                known = member(fields[n - 1], prints)
                at, prints = at[known], prints[known]
                ends = np.zeros(len(whole), bool)
                ends[at] = True
            yield at, prints

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The text of n words from each place on."""
        a, sizes = self.start[at], self.end[at + n - 1] - self.start[at]
        ends = np.cumsum(sizes)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(a - (ends - sizes), sizes)
        bounds = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, bounds, pa.py_buffer(self.data[gather])])


def sequences(batches: Iterator[pa.RecordBatch], limit: int = B.CHUNK_BYTES) -> Iterator[Sequences]:
    for batch in batches:
        for part in B.slices(batch, "text", limit):
            yield Sequences(part)


def counted(docs: DataFrame, fields: list[Broadcast], least: int) -> DataFrame:
    """(key, n): frequent fingerprints of the length after those of `fields`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for found in sequences(batches, COUNT_BYTES):
            *_, (_, prints) = found.frequent([f.value for f in fields])
            keys, n = np.unique(prints.view(np.int64), return_counts=True)
            yield from tally.add(keys, n)
        yield from tally.rows()

    return docs.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, fields: list[Broadcast]) -> DataFrame:
    """(lang, size, phrase, n) by text, for all lengths that have a field; size 0: all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(lang: str, size: int, values: pa.Array, counts: pa.Array) -> pa.RecordBatch:
            k = len(values)
            columns = [pa.array([lang] * k, pa.string()), pa.array([size] * k, pa.int32()), values.cast(pa.string()), counts]
            return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])

        for found in sequences(batches):
            for code, own in enumerate(np.bincount(found.lang, minlength=len(found.langs)).tolist()):
                yield rows(found.langs[code], 0, pa.array([""]), pa.array([own]))
            for size, (at, _) in enumerate(found.frequent([f.value for f in fields]), 1):
                if size > len(fields):
                    break
                for code in np.unique(found.lang[at]).tolist():
                    values = pc.value_counts(found.phrases(at[found.lang[at] == code], size))
                    yield rows(found.langs[code], size, values.field("values"), values.field("counts"))

    out = docs.mapInArrow(run, "lang string, size int, phrase string, n bigint")
    return out.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", words: int = MAX_WORDS, least: int = MIN_COUNT
) -> DataFrame:
    """(lang, size, phrase, n): all phrases of up to `words` words with `least` occurrences, and
    under size 0 the number of words of each language."""
    docs = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    fields: list[Broadcast] = []
    for _ in range(words):
        prints = written(counted(docs, fields, least).select("key"))
        fields.append(docs.sparkSession.sparkContext.broadcast(bit_field(prints, "key", field_bits(prints.count()))))
    return phrase_counts(docs, fields).where((F.col("size") == 0) | (F.col("n") >= least))


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of the phrases of two words and more, by their lowest cut."""
    known = counts.where("size > 0").select("lang", "phrase", F.col("n"))
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")}
    )
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "left", "n": "l"}), ["lang", "left"])
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "right", "n": "r"}), ["lang", "right"])
    score = F.expr(f"cast({SCORE_SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def independent(phrases: DataFrame, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """Without the phrases that a longer one with `percent` of their occurrences contains."""
    longer = phrases.where("size > 2").select("lang", "size", F.split("phrase", " ").alias("w"), "a")
    parts = longer.withColumn("k", F.explode(F.expr("sequence(2, size - 1)")))
    parts = parts.withColumn("i", F.explode(F.expr("sequence(1, size - k + 1)")))
    parts = parts.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = F.col("longer").isNull() | (100 * exact("longer") < percent * exact("a"))
    return phrases.join(most, ["lang", "phrase"], "left").where(kept).drop("longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counts = written(frequent_phrases(docs, text, lang, words, least))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = independent(scored(counts)).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

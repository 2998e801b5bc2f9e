"""Labelled documents -> split, vocabulary, encoded train and validation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.documents import tokenize
from wordloom.operators.encoding import encode
from wordloom.operators.splitting import apply_cuts, split_cuts, split_sizes
from wordloom.operators.vocabulary import build_vocab, vocabulary_rows
from wordloom.session import spread, written
from wordloom.settings import MAX_LEN, MAX_VOCAB_SIZE, MIN_FREQ, SEED, VAL_SIZE


@dataclass(frozen=True)
class Prepared:
    """The split cuts and the vocabulary are on disk, the row tables are lazy."""

    tokenized: DataFrame  # doc_id, label, split, tokens
    vocab: DataFrame  # idx, token, freq
    vocab_rows: int
    max_len: int

    def _encode(self, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        return encode(rows, self.vocab, self.max_len, keep=keep, vocab_rows=self.vocab_rows)

    @property
    def encoded(self) -> DataFrame:
        """(doc_id, label, split, input_ids, length) of both splits."""
        return self._encode(self.tokenized, ("label", "split"))

    def part(self, split: str) -> DataFrame:
        """One split; the other one's texts are not tokenised."""
        return self._encode(self.tokenized.where(F.col("split") == split), ("label",))

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def val(self) -> DataFrame:
        return self.part("val")

    def sizes(self) -> DataFrame:
        return split_sizes(self.tokenized, self.vocab)


def split_tokens(
    docs: DataFrame, val_size: float = VAL_SIZE, lower: bool = True, seed: int = SEED
) -> DataFrame:
    """(doc_id, label, split, tokens).  The cuts are found on (key, label) alone, so that
    pass reads no text."""
    cuts = written(split_cuts(docs, "label", "doc_id", val_size, seed))
    return tokenize(apply_cuts(spread(docs, "doc_id"), cuts, "label", "doc_id", seed), lower=lower)


def train_vocab(
    tokenized: DataFrame, max_vocab_size: int = MAX_VOCAB_SIZE, min_freq: int = MIN_FREQ
) -> DataFrame:
    """The vocabulary sees the training split only."""
    return build_vocab(tokenized.where(F.col("split") == "train"), "doc_id", max_vocab_size, min_freq)


def prepare(
    docs: DataFrame,
    val_size: float = VAL_SIZE,
    max_vocab_size: int = MAX_VOCAB_SIZE,
    min_freq: int = MIN_FREQ,
    max_len: int = MAX_LEN,
    lower: bool = True,
    seed: int = SEED,
) -> Prepared:
    """`docs` has a unique doc_id, label and text."""
    tokenized = split_tokens(docs, val_size, lower, seed)
    # read by the encoder, the vector matrix and the reports: counted once, then a small file
    vocab = train_vocab(tokenized, max_vocab_size, min_freq)
    return Prepared(tokenized, vocab, vocabulary_rows(max_vocab_size), max_len)

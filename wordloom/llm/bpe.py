"""Byte-pair encoding with word ends, and decoding, over whole tables.

Method: the distinct words of a batch lie in one flat array of symbols.  An index maps every
pair of neighbouring symbols that has a rank to all its positions.  Ranks are taken in
ascending order; each merges all its positions at once, and the pairs to the left and right
of a merge enter the lists of their own ranks.

Texts: null counts as empty; an empty text has no ids.  Strings of special tokens inside a
text become those tokens, as the tokenizer file says.  Memory: one batch of texts and a word
cache of bounded size per task.  A row depends on its own text alone, so a lost task is
simply run again; equal rows give equal rows."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from wordloom.llm.batches import slices

WORD_END = "</w>"
CACHED_RUNS = 600_000  # distinct runs a task keeps before it starts a new cache
WHITE = regex.compile(r"\p{White_Space}+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # str.split() takes these four for white space


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest for
    the code points from 256 up, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and patterns of a tokenizer file (the JSON form of the public
    tokenizers library: BPE, word ends, byte-level symbols, lower case)."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as handle:
            spec = json.load(handle)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + WORD_END] for s in byte_symbols()], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, bounds by word), by the pair occurrence index."""
    sizes = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), bounds
    symbol = vocab.inner[data]
    first, last = bounds[:-1][sizes > 0], bounds[1:][sizes > 0] - 1
    symbol[last] = vocab.last[data[last]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[last] = -1
    before[first] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Put the pairs that begin at `positions` into the lists of their ranks."""
        rank = vocab.ranks(symbol[positions], symbol[after[positions]])
        known = rank >= 0
        rank, positions = rank[known], positions[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, positions = rank[order], positions[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        starts = [0, *cuts.tolist()]
        for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)]):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(active, r)

    enter(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocab.left[r], vocab.right[r]
        at = at[alive[at] & (symbol[at] == a)]
        at = at[after[at] >= 0]
        at = at[symbol[after[at]] == b]
        if a == b and len(at) > 1:  # of overlapping occurrences the left one merges
            taken, gone = [], set()
            for p in np.sort(at).tolist():
                if p not in gone:
                    taken.append(p)
                    gone.add(int(after[p]))
            at = np.array(taken, np.int64)
        if not len(at):
            continue
        second = after[at]
        beyond = after[second]
        symbol[at] = vocab.made[r]
        alive[second] = False
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        ahead = before[at]
        enter(np.concatenate([ahead[ahead >= 0], at[linked]]))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], kept[bounds]


def _gather(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `rows` of a ragged array (flat, bounds), as a ragged array."""
    starts, counts = bounds[rows], bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - counts), counts)], np.concatenate([[0], ends])


class Encoder:
    """Texts to ids.  No word crosses white space, so a text is cut there first and the ids of
    the runs between are kept, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        names = sorted(vocab.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = regex.compile(vocab.pattern.replace(r"\s", r"\p{White_Space}"))
        self.rare_words = Split(Regex(vocab.pattern), "removed", invert=True)
        self.rare_form = Sequence([NFC(), Lowercase()])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str | int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def pieces(self, run: str) -> list[str]:
        """Words of a run without white space: normal form, lower case, the file's pattern.
        Beyond Latin letters, where Unicode versions differ, the library's own helpers do this."""
        if run.isascii():
            run = run.lower()
            if run.isalpha():
                return [run]
            return [run[:-1], run[-1]] if run[-1] in ".," and run[:-1].isalpha() else self.words.findall(run)
        if max(run) < "\u0250" and "\u0130" not in run:
            return self.words.findall(run.lower())  # all such letters are in normal form
        return [w for w, _ in self.rare_words.pre_tokenize_str(self.rare_form.normalize_str(run))]

    def runs(self, text: str) -> list[str]:
        return [r for r in WHITE.split(text) if r] if ODD_SPACE.search(text) else text.split()

    def split(self, text: str) -> list[str | int]:
        """Runs between white space, and the ids of special tokens between them."""
        if not self.special or not self.special.search(text):
            return self.runs(text)
        out: list[str | int] = []
        end = 0
        for m in self.special.finditer(text):
            out += [*self.runs(text[end : m.start()]), self.vocab.special[m[0]]]
            end = m.end()
        return out + self.runs(text[end:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text)"""
        if len(self.known) > CACHED_RUNS:
            self.clear()
        known, fresh, places = self.known, [], []
        for text in texts:
            parts = self.split(text or "")
            for p in set(parts).difference(known):
                known[p] = len(known)
                fresh.append(p)
            places.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
        if fresh:
            self._learn(fresh)
        by_text = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        ids, bounds = _gather(self.ids, self.bounds, np.concatenate([np.zeros(0, np.int64), *places]))
        return ids, bounds[by_text]

    def _learn(self, fresh: list[str | int]) -> None:
        """Append the ids of new runs."""
        index: dict[str | int, int] = {}
        places = [
            [index.setdefault(w, len(index)) for w in ([run] if isinstance(run, int) else self.pieces(run))]
            for run in fresh
        ]
        ids, bounds = encode_words(
            self.vocab, [b"" if isinstance(w, int) else w.encode("utf-8", "replace") for w in index]
        )
        for w, row in index.items():
            if isinstance(w, int):  # a special token: its one id goes where its word would be
                at = bounds[row]
                ids, bounds = np.insert(ids, at, w), np.concatenate([bounds[: row + 1], bounds[row + 1 :] + 1])
        ids, bounds = _gather(ids, bounds, np.array([w for p in places for w in p], np.int64))
        bounds = bounds[np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)]
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Token strings joined by spaces: the file names no decoder."""
    return " ".join(map(vocab.strings.__getitem__, ids.tolist()))


Finish = Callable[[Vocabulary, np.ndarray, np.ndarray], dict[str, pa.Array]]


def _over_texts(docs: DataFrame, text: str, file: str, schema: str, finish: Finish) -> DataFrame:
    """`docs` with the columns `finish` makes of the ids of each slice of rows."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(file))  # bounded: the tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                ids, bounds = encoder.encode(part.column(text).to_pylist())
                made = finish(encoder.vocab, ids, bounds)
                keep = {n: part.column(n) for n in names}
                yield pa.RecordBatch.from_pydict(keep | made)

    new = [c.split(" ")[0] for c in schema.split(", ")]
    names = [c for c in docs.columns if c not in new]
    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, f"{old}, {schema}" if old else schema)


def encode(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array<int>) and `decoded` (string); columns of these names are
    replaced."""

    def finish(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        texts = [decode(vocab, ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return {
            "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
            "decoded": pa.array(texts, pa.string()),
        }

    return _over_texts(docs, text, file, "ids array<int>, decoded string", finish)


def digests(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the ids and decoded texts of `encode` as
    digests, taken where they are made, so that no id leaves its task."""

    def finish(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return {
            "n_tokens": pa.array(np.diff(bounds), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
            "decoded_sha256": pa.array(
                [hashlib.sha256(decode(vocab, r).encode("utf-8")).hexdigest() for r in rows], pa.string()
            ),
        }

    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = _over_texts(docs.select(F.col(key), F.col(text)), text, file, made, finish)
    return rows.select(key, "n_tokens", "ids_sha256", "decoded_sha256")

"""Language identification with unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary; each language has a probability for each piece. The likelihood of a word
is the sum, over every way to cut it into pieces, of the product of the pieces' probabilities, computed by
the forward algorithm over the whole word, however long. A text's likelihood is the product over its words.

Languages are held in groups, so a model of any number of them needs the memory of one group at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.common import fresh, ship, stash

LETTERS = regex.compile(r"\p{L}+")
START = "▁"  # begins the pieces that begin a word
UNKNOWN = "und"
GAP = "\n"  # between words that are looked through together; no piece has it
PACK = 1 << 10
WORD_BYTES = 150  # of a remembered word besides its numbers: the text, and its place in the table

COUNTS = "lang string, piece int, n long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.int64())])


@lru_cache(maxsize=2)
def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, dict[str, int], int]:
    """The processor, its pieces (without control and byte pieces), and the longest piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = {model.id_to_piece(i): i for i in plain}
    return model, pieces, max(map(len, pieces))


@lru_cache(maxsize=2)
def piece_finder(path: str) -> ahocorasick.Automaton:
    """Finds all pieces in a text in one pass; the value of a piece is its number times ``PACK`` and its length."""
    machine = ahocorasick.Automaton()
    for piece, number in load(path)[1].items():
        machine.add_word(piece, number * PACK + len(piece))
    machine.make_automaton()
    return machine


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def piece_counts(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", memory: int = 100_000) -> DataFrame:
    """(lang, piece, n): how often each piece of the vocabulary occurs in the documents of a language.

    Each task counts words first and cuts each distinct word once with the vocabulary's own segmentation;
    it sends at most languages x pieces rows per ``memory`` distinct words, which are summed by key.
    """
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, _ = load(vocabulary)
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs, pieces, ns = [], [], []
            for lang, words in counts.items():
                total = np.zeros(model.get_piece_size(), np.int64)
                listed = list(words)
                for k in range(0, len(listed), 10_000):
                    part = listed[k : k + 10_000]
                    cut = model.encode(part, num_threads=1)
                    often = np.repeat([words[w] for w in part], list(map(len, cut)))
                    flat = np.fromiter(chain.from_iterable(cut), np.int64)
                    total += np.bincount(flat, often, len(total)).astype(np.int64)
                seen = np.flatnonzero(total)
                langs += [lang] * len(seen)
                pieces += seen.tolist()
                ns += total[seen].tolist()
            counts.clear()
            return record_batch(COUNTS_ARROW, lang=langs, piece=pieces, n=ns)

        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > memory:
                yield flush()
        yield flush()

    parts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class LanguageGroup:
    """Probabilities of pieces (rows; the last but one for letters outside the vocabulary, the last is zero) by language."""

    langs: list[str]
    probs: np.ndarray


@dataclass
class Model:
    """Piece counts by language, a written table, and the languages by name in groups."""

    counts: DataFrame
    groups: list[list[str]]
    smooth: float

    def group(self, langs: list[str], vocabulary: str) -> LanguageGroup:
        """The probabilities of some languages: as many numbers as languages x pieces, whatever the rows."""
        model, pieces, _ = load(vocabulary)
        size = model.get_piece_size()
        found = self.counts.where(F.col("lang").isin(langs)).toArrow()
        column = {lang: k for k, lang in enumerate(langs)}
        at = np.array([column[x] for x in found.column("lang").to_pylist()], np.int64)
        table = np.zeros((size + 2, len(langs)))
        np.add.at(table, (found.column("piece").to_numpy(), at), found.column("n").to_numpy())
        usable = np.zeros(size, bool)
        usable[list(pieces.values())] = True
        table[:size][~usable] = 0
        table[:size][usable] += self.smooth
        table[size] = self.smooth
        return LanguageGroup(langs, table / table.sum(axis=0, keepdims=True))


def fit(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.1, group_size: int = 100) -> Model:
    """Learn from all rows with a language and a text. Any number of languages; ``group_size`` of them are held at once."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = stash(piece_counts(labelled, vocabulary, lang_col, text_col), "piece-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    return Model(counts, [langs[k : k + group_size] for k in range(0, len(langs), group_size)], smooth)


class Scorer:
    """Log-likelihoods of words by language; remembers words up to about ``memory`` bytes, then only those it meets again."""

    def __init__(self, model: LanguageGroup, vocabulary: str, memory: int = 48 << 20):
        _, pieces, self.longest = load(vocabulary)
        self.finder = piece_finder(vocabulary)
        self.probs = model.probs
        self.most = max(1, memory // (8 * len(model.langs) + WORD_BYTES))
        self.other = len(model.probs) - 2  # row of letters outside the vocabulary; the row after it is zero
        self.row: dict[str, int] = {}
        self.logs = np.empty((1024, len(model.langs)))  # grows by doubling; the first len(self.row) rows are in use

    def pieces_from(self, words: list[str], begin: int, count: int) -> np.ndarray:
        """[start - begin, length, word]: the piece of that length at that place; a letter alone is always one."""
        n, none, deep = len(words), self.other + 1, self.longest + 1
        parts = [w[begin : begin + count + deep - 2] for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, n) + 1
        found = np.fromiter(chain.from_iterable(self.finder.iter(GAP.join(parts))), np.int64).reshape(-1, 2)
        length, piece = found[:, 1] % PACK, found[:, 1] // PACK
        start = found[:, 0] - length + 1  # in the joined parts
        word = np.repeat(np.arange(n), sizes)[start]
        place = start - (np.cumsum(sizes) - sizes)[word]
        here = place < count
        cells = ((place * deep + length) * n + word)[here]
        ids = np.full((count, deep, n), none, np.int32)
        ids.ravel()[cells] = piece[here]
        ids[:, 1][ids[:, 1] == none] = self.other
        return ids

    def forward(self, words: list[str], chunk: int = 512, pause: int = 4) -> np.ndarray:
        """Log of the sum over all segmentations, for words of similar length at once.

        ``ahead[k]`` is the sum for the first ``at + k`` letters, divided by ``exp(scale)``: products of many pieces are too
        small for a number, so every ``pause`` letters what is ahead is divided by its largest value. A chunk of places is looked
        up at a time, so memory does not depend on the length of a word.
        """
        n, none = len(words), self.other + 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = set(sizes.tolist())
        ahead = np.zeros((self.longest + 1, n, self.probs.shape[1]))
        ahead[0] = 1
        scale = np.zeros(ahead.shape[1:])
        out = np.zeros(ahead.shape[1:])
        for at in range(sizes.max() + 1):
            if at in ends:
                done = sizes == at
                out[done] = np.log(ahead[0, done]) + scale[done]
            if at == sizes.max():
                break
            if at % chunk == 0:
                ids = self.pieces_from(words, at, min(chunk, int(sizes.max()) - at))
                lengths = [np.flatnonzero(some) for some in (ids != none).any(axis=2)]
            for k in lengths[at % chunk]:
                row = ids[at % chunk, k]
                used = np.flatnonzero(row != none)
                ahead[k, used] += ahead[0, used] * self.probs[row[used]]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
            if at % pause == pause - 1:
                top = ahead.max(axis=0)
                top[top == 0] = 1
                ahead /= top
                scale += np.log(top)
        return out

    def learn(self, words: set[str], letters: int = 60_000) -> None:
        """Score words, as many of similar length at once as have about ``letters`` letters."""
        listed = sorted(words, key=len)
        base, at = len(self.row), 0
        if base + len(listed) > len(self.logs):
            held = self.logs[:base]
            self.logs = np.empty((max(2 * len(self.logs), base + len(listed)), held.shape[1]))
            self.logs[:base] = held
        while at < len(listed):
            upto = at + 1
            while upto < len(listed) and (upto + 1 - at) * (len(listed[upto]) + 1) <= letters:
                upto += 1
            self.logs[base + at : base + upto] = self.forward([START + w for w in listed[at:upto]])
            at = upto
        self.row.update(zip(listed, range(base, base + len(listed)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log-likelihoods of each text, None without a letter."""
        split = [words_of(t) for t in texts]
        fresh = set().union(*split)
        if len(self.row) > self.most:
            again = list(fresh & self.row.keys())
            self.logs[: len(again)] = self.logs[[self.row[w] for w in again]]
            self.row = {w: k for k, w in enumerate(again)}
        self.learn(fresh - self.row.keys())
        return [self.logs[list(map(self.row.__getitem__, words))].sum(axis=0) if words else None for words in split]


def add_language(docs: DataFrame, model: Model, vocabulary: str, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows and columns of ``docs`` and two columns more: the language and its posterior under equal priors (0 to 1).

    ``und`` with score 0 for a text that is null or has no letter, or if nothing was learned. Equal
    likelihoods: the first language by name. A group of languages has a bounded size and is broadcast; there is no
    shuffle. With several groups, the best language so far and the sum of likelihoods are written with the rows between them.
    """
    ship(docs.sparkSession)
    lang, top, total = fresh(docs, "__lang", "__top", "__total")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in ((lang, "string"), (top, "double"), (total, "double"))]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *none)
    for k, langs in enumerate(model.groups):
        rows = _score(rows, model.group(langs, vocabulary), vocabulary, text_col, (lang, top, total))
        if k + 1 < len(model.groups):
            rows = stash(rows, "language-group")
    score = F.when(F.col(lang).isNull(), 0.0).otherwise(F.exp(F.col(top) - F.col(total)))
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return rows.select(*plain, F.coalesce(lang, F.lit(UNKNOWN)).alias(names[0]), F.least(score, F.lit(1.0)).alias(names[1]))


def _score(rows: DataFrame, group: LanguageGroup, vocabulary: str, text_col: str, state: tuple[str, str, str]) -> DataFrame:
    """``rows`` with their state (best language, its log-likelihood, log of the sum of all) brought up to date by a group."""
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value.langs
        scorer = Scorer(shared.value, vocabulary)
        for part, texts in slices(batches, text_col):
            held = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in state), strict=True)
            new = []
            for logs, (lang, top, total) in zip(scorer(texts), held, strict=True):
                if logs is not None:
                    best = int(logs.argmax())
                    total = float(np.logaddexp.reduce(logs if total is None else np.append(logs, total)))
                    if top is None or logs[best] > top:
                        lang, top = langs[best], float(logs[best])
                new.append((lang, top, total))
            lang, top, total = zip(*new, strict=True)
            kept = part.columns[: part.num_columns - len(state)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())], part.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: -len(state)], *(T.StructField(c, t) for c, t in zip(state, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))]))


def predict(docs: DataFrame, model: Model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, as ``add_language`` gives them. Other columns are not read."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return add_language(slim, model, vocabulary).drop("text")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))

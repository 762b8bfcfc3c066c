"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

The encoding of a word's prefix is known from its last token and the prefix before that token. Each trie
node therefore holds one state, and a prefix that many words share is encoded once. Which token ends a
prefix follows from a test on token pairs: two adjacent tokens can stand side by side only if no merge
across their border would have come before the merges that built them.

Texts are cut into words by Python's tables of letters and cases where these agree with the tokenizers library's; texts with
other characters are normalised and cut by the library's own tables, which belong to another version of Unicode.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.llm.batches import record_batch, slices
from spanlight.llm.common import ship

OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
ENCODED = "doc_id long, ids array<int>, decoded string"
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


#: Blocks of characters on whose class, case and composition all Unicode versions agree; a test goes through them.
AGREED = regex.compile("[^\\u0000-\\u052F\\u1E00-\\u202E\\u2030-\\u205E\\u2190-\\u23FF\\u2500-\\u27BF\\u3001-\\u3029\\u3041-\\u3096\\u30A1-\\u30FF\\u4E00-\\u9FA5\\uAC00-\\uD7A3\\U0001F300-\\U0001F5FF\\U0001F600-\\U0001F64F]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints in Latin-1, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary of a ``tokenizers`` file of kind BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(self.text_of) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.pairs: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pairs[i << 20 | j] = r
            self.rank[made], self.left[made], self.right[made] = r, i, j
        #: Tokens inside a word and tokens that end one (without the mark), by their text; any other text
        #: that a longer token ends with has -1, so a search from the short end knows when to stop.
        self.inner = self.tails({t: i for t, i in self.vocab.items() if not t.endswith(self.end)})
        self.final = self.tails({t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)})
        self.length = [0] * size
        for tokens in (self.inner, self.final):
            for text, i in tokens.items():
                if i >= 0:
                    self.length[i] = len(text)
        self.letters = byte_letters()
        self.fits: dict[int, bool] = {}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.path = path
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is how their joint text is encoded.

        Undoes the merges next to the border from the last to the first; ``until`` is the first rank that is too
        late for a merge across the border while two given parts touch. Of equal ranks the left one goes first.
        """
        key = a << 20 | b
        if (known := self.fits.get(key)) is not None:
            return known
        rank, pairs, until = self.rank, self.pairs, len(self.rank)
        while True:
            crossing = pairs.get(a << 20 | b)
            if crossing is not None and crossing < until:
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:
                fits = True
                break
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            else:
                until, b = rank[b] + 1, self.left[b]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    @staticmethod
    def tails(tokens: dict[str, int]) -> dict[str, int]:
        return {t[k:]: -1 for t in tokens for k in range(1, len(t))} | tokens

    def last_token(self, letters: str, depth: int, ends: list[int], tokens: dict[str, int]) -> int:
        """The token that ends the first ``depth`` letters, given the last tokens of all shorter prefixes."""
        get, known = tokens.get, self.fits.get
        for start in range(depth - 1, -1, -1):
            token = get(letters[start:depth])
            if token is None:
                break
            if token >= 0:
                if not start:
                    return token
                fits = known(ends[start] << 20 | token)
                if self.side_by_side(ends[start], token) if fits is None else fits:
                    return token
        raise ValueError(f"no token ends {letters[:depth]!r}")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Encodings of distinct words, which must not be empty, in the order of their byte letters.

        Sorted, the words list the leaves of their trie in depth-first order. The path from the root to the current
        node is ``path``, with the last token of each prefix in ``ends`` and its length in ``spans``. Going to the
        next word keeps the states of the shared prefix.
        """
        letter, length, inner, final = self.letters, self.length, self.inner, self.final
        entries = sorted(("".join([letter[b] for b in w.encode()]), w) for w in words)
        path, ends, spans = "", [0], [0]
        for letters, word in entries:
            n = len(letters)
            shared, most = 0, min(len(path), n - 1)
            while shared < most and path[shared] == letters[shared]:
                shared += 1
            del ends[shared + 1 :], spans[shared + 1 :]
            for depth in range(shared + 1, n):
                token = self.last_token(letters, depth, ends, inner)
                ends.append(token)
                spans.append(length[token])
            path = letters[: n - 1]
            last = self.last_token(letters, n, ends, final)
            ids, depth = [last], n - length[last]
            while depth:
                ids.append(ends[depth])
                depth -= spans[depth]
            ids.reverse()
            yield word, ids

    def split(self, text: str) -> list[str]:
        """Words of a text, its special tokens among them."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        words: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                words.append(part)
            elif part:
                words += self.split_by_library(part) if AGREED.search(part) else self.split_plain(part)
        return words

    def split_plain(self, part: str) -> list[str]:
        return self.word.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def split_by_library(self, part: str) -> list[str]:
        library = load_library(self.path)
        plain = library.normalizer.normalize_str(part)
        return [plain[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(plain)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def load_library(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes batches of texts; remembers words up to a number of them, then only those it meets again."""

    def __init__(self, path: str, memory: int = 100_000):
        self.bpe, self.memory = load(path), memory
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers and the decoded text (tokens joined by spaces), for each text."""
        split = [self.bpe.split(t) if t else [] for t in texts]
        fresh = set().union(*split)
        if len(self.ids) > self.memory:
            again = fresh & self.ids.keys()
            self.ids, self.text = ({w: held[w] for w in again} for held in (self.ids, self.text))
        fresh -= self.ids.keys()
        for word in fresh & self.bpe.special.keys():
            self.ids[word], self.text[word] = self.bpe.special[word].to_bytes(4, "little"), word
        text_of = self.bpe.text_of
        for word, ids in self.bpe.encode_words(fresh - self.bpe.special.keys()):
            self.ids[word] = pack(ids)
            self.text[word] = " ".join([text_of[i] for i in ids])
        for words in split:
            yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.text.__getitem__, words))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no tokens, and the digests of no bytes. ``vocabulary`` is a path on every
    executor. Tasks hold about a megabyte of text at a time, or one longer text; there is no shuffle.
    """
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for part, texts in slices(batches):
            coded = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in encode(texts)]
            n, ids, decoded = zip(*coded, strict=True)
            yield record_batch(ARROW, doc_id=part.column(0), n_tokens=n, ids_sha256=ids, decoded_sha256=decoded)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUTPUT)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array), decoded (text). Null text counts as empty."""
    ship(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part, texts in slices(batches):
            ids, decoded = zip(*encoder(texts), strict=True)
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield record_batch(ENCODED_ARROW, doc_id=part.column(0), ids=lists, decoded=decoded)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): tokens joined by spaces; ids outside the vocabulary are skipped, null ids are empty."""
    ship(coded.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = load(vocabulary).text_of
        for batch in batches:
            texts = [" ".join([text_of[i] for i in ids or () if i in text_of]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")

"""BPE encoding and decoding on a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from veritab.llm.common import Kept, slices, texts_of

_NONE = 1 << 60
#: Words of more bytes are merged with a heap.
LONG_WORD = 128
#: Longer pieces are not kept.
LONG_PIECE = 256
_WORD_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class WordBpe:
    """The word_bpe vocabulary: NFC, white space, lower case, words by pattern, BPE with word ends.

    Gives what tokenizers gives for encode(text, add_special_tokens=False) and decode(ids, skip_special_tokens=False).
    """

    def __init__(self, path: str, most: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.alphabet = byte_alphabet()
        self.by_word, self.by_piece = Kept(most), Kept(most)

    def merge(self, chars: str) -> list[int]:
        """Ids of one word in the byte alphabet. starts holds part boundaries, ranks the rank of each part joined with the next."""
        ends = [*chars[:-1], chars[-1] + _WORD_END]
        if len(ends) > LONG_WORD:
            return self._merge_long(ends)
        word, rank_of = chars + _WORD_END, self.ranks.get
        starts = [*range(len(ends)), len(word)]
        ranks = [rank_of(pair, _NONE) for pair in zip(ends, ends[1:])]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            del starts[i + 1], ranks[i]
            here, middle = starts[i], starts[i + 1]
            merged = word[here:middle]
            if i < len(ranks):
                ranks[i] = rank_of((merged, word[middle : starts[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = rank_of((word[starts[i - 1] : here], merged), _NONE)
        return [self.vocab[p] for a, b in zip(starts, starts[1:]) if (p := word[a:b]) in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same merges for a long word, whose array would be scanned too often: a heap of (rank, place) over linked parts."""
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or self.ranks.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.vocab[p] for p in parts if p and p in self.vocab]

    def _word(self, word: str) -> bytes:
        found = self.by_word.young.get(word)
        if found is None:
            found = self.by_word.again(word)
        if found is None:
            self.by_word.turn()
            found = self.by_word.young[word] = array("I", self.merge("".join([self.alphabet[b] for b in word.encode("utf-8")]))).tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if not text.isascii() and max(text) >= "\u0180":
            # Python's tables are newer than the library's, so beyond Latin letters its own normaliser and tables decide.
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join(array("I", self.merge(w)).tobytes() for w, _ in words)
        return b"".join(map(self._word, self.words.findall(text.lower())))

    def _piece(self, piece: str) -> tuple[bytes, str]:
        parts = self.cut.split(piece) if "<|" in piece else [piece]
        ids = b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder: tokens are joined by one space."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text.

        Words never span a space, and no character joins with a space under NFC, so pieces between spaces are
        encoded apart; frequent ones are kept.
        """
        out = []
        known = self.by_piece
        for text in texts:
            pieces = text.split(" ")
            known.turn()
            young = known.young
            new = set(pieces).difference(young)
            for p in new:
                if known.again(p) is None:
                    young[p] = self._piece(p)
            got = [young[p] for p in pieces]
            out.append((b"".join([a for a, _ in got]), " ".join([b for _, b in got if b])))
            for p in new:
                if len(p) > LONG_PIECE:
                    known.drop(p)
        return out


@lru_cache(maxsize=4)
def codec_for(path: str) -> WordBpe:
    """One codec a worker process and vocabulary."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded of every text of docs (doc_id, text).

    Null counts as empty; an empty text has no ids and decodes to the empty text. Rows are independent: repeated
    rows come out alike, other columns are not read, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), texts_of(batch.column("text"))
            for a, b in slices(texts):
                done = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_decode() as digests made where the ids are: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), texts_of(batch.column("text"))
            for a, b in slices(texts):
                done = codec.encode(texts[a:b])
                n = pa.array([len(x) // 4 for x, _ in done], pa.int64())
                shas = [pa.array([hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest() for x in col]) for col in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), n, *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"))

"""SentencePiece encoding and decoding with states shared by common prefixes.

A text is marked (blanks become the mark, one mark goes in front) and split into marked words, which no piece spans. The
distinct new words of a slice of texts are sorted; sorted order is the depth-first order of their trie, so a stack holds
the forward state of every prefix on the current path and a word computes only what lies beyond the prefix it shares
with its neighbour. Backward steps along the stack give the pieces.

* Unigram models: the state is the best score (Viterbi).
* BPE models have merge ranks instead of scores that add up, and the best sum is not what the model means. There the
  state is the last piece of the prefix's encoding, which is unique: a piece may end a prefix exactly if merging the
  characters of the piece before it and its own yields these two again. All else (trie, stack, backward steps) is shared.

Everything runs inside Arrow batches, in slices of bounded size, with a cache of bounded size; nothing is shuffled. The
vocabulary is read on the driver and broadcast: its size is that of the model, whatever the input.

Defined cases: null and empty texts give no ids. Characters outside the vocabulary become byte pieces, or the unknown
piece where the model has none. A mark character in a text reads back as a blank, as in the public library. Rows are kept as
they are, repeated ones too; further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import slices

MARK = "▁"
#: Marked words (twice: a new and an old cache) and piece pairs that a Python worker remembers. A word takes about 190 bytes, and
#: workers keep what they remember for as long as they live.
CACHED_WORDS, CACHED_PAIRS = 150_000, 400_000
#: Characters of texts that are split at a time; their new words may come on top of the bound.
SLICE = 500_000
#: Numbers of characters that are no piece begin here, as last pieces of a prefix.
FOREIGN = 1 << 21


@dataclass
class Vocabulary:
    """Pieces of a model. Ranks rise from the best score on."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int] = field(default_factory=dict)
    special: frozenset[int] = frozenset()
    unknown: int = 0
    unigram: bool = False

    def key(self) -> str:
        """Tells models apart."""
        held = hashlib.sha256(repr((self.pieces, self.scores, sorted(self.byte_ids.items()), sorted(self.special), self.unknown, self.unigram)).encode("utf-8", "surrogatepass"))
        return held.hexdigest()

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file with the public library; only identity normalisation with a mark in front is supported."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a leading mark are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        return Vocabulary(
            pieces, [sp.get_score(i) for i in range(n)], {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)},
            frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)),
            sp.unk_id(), proto.trainer_spec.model_type == 1)


class Encoder:
    """Encodes marked words; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.decoder = Decoder(v)
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in v.special}
        self.score = {p: v.scores[i] for p, i in self.ids.items()}
        self.floor = min(self.score.values(), default=0.0) - 10.0
        longer: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                longer.setdefault(p[-3:], set()).add(len(p))
        self.longer = {end: sorted(found, reverse=True) for end, found in longer.items()}
        self.sizes: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.splitter = re.compile(".+" if inner else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", re.S) if not any("\n" in p for p in self.ids) \
            else re.compile(".+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.forget()

    def forget(self) -> None:
        """Begin a new cache; the one before it is kept to copy from."""
        self.older: dict[str, int] = getattr(self, "known", {})
        if self.older:
            self.old_flat, self.old_starts, self.old_lengths, self.old_whole = self.flat, self.starts, self.lengths, self.whole
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = array("i"), array("q"), array("q")
        self.whole = bytearray()  # whether the ids of a word read back as the word

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging of the best pair, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    at, best = i, s
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def text_of(self, number: int) -> str:
        return chr(number - FOREIGN) if number >= FOREIGN else self.vocabulary.pieces[number] if number >= 0 else ""

    def follows(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their characters are merged; -1 on the left asks for the right one alone."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        before, piece = self.text_of(left), self.text_of(right)
        known = self.pairs[left << 24 | right] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return known

    def foreign(self, number: int) -> list[int]:
        """Ids, last first, of a character that is no piece."""
        v = self.vocabulary
        return [v.byte_ids[b] for b in reversed(chr(number - FOREIGN).encode("utf-8", "surrogatepass"))] if v.byte_ids else [v.unknown]

    def ending(self, tail: str) -> tuple[int, ...]:
        """Lengths that a piece ending in these last three characters may have, longest first."""
        if len(self.sizes) >= CACHED_PAIRS:
            self.sizes.clear()
        short = [n for n in (2, 1) if n <= len(tail) and tail[-n:] in self.ids]
        found = self.sizes[tail] = (*(self.longer.get(tail, ()) if len(tail) > 2 else ()), *short)
        return found

    def split(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of distinct words, in sorted order. The stacks hold, for each prefix of the current word, its last piece, where
        that begins and (unigram models) the score."""
        path, last, first, total = "", [-1], [0], [0.0]
        ids, score, unigram, sizes_of, piece_of, known_pair = self.ids, self.score, self.vocabulary.unigram, self.sizes.get, self.ids.get, self.pairs.get
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], first[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 if end > 3 else 0 : end]
                lengths = sizes_of(tail)
                if lengths is None:
                    lengths = self.ending(tail)
                found, best = -1, self.floor + total[end - 1]
                for n in lengths:
                    start = end - n
                    if start < 0:
                        continue
                    piece = piece_of(word[start:end])
                    if piece is None:
                        continue
                    if unigram:
                        if total[start] + score[word[start:end]] > best:
                            found, best, begin = piece, total[start] + score[word[start:end]], start
                        continue
                    fits = known_pair(last[start] << 24 | piece)
                    if self.follows(last[start], piece) if fits is None else fits:
                        found, begin = piece, start
                        break
                if found >= 0:
                    last.append(found)
                    first.append(begin)
                else:
                    last.append(ids.get(word[end - 1], FOREIGN + ord(word[end - 1])))
                    first.append(end - 1)
                total.append(best)
            path, own, end = word, [], len(word)
            while end:
                number = last[end]
                if number < FOREIGN:
                    own.append(number)
                else:
                    own += self.foreign(number)
                end = first[end]
            own.reverse()
            yield word, own

    def learn(self, words: set[str]) -> None:
        """Put new words into the cache; those that the cache before it still holds are copied."""
        known, starts, lengths, flat = self.known, self.starts, self.lengths, self.flat
        new = []
        for word in words:
            if (at := self.older.get(word)) is None:
                new.append(word)
            else:
                known[word] = len(starts)
                starts.append(len(flat))
                lengths.append(self.old_lengths[at])
                self.whole.append(self.old_whole[at])
                flat.extend(self.old_flat[self.old_starts[at] : self.old_starts[at] + self.old_lengths[at]])
        for word, own in self.split(new):
            known[word] = len(starts)
            starts.append(len(flat))
            lengths.append(len(own))
            self.whole.append(self.decoder.joined(own) == word.replace(MARK, " "))
            flat.extend(own)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (with the end of the last)."""
        return self.encode_words(texts)[:2]

    def encode_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Ids and starts as ``encode`` gives them, and the marked words: their places in the cache and where each text's begin."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += self.splitter.findall(MARK + text.replace(" ", MARK))
            ends.append(len(words))
        if len(self.known) >= CACHED_WORDS:
            self.forget()
        self.learn(set(words).difference(self.known))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64), at, ends
        lengths, starts = np.frombuffer(self.lengths, np.int64)[at], np.frombuffer(self.starts, np.int64)[at]  # views: nothing is copied but what is asked for
        stop = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(starts - stop[:-1], lengths) + np.arange(stop[-1])
        return np.frombuffer(self.flat, np.int32)[place], stop[np.array(ends)], at, ends

    def reads_back(self, texts: list[str | None], ids: np.ndarray, stop: np.ndarray, at: np.ndarray, ends: list[int]) -> list[bool]:
        """Whether the ids of each text decode to it. Pieces and byte sequences lie within a word, and each cached word's ids
        were decoded when it was split; a text with a word that differs is decoded as a whole."""
        good = np.concatenate([[0], np.cumsum(np.frombuffer(self.whole, np.uint8)[at])]) if len(at) else np.zeros(1, np.int64)
        edges = np.array(ends)
        sound = good[edges[1:]] - good[edges[:-1]] == np.diff(edges)
        return [bool(s) or self.decoder.decode(ids[a:b]) == (t or "").replace(MARK, " ") for t, s, a, b in zip(texts, sound, stop, stop[1:])]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        byte_of = {i: b for b, i in v.byte_ids.items()}
        hidden = v.special - byte_of.keys()
        self.text = ["" if i in hidden else chr(byte_of[i]) if i in byte_of else p.replace(MARK, " ") for i, p in enumerate(v.pieces)]
        self.high = frozenset(i for i, b in byte_of.items() if b >= 0x80)
        self.byte_of = byte_of

    def joined(self, ids: list[int]) -> str:
        """Bytes above ASCII are joined with their neighbours; broken sequences become the replacement character."""
        if self.high.isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8", "surrogatepass") for i in ids)
        return raw.decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids`` without the leading mark."""
        text = self.joined(ids.tolist())
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder_of(key: str, vocabulary: Vocabulary) -> Encoder:
    """The encoder of a Python worker, with what it has learnt from earlier tasks; that of the last model only."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, round_trip: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens``; with ``round_trip`` also whether decoding the ids gives the text back."""
    held, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key()
    columns = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens", "round_trip")]

    kept = [f for f in columns if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, held.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE):
                ids, stop, *words = encoder.encode_words(texts[a:b])
                out = batch.slice(a, b - a)
                columns_out = [*[out.column(f.name) for f in kept], pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids)), pa.array(np.diff(stop))]
                names = [*[f.name for f in kept], "ids", "n_tokens"]
                if round_trip:
                    columns_out.append(pa.array(encoder.reads_back(texts[a:b], ids, stop, *words), pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns_out, names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids array<int>", "n_tokens long"] + ["round_trip boolean"] * round_trip)
    return docs.select(*[f"`{f.name}`" for f in columns]).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``text`` decoded from ``ids``; null ids give null."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    columns = [f for f in tokens.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            texts = [None if ids is None else decoder.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["text string"])
    return tokens.select(*[f"`{f.name}`" for f in columns]).mapInArrow(run, schema)

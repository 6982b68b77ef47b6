"""Byte-pair encoding and decoding as a streaming transducer with bounded lookahead.

A merge list turns a word into tokens by applying its rules in order of rank. Text that is
appended on the right can only change tokens near the end: a change moves to the left by the
left part of one rule at a time, along rules of rising rank, each of whose right parts begins
with the left part before it. The longest such chain is the merge list's *sufficient
lookahead*. A token that ends further than that from the end of what has been read is stable
and is emitted, so that a word of any length passes through a window of fixed size. Texts are read
in blocks cut at white space; words met before come from a memory bounded by its bytes. Decoding
is a state machine from ids to text, fed the same way. Memory beyond the text itself grows with the
longest run without white space, not with the text.

Definitions: a null text is empty and has no tokens; names of added tokens inside a text are
those tokens; other columns are passed by; rows are never merged, so repeated rows and null ids
come out as they went in; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import narrow

WORD_BPE = "word_bpe_49k.json"

# Fixed values of the tokenizer file: its splitting pattern, its word end, and the white space
# between words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPACES = "\t-\r \x85\xa0  -     　"

# Characters that Python takes for white space and the tokenizer does not.
_PYTHON_ONLY_SPACE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(f"[{SPACES}]+")
_PIECES = regex.compile(SPLIT.replace(r"\s", SPACES))

# Bytes of words that a worker remembers in each of two generations, roughly, and the longest
# words worth it.
CACHE_BYTES = 48_000_000
CACHE_CHARS = 64
# What an entry takes besides its word and its tokens.
ENTRY_BYTES = 200
# Characters of a text that are encoded, and ids that are decoded, at a time.
BLOCK = 1 << 16
_FAR = 1 << 60


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in
    Latin-1, otherwise the next one free from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, free = [], 256
    for byte in range(256):
        if byte in printable:
            signs.append(chr(byte))
        else:
            signs.append(chr(free))
            free += 1
    return signs


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The longest way, in symbols, that appended text can change tokens to the left of it."""
    best: dict[str, int] = {}
    longest = 0
    for left, right in merges:
        reach = max((best.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        reach += len(left)
        if reach > best.get(left, 0):
            best[left] = reach
        longest = max(longest, reach)
    return longest + 1


class Recent:
    """A memory of words bounded by its bytes: when the young half is full it becomes the old half,
    and what is asked for again moves over, so words in use stay and the rest is forgotten."""

    def __init__(self, most: int = CACHE_BYTES):
        self.young: dict = {}
        self.old: dict = {}
        self.most, self.size = most, 0

    def put(self, key, value) -> None:
        size = ENTRY_BYTES + len(key) + len(value)
        if self.size + size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.size += size
        self.young[key] = value

    def again(self, key):
        """What the old half has, moved to the young half; None if it has nothing."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value


class Transducer:
    """One tokenizer file, ready to encode and decode; its memory does not grow with the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        signs = byte_alphabet()
        self.inner = [vocab[sign] for sign in signs]
        self.final = [vocab[sign + WORD_END] for sign in signs]
        self.width = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: at for at, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        # A word end belongs to its last symbol and has no length of its own.
        plain = [(a, b.removesuffix(WORD_END)) for a, b in merges]
        self.lookahead = sufficient_lookahead(plain)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.tokens = [""] * self.width
        for token, at in [*vocab.items(), *self.added.items()]:
            self.tokens[at] = token
        # Symbols in a token: characters of the byte alphabet, without the word end.
        self.length = [len(t.removesuffix(WORD_END)) for t in self.tokens]
        self.known = Recent()
        byte_of = {sign: byte for byte, sign in enumerate(signs)}
        self.raw = [self._bytes_of(token, byte_of) for token in self.tokens]
        self.names = [token.encode() for token in self.tokens]

    def _bytes_of(self, token: str, byte_of: dict[str, int]) -> bytes:
        if token in self.added:
            return token.encode()
        word_end = token.endswith(WORD_END)
        return bytes(byte_of[s] for s in token.removesuffix(WORD_END)) + b" " * word_end

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the rules to a short list of symbols, lowest rank first, leftmost first."""
        get, width, merged = self.rank.get, self.width, self.merged
        ranks = [get(a * width + b, _FAR) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            low = min(ranks)
            if low == _FAR:
                break
            at = ranks.index(low)
            new = symbols[at] = merged[low]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(symbols[at - 1] * width + new, _FAR)
            if at < len(ranks):
                ranks[at] = get(new * width + symbols[at + 1], _FAR)
        return symbols

    def stream(self, blocks):
        """Tokens of one word whose bytes arrive in ``blocks``, emitted once they are stable."""
        pending = bytearray()
        room = 2 * self.lookahead + 256
        for block in blocks:
            for at in range(0, len(block), room):
                pending += block[at : at + room]
                # The last byte may still turn out to be the end of the word.
                stable = len(pending) - 1 - self.lookahead
                if stable < self.lookahead:
                    continue
                done = 0
                for token in self.merge([self.inner[b] for b in pending]):
                    if done + self.length[token] > stable:
                        break
                    done += self.length[token]
                    yield token
                del pending[:done]
        if pending:
            yield from self.last(pending)

    def last(self, window: bytes) -> list[int]:
        """Tokens of what the window holds when a word ends: of a short one, that is all of it."""
        symbols = list(map(self.inner.__getitem__, window))
        symbols[-1] = self.final[window[-1]]
        return self.merge(symbols)

    def fresh(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        # Nothing of a word within the lookahead is stable before its end.
        return array("I", self.last(data) if len(data) <= self.lookahead else self.stream([data])).tobytes()

    def word(self, piece: str) -> bytes:
        """Ids of a piece in lower case. An ASCII one has the same ids standing alone, so it is
        remembered with the words of texts."""
        if not piece.isascii() or len(piece) > CACHE_CHARS:
            return self.fresh(piece)
        found = self.known.young.get(piece) or self.known.again(piece)
        if not found:
            found = self.fresh(piece)
            self.known.put(piece, found)
        return found

    def plain(self, chunk: str) -> bytes:
        """Tokens of text without white space and without added tokens."""
        lowered = chunk
        if not chunk.isascii():
            # Letters are lowered one by one: a capital sigma has no special form at the end.
            lowered = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        lowered = lowered.lower()
        if lowered.isalpha():
            return self.fresh(lowered) if lowered == chunk else self.word(lowered)
        pieces = _PIECES.findall(lowered)
        if pieces == [chunk]:
            return self.fresh(chunk)
        return b"".join([self.word(piece) for piece in pieces])

    def chunk(self, chunk: str) -> bytes:
        found = self.known.again(chunk)
        if found:
            return found
        if "<|" in chunk:
            parts = self.added_split.split(chunk)
            added = {name: at.to_bytes(4, "little") for name, at in self.added.items()}
            data = b"".join([added.get(part) or self.plain(part) for part in parts if part])
        else:
            data = self.plain(chunk)
        if len(chunk) <= CACHE_CHARS:
            self.known.put(chunk, data)
        return data

    def words(self, text: str) -> bytes:
        """Ids of text that ends with a word. White space only ends words, so the words between it
        are encoded one by one."""
        words = list(filter(None, _SPACES.split(text))) if _PYTHON_ONLY_SPACE.search(text) else text.split()
        get, chunk = self.known.young.get, self.chunk
        return b"".join([get(word) or chunk(word) for word in words])

    def blocks(self, text: str):
        """Ids of a text in pieces, as little-endian unsigned 32-bit integers. What is read ahead
        is a block and the word it ends in."""
        at, end = 0, BLOCK
        while end < len(text):
            space = _SPACES.search(text, end)
            if not space:
                break
            yield self.words(text[at : space.start()])
            at, end = space.end(), space.end() + BLOCK
        yield self.words(text[at:] if at else text)

    def encode(self, text: str) -> bytes:
        return b"".join(self.blocks(text))

    def decoder(self, words: bool = False) -> Decoder:
        return Decoder(self.raw if words else self.names, b"" if words else b" ")


class Decoder:
    """From ids to text, piece by piece. Every id stands for bytes: those of its name with a space
    before all but the first, as a tokenizer file without a decoder has it, or those it was made of,
    with a space at every word end. The state is the bytes of an unfinished character, and whether
    anything has come yet."""

    def __init__(self, parts: list[bytes], between: bytes):
        self.parts, self.between, self.before = parts, between, b""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes):
        """Text of more ids, little-endian unsigned 32-bit."""
        found = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(found), BLOCK):
            data = self.before + self.between.join(map(self.parts.__getitem__, found[at : at + BLOCK].tolist()))
            self.before = self.between
            yield self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker and file: tasks that follow each other find its cache filled."""
    return Transducer(path)


def encode(docs: DataFrame, path: str, id_type: str = "bigint") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, little-endian unsigned 32-bit."""

    def run(batches):
        coder = transducer(path)
        for batch in batches:
            ids = [coder.encode(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            )

    return narrow(docs, doc_id=id_type, text="string").mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, path: str, id_type: str = "bigint", words: bool = False) -> DataFrame:
    """``doc_id, text`` of token ids; ``words`` gives running text instead of token names."""

    def run(batches):
        coder = transducer(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder = coder.decoder(words)
                texts.append("".join([*decoder.feed(ids.as_py() or b""), decoder.finish()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                ["doc_id", "ids", "text"],
            )

    columns = f"doc_id {id_type}, ids binary, text string"
    return narrow(encoded, doc_id=id_type, ids="binary").mapInArrow(run, columns)


def digests_of(coder: Transducer, text: str) -> tuple[int, str, str]:
    """Number of tokens, and digests of the ids and of the text they decode to. Ids and text are
    hashed as they come, and never held as a whole."""
    count, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), coder.decoder()
    for ids in coder.blocks(text):
        count += len(ids) // 4
        ids_hash.update(ids)
        for part in decoder.feed(ids):
            text_hash.update(part.encode())
    text_hash.update(decoder.finish().encode())
    return count, ids_hash.hexdigest(), text_hash.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass; counts and digests of both results."""

    def run(batches):
        coder = transducer(path)
        for batch in batches:
            found = [digests_of(coder, text.as_py() or "") for text in batch.column("text")]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return narrow(docs, doc_id="bigint", text="string").mapInArrow(run, schema)

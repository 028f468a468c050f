"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose union is a piece, ordered by score and then by position;
the best pair is merged and its new neighbours join the agenda until none is left. The agenda of a word of up to 48
symbols is a list, of which the least entry is taken, which is faster; longer words keep it as a heap. Symbols outside the vocabulary
fall back to byte pieces. No piece of the vocabulary may cross the start of a word (checked when the model is
loaded), so a text is encoded word by word and equal words are encoded once per task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

SPACE = "▁"
#: Words held by a task's memo; it starts afresh when full.
MEMO = 400_000
NONE = float("inf")


class Vocabulary:
    """Pieces, scores and byte pieces of a merge-type model with identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        costs = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.cost = costs.get
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.surface = [self._surface(i) for i in ids]
        if any(sp.is_unused(i) for i in ids) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or sp.encode("ﬁ  a")[-1:] != sp.encode("a")[-1:]:
            raise ValueError("only merge vocabularies without unused or word-crossing pieces are supported")
        inside = set("".join(costs))
        lone = "".join(re.escape(c) for c in "\n\t\r\v\f" if c not in inside)
        self.words = re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _surface(self, i: int) -> bytes:
        sp = self.library
        if sp.is_control(i):
            return b""
        if sp.is_unknown(i):
            return " ⁇ ".encode()
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()

    def merge(self, word: str) -> list[str]:
        """Symbols of a word after all merges: the best pair is the first of lowest rank."""
        cost, symbols = self.cost, list(word)
        if len(symbols) > 48:
            return self._merge_long(symbols)
        agenda = [cost(word[i : i + 2], NONE) for i in range(len(symbols) - 1)]
        while agenda and (best := min(agenda)) < NONE:
            at = agenda.index(best)
            symbols[at] += symbols[at + 1]
            del symbols[at + 1], agenda[at]
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + symbols[at], NONE)
            if at < len(agenda):
                agenda[at] = cost(symbols[at] + symbols[at + 1], NONE)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        cost, n = self.cost, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (c := cost(both := symbols[a] + symbols[b], NONE)) < NONE:
                heapq.heappush(agenda, (c, a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if right[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            right[b] = -1
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(word):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str, memo) -> tuple[str, list[int]]:
        """(decimal ids joined by commas, ids); the empty text has none."""
        if not text:
            return "", []
        got = list(map(memo.__getitem__, self.words(SPACE + text.replace(" ", SPACE))))
        return ",".join([g[0] for g in got]), list(chain.from_iterable([g[1] for g in got]))

    def decode(self, ids: list[int]) -> str:
        """The pieces' text without the dummy prefix; bytes that are not UTF-8 become U+FFFD each."""
        out = b"".join(map(self.surface.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


class Memo(dict):
    """Word to (decimal ids, ids). ``fresh`` gathers new words until ``check`` has held them against the library."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.fresh = vocabulary, []

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        if len(self) >= MEMO:
            self.clear()
        ids = tuple(self.vocabulary.word_ids(word))
        got = ",".join(map(str, ids)), ids
        if len(word) <= 64:
            self[word] = got
        if word[0] == SPACE:
            self.fresh.append((word, ids))
            if len(self.fresh) > 50_000:
                self.check()
        return got

    def check(self) -> None:
        """Raise unless the library gives each new word the same ids."""
        words, self.fresh = self.fresh, []
        for (w, ids), own in zip(words, self.vocabulary.library.encode([w[1:] for w, _ in words], num_threads=1), strict=True):
            if own and list(ids) != own:
                raise ValueError(f"{w!r}: {ids}, the library has {own}")


@lru_cache(2)
def load(path: str) -> Memo:
    return Memo(Vocabulary(path))


def sentencepieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): every whole text encoded without begin or end ids, and decoded again.

    Null and empty texts have no ids and decode to the empty text. Rows repeat as they do in ``docs``; its other
    columns are not read. ``model`` is a path that every executor can read.
    """
    return _scan(docs, model, id_col, text_col, "ids array<int>, decoded string", lambda csv, ids, text: (ids, text))


def sentencepiece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``sentencepieces``, made in the same Arrow batches.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    """

    def digest(csv, ids, text):
        return len(ids), hashlib.sha256(csv.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _scan(docs, model, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _scan(docs, model, id_col, text_col, schema, row):
    kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        memo = load(model)
        v = memo.vocabulary
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = []
                for t in byte_texts(part.column(1)):
                    csv, ids = v.encode(t.decode("utf-8", "replace"), memo)
                    got.append(row(csv, ids, v.library.decode(ids) if ids else ""))
                memo.check()
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[i] for g in got], kinds[k]) for i, (_, k) in enumerate(fields))], ["id", *(n for n, _ in fields)])

    return rows.mapInArrow(scan, f"id long, {schema}").withColumnRenamed("id", id_col)

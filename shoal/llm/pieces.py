"""Encoding and decoding with a merge-type (BPE) piece model of the sentencepiece format.

Encoding does not replay merges over the text. A sequence of pieces is the encoding of its text exactly if each two neighbours are
compatible, that is if the encoding of their joined text is these two: the first merge across a border would happen in the two alone just
as well. So each prefix of a text has one last piece: of the pieces that end there (matches of an automaton over all pieces), the one that
is compatible with the last piece of the prefix before it. The table of last pieces is filled from left to right, and the ids are
recovered backwards from its end. Merges are replayed for the test of a pair only, which has two pieces' length; answers are kept.

A text is cut first where no piece can reach across: in front of a space that follows anything else (checked against the model), and
where characters of the largest group that pieces connect (letters, in the main) meet others. Such stretches repeat, so their ids and
decoded text are kept in a table of bounded size. Characters without a piece become their UTF-8 bytes. The model's mark for a space is
read as a space throughout.

Reads the model's own normaliser only so far: identity with a space in front, all spaces kept. Others are refused.

Nulls: a null text is encoded as an empty one, which has no ids. A null doc_id stays null, repeated rows give repeated rows, an empty
table gives an empty one. A very long text is encoded whole by the task that reads it, in time linear in its length. Other columns are
ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoal.llm.shared import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches and pair tests that are kept, and the longest stretch of which that is true.
KEPT_STRETCHES, KEPT_PAIRS, LONG = 200_000, 400_000, 64


class _Kept(dict):
    """Results of a function by its text, of the last KEPT_STRETCHES to twice as many different short texts."""

    def __init__(self, make: Callable[[str], tuple]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> tuple:
        found = self.older.get(text) or self.make(text)
        if len(text) <= LONG:
            if len(self) >= KEPT_STRETCHES:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def _largest_group(pairs: set[str]) -> set[str]:
    """Of the characters that pairs connect, the largest connected group; spaces connect nothing."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for a, b in pairs:
        if " " not in (a, b):
            root[find(a)] = find(b)
    groups: dict[str, set[str]] = {}
    for c in root:
        groups.setdefault(find(c), set()).add(c)
    return max(groups.values(), key=len, default=set())


class Pieces:
    """The encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" \ufb01  A ") != f"{SPACE}{SPACE}\ufb01{SPACE}{SPACE}A{SPACE}":
            raise ValueError("only models with the identity normaliser and a space in front are read")
        n = model.vocab_size()
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model lacks byte pieces")
        self.byte_ids, self.byte_of = byte_ids, {i: b for b, i in byte_ids.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        special = [model.is_control(i) or model.is_byte(i) or model.is_unknown(i) for i in range(n)]
        self.texts = ["" if special[i] else model.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.texts) if t}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        if any(" " in t.lstrip(" ") for t in self.ids):
            raise ValueError("a piece reaches across a space")
        self.beside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.single = {t for t in self.ids if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or self.merged(t) == [t]:  # a piece whose own text is encoded otherwise is in no encoding
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        group = "".join(map(re.escape, sorted(_largest_group(self.beside))))
        self.cut = re.compile(f" *[{group}]+| *[^{group} ]+| +")
        self.pairs: dict[int, bool] = {}
        self.kept = _Kept(self.stretch)

    def merged(self, text: str) -> list[str]:
        """Merges replayed: always the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[ab], k) for k in range(len(parts) - 1) if (ab := parts[k] + parts[k + 1]) in self.scores]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def text_of(self, piece: int) -> str:
        return self.texts[piece] if piece >= 0 else chr(-1 - piece)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two are the encoding of their joined text. A character without a piece is the negative number -1 - code point."""
        a, b = self.text_of(left), self.text_of(right)
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = a[-1] + b[0] not in self.beside or self.merged(a + b) == [a, b]
        return known

    def last_pieces(self, text: str) -> list[int | None]:
        """The prefix table: the last piece of each prefix, the empty one left out."""
        last: list[int | None] = [None] * len(text)
        if not self.single.issuperset(text):
            for k, c in enumerate(text):
                if c not in self.single:  # still a symbol that merges start from
                    last[k] = -1 - ord(c)
        pairs = self.pairs
        for end, (piece, n) in self.automaton.iter(text):
            if last[end] is None:
                if n > end:
                    last[end] = piece
                elif (before := last[end - n]) is not None and (known if (known := pairs.get(before << 32 | piece)) is not None else self.compatible(before, piece)):
                    last[end] = piece
        return last

    def split(self, text: str) -> list[int]:
        """The pieces of a text that is escaped already, from the end of its prefix table backwards."""
        last, out, end = self.last_pieces(text), [], len(text)
        while end:
            piece = last[end - 1]
            out.append(piece)
            end -= len(self.texts[piece]) if piece >= 0 else 1
        return out[::-1]

    def stretch_ids(self, text: str) -> list[int]:
        """Ids of one stretch."""
        found = self.split(text)
        if min(found) >= 0:
            return found
        return [i for piece in found for i in ((piece,) if piece >= 0 else [self.byte_ids[b] for b in chr(-1 - piece).encode()])]

    def stretch(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of one stretch."""
        ids = self.stretch_ids(text)
        back = self.join(ids)
        return ",".join(map(str, ids)), text if back == text else back

    def stretches_of(self, text: str) -> list[str]:
        """The text, a space put in front, cut where no piece reaches across."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches_of(text) for i in self.stretch_ids(s)]

    def join(self, ids: list[int]) -> str:
        """Text of ids, spaces unescaped, the one in front kept; each byte that is part of no UTF-8 character becomes U+FFFD, control ids
        nothing."""
        out = [self.texts[i] for i in ids]
        if "" not in out:
            return "".join(out)
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as bad:
                    out.append(held[: bad.start].decode() + "\ufffd")
                    del held[: bad.start + 1]
            if i >= 0:
                out.append(self.texts[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the space that encoding put in front."""
        first = next((k for k, i in enumerate(ids) if i not in self.control), 0)
        text = self.join(ids)
        return text[1:] if ids and self.texts[ids[first]].startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        found = list(map(self.kept.__getitem__, self.stretches_of(text)))
        ids, back = ",".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@functools.cache
def pieces(name: str = MODEL) -> Pieces:
    """The model of that name, loaded once a process."""
    return Pieces(public_tokenizers.path(name))


def encoded(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                ids = model.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([model.decode(ids)], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            found = [model.digest(text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
